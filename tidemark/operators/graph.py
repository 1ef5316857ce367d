"""Connected components of small and large link tables for the event model."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _scratch(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, which cuts its lineage."""
    path = _scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest node that links (a, b) reach from it. Labels spread to neighbours, then jump to the label of their label."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = settle(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(label.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        spread = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"), "component")
        spread = spread.toDF("node", "next", "component")
        jumped = spread.join(spread.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left")
        new = settle(jumped.select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "component"))
        if new.filter("next <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", F.col("next").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
