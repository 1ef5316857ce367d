"""Connected components of a link table, fully distributed.

Alternating large-star and small-star steps rewrite the links until every component is one star
around its smallest node. A step is a grouped minimum (combined before the shuffle) and an equi-join
that adaptive execution may split on a hot node; no neighbour list is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    return turned.select("x.a", "x.b")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest one."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    handed = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(links: DataFrame) -> bool:
    """Whether every node either points to one centre or is pointed to."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out")))).alias("x"))
    by_node = ends.groupBy("x.n").agg(F.sum("x.out").alias("outs"), F.min("x.out").alias("least"))
    return by_node.filter("outs > 1 or (outs > 0 and least = 0)").isEmpty()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reachable.

    Null ends and links of a node to itself are ignored; repeated links count once. No links: no rows.
    Raises if max_rounds are not enough, which takes a path of more than 2**(max_rounds / 2) nodes.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(f"`{a}` is not null and `{b}` is not null").filter("a <> b").distinct()
    now, path = workspace.cut(pairs, "links")
    for _ in range(max_rounds):
        if _is_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        larger, mid = workspace.cut(_large_star(now), "links")
        workspace.drop(spark, path)
        now, path = workspace.cut(_small_star(larger), "links")
        workspace.drop(spark, mid)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
