"""Mutable tables on immutable files: each write makes a new version, and a pointer names the current one.

Upsert, insert-if-absent, update, delete and append are joins against the current version. The pointer is replaced by a rename in
the store that holds the tables, so readers see the old or the new version, whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class SnapshotTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        self._paths = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._paths(self.folder).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> str | None:
        """The current version's name."""
        fs = self._fs()
        if not fs.exists(self._paths(f"{self.folder}/pointers")):
            return None
        found = [s.getPath().getName() for s in fs.listStatus(self._paths(f"{self.folder}/pointers"))]
        return max((n for n in found if not n.startswith((".", "_"))), default=None)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{v}")

    def replace(self, df: DataFrame) -> None:
        """Make df the next version. Pointers are empty files whose names ascend, so the switch is one creation."""
        now = self.version()
        name = f"{int(now.split('-')[0]) + 1 if now else 1:012d}-{uuid.uuid4().hex[:8]}"
        df.select([F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.folder}/data/{name}")
        self._fs().create(self._paths(f"{self.folder}/pointers/{name}"), False).close()

    def _one(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        if not order:
            return rows.dropDuplicates(self.keys)
        w = Window.partitionBy(*self.keys).orderBy(*order)
        return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")

    def insert_new(self, rows: DataFrame, *order: Column) -> int:
        """Add the rows whose key isn't there, one for each key; returns how many."""
        old = self.read()
        new = self._one(rows, list(order)).join(old.select(self.keys), self.keys, "left_anti").select(old.columns)
        before = old.count()
        self.replace(old.unionByName(new))
        return self.read().count() - before

    def upsert(self, rows: DataFrame, *order: Column, keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), add: tuple[str, ...] = (), most: tuple[str, ...] = (), prior: dict[str, str] | None = None) -> None:
        """Insert or overwrite by key. Of existing rows, ``keep`` columns stay, ``fill`` ones change only to values that aren't blank, ``add`` ones are summed, ``most`` ones take the maximum, and ``prior`` maps a column to the one whose old value it gets."""
        old, new = self.read(), self._one(rows, list(order))
        both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), self.keys, "full")
        out = []
        for c in old.columns:
            o, n, was, has = F.col(f"o.{c}") if c not in self.keys else F.col(c), F.col(f"n.{c}") if c in new.columns and c not in self.keys else F.lit(None), F.col("__old"), F.col("__new")
            if c in self.keys:
                out.append(F.col(c))
            elif prior and c in prior:
                out.append(F.when(was & has, F.col(f"o.{prior[c]}")).when(was, o).otherwise(F.lit(None)).alias(c))
            elif c in keep:
                out.append(F.when(was, o).otherwise(n).alias(c))
            elif c in fill:
                out.append(F.when(has & n.isNotNull() & (n.cast("string") != ""), n).otherwise(F.when(was, o).otherwise(n)).alias(c))
            elif c in add:
                out.append((F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0))).alias(c))
            elif c in most:
                out.append(F.greatest(o, n).alias(c))
            else:
                out.append(F.when(has, n).otherwise(o).alias(c))
        self.replace(both.select(out))

    def update(self, where: Column, **values) -> None:
        old = self.read()
        self.replace(old.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, where: Column) -> None:
        self.replace(self.read().filter(~F.coalesce(where, F.lit(False))))

    def append(self, rows: DataFrame) -> None:
        old = self.read()
        self.replace(old.unionByName(rows.select(old.columns)))

    def keep_newest(self, n: int, *order: Column) -> None:
        """Drop all but the first n rows in order, as for an undo log of bounded length."""
        self.replace(self.read().orderBy(*order).limit(n))

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        fs = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._paths(f"{self.folder}/pointers")))
        for name in names[:-keep]:
            fs.delete(self._paths(f"{self.folder}/pointers/{name}"), True)
            fs.delete(self._paths(f"{self.folder}/data/{name}"), True)


def merge_person(edges: DataFrame, winner, loser) -> DataFrame:
    """Edges (event_id, person_id, role) with the loser's re-pointed to the winner; those it already has are dropped."""
    return edges.withColumn("person_id", F.when(F.col("person_id") == loser, winner).otherwise(F.col("person_id"))).distinct()


def rename_topics(annotations: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Annotations (event_id, facet, value) with topic values put through (raw, canonical), each once."""
    named = annotations.join(synonyms.withColumnRenamed("raw", "value"), "value", "left")
    return named.select("event_id", "facet", F.when(F.col("facet") == "topic", F.coalesce("canonical", "value")).otherwise(F.col("value")).alias("value")).distinct()
