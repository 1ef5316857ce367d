"""Time clusters, greedy choices and fuzzy text clusters within bounded blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def anchored_clusters(df: DataFrame, keys: list[str], at: str, tie: str, width: int, name: str = "cluster") -> DataFrame:
    """df with the number of its anchored cluster: a new one begins when a row is more than ``width`` after the first of the current one.

    Rows are sorted by key across all partitions and stream through; a batch carries only the open cluster over, so a hot
    key needs no memory. A key lies in one partition.
    """
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, number = None, 0, 0
        for b in batches:
            out = []
            for k, t in zip(map(tuple, b[keys].itertuples(index=False)), b[at]):
                if k != key:
                    key, first, number = k, t, 0
                elif t - first > width:
                    first, number = t, number + 1
                out.append(number)
            yield b.assign(**{name: out})

    return df.repartition(*keys).sortWithinPartitions(*keys, at, tie).mapInPandas(run, f"{schema},{name}:int")


def bursts(events: DataFrame, width: int = 300, least: int = 3, sources: int = 2) -> DataFrame:
    """(bucket, event_id, ts, n_events, n_sources): events that open a window of ``width`` seconds with enough events and sources; the first of each bucket.

    Each second counts the events from itself to ``width`` later. Seconds, with the number of their events and their sources, go to the slot
    of their bucket and the one before, so a window has at most 2 * width rows, however many events there are.
    """
    each = events.groupBy("ts").agg(F.count("*").alias("n"), F.collect_set("source").alias("s"), F.min("event_id").alias("event_id"))
    slot = F.floor(F.col("ts") / width)
    pieces = each.withColumn("slot", F.explode(F.array(slot, slot - 1))).withColumn("own", F.floor(F.col("ts") / width) == F.col("slot"))
    ahead = Window.partitionBy("slot").orderBy("ts").rangeBetween(0, width)
    counted = pieces.withColumn("n_events", F.sum("n").over(ahead)).withColumn("n_sources", F.size(F.array_distinct(F.flatten(F.collect_list("s").over(ahead)))))
    hot = counted.filter(F.col("own") & (F.col("n_events") >= least) & (F.col("n_sources") >= sources))
    first = Window.partitionBy("slot").orderBy("ts")
    return hot.withColumn("r", F.row_number().over(first)).filter("r = 1").select(F.col("slot").alias("bucket"), "event_id", "ts", "n_events", F.col("n_sources").cast("long").alias("n_sources"))


#: Words that say nothing about a commitment.
STOP = frozenset("a an the at by for in of on to and or is are was were with from as this that vs via".split())


def content_words(s: str) -> set[str]:
    words = set(re.sub(r"[^\w\s]", "", s.lower()).split())
    return words - STOP or words


def alike(a: str, b: str, votes: int = 2) -> bool:
    """Whether enough of three tests hold: equal first 25 characters, Jaccard from 0.40, sequence ratio from 0.65."""
    x, y = content_words(a), content_words(b)
    n = (a.lower()[:25] == b.lower()[:25]) + (bool(x and y) and len(x & y) / len(x | y) >= 0.4)
    if n >= votes or n + 1 < votes:
        return n >= votes
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.65


def fuzzy_pairs(df: DataFrame, item: str, text: str, keys: list[str], votes: int = 2) -> DataFrame:
    """(a, b): pairs of items of one block that are alike. Only pairs that share a first 25 characters or a content word are looked at: with
    two votes needed, one of the first two tests must hold, so no pair is lost. The tests run in Arrow batches."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", "")), r"(?U)\s+"), lambda w: w != "")
    useful = F.array_except(words, F.array(*map(F.lit, sorted(STOP))))
    base = df.select(*keys, F.col(item).alias("i"), F.col(text).alias("t"))
    keyed = df.select(*keys, F.col(item).alias("i"), F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), F.substring(F.lower(text), 1, 25))), F.when(F.size(useful) > 0, useful).otherwise(words)))).alias("w"))
    pairs = keyed.withColumnRenamed("i", "a").join(keyed.withColumnRenamed("i", "b"), [*keys, "w"]).filter("a < b").select(*keys, "a", "b").distinct()
    full = pairs.join(base.withColumnsRenamed({"i": "a", "t": "ta"}), [*keys, "a"]).join(base.withColumnsRenamed({"i": "b", "t": "tb"}), [*keys, "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[alike(x, y, votes) for x, y in zip(p["ta"], p["tb"])], ["a", "b"]]

    kind = df.schema[item].dataType.simpleString()
    return full.select("a", "b", "ta", "tb").mapInPandas(run, f"a {kind}, b {kind}")


def greedy_distinct(df: DataFrame, keys: list[str], item: str, tokens: str, order: list, keep: int, overlap: float = 0.6) -> DataFrame:
    """Of each key's rows in order, the first ``keep`` whose token sets don't overlap an earlier kept one by more than ``overlap`` of the smaller.

    A running fold per key: it holds at most ``keep`` rows.
    """
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for b in batches:
            take = []
            for k, t in zip(map(tuple, b[keys].itertuples(index=False)), b[tokens]):
                if k != key:
                    key, kept = k, []
                s = set(t)
                good = len(kept) < keep and not any(s and o and len(s & o) / min(len(s), len(o)) > overlap for o in kept)
                if good:
                    kept.append(s)
                take.append(good)
            yield b[take]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order, item).mapInPandas(run, schema)
