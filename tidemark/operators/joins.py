"""Joins that aren't plain equalities, as equi-joins on time slots with the exact condition behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose times differ by at most ``width`` and whose keys are equal. The right side is sent to three slots of that width, nothing is broadcast."""
    slot = F.floor(F.col(left_at) / width)
    near = right.withColumn("slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(right_at) / width) + d)))
    return left.withColumn("slot", slot).join(near, ["slot", *keys]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("slot")


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], slack: int, slot: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals that overlap by more than 0 when each end is stretched by ``slack``; ``overlap`` has the unstretched seconds (may be negative within the slack).

    Both sides go to each slot they touch; a pair is kept in the slot where its overlap begins, so it appears once.
    """
    touch = lambda s, e: F.sequence(F.floor((F.col(s) - slack) / slot), F.floor(F.col(e) / slot))
    both = left.withColumn("slot", F.explode(touch(*a))).join(right.withColumn("slot", F.explode(touch(*b))), ["slot", *keys])
    overlap = F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))
    begins = F.greatest(F.floor((F.col(a[0]) - slack) / slot), F.floor((F.col(b[0]) - slack) / slot))
    return both.filter((F.col("slot") == begins) & (overlap + slack > 0)).withColumn("overlap", overlap).drop("slot")


def latest_per(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank_") <= n).drop("rank_")


def partners(edges: DataFrame) -> DataFrame:
    """(person_id, partner_id, events, roles): who shares events with whom. Events have few people, so the self-join stays in proportion."""
    other = edges.select("event_id", F.col("person_id").alias("partner_id"), F.col("role").alias("partner_role"))
    return edges.join(other, "event_id").filter("person_id <> partner_id").groupBy("person_id", "partner_id").agg(F.countDistinct("event_id").alias("events"), F.array_join(F.sort_array(F.collect_set("partner_role")), ",").alias("roles"))


def related(asked: DataFrame, events: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(event_id, related, source, kind, apart): of each event asked for, those of other sources that share a key, nearest in time first.

    keys has event_id, kind, place, most and v: a kind brings at most its ``most`` nearest events, and an event that several kinds
    bring counts for the one with the lowest place. ``asked`` is a short list, so it is broadcast; the other side is read once.
    """
    own = keys.join(F.broadcast(asked.select("event_id", F.col("ts").alias("at"), F.col("source").alias("own"))), "event_id").withColumnRenamed("event_id", "asked")
    other = keys.select(F.col("event_id").alias("related"), "kind", "v").join(F.broadcast(own), ["kind", "v"])
    met = other.join(events.withColumnRenamed("event_id", "related"), "related").filter("source <> own").withColumn("apart", F.abs(F.col("ts") - F.col("at"))).dropDuplicates(["asked", "related", "kind"])
    near = met.withColumn("r", F.row_number().over(Window.partitionBy("asked", "kind").orderBy("apart", "related"))).filter("r <= most")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("asked", "related").orderBy("place"))).filter("r = 1")
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("place", "apart", "related"))).filter(F.col("r") <= most)
    return best.select(F.col("asked").alias("event_id"), "related", "source", "kind", "apart")
