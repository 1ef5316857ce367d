"""Score propagation over messages, senders and threads: a few rounds of five rules, each a pass of windows and conditionals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import settle

#: Fixed values of the rules.
DEEP, LEAST_MESSAGES, ROUNDS, SETTLED = 0.7, 5, 3, 0.01


def _joined(items: DataFrame, key: str, *stats: Column) -> DataFrame:
    """items with statistics of their key, combined before the shuffle; rows without key get nulls."""
    return items.join(items.filter(F.col(key).isNotNull()).groupBy(key).agg(*stats), key, "left")


def sender_reputation(items: DataFrame) -> DataFrame:
    """Outliers of a sender outside the inner tiers, with five messages or more, come down to near the median."""
    x = _joined(items, "sender", F.median("score").alias("med"), F.count("*").alias("n"))
    cap = F.greatest(F.col("med") + 0.2, F.lit(0.3))
    down = (F.col("n") >= LEAST_MESSAGES) & (F.col("tier") > 2) & ~F.col("sender_is_user") & (F.col("score") > F.col("med") + 0.4) & (cap < F.col("score"))
    return x.withColumn("score", F.when(down, cap).otherwise(F.col("score"))).drop("med", "n")


def thread_coherence(items: DataFrame) -> DataFrame:
    """Low outliers of an active thread go up, the top of a quiet one comes down unless the user wrote it; statistics are those before the rule."""
    s = F.col("score")
    x = _joined(items, "thread_id", F.avg("score").alias("mean"), F.max("score").alias("top"), F.count("*").alias("n"), F.count_if(s >= DEEP).alias("deep"))
    up = (F.col("n") >= 2) & (s < F.col("mean") - 0.2) & (F.col("mean") >= 0.3)
    strong = F.least(s + 0.4, F.col("top") - 0.1, F.lit(DEEP))
    new = F.when(up & (F.col("deep") >= 2) & (s < DEEP), strong).when(up, F.least(s + 0.2, F.col("mean"))).otherwise(s)
    down = (F.col("n") >= 2) & (s > F.col("mean") + 0.4) & (s >= F.col("top")) & ~F.col("sender_is_user")
    new = F.when(down, F.greatest(s - 0.2, F.col("mean") + 0.1)).otherwise(new)
    clamped = F.when(new == s, s).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), new)))
    return x.withColumn("score", clamped).drop("mean", "top", "n", "deep")


def contact_boost(items: DataFrame, now: int) -> DataFrame:
    s = F.col("score")
    hit = (F.col("tier") == 1) & s.between(0.3, 0.4) & (F.col("ts") > now - 30 * 86400)
    return items.withColumn("score", F.when(hit, F.least(s + 0.1, F.lit(0.5))).otherwise(s))


def recipient_dampening(items: DataFrame) -> DataFrame:
    s = F.col("score")
    mass = ((F.col("n_cc") > 0) & (F.col("event_type") == "email")) | (F.col("recipients") >= 5)
    return items.withColumn("score", F.when((s >= 0.5) & (F.col("tier") > 2) & mass, F.greatest(s - 0.2, F.lit(0.3))).otherwise(s))


def source_prior(items: DataFrame) -> DataFrame:
    s = F.col("score")
    x = _joined(items, "thread_id", F.max(F.col("sender_is_user") & (F.col("event_type") == "message")).alias("mine"))
    floor = F.when((F.col("event_type") == "message") & F.coalesce("mine", F.lit(False)), 0.3).when(F.col("event_type") == "meeting", 0.5).otherwise(0.0)
    return x.withColumn("score", F.greatest(s, floor)).drop("mine")


def propagate(items: DataFrame, now: int) -> tuple[DataFrame, int]:
    """items (event_id, score, event_type, thread_id, sender, sender_is_user, tier, n_cc, recipients, ts) with their settled
    scores in ``score`` and the first ones in ``before``; and the number of rounds run. Stops when under one in a hundred changes."""
    total = items.count()
    items = settle(items.withColumn("before", F.col("score")))
    for done in range(1, ROUNDS + 1):
        new = items.withColumn("prior", F.col("score"))
        for rule in (sender_reputation, thread_coherence, lambda x: contact_boost(x, now), recipient_dampening, source_prior):
            new = rule(new)
        new = settle(new)
        changed, items = new.filter("score <> prior").count(), new.drop("prior")
        if not total or changed / total < SETTLED:
            break
    return items, done
