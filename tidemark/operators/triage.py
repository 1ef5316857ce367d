"""Selection and routing of threads before and after a model has read them; the model's answers are input tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.graph import components

#: Parts of an address that mark automatic mail, and salutations of letters to anybody.
AUTOMATIC = ["noreply", "no-reply", "notifications", "alerts", "mailer-daemon", "donotreply", "automated", "marketing", "newsletter", "updates@", "info@", "support@", "hello@"]
SALUTATIONS = ["dear user", "dear customer", "dear sir", "dear madam", "dear sir/madam", "dear account holder", "dear valued", "dear member"]


def _contains(x: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(x.contains(p), F.lit(False)) for p in parts))


def age_bucket(ts: Column, now: Column) -> Column:
    days = (now - ts) / 86400
    return F.when(days <= 7, 1).when(days <= 30, 2).when(days <= 90, 3).when(days <= 365, 4).otherwise(5)


def automatic_sender(address: Column) -> Column:
    return _contains(F.lower(address), AUTOMATIC)


def generic_salutation(body: Column) -> Column:
    return _contains(F.lower(F.substring(body, 1, 200)), SALUTATIONS)


def floored(score: Column, event_type: Column, tier: Column, commitment: Column, sender: Column, n_messages: Column, body: Column) -> Column:
    """A model's score with the floors of meetings, appointments, the closest people and commitments; the last not for automatic or unknown mass mail."""
    by_kind = F.when(event_type == "meeting", F.greatest(score, F.lit(0.5))).when(event_type == "calendar_event", F.greatest(score, F.lit(0.3))).otherwise(score)
    by_tier = F.when(tier == 1, F.greatest(by_kind, F.lit(0.3))).otherwise(by_kind)
    spared = automatic_sender(sender) | ((n_messages <= 2) & generic_salutation(body))
    return F.round(F.when(commitment.isNotNull() & ~spared, F.greatest(by_tier, F.lit(0.7))).otherwise(by_tier), 1)


def strategies(events: DataFrame, cloud_all: bool = False) -> DataFrame:
    """(thread_id, n, strategy): where a thread is read, from events (thread_id, sensitivity, route); an unknown route counts as worth reading in full.

    Critical content and threads of low priority alone are read locally, one message at once or several.
    """
    low = F.coalesce(F.col("route") == "low_priority", F.lit(False))
    t = events.groupBy("thread_id").agg(F.count("*").alias("n"), F.max(F.coalesce("sensitivity", F.lit(2))).alias("worst"), F.bool_and(low).alias("low"))
    local = F.when(F.col("n") == 1, "msg_compact").otherwise("msg_batch_compact")
    return t.select("thread_id", "n", F.when(F.lit(cloud_all) | ((F.col("worst") < 3) & ~F.col("low")), "thread_full").otherwise(local).alias("strategy"))


def increments(threads: DataFrame, prior: DataFrame) -> DataFrame:
    """threads (thread_id) with ``how`` they are read again: fresh if never read, reactivated if it scored below 0.3 and passed no gate, else incremental. prior: thread_id, score, gated."""
    low = (F.col("score") < 0.3) & ~F.coalesce(F.col("gated"), F.lit(False))
    return threads.join(prior, "thread_id", "left").withColumn("how", F.when(F.col("score").isNull(), "fresh").when(low, "reactivated").otherwise("incremental"))


def tail(events: DataFrame, key: str, *order: Column, most: int = 500) -> DataFrame:
    """The last ``most`` rows of each key in an order that ends with an id."""
    back = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= most).drop("r")


def parsed(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """answers with score, reason and topics of a model's JSON: the outermost braces, score held to 0..1, other text around it ignored; unreadable or without score: null."""
    body = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "score double, reason string, topics array<string>")
    a = answers.withColumn("x", body)
    return a.select("*", F.when(F.col("x.score").isNotNull(), F.least(F.greatest(F.col("x.score"), F.lit(0.0)), F.lit(1.0))).alias("score"), F.col("x.reason").alias("reason"), F.col("x.topics").alias("topics")).drop("x")


def clean_topic(x: Column) -> Column:
    """Lower case, separators as single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"[\s_/-]+", " "))


def canonical_topics(topics: DataFrame, taxonomy: list[str], synonyms: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """topics (topic) with ``canonical``: itself if the taxonomy has it; else, cleaned, by the synonyms (raw, canonical), by the seeds, or as it is."""
    t = topics.withColumn("clean", clean_topic(F.col("topic"))).join(synonyms.select(F.col("raw").alias("clean"), F.col("canonical").alias("known")), "clean", "left")
    seed = F.create_map(*(F.lit(x) for kv in seeds.items() for x in kv))[F.col("clean")] if seeds else F.lit(None).cast("string")
    return t.withColumn("canonical", F.when(F.col("topic").isin(taxonomy), F.col("topic")).otherwise(F.coalesce("known", seed, "clean"))).drop("clean", "known")


def topic_batches(topics: DataFrame, most: int = 70) -> DataFrame:
    """(component, topic, n, batch): topics (topic, n) that share a word belong together; each component in batches of at most ``most``, the commonest first."""
    words = topics.select("topic", F.explode(F.array_distinct(F.split(F.lower("topic"), " +"))).alias("w"))
    hubs = words.groupBy("w").agg(F.min("topic").alias("hub"))
    links = words.join(hubs, "w").filter("topic <> hub").select(F.col("topic").alias("a"), F.col("hub").alias("b"))
    found = components(topics.select(F.col("topic").alias("node")), links)
    t = topics.join(found, F.col("topic") == F.col("node"))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "topic")) - 1
    return t.select("component", "topic", "n", F.floor(place / most).alias("batch"))
