"""Data-quality checks and evaluation (survey 2.23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

DAY = 86400


@query("SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY ROLLUP (source)")
def event_counts(t: Tables) -> DataFrame:
    c = t.events.rollup("source").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return c.withColumn("source", F.coalesce("source", F.lit("TOTAL")))


@query("""SELECT source, day FROM (SELECT DISTINCT source || '/' || thread_id AS source FROM ev), (SELECT CAST(unnest(range(now // 86400 - 13, now // 86400 + 1)) AS BIGINT) AS day FROM clock)
    EXCEPT SELECT source || '/' || thread_id, ts // 86400 FROM ev""")
def coverage_gaps(t: Tables) -> DataFrame:
    """Days of the last two weeks without an event of a source and thread."""
    key = F.concat_ws("/", "source", "thread_id")
    days = t.now.select(F.explode(F.sequence(F.floor(F.col("now") / DAY) - 13, F.floor(F.col("now") / DAY))).alias("day"))
    expected = t.events.select(key.alias("source")).distinct().join(F.broadcast(days))
    return expected.join(t.events.select(key.alias("source"), F.floor(F.col("ts") / DAY).alias("day")), ["source", "day"], "left_anti")


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, count(*) - 1 AS excess, count(DISTINCT source) > 1 AS cross_source FROM documents WHERE length(text) >= 20 GROUP BY content_hash HAVING count(*) > 1")
def duplicate_contents(t: Tables) -> DataFrame:
    d = t.read("documents").filter(F.length("text") >= 20).groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    return d.agg(F.count("*").alias("n"), (F.count("*") - 1).alias("excess"), (F.countDistinct("source") > 1).alias("cross_source")).filter("n > 1")


@query("SELECT source, round(100 * count(thread_id) / count(*)::DOUBLE, 1) AS thread_fill, round(100 * count(amount) / count(*)::DOUBLE, 1) AS amount_fill, round(100 * count(*) FILTER (is_from_me) / count(*)::DOUBLE, 1) AS mine FROM ev GROUP BY source")
def schema_coverage(t: Tables) -> DataFrame:
    fill = lambda c: F.round(100 * F.count(c) / F.count("*"), 1)
    return t.events.groupBy("source").agg(fill("thread_id").alias("thread_fill"), fill("amount").alias("amount_fill"), F.round(100 * F.count_if("is_from_me") / F.count("*"), 1).alias("mine"))


@query("SELECT source, count(*) FILTER (length(text) = 0) AS empty_n, count(*) FILTER (length(text) < 50) AS tiny, count(*) FILTER (length(text) > 5000) AS huge, count(*) FILTER (regexp_matches(substr(text, 1, 2000), '<[a-z]+')) AS html, count(*) FILTER (regexp_matches(substr(text, 1, 2000), '=[0-9A-F]{2}')) AS quoted FROM documents GROUP BY source")
def encoding_issues(t: Tables) -> DataFrame:
    n, head = F.length("text"), F.substring("text", 1, 2000)
    return t.read("documents").groupBy("source").agg(F.count_if(n == 0).alias("empty_n"), F.count_if(n < 50).alias("tiny"), F.count_if(n > 5000).alias("huge"), F.count_if(head.rlike("<[a-z]+")).alias("html"), F.count_if(head.rlike("=[0-9A-F]{2}")).alias("quoted"))


@query("SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share FROM labels GROUP BY quality, toxic")
def judgment_stats(t: Tables) -> DataFrame:
    c = t.read("labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).select("quality", "toxic", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


@query("SELECT CAST(least(floor(confidence * 5), 4) AS INT) AS bucket, status, count(*) AS n FROM cl GROUP BY ALL")
def confidence_distribution(t: Tables) -> DataFrame:
    return t.claims.groupBy(F.least(F.floor(F.col("confidence") * 5), F.lit(4)).cast("int").alias("bucket"), "status").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS unanimous, count(*) AS reviewers FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def reviewer_agreement(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_returnflag") == 1).alias("unanimous"), F.count("*").alias("reviewers")).filter("reviewers > 1")


@query("SELECT topics, count(*) AS n FROM (SELECT person_id, string_agg(DISTINCT source, ',' ORDER BY source) AS topics FROM ev GROUP BY person_id, ts // 86400) WHERE topics LIKE '%,%' GROUP BY topics HAVING count(*) >= 20")
def batch_artifacts(t: Tables) -> DataFrame:
    """Combinations of at least two topics that occur suspiciously often."""
    sets = t.events.groupBy("person_id", F.floor(F.col("ts") / DAY)).agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") >= 2)
    return sets.groupBy(F.array_join("s", ",").alias("topics")).agg(F.count("*").alias("n")).filter("n >= 20")


@query("SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM cl) AS claims, (SELECT count(*) FROM ce) AS claim_events, (SELECT count(DISTINCT person_id) FROM ev) AS persons, (SELECT count(*) FROM cl WHERE status = 'open') AS open_claims")
def pipeline_summary(t: Tables) -> DataFrame:
    parts = [t.events.agg(F.count("*").alias("events"), F.countDistinct("person_id").alias("persons")), t.claims.agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "open").alias("open_claims")), t.claim_events.agg(F.count("*").alias("claim_events"))]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))


@query("SELECT source, person_id, gap FROM (SELECT source, person_id, ts - lag(ts) OVER (PARTITION BY source, person_id ORDER BY ts, event_id) AS gap FROM ev) WHERE gap > 7 * 86400")
def long_silences(t: Tables) -> DataFrame:
    w = Window.partitionBy("source", "person_id").orderBy("ts", "event_id")
    return t.events.select("source", "person_id", (F.col("ts") - F.lag("ts").over(w)).alias("gap")).filter(f"gap > 7 * {DAY}")
