"""Claims, beliefs, scores and tasks (survey 2.5, 2.6, 2.11, 2.14-2.16, 2.18, 2.20-2.22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import confidence as conf
from tidemark.operators import clusters, graph, joins, tasks
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query


@query("SELECT claim_id, person_id, confidence FROM cl WHERE status = 'open' AND confidence >= 0.5 ORDER BY confidence DESC, claim_id LIMIT 100")
def active_claims(t: Tables) -> DataFrame:
    return t.claims.filter("status = 'open' and confidence >= 0.5").orderBy(F.desc("confidence"), "claim_id").limit(100).select("claim_id", "person_id", "confidence")


@query("SELECT claim_id, deadline, priority FROM cl, today WHERE status = 'open' AND deadline < day")
def overdue_commitments(t: Tables) -> DataFrame:
    return t.claims.filter("status = 'open'").join(F.broadcast(t.today)).filter("deadline < day").select("claim_id", "deadline", "priority")


@query("""SELECT claim_id, priority, count(DISTINCT ep.person_id) AS people FROM cl LEFT JOIN ce USING (claim_id) LEFT JOIN ep ON ep.event_id = ce.event_id AND ep.role <> 'self' WHERE status = 'open' GROUP BY claim_id, priority""")
def open_commitments(t: Tables) -> DataFrame:
    """Open commitments with how many others their source events involve."""
    people = t.claim_events.join(t.event_persons.filter("role <> 'self'").select("event_id", F.col("person_id").alias("p")), "event_id")
    return t.claims.filter("status = 'open'").join(people, "claim_id", "left").groupBy("claim_id", "priority").agg(F.countDistinct("p").alias("people"))


@query("SELECT claim_id, arg_max(event_id, ts * 1000000 + event_id) AS latest_event, arg_min(source, ts * 1000000 + event_id) AS first_source FROM ce JOIN ev USING (event_id) GROUP BY claim_id")
def commitment_sources(t: Tables) -> DataFrame:
    """The latest source event of each claim, and the channel it first came through."""
    order = F.col("ts") * 1000000 + F.col("event_id")
    return t.claim_events.join(t.events.select("event_id", "ts", "source"), "event_id").groupBy("claim_id").agg(F.max_by("event_id", order).alias("latest_event"), F.min_by("source", order).alias("first_source"))


@query("""SELECT CASE WHEN deadline < day THEN 'overdue' WHEN deadline <= strftime(CAST(day AS DATE) + 3, '%Y-%m-%d') THEN 'imminent' WHEN deadline <= strftime(CAST(day AS DATE) + 7, '%Y-%m-%d') OR priority <= 2 THEN 'this_week' ELSE 'later' END AS cell,
    priority, count(*) AS n, round(max(confidence), 6) AS best FROM cl, today WHERE status = 'open' GROUP BY ALL""")
def action_matrix(t: Tables) -> DataFrame:
    c = t.claims.filter("status = 'open'").join(F.broadcast(t.today))
    ahead = lambda n: F.date_add(F.to_date("day"), n).cast("string")
    cell = F.when(F.col("deadline") < F.col("day"), "overdue").when(F.col("deadline") <= ahead(3), "imminent").when((F.col("deadline") <= ahead(7)) | (F.col("priority") <= 2), "this_week").otherwise("later")
    return c.groupBy(cell.alias("cell"), "priority").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("best"))


@query("SELECT claim_id, deadline, 'stale:' || now AS superseded_by FROM cl, today WHERE status = 'open' AND deadline < strftime(CAST(day AS DATE) - 7, '%Y-%m-%d')")
def expired_commitments(t: Tables) -> DataFrame:
    """Open commitments a week past their deadline."""
    c = t.claims.filter("status = 'open'").join(F.broadcast(t.today))
    return c.filter(F.col("deadline") < F.date_sub(F.to_date("day"), 7).cast("string")).select("claim_id", "deadline", F.concat(F.lit("stale:"), F.col("now").cast("string")).alias("superseded_by"))


@query("""SELECT person_id, count(*) AS n, count(*) FILTER (status = 'open') AS open_n, min(priority) AS top_priority, round(least(0.99, best + 0.05 * coalesce(second, 0) + 0.05 * coalesce(third, 0)), 6) AS confidence FROM (
    SELECT *, nth_value(confidence, 1) OVER w AS best, nth_value(confidence, 2) OVER w AS second, nth_value(confidence, 3) OVER w AS third FROM cl
    WINDOW w AS (PARTITION BY person_id ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY person_id, best, second, third""")
def entity_beliefs(t: Tables) -> DataFrame:
    """One belief per person, as sure as its three best claims."""
    top = joins.latest_per(t.claims, ["person_id"], F.desc("confidence"), F.col("claim_id"), n=3).groupBy("person_id").agg(F.round(conf.aggregate(F.collect_list("confidence")), 6).alias("confidence"))
    return t.claims.groupBy("person_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open_n"), F.min("priority").alias("top_priority")).join(top, "person_id")


@query("""SELECT person_id, deadline, count(*) AS n, min(priority) AS priority, arg_max(claim_id, confidence * 1000000000 - claim_id) AS canonical, strftime(CAST(deadline AS DATE) + 14, '%Y-%m-%d') AS expires FROM cl GROUP BY person_id, deadline""")
def commitment_beliefs(t: Tables) -> DataFrame:
    """Commitments of one person and deadline as one belief; the surest is its face, the least priority its priority."""
    c = t.claims.groupBy("person_id", "deadline").agg(F.count("*").alias("n"), F.min("priority").alias("priority"), F.max_by("claim_id", F.col("confidence") * 1000000000 - F.col("claim_id")).alias("canonical"))
    return c.withColumn("expires", F.date_add(F.to_date("deadline"), 14).cast("string"))


@query()
def clustered_commitments(t: Tables) -> DataFrame:
    """Part names alike by two of three tests, within their brand, as clusters. The sequence ratio has no SQL; tests hold it against all pairs."""
    p = t.read("part").groupBy("p_brand", F.col("p_name").alias("what")).agg(F.min("p_partkey").alias("id"))
    pairs = clusters.fuzzy_pairs(p, "id", "what", ["p_brand"])
    return graph.components(p.select(F.col("id").alias("node")), pairs)


@query()
def ranked_candidates(t: Tables) -> DataFrame:
    """The best five orders a customer, without near repeats of their lines' parts; a greedy fold, so no SQL."""
    words = t.read("lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 40)).alias("tokens"))
    c = t.claims.join(words, "claim_id").withColumn("rank", F.round(-2 * (6 - F.col("priority")) - F.col("confidence"), 6))
    return clusters.greedy_distinct(c.select("person_id", "claim_id", "rank", "tokens"), ["person_id"], "claim_id", "tokens", ["rank"], 5).select("person_id", "claim_id", "rank")


_SCORE = """, s AS (SELECT event_id, source, CASE source
    WHEN 'mail' THEN 0.3 + CASE WHEN event_id % 5 = 0 THEN 0.4 ELSE 0 END + CASE WHEN event_id % 11 = 0 THEN 0.3 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 0.15 ELSE 0 END - CASE WHEN event_id % 2 = 0 THEN 0.15 ELSE 0 END - CASE WHEN event_id % 13 = 0 THEN 0.2 ELSE 0 END - CASE WHEN event_id % 17 = 0 THEN 0.3 ELSE 0 END
    WHEN 'imessage' THEN 0.3 - CASE WHEN event_id % 6 = 0 THEN 0.1 ELSE 0 END - CASE WHEN event_id % 10 = 0 THEN 0.15 ELSE 0 END
    WHEN 'whatsapp' THEN 0.3 - CASE WHEN is_group THEN 0.15 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0.1 ELSE 0 END
    WHEN 'calendar' THEN 0.3 + CASE WHEN event_id % 3 > 0 THEN 0.1 ELSE 0 END - CASE WHEN event_id % 19 = 0 THEN 0.3 ELSE 0 END
    ELSE 0.3 + CASE WHEN event_id % 4 = 0 THEN 0.1 ELSE 0 END END::DOUBLE AS base, is_from_me FROM ev),
r AS (SELECT event_id, source, round(greatest(least(greatest(base, 0), 1), CASE WHEN is_from_me THEN 0.3 ELSE 0 END::DOUBLE), 3) AS score FROM s)
SELECT event_id, source, score, CASE WHEN score < 0.1 THEN 'skip' WHEN score < 0.4 THEN 'low_priority' ELSE 'full_triage' END AS route FROM r"""


@query(_SCORE)
def event_scores(t: Tables) -> DataFrame:
    """Heuristic score and route of each event, from flags of its source."""
    flag = lambda m: F.col("event_id") % m == 0
    e = t.events.withColumns({"replied": flag(5), "flagged": flag(11), "urgent": flag(7), "automated": flag(2), "listed": flag(13), "junk": flag(17), "filtered": flag(6), "auto_reply": flag(10), "has_url": flag(5), "attended": F.col("event_id") % 3 > 0, "holiday": flag(19), "threaded": flag(4)})
    return tasks.score_events(e).select("event_id", "source", "score", conf.route(F.col("score")).alias("route"))


_BUCKET = """SELECT claim_id, deadline, CASE WHEN CAST(deadline AS DATE) - CAST(day AS DATE) <= 0 OR priority = 1 THEN 'immediate' WHEN CAST(deadline AS DATE) - CAST(day AS DATE) <= 7 OR priority = 2 THEN 'review' ELSE 'background' END AS bucket FROM cl, today WHERE status = 'open'"""


@query(_BUCKET)
def task_buckets(t: Tables) -> DataFrame:
    c = t.claims.filter("status = 'open'").join(F.broadcast(t.today))
    return c.select("claim_id", "deadline", tasks.bucket(F.col("deadline"), F.col("day"), F.col("priority")).alias("bucket"))


@query("""SELECT claim_id, strftime(CASE claim_id % 4 WHEN 0 THEN d + 1 WHEN 1 THEN d + 7 WHEN 2 THEN CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) + least(day(d), 28)::INT - 1 ELSE NULL END, '%Y-%m-%d') AS next_due FROM (SELECT claim_id, CAST(deadline AS DATE) AS d FROM cl) WHERE claim_id % 4 < 3""")
def recurring_tasks(t: Tables) -> DataFrame:
    rule = F.expr("case claim_id % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then 'monthly' end")
    return t.claims.filter("claim_id % 4 < 3").select("claim_id", tasks.next_due(F.to_date("deadline"), rule).cast("string").alias("next_due"))


@query("""SELECT claim_id, CASE WHEN d = t THEN 'today' WHEN d = t + 1 THEN 'tomorrow' WHEN date_trunc('week', d) = date_trunc('week', t) THEN 'this_week' WHEN date_trunc('week', d) = date_trunc('week', t) + INTERVAL 7 DAY THEN 'next_week' WHEN date_trunc('month', d) = date_trunc('month', t) THEN 'rest_of_month' ELSE 'later' END AS band
    FROM (SELECT claim_id, CAST(deadline AS DATE) AS d, CAST(day AS DATE) AS t FROM cl, today) WHERE d >= t""")
def agenda_bands(t: Tables) -> DataFrame:
    c = t.claims.join(F.broadcast(t.today)).select("claim_id", F.to_date("deadline").alias("d"), F.to_date("day").alias("t")).filter("d >= t")
    return c.select("claim_id", tasks.band(F.col("d"), F.col("t")).alias("band"))


@query("SELECT person_id, substr(sha256(string_agg(claim_id::VARCHAR, '|' ORDER BY claim_id::VARCHAR)), 1, 12) AS story, count(*) AS n, min(priority) AS priority FROM cl WHERE status = 'open' GROUP BY person_id")
def stories(t: Tables) -> DataFrame:
    """Open commitments gathered by person, with an id that only the members decide."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("claim_id").cast("string"))), "|")
    return t.claims.filter("status = 'open'").groupBy("person_id").agg(F.substring(F.sha2(ids, 256), 1, 12).alias("story"), F.count("*").alias("n"), F.min("priority").alias("priority"))


@query("SELECT status, priority, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY status, priority ORDER BY md5(claim_id::VARCHAR), claim_id) AS r FROM cl) WHERE r <= 20")
def stratified_sample(t: Tables) -> DataFrame:
    """Twenty claims of each stratum, in an order that a hash decides, so the sample can be drawn again."""
    return joins.latest_per(t.claims, ["status", "priority"], F.md5(F.col("claim_id").cast("string")), F.col("claim_id"), n=20).select("status", "priority", "claim_id")


@query("""SELECT person_id, claim_id, deadline FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY created_at DESC, claim_id DESC) AS r FROM cl) WHERE r = 1""")
def latest_claims(t: Tables) -> DataFrame:
    """Upsert by key: the newest version of each wins."""
    return joins.latest_per(t.claims, ["person_id"], F.desc("created_at"), F.desc("claim_id")).select("person_id", "claim_id", "deadline")


@query("SELECT person_id, count(DISTINCT c.claim_id) AS due, count(DISTINCT l.l_partkey) AS items FROM cl c JOIN lineitem l ON l.l_orderkey = c.claim_id WHERE status = 'open' GROUP BY person_id HAVING count(DISTINCT c.claim_id) >= 3")
def commitment_load(t: Tables) -> DataFrame:
    c = t.claims.filter("status = 'open'").join(t.read("lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_partkey"), "claim_id")
    return c.groupBy("person_id").agg(F.countDistinct("claim_id").alias("due"), F.countDistinct("l_partkey").alias("items")).filter("due >= 3")


@query("SELECT claim_id, person_id FROM cl WHERE person_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.claim_id = cl.claim_id)")
def claims_without_evidence(t: Tables) -> DataFrame:
    people = t.read("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("person_id"))
    return t.claims.join(people, "person_id", "left_semi").join(t.claim_events, "claim_id", "left_anti").select("claim_id", "person_id")


@query("""SELECT n_name, count(*) AS n, round(avg(confidence), 6) AS confidence FROM cl JOIN customer ON c_custkey = person_id JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def claims_by_place(t: Tables) -> DataFrame:
    c = t.claims.join(t.read("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("n_nationkey")), "person_id").join(t.read("nation").select("n_nationkey", "n_name"), "n_nationkey")
    return c.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("""SELECT deadline, running, n FROM (SELECT deadline, count(*) AS n, sum(count(*)) OVER (ORDER BY deadline)::BIGINT AS running FROM cl GROUP BY deadline)""")
def deadlines_over_time(t: Tables) -> DataFrame:
    """Deadlines a day, and so far. The running sum orders one row for each day, never the claims."""
    d = t.claims.groupBy("deadline").agg(F.count("*").alias("n"))
    return d.withColumn("running", F.sum("n").over(Window.orderBy("deadline").rowsBetween(Window.unboundedPreceding, 0)))
