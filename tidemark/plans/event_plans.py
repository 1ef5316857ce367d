"""Reads, joins and aggregates over events and people (survey 2.1-2.4, 2.10, 2.12, 2.16-2.19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import confidence as conf
from tidemark.functions import text as tx
from tidemark.operators import clusters, joins
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

DAY = 86400


@query("SELECT id, source, ts, person_id FROM ev, clock WHERE ts >= now - 10 * 86400 AND ts <= now AND source = 'mail' ORDER BY ts DESC, id LIMIT 1000")
def events_filtered(t: Tables) -> DataFrame:
    e = t.events.filter("source = 'mail'").join(F.broadcast(t.now))
    return e.filter(f"ts >= now - 10 * {DAY} and ts <= now").orderBy(F.desc("ts"), "id").limit(1000).select("id", "source", "ts", "person_id")


@query("SELECT source, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY ALL")
def events_by_source(t: Tables) -> DataFrame:
    return t.events.groupBy("source", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT thread_id, id, ts, source FROM ev WHERE thread_id IN ('7', '42') AND source = 'imessage'")
def thread_events(t: Tables) -> DataFrame:
    return t.events.filter(F.col("thread_id").isin("7", "42") & (F.col("source") == "imessage")).select("thread_id", "id", "ts", "source")


@query("SELECT doc_id, source, substr(text, 1, 200) AS preview FROM documents WHERE text ILIKE '%license%' AND source IN ('src1', 'src2', 'src3') ORDER BY doc_id DESC LIMIT 50")
def content_search(t: Tables) -> DataFrame:
    d = t.read("documents").filter(F.col("source").isin("src1", "src2", "src3") & F.col("text").ilike("%license%"))
    return d.orderBy(F.desc("doc_id")).limit(50).select("doc_id", "source", F.substring("text", 1, 200).alias("preview"))


@query("SELECT claim_id, event_id, id, ts FROM ce JOIN ev USING (event_id)")
def events_for_claim(t: Tables) -> DataFrame:
    return t.claim_events.join(t.events, "event_id").select("claim_id", "event_id", "id", "ts")


@query("SELECT event_id, claim_id, confidence FROM ce JOIN cl USING (claim_id)")
def claims_for_event(t: Tables) -> DataFrame:
    return t.claim_events.join(t.claims.select("claim_id", "confidence"), "claim_id").select("event_id", "claim_id", "confidence")


@query("SELECT a.person_id, b.person_id AS partner_id, count(DISTINCT a.event_id) AS events, string_agg(DISTINCT b.role, ',' ORDER BY b.role) AS roles FROM ep a JOIN ep b ON a.event_id = b.event_id AND a.person_id <> b.person_id GROUP BY ALL")
def communication_partners(t: Tables) -> DataFrame:
    return joins.partners(t.event_persons)


@query("SELECT event_id, ts FROM ev WHERE event_id NOT IN (SELECT event_id FROM ce) AND amount >= 20")
def untriaged_events(t: Tables) -> DataFrame:
    return t.events.filter("amount >= 20").join(t.claim_events, "event_id", "left_anti").select("event_id", "ts")


_CALLS = """, call AS (SELECT event_id AS call_id, person_id, ts AS c0, ts + 60 + CAST(floor(amount) AS BIGINT) AS c1 FROM ev WHERE source = 'whatsapp' AND floor(amount) + 60 >= 10),
meet AS (SELECT event_id AS meet_id, person_id, ts AS m0, ts + 1800 AS m1 FROM ev WHERE source = 'calendar')
SELECT meet_id, call_id, m.person_id, least(c1, m1) - greatest(c0, m0) AS overlap_s, CASE WHEN least(c1, m1) - greatest(c0, m0) >= 0.9 * (m1 - m0) THEN 0.85 WHEN least(c1, m1) - greatest(c0, m0) >= 0.5 * (m1 - m0) THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
FROM meet m JOIN call c ON m.person_id = c.person_id AND least(c1, m1) - greatest(c0, m0) + 600 > 0"""


@query(_CALLS)
def meeting_call_overlap(t: Tables) -> DataFrame:
    """Calls that overlap a person's meetings, with ten minutes' tolerance."""
    e = t.events
    call = e.filter("source = 'whatsapp' and floor(amount) + 60 >= 10").select(F.col("event_id").alias("call_id"), "person_id", F.col("ts").alias("c0"), F.expr("ts + 60 + floor(amount)").alias("c1"))
    meet = e.filter("source = 'calendar'").select(F.col("event_id").alias("meet_id"), "person_id", F.col("ts").alias("m0"), F.expr("ts + 1800").alias("m1"))
    both = joins.overlap_join(meet, call, ("m0", "m1"), ("c0", "c1"), 600, 3600, ("person_id",))
    share = F.expr("case when overlap >= 0.9 * (m1 - m0) then 0.85D when overlap >= 0.5 * (m1 - m0) then 0.7D else 0.5D end")
    return both.select("meet_id", "call_id", "person_id", F.col("overlap").alias("overlap_s"), share.alias("confidence"))


@query("SELECT a.event_id AS meeting, b.event_id AS other, b.source, b.ts - a.ts AS apart FROM ev a JOIN ev b ON a.source = 'calendar' AND b.source <> 'calendar' AND a.person_id = b.person_id AND abs(a.ts - b.ts) <= 1800")
def calendar_corroboration(t: Tables) -> DataFrame:
    """Other events within half an hour of a meeting that mention the same person."""
    a = t.events.filter("source = 'calendar'").select(F.col("event_id").alias("meeting"), "person_id", F.col("ts").alias("t0"))
    b = t.events.filter("source <> 'calendar'").select(F.col("event_id").alias("other"), "source", "person_id", F.col("ts").alias("t1"))
    return joins.band_join(a, b, "t0", "t1", 1800, ("person_id",)).select("meeting", "other", "source", F.expr("t1 - t0").alias("apart"))


@query(""", asked AS (SELECT * FROM ev WHERE source = 'mail' ORDER BY ts DESC, event_id DESC LIMIT 20),
k AS (SELECT event_id, 'dollar' AS kind, 1 AS place, 10 AS most, printf('%.2f', amount) AS v FROM ev WHERE amount > 20 UNION ALL SELECT event_id, 'name', 2, 3, value FROM an WHERE facet = 'person_mention' UNION ALL SELECT event_id, 'person', 3, 3, person_id::VARCHAR FROM ev),
m AS (SELECT DISTINCT a.event_id, o.event_id AS related, o.source, x.kind, x.place, x.most, abs(a.ts - o.ts) AS apart FROM asked a JOIN k x ON x.event_id = a.event_id JOIN k y ON y.kind = x.kind AND y.v = x.v JOIN ev o ON o.event_id = y.event_id AND o.source <> a.source),
c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY apart, related) <= most),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_id, related ORDER BY place) = 1)
SELECT event_id, related, source, kind, apart FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place, apart, related) <= 10""")
def related_events(t: Tables) -> DataFrame:
    """Of the twenty newest mails, events of other sources with the same amount (ten), then name (three), then person (three); ten in all."""
    asked = t.events.filter("source = 'mail'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "source")
    key = lambda df, kind, place, most, v: df.select("event_id", F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.lit(most).alias("most"), v.alias("v"))
    keys = key(t.events.filter("amount > 20"), "dollar", 1, 10, F.format_string("%.2f", "amount")).unionByName(key(t.store("an").filter("facet = 'person_mention'"), "name", 2, 3, F.col("value"))).unionByName(key(t.events, "person", 3, 3, F.col("person_id").cast("string")))
    return joins.related(asked, t.events.select("event_id", "ts", "source"), keys, 10)


@query("""SELECT person_id, n, group_count, n - group_count AS direct_count, round(least(0.95, 0.3 + 0.7 * (1 - exp(-n / 20.0::DOUBLE))), 4) AS confidence FROM (
    SELECT person_id, count(DISTINCT event_id) AS n, count(DISTINCT CASE WHEN is_group THEN event_id END) AS group_count FROM ev GROUP BY person_id)""")
def communication_frequency(t: Tables) -> DataFrame:
    """How often the user interacts with each person, and how sure that is."""
    c = t.events.groupBy("person_id").agg(F.countDistinct("event_id").alias("n"), F.countDistinct(F.when(F.col("is_group"), F.col("event_id"))).alias("group_count"))
    return c.select("person_id", "n", "group_count", (F.col("n") - F.col("group_count")).alias("direct_count"), conf.confidence(F.col("n"), 20.0).alias("confidence"))


@query("SELECT person_id, string_agg(DISTINCT source, ',' ORDER BY source) AS channels, count(DISTINCT source) AS n, round(least(0.95, 0.3 + 0.7 * (1 - exp(-count(DISTINCT source) / 3.0::DOUBLE))), 4) AS confidence FROM ev GROUP BY person_id")
def communication_channels(t: Tables) -> DataFrame:
    c = t.events.groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("channels"), F.countDistinct("source").alias("n"))
    return c.withColumn("confidence", conf.confidence(F.col("n"), 3.0))


@query("SELECT person_id, user_sent, they_sent, round(user_sent::DOUBLE / (user_sent + they_sent), 2) AS ratio FROM (SELECT person_id, count(*) FILTER (is_from_me) AS user_sent, count(*) FILTER (NOT is_from_me) AS they_sent FROM ev GROUP BY person_id) WHERE user_sent + they_sent > 0")
def directionality(t: Tables) -> DataFrame:
    c = t.events.groupBy("person_id").agg(F.count_if("is_from_me").alias("user_sent"), F.count_if(~F.col("is_from_me")).alias("they_sent"))
    return c.filter("user_sent + they_sent > 0").withColumn("ratio", F.round(F.col("user_sent") / (F.col("user_sent") + F.col("they_sent")), 2))


_TIMING = """, g AS (SELECT person_id, CAST((ts // 3600) % 24 AS INT) AS hour, count(*) AS c FROM ev GROUP BY 1, 2), h AS (SELECT *, sum(c) OVER (PARTITION BY person_id) AS total FROM g)
SELECT person_id, string_agg(hour, ',' ORDER BY c DESC, hour) FILTER (r <= 3) AS top_hours, max(total)::BIGINT AS n, round(sum(c) FILTER (hour BETWEEN 9 AND 17) / max(total)::DOUBLE, 2) AS business_ratio
FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY c DESC, hour) AS r FROM h WHERE total >= 3) GROUP BY person_id HAVING count(*) FILTER (hour BETWEEN 9 AND 17) > 0"""


@query(_TIMING)
def timing_patterns(t: Tables) -> DataFrame:
    hours = t.events.groupBy("person_id", (F.floor(F.col("ts") / 3600) % 24).cast("int").alias("hour")).agg(F.count("*").alias("c"))
    per = hours.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "hour"))).alias("h"), F.sum("c").alias("n"), F.sum(F.when(F.col("hour").between(9, 17), F.col("c"))).alias("b"))
    return per.filter("n >= 3 and b is not null").select("person_id", F.array_join(F.transform(F.slice("h", 1, 3), lambda x: x["hour"].cast("string")), ",").alias("top_hours"), "n", F.round(F.col("b") / F.col("n"), 2).alias("business_ratio"))


@query("""SELECT person_id, first_ts, last_ts, days_since, round(least(0.95, 0.3 + 0.7 * (1 - exp(-n / 20.0::DOUBLE))) * pow(2.0::DOUBLE, -(days_since / 30.0::DOUBLE)), 4) AS confidence FROM (
    SELECT person_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST((max(now) - max(ts)) // 86400 AS BIGINT) AS days_since, count(*) AS n FROM ev, clock WHERE ts <= now GROUP BY person_id)""")
def recency(t: Tables) -> DataFrame:
    c = t.events.join(F.broadcast(t.now)).filter("ts <= now").groupBy("person_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.floor((F.max("now") - F.max("ts")) / DAY).alias("days_since"), F.count("*").alias("n"))
    return c.withColumn("confidence", conf.confidence(F.col("n"), 20.0, age_days=F.col("days_since") / 1.0)).drop("n")


@query("SELECT thread_id, count(*) AS n, count(DISTINCT person_id) AS people, min(ts) AS first_ts, max(ts) AS last_ts FROM ev JOIN (SELECT event_id FROM ep) USING (event_id) WHERE source = 'mail' GROUP BY thread_id HAVING count(*) >= 2")
def thread_activity(t: Tables) -> DataFrame:
    """Mail threads with at least two joined rows; the count includes every participant, as users expect of it."""
    j = t.events.filter("source = 'mail'").join(t.event_persons.select("event_id"), "event_id")
    return j.groupBy("thread_id").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("people"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).filter("n >= 2")


@query("SELECT person_id, thread_id AS topic, count(DISTINCT event_id) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, round(least(0.95, 0.3 + 0.7 * (1 - exp(-count(DISTINCT event_id) / 10.0::DOUBLE))), 4) AS confidence FROM ev GROUP BY ALL HAVING count(DISTINCT event_id) >= 2")
def topic_affinity(t: Tables) -> DataFrame:
    c = t.events.groupBy("person_id", F.col("thread_id").alias("topic")).agg(F.countDistinct("event_id").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return c.filter("n >= 2").withColumn("confidence", conf.confidence(F.col("n"), 10.0))


_PROFILE = """, p AS (SELECT person_id, count(*) AS n, count(*) FILTER (is_group) AS g, count(DISTINCT source) AS channels, max(ts) AS last_seen, round(count(*) FILTER (is_from_me) / count(*)::DOUBLE, 2) AS from_me FROM ev GROUP BY person_id),
q AS (SELECT *, n - g + CAST(floor(0.05 * g) AS BIGINT) AS effective FROM p)
SELECT person_id, n, channels, last_seen, from_me, effective, greatest(1, CASE WHEN effective >= 50 THEN 1 WHEN effective >= 20 THEN 2 WHEN effective >= 5 THEN 3 ELSE 4 END - CASE WHEN channels >= 3 THEN 1 ELSE 0 END)::INT AS tier FROM q"""


@query(_PROFILE)
def person_profiles(t: Tables) -> DataFrame:
    """Engagement of each person; group messages count a twentieth, three channels promote by a tier."""
    p = t.events.groupBy("person_id").agg(F.count("*").alias("n"), F.count_if("is_group").alias("g"), F.countDistinct("source").alias("channels"), F.max("ts").alias("last_seen"), F.round(F.count_if("is_from_me") / F.count("*"), 2).alias("from_me"))
    p = p.withColumn("effective", F.col("n") - F.col("g") + F.floor(0.05 * F.col("g")))
    tier = F.greatest(F.lit(1), conf.tier_three(F.col("effective")) - F.when(F.col("channels") >= 3, 1).otherwise(0))
    return p.drop("g").withColumn("tier", tier.cast("int"))


@query("SELECT person_id, count(DISTINCT source) AS sources, count(DISTINCT event_id) AS n FROM ev GROUP BY person_id HAVING count(DISTINCT source) >= 2")
def entity_bridges(t: Tables) -> DataFrame:
    return t.events.groupBy("person_id").agg(F.countDistinct("source").alias("sources"), F.countDistinct("event_id").alias("n")).filter("sources >= 2")


@query("SELECT CASE WHEN amount < 5 THEN 'ignore' WHEN amount < 50 THEN 'lightweight' ELSE 'deep' END AS tier, source, count(*) AS n FROM ev GROUP BY ALL")
def tier_distribution(t: Tables) -> DataFrame:
    return t.events.groupBy(F.expr("case when amount < 5 then 'ignore' when amount < 50 then 'lightweight' else 'deep' end").alias("tier"), "source").agg(F.count("*").alias("n"))


_COST = "(amount * 1000 * 0.3 + thread_id::DOUBLE * 100 * 0.3 * 0.1 + 200 * 2.5) / 1000000.0::DOUBLE"


@query(f"SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, source, event_type AS provider, count(*) AS calls, round(sum({_COST}), 6) AS cost FROM ev GROUP BY GROUPING SETS ((day, source, provider), (day))")
def spend_rollup(t: Tables) -> DataFrame:
    """Cost by day, source and provider, with day totals: cached input costs a tenth."""
    cost = (F.col("amount") * 1000 * 0.3 + F.col("thread_id").cast("double") * 100 * 0.3 * 0.1 + 200 * 2.5) / 1000000.0
    e = t.events.select(F.date_from_unix_date((F.col("ts") / DAY).cast("int")).cast("string").alias("day"), "source", F.col("event_type").alias("provider"), cost.alias("c"))
    full = e.groupBy("day", "source", "provider").agg(F.count("*").alias("calls"), F.sum("c").alias("s"))
    total = full.groupBy("day").agg(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("provider"), F.sum("calls").alias("calls"), F.sum("s").alias("s"))
    return full.unionByName(total).select("day", "source", "provider", "calls", F.round("s", 6).alias("cost"))


@query("""SELECT bucket, event_id, ts, n_events, n_sources FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS r FROM (
    SELECT event_id, ts, ts // 300 AS bucket, count(*) OVER w AS n_events, count(DISTINCT source) OVER w AS n_sources FROM ev WINDOW w AS (ORDER BY ts RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING)) WHERE n_events >= 3 AND n_sources >= 2) WHERE r = 1""")
def temporal_bursts(t: Tables) -> DataFrame:
    return clusters.bursts(t.events.select("event_id", "ts", "source"))


@query()
def dollar_clusters(t: Tables) -> DataFrame:
    """Equal amounts in two or more sources within an hour of the first. SQL would need a recursion for each cluster; tests hold it against a loop."""
    e = t.events.filter("amount is not null").select("event_id", "ts", "source", F.format_string("%.1f", F.round("amount", 1)).alias("sum"))
    c = clusters.anchored_clusters(e, ["sum"], "ts", "event_id", 3600)
    g = c.groupBy("sum", "cluster").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.filter("sources >= 2").withColumn("confidence", conf.confidence(F.col("n"), 5.0))


@query("""SELECT CASE WHEN source = 'calendar' THEN source || ':' || strftime(make_timestamp(ts * 1000000), '%G-W%V') WHEN thread_id IS NOT NULL THEN source || ':' || thread_id ELSE 'event:' || id END AS bundle,
    count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, (min(id))  AS least_id FROM ev GROUP BY bundle""")
def thread_bundles(t: Tables) -> DataFrame:
    """Events grouped for triage: calendars by ISO week, others by thread."""
    day = F.date_from_unix_date((F.col("ts") / DAY).cast("int"))
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
    key = F.when(F.col("source") == "calendar", F.concat_ws(":", "source", week)).when(F.col("thread_id").isNotNull(), F.concat_ws(":", "source", "thread_id")).otherwise(F.concat(F.lit("event:"), "id"))
    return t.events.groupBy(key.alias("bundle")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("id").alias("least_id"))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 100) OVER (PARTITION BY conv_id ORDER BY turn DESC, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1200""")
def thread_tail_in_budget(t: Tables) -> DataFrame:
    """The newest turns of each thread that fit a budget of characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text").rowsBetween(Window.unboundedPreceding, 0)
    return t.read("conversations").withColumn("used", F.sum(F.length("text") + 100).over(w)).filter("used <= 1200").select("conv_id", "turn")


@query("""SELECT person_id, n7, n30 - n7 AS prev23, CASE WHEN n30 = n7 THEN NULL ELSE round((n7 / 7.0::DOUBLE) / ((n30 - n7) / 23.0::DOUBLE), 4) END AS ratio FROM (
    SELECT person_id, count(*) FILTER (ts > now - 7 * 86400) AS n7, count(*) FILTER (ts > now - 30 * 86400) AS n30 FROM ev, clock GROUP BY person_id) WHERE n7 > 3 AND (n30 = n7 OR (n7 / 7.0) / ((n30 - n7) / 23.0) > 1.2)""")
def rising_contacts(t: Tables) -> DataFrame:
    e = t.events.join(F.broadcast(t.now))
    c = e.groupBy("person_id").agg(F.count_if(F.expr(f"ts > now - 7 * {DAY}")).alias("n7"), F.count_if(F.expr(f"ts > now - 30 * {DAY}")).alias("n30"))
    c = c.withColumn("prev23", F.col("n30") - F.col("n7")).withColumn("r", F.when(F.col("prev23") > 0, (F.col("n7") / 7.0) / (F.col("prev23") / 23.0)))
    return c.filter("n7 > 3 and (prev23 = 0 or r > 1.2)").select("person_id", "n7", "prev23", F.round("r", 4).alias("ratio"))


@query("""SELECT person_id, sources, n FROM (SELECT person_id, count(DISTINCT source) AS sources, count(*) AS n FROM ev, clock WHERE ts > now - 30 * 86400 GROUP BY person_id) WHERE sources >= 3 AND n >= 10 ORDER BY n DESC, person_id LIMIT 15""")
def inner_circle(t: Tables) -> DataFrame:
    e = t.events.join(F.broadcast(t.now)).filter(f"ts > now - 30 * {DAY}")
    c = e.groupBy("person_id").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n")).filter("sources >= 3 and n >= 10")
    return c.orderBy(F.desc("n"), "person_id").limit(15)


@query("SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round((max(ts) - min(ts)) / 3600.0::DOUBLE, 2) AS hours FROM ev WHERE source = 'slack' GROUP BY day ORDER BY day DESC LIMIT 7")
def work_rhythm(t: Tables) -> DataFrame:
    day = F.date_from_unix_date((F.col("ts") / DAY).cast("int")).cast("string")
    c = t.events.filter("source = 'slack'").groupBy(day.alias("day")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return c.withColumn("hours", F.round((F.col("last_ts") - F.col("first_ts")) / 3600.0, 2)).orderBy(F.desc("day")).limit(7)


@query("SELECT person_id, CAST(isodow(make_timestamp(ts * 1000000)) - 1 AS INT) AS weekday, CAST((ts // 3600 % 24) // 4 AS INT) AS slot, is_from_me, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 3")
def timing_histogram(t: Tables) -> DataFrame:
    day = F.date_from_unix_date((F.col("ts") / DAY).cast("int"))
    slot = F.floor(F.floor(F.col("ts") / 3600) % 24 / 4).cast("int")
    return t.events.groupBy("person_id", F.weekday(day).alias("weekday"), slot.alias("slot"), "is_from_me").agg(F.count("*").alias("n")).filter("n >= 3")


@query("""SELECT conv_id, count(*) AS n, max(turn) AS last_turn, max(turn) FILTER (role = 'user') AS last_user, max(turn) FILTER (role <> 'user') AS last_other,
    coalesce(max(turn) FILTER (role <> 'user') > max(turn) FILTER (role = 'user'), false) AS awaiting_user FROM conversations GROUP BY conv_id""")
def thread_snapshots(t: Tables) -> DataFrame:
    c = t.read("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"), F.max(F.when(F.col("role") != "user", F.col("turn"))).alias("last_other"))
    return c.withColumn("awaiting_user", F.coalesce(F.col("last_other") > F.col("last_user"), F.lit(False)))


@query("""SELECT person_id, source, count(*) AS n, count(*) FILTER (is_from_me) AS sent, min(ts) AS first_ts, max(ts) AS last_ts,
    CASE WHEN count(*) / 30.0 >= 1 THEN 'daily' WHEN count(*) / 30.0 >= 0.15 THEN 'weekly' WHEN count(*) / 30.0 >= 0.03 THEN 'monthly' ELSE 'rare' END AS frequency FROM ev GROUP BY person_id, source""")
def contact_dossier(t: Tables) -> DataFrame:
    c = t.events.groupBy("person_id", "source").agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("sent"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rate = F.col("n") / 30.0
    return c.withColumn("frequency", F.when(rate >= 1, "daily").when(rate >= 0.15, "weekly").when(rate >= 0.03, "monthly").otherwise("rare"))


@query("""SELECT person_id, round(0.45 * bi * CASE WHEN n < 10 THEN 0.3 WHEN n < 20 THEN 0.6 ELSE 1 END + 0.35 * least(ch / 3.0::DOUBLE, 1) + 0.2 * log10(greatest(n, 1)::DOUBLE) / 5, 4) AS score FROM (
    SELECT person_id, count(*) AS n, count(DISTINCT source) AS ch, 1 - abs(count(*) FILTER (is_from_me) / count(*)::DOUBLE - 0.5) * 2 AS bi FROM ev GROUP BY person_id HAVING count(*) >= 5)""")
def top_contacts(t: Tables) -> DataFrame:
    c = t.events.groupBy("person_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("ch"), (1 - F.abs(F.count_if("is_from_me") / F.count("*") - 0.5) * 2).alias("bi")).filter("n >= 5")
    score = 0.45 * F.col("bi") * F.when(F.col("n") < 10, 0.3).when(F.col("n") < 20, 0.6).otherwise(1.0) + 0.35 * F.least(F.col("ch") / 3.0, F.lit(1.0)) + 0.2 * F.log10(F.greatest(F.col("n"), F.lit(1)).cast("double")) / 5
    return c.select("person_id", F.round(score, 4).alias("score"))


@query("SELECT source, CAST(count(DISTINCT ts // 86400) AS BIGINT) AS days, max(ts) < (SELECT now FROM clock) - 7 * 86400 AS stale FROM ev GROUP BY source")
def visibility_gaps(t: Tables) -> DataFrame:
    c = t.events.join(F.broadcast(t.now)).groupBy("source").agg(F.countDistinct(F.floor(F.col("ts") / DAY)).alias("days"), F.max("ts").alias("last"), F.max("now").alias("now"))
    return c.select("source", "days", F.expr(f"last < now - 7 * {DAY}").alias("stale"))


@query("""SELECT person_id, days, CASE WHEN days <= 14 THEN 'active' WHEN days <= 30 THEN 'warm' WHEN days <= 60 THEN 'cooling' WHEN days <= 90 THEN 'cold' ELSE 'dormant' END AS stage FROM (
    SELECT person_id, CAST((max(now) - max(ts)) // 86400 AS BIGINT) AS days FROM ev, clock WHERE source = 'calendar' GROUP BY person_id)""")
def relationship_stage(t: Tables) -> DataFrame:
    c = t.events.filter("source = 'calendar'").join(F.broadcast(t.now)).groupBy("person_id").agg(F.floor((F.max("now") - F.max("ts")) / DAY).alias("days"))
    d = F.col("days")
    return c.withColumn("stage", F.when(d <= 14, "active").when(d <= 30, "warm").when(d <= 60, "cooling").when(d <= 90, "cold").otherwise("dormant"))


@query("SELECT source, (ep.role) AS role, count(*) AS n FROM ep JOIN ev USING (event_id) GROUP BY source, ep.role")
def event_roles(t: Tables) -> DataFrame:
    return t.event_persons.join(t.events.select("event_id", "source"), "event_id").groupBy("source", "role").agg(F.count("*").alias("n"))


@query("""SELECT source, thread_id, person_id, arg_min(event_id, ts * 1000000 + event_id) AS anchor FROM ep JOIN (SELECT event_id, source, thread_id, ts FROM ev) USING (event_id)
    WHERE (source, thread_id) IN (SELECT source, thread_id FROM ep JOIN (SELECT event_id, source, thread_id FROM ev) USING (event_id) GROUP BY ALL HAVING count(DISTINCT person_id) <= 40 OR source <> 'mail') GROUP BY source, thread_id, person_id""")
def thread_members(t: Tables) -> DataFrame:
    """One member edge per person and thread, at its earliest event; crowded mail threads are left out."""
    j = t.event_persons.join(t.events.select("event_id", "source", "thread_id", "ts"), "event_id")
    size = j.groupBy("source", "thread_id").agg(F.countDistinct("person_id").alias("people")).filter("people <= 40 or source <> 'mail'")
    members = j.groupBy("source", "thread_id", "person_id").agg(F.min_by("event_id", F.col("ts") * 1000000 + F.col("event_id")).alias("anchor"))
    return members.join(size.drop("people"), ["source", "thread_id"]).select("source", "thread_id", "person_id", "anchor")


@query("""SELECT m.person_id, count(DISTINCT e.event_id) AS n FROM (SELECT DISTINCT source, thread_id, person_id FROM ep JOIN (SELECT event_id, source, thread_id FROM ev) USING (event_id)) m JOIN ev e ON e.source = m.source AND e.thread_id = m.thread_id GROUP BY m.person_id""")
def participation(t: Tables) -> DataFrame:
    """Events that a person takes part in through the threads they are in.

    Events are counted once for each set of threads that an event_id stands in (one thread, unless ids repeat), so no thread's events meet its people one by one.
    """
    e = t.events.select("event_id", "source", "thread_id").filter("event_id is not null and source is not null and thread_id is not null").repartition("event_id")
    members = t.event_persons.join(e, "event_id").select("source", "thread_id", "person_id").distinct()
    sets = e.groupBy("event_id").agg(F.sort_array(F.collect_set(F.struct("source", "thread_id"))).alias("threads")).groupBy("threads").agg(F.count("*").alias("n"))
    seen = sets.select("threads", "n", F.explode("threads").alias("at")).select("threads", "n", "at.source", "at.thread_id").join(members, ["source", "thread_id"])
    once = seen.filter(F.size("threads") == 1).select("person_id", "n").unionByName(seen.filter(F.size("threads") > 1).select("threads", "person_id", "n").distinct().drop("threads"))
    return once.groupBy("person_id").agg(F.sum("n").alias("n"))


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS domain, substr(sha256('visit:' || url), 1, 20) AS source_id FROM pages""")
def browser_visits(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("domain"), F.substring(F.sha2(F.concat(F.lit("visit:"), "url"), 256), 1, 20).alias("source_id"))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS domain, count(*) AS visits FROM pages GROUP BY domain HAVING count(*) >= 3")
def shadow_activity(t: Tables) -> DataFrame:
    return t.read("pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("domain")).agg(F.count("*").alias("visits")).filter("visits >= 3")


@query("SELECT event_id, raw, CAST(floor(ts_raw) AS BIGINT) AS ts FROM (SELECT event_id, event_id % 4 AS raw, ts AS ts_raw FROM ev)")
def clock_detection(t: Tables) -> DataFrame:
    """Times written in four encodings come back as the same epoch seconds."""
    k, ts = F.col("event_id") % 4, F.col("ts")
    raw = F.when(k == 0, ts.cast("double")).when(k == 1, ts * 1e3).when(k == 2, ts - 978_307_200.0).otherwise((ts + 11_644_473_600.0) * 1e6)
    return t.events.select("event_id", k.alias("raw"), tx.to_unix(raw).alias("ts"))
