"""Reads of the store, evidence joins, rollups and samples (survey 2.2-2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import joins, store
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

DAY = 86400


@query("SELECT event_id, id, source, ts FROM ev WHERE id = (SELECT id FROM ev WHERE event_id = 17)")
def event_by_id(t: Tables) -> DataFrame:
    wanted = t.spark.range(17, 18).select(F.substring(F.sha2(F.concat(F.lit("events:"), F.col("id").cast("string")), 256), 1, 24).alias("id"))
    return t.events.join(F.broadcast(wanted), "id", "left_semi").select("event_id", "id", "source", "ts")


@query("SELECT claim_id, status, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS events FROM cl JOIN ce USING (claim_id) WHERE claim_id = 33 GROUP BY ALL")
def claim_by_id(t: Tables) -> DataFrame:
    c = store.find(t.claims, claim_id=33).join(store.find(t.claim_events, claim_id=33), "claim_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return c.groupBy("claim_id", "status").agg(ids.alias("events"))


@query("SELECT claim_id, person_id, confidence FROM cl WHERE status = 'open' AND priority = 2 AND confidence >= 0.5 ORDER BY confidence DESC, claim_id LIMIT 100")
def claims_of_type(t: Tables) -> DataFrame:
    c = t.claims.filter("confidence >= 0.5")
    return store.find(c, 100, [F.desc("confidence"), F.col("claim_id")], status="open", priority=2).select("claim_id", "person_id", "confidence")


@query("SELECT belief_id, subject, confidence FROM be WHERE status = 'active' AND belief_type = 'fact' AND confidence >= 0.6 ORDER BY confidence DESC, belief_id LIMIT 100")
def beliefs_found(t: Tables) -> DataFrame:
    return store.beliefs(t.store("be"), belief_type="fact", min_confidence=0.6).select("belief_id", "subject", "confidence")


@query("SELECT belief_id, belief_type, status FROM be WHERE belief_id = 21")
def belief_by_id(t: Tables) -> DataFrame:
    return store.find(t.store("be"), belief_id=21).select("belief_id", "belief_type", "status")


@query("SELECT belief_id, subject, confidence FROM be WHERE status = 'active' AND subject = 7")
def beliefs_of_subject(t: Tables) -> DataFrame:
    return store.beliefs(t.store("be"), subject=7, limit=None).select("belief_id", "subject", "confidence")


@query("SELECT belief_id, belief_type FROM be WHERE claim_a IN (SELECT claim_id FROM cl WHERE priority = 1) OR claim_b IN (SELECT claim_id FROM cl WHERE priority = 1)")
def beliefs_by_claims(t: Tables) -> DataFrame:
    b = t.store("be").withColumn("claims", F.array("claim_a", "claim_b"))
    return store.beliefs_by_claims(b, t.claims.filter("priority = 1")).select("belief_id", "belief_type")


@query("SELECT event_id, facet, value FROM an WHERE facet = 'topic' AND value = 'topic 7'")
def annotations_found(t: Tables) -> DataFrame:
    return store.find(t.store("an"), facet="topic", value="topic 7").select("event_id", "facet", "value")


@query("SELECT event_id, coalesce(canonical, value) AS topic, canonical IS NOT NULL AS known FROM an LEFT JOIN sy ON raw = value WHERE facet = 'topic'")
def canonical_topics(t: Tables) -> DataFrame:
    """The whole map of synonyms, applied to all topics."""
    a = store.find(t.store("an"), facet="topic").join(t.store("sy"), F.col("raw") == F.col("value"), "left")
    return a.select("event_id", F.coalesce("canonical", "value").alias("topic"), F.col("canonical").isNotNull().alias("known"))


@query("SELECT raw, canonical FROM sy WHERE raw = 'topic 3'")
def topic_synonym(t: Tables) -> DataFrame:
    return store.find(t.store("sy"), raw="topic 3")


@query("SELECT event_id, score, route FROM pr WHERE event_id = 5 AND lens = 'default'")
def projection_of_event(t: Tables) -> DataFrame:
    return store.find(t.store("pr"), event_id=5, lens="default").select("event_id", "score", "route")


@query("SELECT event_id, score FROM pr WHERE lens = 'default' AND route = 'full_triage' AND score >= 0.8 ORDER BY score DESC, event_id LIMIT 1000")
def projections_found(t: Tables) -> DataFrame:
    return store.projections(t.store("pr"), "default", "full_triage", 0.8).select("event_id", "score")


@query("""SELECT n, id_type, identifier, coalesce(person_id, -1) AS person_id FROM (SELECT s_suppkey AS n, CASE s_suppkey % 2 WHEN 0 THEN 'phone' ELSE 'email' END AS id_type,
    CASE s_suppkey % 2 WHEN 0 THEN '+1' || (2000000000 + s_suppkey * 3) ELSE 'c' || s_suppkey || '@building.com' END AS identifier FROM supplier) LEFT JOIN pid USING (id_type, identifier)""")
def resolved_identifiers(t: Tables) -> DataFrame:
    """Who e-mail addresses and phone numbers belong to, or nobody."""
    even, k = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")
    asked = t.read("supplier").select(k.alias("n"), F.when(even, "phone").otherwise("email").alias("id_type"), F.when(even, F.concat(F.lit("+1"), (k * 3 + 2000000000).cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@building.com"))).alias("identifier"))
    return store.resolved(t.store("pid"), asked).withColumn("person_id", F.coalesce("person_id", F.lit(-1)))


@query("SELECT 'person' AS kind, person_id, name AS value FROM pe WHERE person_id = 9 UNION ALL SELECT id_type, person_id, identifier FROM pid WHERE person_id = 9")
def person_by_id(t: Tables) -> DataFrame:
    """A person's row and identifiers."""
    own = store.find(t.store("pe"), person_id=9).select(F.lit("person").alias("kind"), "person_id", F.col("name").alias("value"))
    return own.unionByName(store.find(t.store("pid"), person_id=9).select(F.col("id_type").alias("kind"), "person_id", F.col("identifier").alias("value")))


@query("SELECT person_id, name FROM pe ORDER BY name, person_id LIMIT 200")
def persons_by_name(t: Tables) -> DataFrame:
    return store.find(t.store("pe"), 200, [F.col("name"), F.col("person_id")]).select("person_id", "name")


@query("""SELECT person_id, count(*) AS message_count, string_agg(DISTINCT source, ',' ORDER BY source) AS channels FROM ev GROUP BY person_id HAVING count(*) >= 5 ORDER BY message_count DESC, person_id""")
def profiles_by_volume(t: Tables) -> DataFrame:
    p = t.events.groupBy("person_id").agg(F.count("*").alias("message_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("channels"))
    return p.filter("message_count >= 5").orderBy(F.desc("message_count"), "person_id")


@query("SELECT event_id, role, person_id, name FROM ep JOIN pe USING (person_id)")
def event_people(t: Tables) -> DataFrame:
    return store.persons_of(t.event_persons, t.store("pe"))


@query("SELECT source, max(ts) AS synced_to, count(*) AS events FROM ev GROUP BY source")
def sync_state(t: Tables) -> DataFrame:
    return t.events.groupBy("source").agg(F.max("ts").alias("synced_to"), F.count("*").alias("events"))


@query("SELECT task_id, bucket, position FROM tk WHERE NOT done AND bucket = 'immediate'")
def tasks_in_bucket(t: Tables) -> DataFrame:
    return store.find(t.store("tk"), None, [F.col("bucket"), F.col("position"), F.col("task_id")], bucket="immediate", done=False).select("task_id", "bucket", "position")


@query("SELECT task_id, to_json({'bucket': bucket, 'position': position, 'done': done})::VARCHAR AS snapshot FROM tk WHERE task_id = 12")
def task_snapshot(t: Tables) -> DataFrame:
    """A task's row as it is, to put back later."""
    return store.find(t.store("tk"), task_id=12).select("task_id", F.to_json(F.struct("bucket", "position", "done")).alias("snapshot"))


@query("SELECT rule_id, pattern, action FROM ru ORDER BY created_at DESC, rule_id")
def rules_by_age(t: Tables) -> DataFrame:
    return t.store("ru").orderBy(F.desc("created_at"), "rule_id").select("rule_id", "pattern", "action")


@query(""", a AS (SELECT DISTINCT 'c' || c_custkey || '@' || CASE c_custkey % 3 WHEN 0 THEN 'd' || (c_custkey % 26) ELSE 'building' END || '.com' AS identifier FROM customer),
e AS (SELECT identifier, action FROM a JOIN ru ON pattern = identifier QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY created_at DESC, rule_id) = 1),
d AS (SELECT identifier, action FROM a JOIN ru ON pattern = regexp_extract(identifier, '@.*$') QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY created_at DESC, rule_id) = 1)
SELECT identifier, coalesce(e.action, d.action) AS action FROM a LEFT JOIN e USING (identifier) LEFT JOIN d USING (identifier)""")
def matched_rules(t: Tables) -> DataFrame:
    """What the rules say to each address: the rule for it, else the one for its domain."""
    k = F.col("c_custkey")
    host = F.when(k % 3 == 0, F.concat(F.lit("D"), (k % 26).cast("string"))).otherwise("building")
    asked = t.read("customer").select(F.concat(F.lit("c"), k.cast("string"), F.lit("@"), F.lower(host), F.lit(".com")).alias("identifier"))
    return store.matched_rules(asked, t.store("ru"))


@query("SELECT n_nationkey AS position, n_name AS name FROM nation ORDER BY position")
def categories(t: Tables) -> DataFrame:
    return store.find(t.read("nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name")), None, [F.col("position")])


@query("SELECT r_regionkey AS position, r_name AS name FROM region ORDER BY position")
def extractable_fields(t: Tables) -> DataFrame:
    return store.find(t.read("region").select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("name")), None, [F.col("position")])


@query("SELECT story_id, coalesce(override, priority, 99) AS rank, updated_at FROM st WHERE status = 'active'")
def stories_by_rank(t: Tables) -> DataFrame:
    return store.stories(t.store("st"))


@query("SELECT story_id, task_id, row_number() OVER (PARTITION BY story_id ORDER BY position, task_id) - 1 AS at FROM tk WHERE NOT done")
def story_members(t: Tables) -> DataFrame:
    return store.ordered_members(t.store("tk").filter("not done"), "story_id", F.col("position"), F.col("task_id")).select("story_id", "task_id", F.col("at").cast("long").alias("at"))


@query("SELECT a, b, a % 3 = 0 AND b = a + 1 OR b % 3 = 0 AND a = b + 1 AS apart FROM (SELECT p_partkey AS a, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS b FROM part)")
def story_anti_links(t: Tables) -> DataFrame:
    """Whether two tasks may never share a story, asked in either order."""
    p = t.read("part").select(F.col("p_partkey").alias("a"))
    links = p.filter("a % 3 = 0").select("a", (F.col("a") + 1).alias("b")).unionByName(p.filter("a = 0").select(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
    asked = p.select("a", (F.col("a") + F.when(F.col("a") % 2 == 0, 1).otherwise(-1)).alias("b"))
    return store.apart(links, asked)


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def sessions(t: Tables) -> DataFrame:
    """Each session with its messages in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = t.read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return c


@query("SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20")
def newest_sessions(t: Tables) -> DataFrame:
    return t.read("conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).orderBy(F.desc("conv_id")).limit(20)


@query(""", n AS (SELECT event_id, source FROM ev WHERE event_id IN (SELECT event_id FROM ep WHERE person_id = 7) ORDER BY ts DESC, event_id DESC LIMIT 20)
SELECT 'person' AS kind, person_id::VARCHAR AS key, name AS text FROM pe WHERE person_id = 7 UNION ALL SELECT 'identifier', id_type, identifier FROM pid WHERE person_id = 7
UNION ALL SELECT 'event', event_id::VARCHAR, source FROM n UNION ALL SELECT 'belief', belief_id::VARCHAR, belief_type FROM be WHERE subject = 7""")
def person_detail(t: Tables) -> DataFrame:
    return store.person_detail(7, t.store("pe"), t.store("pid"), t.events, t.event_persons, t.store("be"))


@query("SELECT DISTINCT person_id, event_id, ts, source FROM ep JOIN ev USING (event_id, person_id) WHERE role = 'sender' AND source = 'mail'")
def sent_by_person(t: Tables) -> DataFrame:
    """Events of each person in a role, of a source."""
    return store.events_of(t.events, t.event_persons, role="sender", source="mail")


@query("""SELECT person_id, event_id, ts, source FROM (SELECT DISTINCT ep.person_id, event_id, ts, source FROM ep JOIN ev USING (event_id)) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY ts DESC, event_id DESC) <= 5""")
def newest_of_person(t: Tables) -> DataFrame:
    return store.events_of(t.events, t.event_persons, most=5)


@query("SELECT DISTINCT story_id, tk.person_id, name FROM tk LEFT JOIN pe USING (person_id)")
def story_people(t: Tables) -> DataFrame:
    return t.store("tk").select("story_id", "person_id").distinct().join(t.store("pe").select("person_id", "name"), "person_id", "left").select("story_id", "person_id", "name")


@query("""SELECT thread_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(DISTINCT ep.person_id) AS people FROM ev e JOIN ep USING (event_id) JOIN pe ON pe.person_id = ep.person_id GROUP BY thread_id""")
def persons_of_threads(t: Tables) -> DataFrame:
    """The people of each thread's events, once each."""
    p = store.persons_of(t.event_persons, t.store("pe")).join(t.events.select("event_id", "thread_id"), "event_id").select("thread_id", "person_id", "name").distinct()
    return p.groupBy("thread_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.count("*").alias("people"))


@query("""SELECT m.event_id AS meeting, string_agg(DISTINCT a.person_id::VARCHAR, ',' ORDER BY a.person_id::VARCHAR) AS attendees FROM ev m JOIN ep a ON a.event_id = m.event_id AND a.role <> 'self', clock WHERE m.source = 'calendar' AND m.ts BETWEEN now - 7 * 86400 AND now GROUP BY m.event_id""")
def upcoming_meetings(t: Tables) -> DataFrame:
    """Meetings of a week, with who else takes part; the week ends at the newest event."""
    m = t.events.filter("source = 'calendar'").join(F.broadcast(t.now)).filter(f"ts between now - 7 * {DAY} and now").select("event_id")
    people = m.join(t.event_persons.filter("role <> 'self'"), "event_id").groupBy(F.col("event_id").alias("meeting"))
    return people.agg(F.array_join(F.array_sort(F.collect_set(F.col("person_id").cast("string"))), ",").alias("attendees"))


@query(""", m AS (SELECT event_id AS meeting, ts AS begins FROM ev WHERE source = 'calendar'),
x AS (SELECT DISTINCT meeting, ep.person_id, e.event_id, e.ts FROM m JOIN ep ON ep.event_id = meeting JOIN ev e ON e.person_id = ep.person_id AND e.source IN ('mail', 'imessage') AND e.ts BETWEEN begins - 3 * 86400 AND begins)
SELECT DISTINCT meeting, event_id FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY meeting, person_id ORDER BY ts DESC, event_id DESC) <= 3)""")
def meeting_context(t: Tables) -> DataFrame:
    """For each meeting the three newest messages of each attendee in the three days before it, once each."""
    m = t.events.filter("source = 'calendar'").select(F.col("event_id").alias("meeting"), F.col("ts").alias("at"))
    who = m.join(t.event_persons.select(F.col("event_id").alias("meeting"), "person_id").distinct(), "meeting")
    said = t.events.filter(F.col("source").isin("mail", "imessage")).select("event_id", "ts", "person_id")
    near = joins.band_join(who, said, "at", "ts", 3 * DAY, ("person_id",)).filter("ts <= at")
    newest = Window.partitionBy("meeting", "person_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return near.withColumn("r", F.row_number().over(newest)).filter("r <= 3").select("meeting", "event_id").distinct()


@query("""SELECT thread_id, claim_id, created_at FROM (SELECT DISTINCT thread_id, claim_id, created_at FROM cl JOIN ce USING (claim_id) JOIN ev USING (event_id) WHERE status = 'open')""")
def prior_commitments(t: Tables) -> DataFrame:
    """The open commitments of each thread."""
    threads = t.claim_events.join(t.events.select("event_id", "thread_id"), "event_id").select("claim_id", "thread_id").distinct()
    return t.claims.filter("status = 'open'").join(threads, "claim_id").select("thread_id", "claim_id", "created_at")


@query("""SELECT claim_id, arg_min(source, [ts, event_id]) AS channel FROM ce JOIN ev USING (event_id) GROUP BY claim_id""")
def claim_channels(t: Tables) -> DataFrame:
    """The source of each claim's earliest event."""
    c = t.claim_events.join(t.events.select("event_id", "ts", "source"), "event_id")
    return c.groupBy("claim_id").agg(F.min_by("source", F.struct("ts", "event_id")).alias("channel"))


@query(""", x AS (SELECT claim_id, thread_id, cl.person_id, strptime(deadline, '%Y-%m-%d') AS d FROM cl JOIN ce USING (claim_id) JOIN ev USING (event_id) WHERE status = 'open' AND priority = 1),
th AS (SELECT DISTINCT claim_id, event_id, ts, 'thread' AS how, 1 AS place FROM x JOIN ev USING (thread_id) QUALIFY dense_rank() OVER (PARTITION BY claim_id ORDER BY ts DESC, event_id DESC) <= 10),
pp AS (SELECT DISTINCT claim_id, event_id, ts, 'person' AS how, 2 AS place FROM x JOIN ev ON ev.person_id = x.person_id QUALIFY dense_rank() OVER (PARTITION BY claim_id ORDER BY ts DESC, event_id DESC) <= 10),
u AS (SELECT * FROM (SELECT * FROM th UNION ALL SELECT * FROM pp) QUALIFY row_number() OVER (PARTITION BY claim_id, event_id ORDER BY place) = 1)
SELECT claim_id, event_id, how FROM u QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY place, ts DESC, event_id DESC) <= 15""")
def follow_ups(t: Tables) -> DataFrame:
    """Evidence for urgent commitments: the ten newest events of their threads, then of their people; fifteen in all, once each."""
    c = t.claims.filter("status = 'open' and priority = 1").select("claim_id", F.col("person_id").alias("who"))
    x = c.join(t.claim_events, "claim_id").join(t.events.select("event_id", "thread_id"), "event_id")
    e = t.events.select("event_id", "ts", "thread_id", "person_id")
    newest = lambda *by: Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
    per = lambda key: e.withColumn("r", F.row_number().over(newest(key))).filter("r <= 10").drop("r")
    best = lambda df: df.distinct().withColumn("r", F.row_number().over(newest("claim_id"))).filter("r <= 10").drop("r")
    th = best(x.select("claim_id", "thread_id").distinct().join(per("thread_id"), "thread_id").select("claim_id", "event_id", "ts", F.lit("thread").alias("how"), F.lit(1).alias("place")))
    pp = best(x.select("claim_id", F.col("who").alias("person_id")).distinct().join(per("person_id"), "person_id").select("claim_id", "event_id", "ts", F.lit("person").alias("how"), F.lit(2).alias("place")))
    once = th.unionByName(pp).withColumn("r", F.row_number().over(Window.partitionBy("claim_id", "event_id").orderBy("place"))).filter("r = 1")
    return once.withColumn("r", F.row_number().over(Window.partitionBy("claim_id").orderBy("place", F.desc("ts"), F.desc("event_id")))).filter("r <= 15").select("claim_id", "event_id", "how")


@query("SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'claims', count(*) FROM cl UNION ALL SELECT 'beliefs', count(*) FROM be UNION ALL SELECT 'persons', count(*) FROM pe UNION ALL SELECT 'annotations', count(*) FROM an UNION ALL SELECT 'projections', count(*) FROM pr")
def store_counts(t: Tables) -> DataFrame:
    return store.counts(events=t.events, claims=t.claims, beliefs=t.store("be"), persons=t.store("pe"), annotations=t.store("an"), projections=t.store("pr"))


@query("SELECT event_id, ts FROM ev WHERE source IN ('mail', 'imessage', 'whatsapp') OR event_id IN (SELECT event_id FROM ep WHERE role = 'self')")
def user_events(t: Tables) -> DataFrame:
    """The user's events: those with a self edge, and all of the sources that only ever hold their own."""
    own = t.event_persons.filter("role = 'self'").select("event_id").union(t.events.filter(F.col("source").isin("mail", "imessage", "whatsapp")).select("event_id")).distinct()
    return t.events.join(own, "event_id", "left_semi").select("event_id", "ts")


@query("SELECT value AS name, count(DISTINCT source) AS sources, count(DISTINCT event_id) AS events FROM an WHERE facet = 'person_mention' GROUP BY value HAVING count(DISTINCT source) >= 2")
def name_bridges(t: Tables) -> DataFrame:
    """Names that are mentioned in two sources or more."""
    a = store.find(t.store("an"), facet="person_mention").groupBy(F.col("value").alias("name"))
    return a.agg(F.countDistinct("source").alias("sources"), F.countDistinct("event_id").alias("events")).filter("sources >= 2")


@query("SELECT value AS topic, count(*) AS n, count(*) = 1 AS single FROM an WHERE facet = 'topic' GROUP BY value ORDER BY n DESC, topic LIMIT 20")
def topic_counts(t: Tables) -> DataFrame:
    return store.find(t.store("an"), facet="topic").groupBy(F.col("value").alias("topic")).agg(F.count("*").alias("n")).select("topic", "n", (F.col("n") == 1).alias("single")).orderBy(F.desc("n"), "topic").limit(20)


_COSTS = """, pc AS (SELECT *, CASE model WHEN 'model 0' THEN 0.3 WHEN 'model 1' THEN 1.25 WHEN 'model 2' THEN 3.0 END::DOUBLE AS i, CASE model WHEN 'model 0' THEN 2.5 WHEN 'model 1' THEN 10.0 WHEN 'model 2' THEN 15.0 END::DOUBLE AS o FROM sp),
co AS (SELECT *, coalesce(round(((input_tokens - cached_tokens) * i + cached_tokens * i * 0.1::DOUBLE + (output_tokens + 50) * o) / 1000000::DOUBLE, 8), 0)::DECIMAL(18, 8) AS cost FROM pc)"""


def _costs(t: Tables) -> DataFrame:
    rates = {"model 0": (0.3, 2.5), "model 1": (1.25, 10.0), "model 2": (3.0, 15.0)}
    price = F.create_map(*(x for m, (i, o) in rates.items() for x in (F.lit(m), F.struct(F.lit(i).alias("input"), F.lit(o).alias("output")))))[F.col("model")]
    return t.store("sp").withColumn("cost", store.cost(price, F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.lit(50)).cast("decimal(18,8)"))


@query(_COSTS + " SELECT model, count(*) AS calls, sum(cost)::DOUBLE AS cost FROM co GROUP BY model")
def model_costs(t: Tables) -> DataFrame:
    """What the calls of each model cost; an unknown model costs nothing."""
    return _costs(t).groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost").cast("double").alias("cost"))


@query(_COSTS + " SELECT provider, strftime(spent_at, '%Y-%m-%d') AS day, sum(CASE WHEN source <> 'onboarding' THEN cost ELSE 0 END)::DOUBLE AS spent, sum(CASE WHEN source <> 'onboarding' THEN cost ELSE 0 END) >= 2 AS over_limit FROM co GROUP BY ALL")
def daily_limits(t: Tables) -> DataFrame:
    """A day's spending with each provider, onboarding apart, against two dollars."""
    counted = F.sum(F.when(F.col("source") != "onboarding", F.col("cost")).otherwise(0).cast("decimal(18,8)"))
    return _costs(t).groupBy("provider", F.date_format("spent_at", "yyyy-MM-dd").alias("day")).agg(counted.cast("double").alias("spent"), (counted >= 2).alias("over_limit"))


@query(_COSTS + " SELECT provider, sum(cost)::DOUBLE AS spent, sum(cost) < 5 AS may_go_on FROM co WHERE source = 'onboarding' GROUP BY provider")
def onboarding_budget(t: Tables) -> DataFrame:
    return _costs(t).filter("source = 'onboarding'").groupBy("provider").agg(F.sum("cost").cast("double").alias("spent"), (F.sum("cost") < 5).alias("may_go_on"))


@query("""SELECT person_id, n, CASE WHEN n >= 80 THEN 1 WHEN n >= 65 THEN 2 WHEN n >= 50 THEN 3 ELSE 4 END AS tier, round(mine / n::DOUBLE, 2) AS reply_ratio, identifier AS email
    FROM (SELECT person_id, count(*) AS n, count_if(is_from_me) AS mine FROM ev GROUP BY person_id) LEFT JOIN (SELECT person_id, identifier FROM pid WHERE id_type = 'email') USING (person_id)""")
def sender_cache(t: Tables) -> DataFrame:
    """What propagation wants to know of each sender."""
    n = t.events.groupBy("person_id").agg(F.count("*").alias("n"), F.count_if("is_from_me").alias("mine"))
    tier = F.when(F.col("n") >= 80, 1).when(F.col("n") >= 65, 2).when(F.col("n") >= 50, 3).otherwise(4)
    mail = store.find(t.store("pid"), id_type="email").select("person_id", F.col("identifier").alias("email"))
    return n.join(mail, "person_id", "left").select("person_id", "n", tier.alias("tier"), F.round(F.col("mine") / F.col("n"), 2).alias("reply_ratio"), "email")


@query("""SELECT pr.event_id, score, thread_id, ep.person_id AS sender, coalesce(n, 0) AS recipients FROM pr JOIN ev USING (event_id) JOIN ep ON ep.event_id = pr.event_id AND role IN ('sender', 'self')
    LEFT JOIN (SELECT event_id, count(*) AS n FROM ep WHERE role = 'recipient' GROUP BY event_id) r ON r.event_id = pr.event_id WHERE route <> 'skip'""")
def working_set(t: Tables) -> DataFrame:
    """Scored events with thread, sender and number of recipients: what propagation works on."""
    sent = t.event_persons.filter("role in ('sender', 'self')").select("event_id", F.col("person_id").alias("sender"))
    got = t.event_persons.filter("role = 'recipient'").groupBy("event_id").agg(F.count("*").alias("n"))
    p = t.store("pr").filter("route <> 'skip'").join(t.events.select("event_id", "thread_id"), "event_id").join(sent, "event_id").join(got, "event_id", "left")
    return p.select("event_id", "score", "thread_id", "sender", F.coalesce("n", F.lit(0)).alias("recipients"))


@query("""SELECT person_id, count(*) AS events, count(DISTINCT source) AS sources, round(avg(is_from_me::INT), 4) AS from_me, max(ts) AS last_seen FROM ev GROUP BY person_id""")
def engagement(t: Tables) -> DataFrame:
    return t.events.groupBy("person_id").agg(F.count("*").alias("events"), F.countDistinct("source").alias("sources"), F.round(F.avg(F.col("is_from_me").cast("int")), 4).alias("from_me"), F.max("ts").alias("last_seen"))


def _picked(by: str, table: str, key: str, n: int = 50) -> str:
    return f""", q AS (SELECT {by}, greatest(1, round({n}.0::DOUBLE * count(*) / (SELECT count(*) FROM {table})))::INT AS quota FROM {table} GROUP BY {by})
    SELECT {by}, {key} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5({key}::VARCHAR), {key}) AS r FROM {table}) JOIN q USING ({by}) WHERE r <= quota"""


@query(_picked("source", "ev", "event_id"))
def sampled_events(t: Tables) -> DataFrame:
    """Fifty events, of each source as many as its share."""
    return store.proportional_sample(t.events, ["source"], 50, F.md5(F.col("event_id").cast("string")), F.col("event_id")).select("source", "event_id")


@query(_picked("role", "ep", "event_id"))
def sampled_links(t: Tables) -> DataFrame:
    return store.proportional_sample(t.event_persons, ["role"], 50, F.md5(F.col("event_id").cast("string")), F.col("event_id")).select("role", "event_id")


@query(_picked("belief_type", "be", "belief_id"))
def sampled_beliefs(t: Tables) -> DataFrame:
    return store.proportional_sample(t.store("be"), ["belief_type"], 50, F.md5(F.col("belief_id").cast("string")), F.col("belief_id")).select("belief_type", "belief_id")


@query(_picked("priority", "cl", "claim_id"))
def sampled_commitments(t: Tables) -> DataFrame:
    return store.proportional_sample(t.claims, ["priority"], 50, F.md5(F.col("claim_id").cast("string")), F.col("claim_id")).select("priority", "claim_id")


@query("""SELECT tier, event_id FROM (SELECT *, CASE WHEN score < 0.3 THEN 'ignore' WHEN score < 0.7 THEN 'lightweight' ELSE 'deep' END AS tier FROM pr) QUALIFY row_number() OVER (PARTITION BY tier ORDER BY md5(event_id::VARCHAR), event_id) <= 16""")
def sampled_tiers(t: Tables) -> DataFrame:
    """A third of fifty events of each tier."""
    tier = F.when(F.col("score") < 0.3, "ignore").when(F.col("score") < 0.7, "lightweight").otherwise("deep")
    return joins.latest_per(t.store("pr").withColumn("tier", tier), ["tier"], F.md5(F.col("event_id").cast("string")), F.col("event_id"), n=16).select("tier", "event_id")


@query("""SELECT kind, person_id FROM (SELECT person_id, CASE WHEN is_user THEN 'user' WHEN n >= 5 THEN 'multi' WHEN n >= 1 THEN 'single' ELSE 'contacts' END AS kind FROM pe LEFT JOIN (SELECT person_id, count(DISTINCT source) AS n FROM ev GROUP BY person_id) USING (person_id))
    QUALIFY kind = 'user' OR row_number() OVER (PARTITION BY kind ORDER BY md5(person_id::VARCHAR), person_id) <= 16""")
def sampled_persons(t: Tables) -> DataFrame:
    """The user, and a third of fifty each of people of all sources, of some, and of none."""
    n = t.events.groupBy("person_id").agg(F.countDistinct("source").alias("n"))
    kind = F.when(F.col("is_user"), "user").when(F.col("n") >= 5, "multi").when(F.col("n") >= 1, "single").otherwise("contacts")
    p = t.store("pe").join(n, "person_id", "left").select(kind.alias("kind"), "person_id")
    return joins.latest_per(p, ["kind"], F.md5(F.col("person_id").cast("string")), F.col("person_id"), n=16)


@query("""SELECT task_id, row_number() OVER (PARTITION BY bucket ORDER BY task_id DESC) - 1 AS position FROM tk WHERE bucket = 'review' UNION ALL SELECT task_id, position FROM tk WHERE bucket <> 'review'""")
def reordered_tasks(t: Tables) -> DataFrame:
    """The review bucket put in a new order, all others as they were."""
    new = store.ordered_members(store.find(t.store("tk"), bucket="review"), "bucket", F.desc("task_id")).select("task_id", F.col("at").cast("long").alias("position"))
    return new.unionByName(t.store("tk").filter("bucket <> 'review'").select("task_id", "position"))


@query(""", c AS (SELECT event_id, string_agg(value, '|' ORDER BY value) AS combo FROM an WHERE facet <> 'person_mention' GROUP BY event_id)
SELECT event_id, value FROM an WHERE facet = 'topic' AND event_id NOT IN (SELECT event_id FROM c WHERE combo IN (SELECT combo FROM c GROUP BY combo HAVING count(*) >= 40))""")
def topics_without_artifacts(t: Tables) -> DataFrame:
    """Topics of events without those that carry a combination which a batch stamped on very many."""
    return store.without_artifacts(t.store("an").filter("facet <> 'person_mention'").select("event_id", "facet", "value"), 40).filter("facet = 'topic'").select("event_id", "value")
