"""Named searches, people's standing, tasks and actions (survey 2.3-2.5, 2.7, 2.9, 2.14, 2.16, 2.18-2.22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import joins, scout, store
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

DAY = 86400


def _scouted(t: Tables) -> dict[str, DataFrame]:
    events = t.store("rw").select("event_id", "source", "ts", "thread_id", F.col("a").alias("person_id"), F.concat_ws(" ", "subject", "body").alias("text"))
    what = F.concat(F.lit("Order "), F.col("claim_id").cast("string"), F.when(F.col("claim_id") % 3 == 0, " for Lunch").otherwise(""))
    return {"events": events, "now": t.now, "persons": t.store("pe"), "commitments": t.claims.withColumn("what", what)}


@query("SELECT event_id, source, ts FROM rw, clock WHERE ts >= now - 10 * 86400 AND source = 'mail' AND k % 8 = 2 ORDER BY ts DESC, event_id DESC LIMIT 20")
def scout_events(t: Tables) -> DataFrame:
    return scout.execute(_scouted(t), {"tool": "search_events", "args": {"query": "LUNCH", "days": 10, "source": "mail"}})


@query("SELECT claim_id, 'Order ' || claim_id || ' for Lunch' AS what, confidence FROM cl WHERE status = 'open' AND claim_id % 3 = 0 ORDER BY confidence DESC, claim_id LIMIT 20")
def scout_commitments(t: Tables) -> DataFrame:
    return scout.execute(_scouted(t), {"tool": "search_commitments", "args": {"keyword": "lunch"}})


@query("SELECT event_id, source, ts FROM rw WHERE abs(ts - 1705000000) <= 6 * 3600 AND source = 'slack'")
def scout_around(t: Tables) -> DataFrame:
    return scout.execute(_scouted(t), {"tool": "temporal_xref", "args": {"at": 1705000000, "source": "slack", "window_hours": 6}})


@query("SELECT event_id, source, ts FROM rw WHERE thread_id = '33' ORDER BY ts DESC, event_id DESC LIMIT 20")
def scout_thread(t: Tables) -> DataFrame:
    return scout.execute(_scouted(t), {"tool": "get_thread", "args": {"thread": "33"}})


@query("""SELECT 'event' AS kind, event_id AS key FROM (SELECT event_id FROM rw, clock WHERE a = 7 AND ts >= now - 30 * 86400 ORDER BY ts DESC, event_id DESC LIMIT 15)
    UNION ALL SELECT 'commitment', claim_id FROM (SELECT claim_id FROM cl WHERE person_id = 7 AND status = 'open' ORDER BY confidence DESC, claim_id LIMIT 10)""")
def scout_person(t: Tables) -> DataFrame:
    return scout.execute(_scouted(t), {"tool": "person_context", "args": {"person": "customer#000000007"}})


@query("SELECT 'unknown tool: nothing' AS error")
def scout_error(t: Tables) -> DataFrame:
    """An error is a row."""
    return scout.execute(_scouted(t), {"tool": "nothing"})


@query("""SELECT 0 AS query, count(*) AS n FROM (SELECT event_id FROM rw WHERE thread_id = '33' LIMIT 10) HAVING count(*) > 0 UNION ALL SELECT 1, 1 UNION ALL SELECT 2, count(*) FROM (SELECT 1 FROM cl WHERE status = 'open' LIMIT 10)""")
def scout_batch(t: Tables) -> DataFrame:
    """Several queries at once, ten rows of each."""
    asked = [{"tool": "get_thread", "args": {"thread_id": "33"}}, {"tool": "get_thread"}, {"tool": "search_commitments"}]
    return scout.run_all(_scouted(t), asked).groupBy("query").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, name FROM (SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN ['Ann Lee'] WHEN 1 THEN ['Lee'] WHEN 2 THEN ['Ann Lee', 'Lee'] ELSE [] END) AS name FROM customer)""")
def names_found(t: Tables) -> DataFrame:
    """Names in texts, longest first, between characters that are no letters."""
    names = t.spark.createDataFrame([("Ann Lee",), ("Lee",), ("Mo",)], "name string")
    text = F.element_at(F.array(F.lit("to ANN  LEE, today"), F.lit("ask lee's list"), F.lit("Ann Lee and (Lee)"), F.lit("sleep annlee Leeds more")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return scout.names_in(t.read("customer").select(F.col("c_custkey").alias("id"), text.alias("text")), names)


@query("""SELECT claim_type, count(DISTINCT claim_id) AS claims, min(claim_id) AS first FROM (SELECT 'communication_frequency' AS claim_type, person_id FROM ev GROUP BY person_id UNION ALL SELECT 'communication_channel', person_id FROM ev GROUP BY person_id UNION ALL SELECT 'directionality', person_id FROM ev GROUP BY person_id HAVING count(*) >= 3) x,
    LATERAL (SELECT 'claim:' || substr(sha256(claim_type || ':' || person_id || ':with'), 1, 16) AS claim_id) GROUP BY claim_type""")
def stage_one_claims(t: Tables) -> DataFrame:
    """Claims that follow from events alone, with ids that their type, subject and predicate decide, so a second run adds none."""
    n = t.events.groupBy("person_id").agg(F.count("*").alias("n"))
    claim = lambda kind, df: df.select(F.lit(kind).alias("claim_type"), F.concat(F.lit("claim:"), F.substring(F.sha2(F.concat_ws(":", F.lit(kind), F.col("person_id").cast("string"), F.lit("with")), 256), 1, 16)).alias("claim_id"))
    c = claim("communication_frequency", n).unionByName(claim("communication_channel", n)).unionByName(claim("directionality", n.filter("n >= 3")))
    return c.groupBy("claim_type").agg(F.countDistinct("claim_id").alias("claims"), F.min("claim_id").alias("first"))


@query("""SELECT person_id, direct + CAST(floor(0.05 * grouped) AS BIGINT) AS effective, CASE WHEN direct + floor(0.05 * grouped) >= 50 THEN 1 WHEN direct + floor(0.05 * grouped) >= 20 THEN 2 WHEN direct + floor(0.05 * grouped) >= 5 THEN 3 ELSE 4 END AS tier
    FROM (SELECT person_id, count_if(NOT is_group)::BIGINT AS direct, count_if(is_group)::BIGINT AS grouped FROM ev GROUP BY person_id)""")
def claimed_profiles(t: Tables) -> DataFrame:
    """Tiers from counts, groups at a twentieth."""
    p = t.events.groupBy("person_id").agg(F.count_if(~F.col("is_group")).alias("direct"), F.count_if("is_group").alias("grouped"))
    e = F.col("direct") + F.floor(F.col("grouped") * 5 / 100)
    return p.select("person_id", e.alias("effective"), F.when(e >= 50, 1).when(e >= 20, 2).when(e >= 5, 3).otherwise(4).alias("tier"))


@query("""SELECT stage, claim_id FROM (SELECT claim_id, CASE WHEN status = 'done' THEN 'closed' WHEN deadline < day THEN 'overdue' WHEN created_at < now - 14 * 86400 THEN 'stale' WHEN priority = 1 THEN 'urgent' ELSE 'open' END AS stage, priority FROM cl, today)
    QUALIFY row_number() OVER (PARTITION BY stage ORDER BY priority, claim_id) <= 10""")
def recommended_actions(t: Tables) -> DataFrame:
    """Five groups by how things stand, the ten first of each."""
    c = t.claims.join(F.broadcast(t.today))
    stage = F.when(F.col("status") == "done", "closed").when(F.col("deadline") < F.col("day"), "overdue").when(F.col("created_at") < F.col("now") - 14 * DAY, "stale").when(F.col("priority") == 1, "urgent").otherwise("open")
    return joins.latest_per(c.withColumn("stage", stage), ["stage"], F.col("priority"), F.col("claim_id"), n=10).select("stage", "claim_id")


@query("""SELECT person_id, 3 * least(paths, 5) + CASE priority WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END + CASE WHEN d < 14 THEN 2 WHEN d < 30 THEN 1 ELSE 0 END AS score
    FROM (SELECT person_id, count(*) AS paths, min(priority) AS priority, min((SELECT max(created_at) FROM cl) - created_at) / 86400.0 AS d FROM cl GROUP BY person_id)""")
def scored_investors(t: Tables) -> DataFrame:
    """Warm paths, tier and recency in one number."""
    last = t.claims.agg(F.max("created_at").alias("last"))
    p = t.claims.join(F.broadcast(last)).groupBy("person_id").agg(F.count("*").alias("paths"), F.min("priority").alias("priority"), F.min((F.col("last") - F.col("created_at")) / DAY).alias("d"))
    tier = F.when(F.col("priority") == 1, 3).when(F.col("priority") == 2, 2).when(F.col("priority") == 3, 1).otherwise(0)
    return p.select("person_id", (F.least("paths", F.lit(5)) * 3 + tier + F.when(F.col("d") < 14, 2).when(F.col("d") < 30, 1).otherwise(0)).alias("score"))


@query("SELECT person_id, id_type, count(*) AS n FROM (SELECT person_id, id_type FROM pid WHERE id_type <> 'display_name' UNION ALL SELECT c_custkey, 'email' FROM customer WHERE c_custkey % 2 = 0) GROUP BY ALL")
def contact_identities(t: Tables) -> DataFrame:
    """An identity for each address and number of a contact."""
    key = F.col("c_custkey").cast("string")
    mails = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("a"), key, F.lit("@x.org")), F.concat(F.lit("b"), key, F.lit("@x.org")))).otherwise(F.array(F.concat(F.lit("a"), key, F.lit("@x.org"))))
    c = t.read("customer").select(F.col("c_custkey").alias("person_id"), mails.alias("emails"), F.array(F.concat(F.lit("555"), key)).alias("phones"))
    each = c.select("person_id", F.lit("email").alias("id_type"), F.explode("emails").alias("i")).unionByName(c.select("person_id", F.lit("phone").alias("id_type"), F.explode("phones").alias("i")))
    return each.groupBy("person_id", "id_type").agg(F.count("*").alias("n"))


@query("""SELECT thread, count(*) AS n, max(score) AS score, bool_or(a % 10 = 3) AS sensitive FROM (SELECT CASE WHEN source = 'imessage' AND k % 10 = 0 THEN 'contact:' || a WHEN k % 10 = 1 THEN 'single:' || event_id ELSE thread_id END AS thread, a, score FROM rw JOIN pr USING (event_id) WHERE score >= 0.5) GROUP BY thread""")
def candidate_threads(t: Tables) -> DataFrame:
    """Candidates by thread, else by the other party, else alone; sensitive if any of them names personal data."""
    e = t.store("rw").join(t.store("pr").filter("score >= 0.5").select("event_id", "score"), "event_id")
    thread = F.when((F.col("source") == "imessage") & (F.col("k") % 10 == 0), F.concat(F.lit("contact:"), F.col("a").cast("string"))).when(F.col("k") % 10 == 1, F.concat(F.lit("single:"), F.col("event_id").cast("string"))).otherwise(F.col("thread_id"))
    return e.groupBy(thread.alias("thread")).agg(F.count("*").alias("n"), F.max("score").alias("score"), F.bool_or(F.col("a") % 10 == 3).alias("sensitive"))


@query("""SELECT belief_id FROM be WHERE belief_type = 'fact' QUALIFY row_number() OVER (PARTITION BY subject, status ORDER BY confidence DESC, belief_id) = 1""")
def beliefs_across_groups(t: Tables) -> DataFrame:
    """Of facts about one subject the surest."""
    return joins.latest_per(store.find(t.store("be"), belief_type="fact"), ["subject", "status"], F.desc("confidence"), F.col("belief_id")).select("belief_id")


@query("""SELECT a.claim_id, count(b.claim_id) AS collisions FROM (SELECT * FROM cl WHERE status = 'open' AND priority = 1) a LEFT JOIN (SELECT * FROM cl WHERE status = 'open' AND priority = 1) b ON b.person_id = a.person_id AND b.claim_id <> a.claim_id AND abs(b.created_at - a.created_at) <= 86400 GROUP BY a.claim_id""")
def deadline_collisions(t: Tables) -> DataFrame:
    """How many other urgent commitments of the same person fall within a day of each."""
    c = t.claims.filter("status = 'open' and priority = 1")
    a, b = c.select("claim_id", "person_id", F.col("created_at").alias("t0")), c.select(F.col("claim_id").alias("other"), "person_id", F.col("created_at").alias("t1"))
    near = joins.band_join(a, b, "t0", "t1", DAY, ("person_id",)).filter("claim_id <> other").groupBy("claim_id").agg(F.count("*").alias("collisions"))
    return a.select("claim_id").join(near, "claim_id", "left").select("claim_id", F.coalesce("collisions", F.lit(0)).alias("collisions"))


@query("SELECT person_id, count(*) AS edges, count(*) > 100 AS noisy FROM ep GROUP BY person_id")
def noisy_people(t: Tables) -> DataFrame:
    """People with so many edges that they are more likely a list."""
    return t.event_persons.groupBy("person_id").agg(F.count("*").alias("edges")).withColumn("noisy", F.col("edges") > 100)


@query("SELECT id_type, identifier FROM pid WHERE person_id IN (SELECT person_id FROM pe WHERE is_user)")
def user_identity(t: Tables) -> DataFrame:
    return t.store("pid").join(t.store("pe").filter("is_user"), "person_id", "left_semi").select("id_type", "identifier")


@query("SELECT status, priority, count(*) AS n, count_if(deadline < day)::BIGINT AS overdue FROM cl, today GROUP BY ALL")
def workstreams(t: Tables) -> DataFrame:
    return t.claims.join(F.broadcast(t.today)).groupBy("status", "priority").agg(F.count("*").alias("n"), F.count_if(F.col("deadline") < F.col("day")).alias("overdue"))


@query("SELECT category, count(*) AS n, count_if(urgent)::BIGINT AS urgent, count_if(high_impact)::BIGINT AS sensitive FROM (SELECT coalesce(category, -1) AS category, urgent, high_impact FROM rw WHERE source = 'mail') GROUP BY category")
def mail_categories(t: Tables) -> DataFrame:
    e = store.find(t.store("rw"), source="mail").groupBy(F.coalesce("category", F.lit(-1)).alias("category"))
    return e.agg(F.count("*").alias("n"), F.count_if("urgent").alias("urgent"), F.count_if("high_impact").alias("sensitive"))


@query("""SELECT claim_id, d < 0 AND (claim_id % 4 = 0 OR claim_id % 3 = 0) AS stale FROM (SELECT claim_id, CAST(deadline AS DATE) - CAST(day AS DATE) AS d FROM cl, today)""")
def stale_tasks(t: Tables) -> DataFrame:
    """Tasks a day or more past that were bound to their time: appointments, and what begins with a verb of going."""
    c = t.claims.join(F.broadcast(t.today)).withColumn("d", F.date_diff(F.to_date("deadline"), F.to_date("day")))
    channel, what = F.when(F.col("claim_id") % 4 == 0, "calendar").otherwise("mail"), F.when(F.col("claim_id") % 3 == 0, "Attend the fair").otherwise("write a note")
    return c.select("claim_id", ((F.col("d") < 0) & ((channel == "calendar") | F.lower(what).rlike("^(attend|join|meet|call|visit|go to|pick up)"))).alias("stale"))


@query("SELECT belief_id FROM be WHERE belief_type = 'fact' AND status = 'active' AND confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM cl WHERE claim_id = claim_b AND status = 'open') ORDER BY confidence DESC, belief_id LIMIT 50")
def belief_tasks(t: Tables) -> DataFrame:
    """Facts that become tasks: sure ones that don't come from an open commitment."""
    b = store.find(t.store("be").filter("confidence >= 0.6"), belief_type="fact", status="active")
    still = t.claims.filter("status = 'open'").select(F.col("claim_id").alias("claim_b"))
    return b.join(still, "claim_b", "left_anti").orderBy(F.desc("confidence"), "belief_id").limit(50).select("belief_id")


@query("SELECT bucket, done, count(*) AS n FROM tk GROUP BY ALL")
def desk_overview(t: Tables) -> DataFrame:
    return t.store("tk").groupBy("bucket", "done").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT task_id, thread_id FROM tk JOIN ce ON claim_id = task_id JOIN ev USING (event_id) WHERE task_id = 33")
def thread_of_task(t: Tables) -> DataFrame:
    """From a task to its claim, events and threads."""
    k = store.find(t.store("tk"), task_id=33).select("task_id").join(t.claim_events.withColumnRenamed("claim_id", "task_id"), "task_id")
    return k.join(t.events.select("event_id", "thread_id"), "event_id").select("task_id", "thread_id").distinct()


@query("SELECT claim_id, CASE WHEN claim_id % 50 = 0 THEN 'done' ELSE status END AS status FROM cl")
def resolved_claims(t: Tables) -> DataFrame:
    """Claims after the tasks that came from some of them were done."""
    done = t.claims.filter("claim_id % 50 = 0").select("claim_id", F.lit("done").alias("now"))
    return t.claims.join(done, "claim_id", "left").select("claim_id", F.coalesce("now", "status").alias("status"))


@query("SELECT task_id, coalesce(CASE WHEN task_id % 9 = 0 THEN story_id + 1 END, story_id) AS story_id FROM tk")
def merged_assignments(t: Tables) -> DataFrame:
    """Members of stories after new assignments; a task that was assigned anew moves."""
    k = t.store("tk").select("task_id", "story_id")
    new = k.filter("task_id % 9 = 0").select("task_id", (F.col("story_id") + 1).alias("to"))
    return k.join(new, "task_id", "left").select("task_id", F.coalesce("to", "story_id").alias("story_id"))


@query("""SELECT word, belief_id FROM (SELECT unnest(['fact', 'relation', 'entity']) AS word) JOIN be ON belief_type = word QUALIFY row_number() OVER (PARTITION BY word ORDER BY confidence DESC, belief_id) <= 5""")
def beliefs_by_keyword(t: Tables) -> DataFrame:
    """For each keyword the five surest beliefs that have it."""
    words = F.array(F.lit("fact"), F.lit("relation"), F.lit("entity"))
    b = t.store("be").withColumn("said", F.concat(F.lit("a "), F.col("belief_type"), F.lit(" about "), F.col("subject").cast("string")))
    met = b.withColumn("word", F.explode(F.filter(words, lambda w: F.col("said").contains(w))))
    return joins.latest_per(met, ["word"], F.desc("confidence"), F.col("belief_id"), n=5).select("word", "belief_id")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN '' ELSE 'Ann Lee' END AS person, CASE c_custkey % 4 WHEN 0 THEN 'Blue Fund' WHEN 1 THEN 'Blue Fund' WHEN 2 THEN '' ELSE 'Blue Fund' END AS firm FROM customer")
def parsed_prospects(t: Tables) -> DataFrame:
    """Who and which firm a line names: "name at firm", "name (firm)", a name, or "at firm"."""
    raw = F.element_at(F.array(F.lit("Ann Lee at Blue Fund"), F.lit(" Ann Lee  (Blue Fund)"), F.lit("Ann Lee"), F.lit("@ Blue Fund")), (F.col("c_custkey") % 4 + 1).cast("int"))
    person = F.trim(F.regexp_extract(raw, r"^([^(@]*?)(\s+at\s+.*|\s*\(.*|\s*@.*)?$", 1))
    firm = F.trim(F.coalesce(F.nullif(F.regexp_extract(raw, r"(?:\sat\s+|@\s*)(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"\(([^)]*)\)", 1), F.lit("")), F.lit("")))
    return t.read("customer").select("c_custkey", person.alias("person"), firm.alias("firm"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' OR role = 'system'")
def pending_messages(t: Tables) -> DataFrame:
    """Messages for one reader or for all."""
    return t.read("conversations").filter(F.col("role").isin("user", "system")).select("conv_id", "turn")


@query("SELECT person_id, count(DISTINCT event_id) AS events, count(DISTINCT source) AS sources, max(ts) AS last FROM ep JOIN (SELECT event_id, source, ts FROM ev, clock WHERE ts >= now - 30 * 86400) USING (event_id) GROUP BY person_id")
def people_lately(t: Tables) -> DataFrame:
    """What was going on with each person in the last thirty days."""
    e = t.events.join(F.broadcast(t.now)).filter(f"ts >= now - 30 * {DAY}").select("event_id", "source", "ts")
    return t.event_persons.join(e, "event_id").groupBy("person_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("source").alias("sources"), F.max("ts").alias("last"))


@query("""SELECT m.event_id AS meeting, count(DISTINCT c.claim_id) AS commitments FROM ev m JOIN ep USING (event_id) JOIN cl c ON c.person_id = ep.person_id AND c.status = 'open' WHERE m.source = 'calendar' GROUP BY m.event_id""")
def matched_commitments(t: Tables) -> DataFrame:
    """Open commitments of those who attend each meeting."""
    m = t.events.filter("source = 'calendar'").select("event_id")
    who = m.join(t.event_persons, "event_id").select(F.col("event_id").alias("meeting"), "person_id").distinct()
    own = t.claims.filter("status = 'open'").groupBy("person_id").agg(F.count("*").alias("n"))
    return who.join(own, "person_id").groupBy("meeting").agg(F.sum("n").alias("commitments"))
