"""Evidence checks, beliefs, summaries, privacy and quality (survey 2.15-2.23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators import evidence, privacy, store
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

DAY = 86400


def _pick(n: int, *values):
    """values in turn by a number."""
    return F.element_at(F.array(*(F.lit(v) if not hasattr(v, "alias") else v for v in values)), (F.col("claim_id") % n + 1).cast("int"))


@query("SELECT claim_id, claim_id % 4 IN (0, 1, 2) AS found FROM cl")
def supported_quotes(t: Tables) -> DataFrame:
    """Quotes as they stand in their source but for case and spaces, with a word changed, with two words left out, and from elsewhere."""
    key = F.col("claim_id").cast("string")
    source = F.concat(F.lit("Hello all. We will send the signed contract for order "), key, F.lit(" to the supplier by Friday, and call them."))
    quote = _pick(4, F.concat(F.lit("send THE  signed contract, for order "), key), F.lit("send the signed contracts for order to the supplier"), F.lit("we send the contract for order"), F.lit("zebra moon quartz jigsaw"))
    spread = t.claims.select("claim_id").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "claim_id")  # a file may be one task; AQE would join so short rows again
    return evidence.supported(spread.select("claim_id", quote.alias("quote"), source.alias("source")), "claim_id").select("claim_id", "found")


@query("SELECT claim_id FROM cl WHERE claim_id % 4 < 3 OR confidence >= 0.7")
def believable_commitments(t: Tables) -> DataFrame:
    """Commitments with a quote that is found, or sure enough without."""
    key = F.col("claim_id").cast("string")
    c = t.claims.select("claim_id", "confidence", F.when(F.col("claim_id") % 4 < 3, F.concat(F.lit("pay bill "), key)).alias("quote"), F.concat(F.lit("please pay bill "), key, F.lit(" today")).alias("source"))
    return c.join(evidence.supported(c, "claim_id"), "claim_id").filter("found or confidence >= 0.7").select("claim_id")


@query("SELECT doc_id, doc_id % 3 = 0 AND length(text) >= 30 AS holds FROM documents WHERE text IS NOT NULL")
def evidence_spans(t: Tables) -> DataFrame:
    """Whether the characters that a claim points to are the quote it gives."""
    d = t.read("documents").filter("text is not null")
    k, first = F.col("doc_id") % 3, F.lit(10)
    quote = F.when(k == 0, F.regexp_replace(F.substring("text", 11, 20), " ", " \n ")).when(k == 1, "something else").otherwise(F.substring("text", 11, 20))
    return d.select("doc_id", evidence.span_holds(F.col("text"), F.when(k == 2, -1).otherwise(first), F.when(k == 2, 5).otherwise(first + 20), quote).alias("holds"))


@query("SELECT claim_id, claim_id % 3 = 0 AS is_vague, claim_id % 5 IN (0, 1) OR (claim_id % 5 = 2 AND claim_id % 2 = 0) AS is_commitment, (claim_id % 2 = 0)::INT + (claim_id % 3 = 0)::INT + (claim_id % 5 = 0)::INT >= 2 AS sure FROM cl")
def commitment_filters(t: Tables) -> DataFrame:
    """Vague actions, speech acts that commit nobody, and items of which too few of four tests hold."""
    c = t.claims.select("claim_id", _pick(3, "  Look into the offer", "Send the offer", "please explore it").alias("what"), _pick(5, "promise", "decision", "delegation", "inform", "chat").alias("act"), _pick(2, "user", "ann").alias("who"))
    c = c.withColumns({"f1": F.col("claim_id") % 2 == 0, "f2": F.col("claim_id") % 3 == 0, "f3": F.col("claim_id") % 5 == 0, "f4": F.lit(None).cast("boolean")})
    return c.select("claim_id", evidence.vague(F.col("what")).alias("is_vague"), evidence.commits(F.col("act"), F.col("who")).alias("is_commitment"), evidence.sure_enough(["f1", "f2", "f3", "f4"]).alias("sure"))


@query("SELECT claim_id FROM cl WHERE claim_id % 4 <> 1")
def answered_commitments(t: Tables) -> DataFrame:
    """Commitments but those that only go on with a discussion."""
    return t.claims.select("claim_id", _pick(4, "accepted", "continued_discussion", "declined", None).alias("response")).filter("response is null or response <> 'continued_discussion'").select("claim_id")


@query("SELECT claim_id, best AS superseded_by FROM (SELECT claim_id, first_value(claim_id) OVER (PARTITION BY person_id, priority, status ORDER BY confidence DESC, claim_id) AS best FROM cl) WHERE best <> claim_id")
def superseded_commitments(t: Tables) -> DataFrame:
    """Commitments that say the same as a surer one."""
    return evidence.superseded(t.claims, ["person_id", "priority", "status"])


@query("SELECT DISTINCT claim_id FROM cl JOIN ce USING (claim_id) JOIN ev USING (event_id), today WHERE status = 'open' AND deadline < day AND ts > created_at + 86400")
def completed_candidates(t: Tables) -> DataFrame:
    """Overdue commitments with later evidence: those that are worth asking about."""
    c = t.claims.filter("status = 'open'").join(F.broadcast(t.today)).filter("deadline < day").select("claim_id", "created_at")
    return c.join(t.claim_events, "claim_id").join(t.events.select("event_id", "ts"), "event_id").filter(f"ts > created_at + {DAY}").select("claim_id").distinct()


@query("SELECT DISTINCT claim_id, thread_id FROM cl JOIN ce USING (claim_id) JOIN ev USING (event_id) WHERE thread_id = '12'")
def commitments_of_thread(t: Tables) -> DataFrame:
    e = store.find(t.events, thread_id="12").select("event_id", "thread_id")
    return t.claim_events.join(e, "event_id").join(t.claims.select("claim_id"), "claim_id").select("claim_id", "thread_id").distinct()


@query("""SELECT person_id, CASE WHEN ch >= 3 AND person_id % 2 = 0 THEN 'multi_channel_contact' WHEN mine > 0.7 THEN 'user_initiates_with' WHEN mine < 0.3 THEN 'receives_from' ELSE 'communicates_with' END AS relation
    FROM (SELECT person_id, count(DISTINCT source) AS ch, avg(is_from_me::INT) AS mine FROM ev GROUP BY person_id)""")
def relation_beliefs(t: Tables) -> DataFrame:
    """How the user stands to each person, from channels and direction; channels are known for every other person here."""
    p = t.events.groupBy("person_id").agg(F.countDistinct("source").alias("ch"), F.avg(F.col("is_from_me").cast("int")).alias("mine"))
    return p.select("person_id", evidence.relation_type(F.when(F.col("person_id") % 2 == 0, F.col("ch")).otherwise(1), F.col("mine")).alias("relation"))


@query("""SELECT claim_id, CASE claim_id % 8 WHEN 0 THEN 'Reservation at Inn on ' || d || ' at ?' WHEN 1 THEN 'Travel to Rome on ' || d WHEN 2 THEN 'Dr Lee on ' || d WHEN 3 THEN 'Appt with Dr Lee on ' || d WHEN 4 THEN 'Swim on ?'
    WHEN 5 THEN 'Swim at Lake on ' || d WHEN 6 THEN 'Max at Inn on ' || d ELSE 'as said' END AS summary, CASE WHEN claim_id % 16 < 12 THEN CAST(epoch(CAST(deadline AS DATE)) AS BIGINT) + 3 * 86400 ELSE -1 END AS expires
    FROM (SELECT *, CASE WHEN claim_id % 16 < 12 THEN deadline ELSE '?' END AS d FROM cl)""")
def logistics_facts(t: Tables) -> DataFrame:
    """One line for each kind of fact, and when it expires."""
    date = F.when(F.col("claim_id") % 16 < 12, F.col("deadline"))
    fields = {"venue": F.lit("Inn"), "destination": F.lit("Rome"), "provider": F.lit("Dr Lee"), "name": F.lit("Swim"), "location": F.lit("Lake"), "child": F.lit("Max"), "facility": F.lit("Inn"), "summary": F.lit("as said"), "date": date}
    get = lambda name: fields.get(name, F.lit(None).cast("string"))
    kind = _pick(8, "reservation", "travel", "care_provider", "appointment", "activity", "outing", "childcare", "other")
    return t.claims.select("claim_id", evidence.logistics_summary(kind, get).alias("summary"), F.coalesce(evidence.logistics_expiry(date), F.lit(-1)).alias("expires"))


@query("""SELECT person_id, kind, surest FROM (SELECT person_id, priority AS kind, max(confidence) AS surest, count(*) AS n FROM cl WHERE status = 'open' GROUP BY ALL)""")
def logistics_beliefs(t: Tables) -> DataFrame:
    """Of facts of one kind about one person the surest."""
    return t.claims.filter("status = 'open'").groupBy("person_id", F.col("priority").alias("kind")).agg(F.max("confidence").alias("surest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'N' || p_partkey || ' One' ELSE 'twin' END AS whole FROM part WHERE p_partkey % 3 < 2")
def first_names(t: Tables) -> DataFrame:
    """First names completed where one close person bears them; two bear the other one."""
    p, key = t.read("part"), F.col("p_partkey").cast("string")
    persons = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("N"), key, F.lit(" One")).alias("name"), F.lit(1).alias("tier"))
    persons = persons.unionByName(p.filter("p_partkey < 2").select(F.concat(F.lit("Twin "), key).alias("name"), F.lit(2).alias("tier"))).unionByName(p.select(F.concat(F.lit("n"), key, F.lit(" far")).alias("name"), F.lit(3).alias("tier")))
    asked = p.filter("p_partkey % 3 < 2").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("n"), key)).otherwise("twin").alias("name"))
    return evidence.first_names(persons, asked).select("p_partkey", F.col("full").alias("whole"))


@query("""SELECT person_id AS person, tier, string_agg(context, '; ' ORDER BY c DESC, context) AS contexts FROM (SELECT person_id, priority AS tier, 'context ' || (claim_id % 3) AS context, max(confidence) AS c FROM cl GROUP BY ALL)
    WHERE (person_id, tier) IN (SELECT person_id, min(priority) FROM cl GROUP BY person_id) GROUP BY ALL""")
def relational_contexts(t: Tables) -> DataFrame:
    c = t.claims.select(F.col("person_id").alias("person"), F.col("priority").alias("tier"), "confidence", F.concat(F.lit("context "), (F.col("claim_id") % 3).cast("string")).alias("context"))
    return evidence.joined_contexts(c)


@query("SELECT DISTINCT thread_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM ce)")
def fresh_threads(t: Tables) -> DataFrame:
    """Threads with an event that no claim cites yet."""
    bundles = t.events.select("thread_id", "event_id")
    return evidence.fresh_bundles(bundles, t.claim_events.join(bundles, "event_id"))


@query("""SELECT thread_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS events, max(score) AS score FROM ev JOIN pr USING (event_id) WHERE thread_id IN ('3', '8') GROUP BY thread_id""")
def rebuilt_bundles(t: Tables) -> DataFrame:
    """Two threads' events in order, with the highest score of their triage."""
    e = t.events.filter(F.col("thread_id").isin("3", "8")).join(t.store("pr").select("event_id", "score"), "event_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return e.groupBy("thread_id").agg(ids.alias("events"), F.max("score").alias("score"))


@query("SELECT event_id, CASE WHEN value = 'topic 3' THEN 'topic 4' ELSE value END AS value FROM an WHERE facet = 'topic' AND value <> 'topic 5'")
def corrected_topics(t: Tables) -> DataFrame:
    """Topics after corrections: one renamed, one taken back."""
    fixes = t.spark.createDataFrame([("topic 3", "topic 4"), ("topic 5", None)], "wrong string, right string")
    a = store.find(t.store("an"), facet="topic").join(F.broadcast(fixes), F.col("value") == F.col("wrong"), "left")
    return a.filter("wrong is null or right is not null").select("event_id", F.coalesce("right", "value").alias("value"))


@query("""SELECT meet_id AS event_id, m.person_id, CASE WHEN o >= 0.9 THEN 2 WHEN o >= 0.5 THEN 3 ELSE 4 END AS credibility FROM (SELECT m.event_id AS meet_id, m.person_id, max(least(c.ts + 60 + floor(c.amount), m.ts + 1800) - greatest(c.ts, m.ts)) / 1800.0::DOUBLE AS o
    FROM ev m JOIN ev c ON m.source = 'calendar' AND c.source = 'whatsapp' AND c.person_id = m.person_id AND least(c.ts + 60 + floor(c.amount), m.ts + 1800) - greatest(c.ts, m.ts) > 0 GROUP BY ALL) m""")
def inferred_attendees(t: Tables) -> DataFrame:
    """People who called during a meeting, and how far to believe that they took part."""
    from tidemark.operators import joins

    e = t.events
    meet = e.filter("source = 'calendar'").select(F.col("event_id").alias("meet"), "person_id", F.col("ts").alias("m0"), F.expr("ts + 1800").alias("m1"))
    call = e.filter("source = 'whatsapp'").select(F.col("event_id").alias("call"), "person_id", F.col("ts").alias("c0"), F.expr("ts + 60 + floor(amount)").alias("c1"))
    o = joins.overlap_join(meet, call, ("m0", "m1"), ("c0", "c1"), 0, 3600, ("person_id",)).filter("overlap > 0").groupBy(F.col("meet").alias("event_id"), "person_id").agg((F.max("overlap") / 1800.0).alias("o"))
    return o.select("event_id", "person_id", F.when(F.col("o") >= 0.9, 2).when(F.col("o") >= 0.5, 3).otherwise(4).alias("credibility"))


@query("""SELECT source, day, n, (sum(n) OVER (PARTITION BY source))::BIGINT AS total FROM (SELECT source, ts // 86400 AS day, count(*) AS n FROM ev, clock WHERE ts > now - 7 * 86400 GROUP BY ALL)""")
def ambient_sources(t: Tables) -> DataFrame:
    """What each source brought a day in the last week, and in all."""
    d = t.events.join(F.broadcast(t.now)).filter(f"ts > now - 7 * {DAY}").groupBy("source", F.floor(F.col("ts") / DAY).alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.partitionBy("source")))


@query("SELECT belief_type, status, count(*) AS n FROM be GROUP BY ALL")
def belief_counts(t: Tables) -> DataFrame:
    return t.store("be").groupBy("belief_type", "status").agg(F.count("*").alias("n"))


@query("""SELECT person_id, n, now - last AS silent FROM (SELECT person_id, count(*) AS n, max(ts) AS last FROM ev GROUP BY person_id), clock WHERE n >= 50 AND now - last > 43200""")
def silent_contacts(t: Tables) -> DataFrame:
    """Close people who have gone silent."""
    p = t.events.groupBy("person_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).join(F.broadcast(t.now))
    return p.filter("n >= 50 and now - last > 43200").select("person_id", "n", F.expr("now - last").alias("silent"))


@query("""SELECT e.thread_id, max(e.ts) >= any_value(now) - 86400 AS active FROM ev e, clock GROUP BY e.thread_id""")
def active_threads(t: Tables) -> DataFrame:
    e = t.events.join(F.broadcast(t.now))
    return e.groupBy("thread_id").agg((F.max("ts") >= F.max("now") - DAY).alias("active"))


@query("SELECT belief_id, subject, confidence, subject % 5 = 0 AS bleeds FROM be WHERE belief_type = 'relation' AND status = 'active' ORDER BY bleeds DESC, confidence DESC, belief_id LIMIT 15")
def top_relations(t: Tables) -> DataFrame:
    """The surest relations, those across spheres of life first."""
    b = t.store("be").filter("belief_type = 'relation' and status = 'active'").withColumn("bleeds", F.col("subject") % 5 == 0)
    return b.orderBy(F.desc("bleeds"), F.desc("confidence"), "belief_id").limit(15).select("belief_id", "subject", "confidence", "bleeds")


@query("""SELECT strftime(make_timestamp((ts // 86400) * 86400000000), '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT person_id) AS people, count_if(source = 'calendar')::BIGINT AS meetings FROM ev GROUP BY 1""")
def day_contexts(t: Tables) -> DataFrame:
    day = F.date_format(F.timestamp_seconds(F.floor(F.col("ts") / DAY) * DAY), "yyyy-MM-dd").alias("day")
    return t.events.groupBy(day).agg(F.count("*").alias("events"), F.countDistinct("person_id").alias("people"), F.count_if(F.col("source") == "calendar").alias("meetings"))


@query("""SELECT person_id, 'P' || person_id || ' (' || n || ' events, ' || s || ')' AS line FROM (SELECT person_id, count(*) AS n, string_agg(DISTINCT source, '+' ORDER BY source) AS s FROM ev GROUP BY person_id)""")
def compact_contacts(t: Tables) -> DataFrame:
    p = t.events.groupBy("person_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("s"))
    return p.select("person_id", F.format_string("P%d (%d events, %s)", "person_id", "n", "s").alias("line"))


@query("SELECT event_id, coalesce(name, 'unknown') AS sender FROM ev LEFT JOIN (SELECT event_id, any_value(name) AS name FROM ep JOIN pe USING (person_id) WHERE role = 'sender' GROUP BY event_id) USING (event_id)")
def sender_names(t: Tables) -> DataFrame:
    s = t.event_persons.filter("role = 'sender'").join(t.store("pe").select("person_id", "name"), "person_id").groupBy("event_id").agg(F.min("name").alias("name"))
    return t.events.select("event_id").join(s, "event_id", "left").select("event_id", F.coalesce("name", F.lit("unknown")).alias("sender"))


@query("""SELECT claim_id, e.event_id, e.ts FROM cl JOIN ev e ON e.source = 'mail' AND abs(e.ts - (SELECT now FROM clock)) <= 86400 AND e.person_id = cl.person_id WHERE status = 'open' AND priority <= 2""")
def dated_events(t: Tables) -> DataFrame:
    """Mail within a day of a date, for each urgent commitment of its sender."""
    e = t.events.filter("source = 'mail'").join(F.broadcast(t.now)).filter(f"abs(ts - now) <= {DAY}").select("event_id", "ts", "person_id")
    return t.claims.filter("status = 'open' and priority <= 2").select("claim_id", "person_id").join(e, "person_id").select("claim_id", "event_id", "ts")


@query("SELECT claim_id, CAST(deadline AS DATE) - CAST(day AS DATE) AS days, deadline < day AS overdue FROM cl, today WHERE status = 'open'")
def deadline_days(t: Tables) -> DataFrame:
    c = t.claims.filter("status = 'open'").join(F.broadcast(t.today))
    return c.select("claim_id", F.date_diff(F.to_date("deadline"), F.to_date("day")).cast("long").alias("days"), (F.col("deadline") < F.col("day")).alias("overdue"))


@query("SELECT claim_id, created_at FROM cl WHERE status <> 'open' AND created_at >= (SELECT max(created_at) FROM cl) - 30 * 86400 ORDER BY created_at DESC, claim_id LIMIT 20")
def recently_resolved(t: Tables) -> DataFrame:
    last = t.claims.agg(F.max("created_at").alias("last"))
    c = t.claims.filter("status <> 'open'").join(F.broadcast(last)).filter(f"created_at >= last - 30 * {DAY}")
    return c.orderBy(F.desc("created_at"), "claim_id").limit(20).select("claim_id", "created_at")


@query("SELECT event_id, string_agg(facet || '=' || value, ',' ORDER BY facet, value) AS facets FROM an GROUP BY event_id")
def event_facets(t: Tables) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("facet", "value")))
    return t.store("an").groupBy("event_id").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["facet"], F.lit("="), x["value"])), ",").alias("facets"))


@query("SELECT domain, count(*) AS claims, round(avg((n > 0)::INT), 4) AS visible FROM (SELECT claim_id, 'priority ' || priority AS domain, count(e.event_id) AS n FROM cl LEFT JOIN ce USING (claim_id) LEFT JOIN ev e ON e.event_id = ce.event_id AND e.amount > 20 GROUP BY ALL) GROUP BY domain")
def visibility_index(t: Tables) -> DataFrame:
    """For each kind of commitment the share that some event bears witness to."""
    e = t.claim_events.join(t.events.filter("amount > 20").select("event_id"), "event_id", "left_semi").select("claim_id").distinct().withColumn("seen", F.lit(1))
    c = t.claims.join(e, "claim_id", "left").groupBy(F.concat(F.lit("priority "), F.col("priority").cast("string")).alias("domain"))
    return c.agg(F.count("*").alias("claims"), F.round(F.avg(F.coalesce("seen", F.lit(0))), 4).alias("visible"))


@query("SELECT claim_id, CASE WHEN deadline IS NULL THEN true ELSE CAST(deadline AS DATE) - CAST(day AS DATE) BETWEEN -14 AND 90 END AS relevant FROM (SELECT claim_id, CASE WHEN claim_id % 6 > 0 THEN deadline END AS deadline FROM cl), today")
def relevant_tasks(t: Tables) -> DataFrame:
    """Tasks due from a fortnight ago to a quarter ahead, or without a date."""
    d = F.when(F.col("claim_id") % 6 > 0, F.col("deadline"))
    days = F.date_diff(F.to_date(d), F.to_date("day"))
    return t.claims.join(F.broadcast(t.today)).select("claim_id", F.coalesce(days.between(-14, 90), F.lit(True)).alias("relevant"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) OR c_custkey % 5 = 4 THEN '' ELSE 'Ann <ann' || c_custkey || '@x.org>' END AS who FROM customer")
def cleaned_person_fields(t: Tables) -> DataFrame:
    """Names of persons in tasks: none for blanks, stand-ins and the user."""
    key = F.col("c_custkey").cast("string")
    raw = F.element_at(F.array(F.lit("  "), F.lit("Unknown"), F.concat(F.lit("Ann <ann"), key, F.lit("@x.org>")), F.concat(F.lit("Ann <ann"), key, F.lit("@x.org>")), F.lit("Me <ME@x.org>")), (F.col("c_custkey") % 5 + 1).cast("int"))
    inner = F.lower(F.trim(F.regexp_replace(raw, "<[^>]*>", "")))
    address = F.lower(F.regexp_extract(raw, "<([^>]*)>", 1))
    gone = (F.trim(raw) == "") | F.lower(F.trim(raw)).isin("unresolved", "unknown", "none") | inner.isin("me") | address.isin("me@x.org")
    return t.read("customer").select("c_custkey", F.when(gone, "").otherwise(raw).alias("who"))


@query("SELECT story_id, count(*) AS tasks, min(CASE bucket WHEN 'immediate' THEN 1 WHEN 'review' THEN 2 ELSE 3 END) AS priority, count(DISTINCT person_id) AS people, max(task_id) AS latest FROM tk GROUP BY story_id")
def story_heads(t: Tables) -> DataFrame:
    rank = F.when(F.col("bucket") == "immediate", 1).when(F.col("bucket") == "review", 2).otherwise(3)
    return t.store("tk").groupBy("story_id").agg(F.count("*").alias("tasks"), F.min(rank).alias("priority"), F.countDistinct("person_id").alias("people"), F.max("task_id").alias("latest"))


@query("SELECT task_id, CASE story_id WHEN 3 THEN 4 ELSE story_id END AS story_id FROM tk WHERE story_id <> 5 UNION ALL SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 1000 ELSE 5 END FROM tk WHERE story_id = 5")
def regrouped_stories(t: Tables) -> DataFrame:
    """Members after one story went into another and one was split."""
    to = F.when(F.col("story_id") == 3, 4).when((F.col("story_id") == 5) & (F.col("task_id") % 2 == 0), 1000).otherwise(F.col("story_id"))
    return t.store("tk").select("task_id", to.cast("long").alias("story_id"))


@query("SELECT count_if(status = 'open')::BIGINT AS open, count_if(status = 'open' AND deadline < day)::BIGINT AS overdue, count_if(status = 'open' AND priority = 1)::BIGINT AS urgent FROM cl, today")
def commitment_summary(t: Tables) -> DataFrame:
    still = F.col("status") == "open"
    c = t.claims.join(F.broadcast(t.today))
    return c.agg(F.count_if(still).alias("open"), F.count_if(still & (F.col("deadline") < F.col("day"))).alias("overdue"), F.count_if(still & (F.col("priority") == 1)).alias("urgent"))


@query("SELECT belief_id, belief_type, confidence FROM be WHERE status = 'active' AND confidence >= 0.6 ORDER BY CASE belief_type WHEN 'relation' THEN 0 WHEN 'fact' THEN 1 WHEN 'observation' THEN 2 ELSE 3 END, confidence DESC, belief_id LIMIT 10")
def notable_beliefs(t: Tables) -> DataFrame:
    rank = F.when(F.col("belief_type") == "relation", 0).when(F.col("belief_type") == "fact", 1).when(F.col("belief_type") == "observation", 2).otherwise(3)
    return store.find(t.store("be").filter("confidence >= 0.6"), 10, [rank, F.desc("confidence"), F.col("belief_id")], status="active").select("belief_id", "belief_type", "confidence")


@query("SELECT value AS category, count(DISTINCT event_id) AS events FROM an WHERE facet = 'sender_domain' GROUP BY value HAVING count(DISTINCT event_id) >= 5")
def suggested_categories(t: Tables) -> DataFrame:
    return store.find(t.store("an"), facet="sender_domain").groupBy(F.col("value").alias("category")).agg(F.countDistinct("event_id").alias("events")).filter("events >= 5")


@query("SELECT person_id, id_type, identifier, name FROM pid JOIN pe USING (person_id) WHERE identifier LIKE '%c12%' OR name ILIKE '%00012%' ORDER BY person_id, id_type, identifier LIMIT 20")
def people_found(t: Tables) -> DataFrame:
    p = t.store("pid").join(t.store("pe").select("person_id", "name"), "person_id").filter(F.col("identifier").contains("c12") | F.lower("name").contains("00012"))
    return p.orderBy("person_id", "id_type", "identifier").limit(20).select("person_id", "id_type", "identifier", "name")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'block' WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 < 2 THEN 'share' ELSE 'block' END WHEN doc_id % 4 = 1 THEN 'block' WHEN doc_id % 4 = 0 OR (doc_id % 4 = 2 AND doc_id % 5 = 0) THEN 'share' ELSE 'review' END AS decision FROM documents")
def event_decisions(t: Tables) -> DataFrame:
    """Whether events may be shared: by sensitivity, source, and words of business, of personal matters, and of meetings."""
    k = F.col("doc_id")
    text = F.element_at(F.array(F.lit("The new Roadmap of 2024"), F.lit("to my MOTHER about a roadmap"), F.lit("weekly sync"), F.lit("lunch")), (k % 4 + 1).cast("int"))
    source = F.when(k % 3 == 0, "whatsapp").when(k % 5 == 0, "calendar").otherwise("mail")
    return t.read("documents").select("doc_id", privacy.decision(text, source, F.when(k % 7 == 0, "medical"), meetings=True).alias("decision"))


@query("SELECT doc_id, 'pitch deck for [email], see [url] or https://github.com/x' AS summary FROM documents WHERE doc_id % 2 = 0")
def shared_projection(t: Tables) -> DataFrame:
    """What another role gets to see."""
    k = F.col("doc_id")
    text = F.when(k % 2 == 0, F.concat(F.lit("pitch deck for a.b+c"), k.cast("string"), F.lit("@mail.example.org, see http://x.org/"), k.cast("string"), F.lit(" or https://github.com/x"))).otherwise("nothing")
    d = t.read("documents").select("doc_id", text.alias("said"), F.lit("mail").alias("src"), F.lit("").alias("level"))
    return privacy.projected(d, "doc_id", "said", "src", "level")


@query("SELECT n_nationkey AS country_code, n_name AS source_name FROM nation")
def redacted_fields(t: Tables) -> DataFrame:
    """A table without the columns that metadata alone doesn't allow."""
    n = t.read("nation").select(F.col("n_nationkey").alias("country_code"), F.col("n_name").alias("source_name"), F.col("n_name").alias("body"), F.lit("x").alias("user_phone"), F.lit("y").alias("anything"))
    return privacy.redacted(n, privacy.highest(metadata=True))


@query("SELECT unnest(['email', 'body', 'inferred_role', 'source_name', 'else']) AS field, unnest([1, 2, 3, 0, 2]) AS level")
def field_levels(t: Tables) -> DataFrame:
    f = t.spark.createDataFrame([(x,) for x in ("email", "body", "inferred_role", "source_name", "else")], "field string")
    return f.select("field", privacy.field_level(F.col("field")).alias("level"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'quoted_reply' WHEN doc_id % 6 = 1 THEN 'attribution' WHEN doc_id % 6 = 2 THEN 'headers' WHEN doc_id % 6 = 3 THEN 'forwarded' WHEN doc_id % 6 = 4 THEN 'html' END AS leak FROM documents WHERE doc_id % 6 < 5""")
def body_leaks(t: Tables) -> DataFrame:
    """What a mail's body still holds of quotes, headers and markup."""
    cases = ["a\n> b\n> c", "hi\nOn Monday, Bo wrote:\nx", "x\nFrom: a\nSent: b\nTo: c\nSubject: d", "---------- Forwarded message ---------\nx", "x <div>y</div>", "> one line quoted, and on it goes"]
    body = F.element_at(F.array(*map(F.lit, cases)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.read("documents").select("doc_id", F.explode(tx.body_leaks(body)).alias("leak"))


@query("SELECT source, CASE WHEN amount > 100 THEN 3 WHEN amount > 20 THEN 2 ELSE 1 END AS level, count(*) AS n FROM ev GROUP BY ALL")
def sensitivity_levels(t: Tables) -> DataFrame:
    level = F.when(F.col("amount") > 100, 3).when(F.col("amount") > 20, 2).otherwise(1)
    return t.events.groupBy("source", level.alias("level")).agg(F.count("*").alias("n"))


@query("SELECT 'quality ' || quality AS issue, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1 ORDER BY n DESC, issue LIMIT 10")
def common_issues(t: Tables) -> DataFrame:
    """The ten commonest notes of reviewers, white space and case apart."""
    note = F.concat(F.when(F.col("doc_id") % 2 == 0, "  Quality ").otherwise("quality  "), F.col("quality").cast("string"))
    flat = F.trim(F.regexp_replace(F.lower(note), r"\s+", " "))
    return t.read("labels").filter("toxic = 1").groupBy(flat.alias("issue")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(10)


@query("SELECT doc_id, concat_ws(',', CASE WHEN quality <> doc_id % 2 THEN 'quality' END, CASE WHEN toxic <> doc_id % 3 % 2 THEN 'toxic' END) AS differ FROM labels")
def output_differences(t: Tables) -> DataFrame:
    """Fields in which an output differs from what was expected."""
    x = lambda name, want: F.when(F.col(name) != want, name)
    return t.read("labels").select("doc_id", F.concat_ws(",", x("quality", F.col("doc_id") % 2), x("toxic", F.col("doc_id") % 3 % 2)).alias("differ"))
