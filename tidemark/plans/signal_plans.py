"""Linking, facets, scores and triage of raw events (survey 2.8, 2.9, 2.11, 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import linking, scoring, triage
from tidemark.plans.bridge import Tables
from tidemark.plans.registry import query

def _raw(t: Tables) -> DataFrame:
    """Raw events with the strings that sources give for their participants: a person, another one, and the user."""
    pid = t.store("pid")
    mail, phone, name = (pid.filter(F.col("id_type") == k).select(F.col("person_id"), F.col("identifier").alias(k.removeprefix("display_"))) for k in ("email", "phone", "display_name"))
    names = name.join(mail, "person_id").join(phone, "person_id")
    e = t.store("rw")
    for x in "ab":
        e = e.join(names.select(F.col("person_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("name", "email", "phone"))), x)
    by_mail = F.array(F.concat(F.col("a_name"), F.lit(" <"), F.upper("a_email"), F.lit(">; CC: "), F.col("b_email")), F.lit("#team"), F.concat(F.lit("x <"), F.col("b_phone"), F.lit(">")))
    by_phone = F.array(F.concat(F.lit("  "), F.regexp_replace("a_phone", r"^(\+1)(\d{3})(\d{3})", "$1 ($2) $3-")), F.col("b_name"))
    named = F.array(F.col("a_name"), F.col("b_email"), F.lit("nobody@nowhere.org"), F.lit(""))
    who = F.when(F.col("source") == "mail", by_mail).when(F.col("source").isin("imessage", "whatsapp", "calls"), by_phone).otherwise(named)
    return e.withColumns({"participants": who, "recent": F.col("amount") > 20, "originated": F.col("k") % 2 == 0, "host": F.when(F.col("k") % 3 == 0, F.upper("b_email")).otherwise("z@z.org")})


_ROLES = """, r AS (SELECT *, amount > 20 AS recent, k % 2 = 0 AS originated FROM rw WHERE a IN (SELECT person_id FROM pe) AND b IN (SELECT person_id FROM pe)),
l AS (SELECT event_id, a AS person_id, CASE WHEN source = 'mail' THEN CASE WHEN a = 1 THEN NULL WHEN NOT is_from_me THEN 'sender' WHEN recent THEN 'recipient' END
        WHEN source IN ('imessage', 'whatsapp') THEN CASE WHEN a <> 1 AND NOT is_from_me THEN 'sender' END WHEN a = 1 THEN 'self' WHEN source = 'calls' THEN CASE WHEN originated THEN 'recipient' ELSE 'sender' END
        WHEN source = 'slack' THEN CASE WHEN is_from_me THEN 'recipient' ELSE 'sender' END ELSE 'attendee' END AS role FROM r
    UNION SELECT event_id, b, CASE WHEN source = 'mail' THEN CASE WHEN b <> 1 AND recent THEN 'cc' END WHEN source IN ('imessage', 'whatsapp') THEN NULL WHEN b = 1 THEN 'self'
        WHEN source = 'calls' THEN CASE WHEN originated THEN 'recipient' ELSE 'sender' END WHEN source = 'slack' THEN 'recipient' WHEN source = 'calendar' AND k % 3 = 0 THEN 'organizer' ELSE 'attendee' END FROM r
    UNION SELECT event_id, b, 'recipient' FROM r WHERE source = 'mail' AND b <> 1 AND recent
    UNION SELECT event_id, 1, 'self' FROM r WHERE source NOT IN ('mail', 'imessage', 'whatsapp'))
SELECT event_id, person_id, role FROM l WHERE role IS NOT NULL"""


@query(_ROLES)
def linked_persons(t: Tables) -> DataFrame:
    """Edges from participant strings of six kinds of sources: addresses in any case, phone numbers as written, names, groups and noise."""
    e = _raw(t).select("event_id", "source", "participants", "is_from_me", "recent", "originated", F.col("host").alias("organizer"))
    return linking.link(e, t.store("pid"), 1)


@query("""SELECT event_id, CASE k % 3 WHEN 0 THEN b ELSE a END AS person_id FROM rw WHERE source IN ('imessage', 'whatsapp') AND b IN (SELECT person_id FROM pe) AND a IN (SELECT person_id FROM pe)
    AND CASE k % 3 WHEN 0 THEN b ELSE a END <> 1 AND CASE k % 3 WHEN 0 THEN b <> a WHEN 1 THEN false ELSE is_from_me END""")
def group_mentions(t: Tables) -> DataFrame:
    """Members of a group whom a message names, but for its sender and the user."""
    e = t.store("rw").filter(F.col("source").isin("imessage", "whatsapp"))
    word = lambda x: F.concat(F.lit("ref"), F.lpad(F.col(x).cast("string"), 6, "0"))
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("ask "), F.upper(word("b")), F.lit(", not me"))).when(F.col("k") % 3 == 1, F.concat(F.lit("x"), word("a"))).otherwise(F.concat(word("a"), F.lit(" or c# will know")))
    persons = t.store("pe").select("person_id", F.concat(F.lit("c "), word("person_id")).alias("name"))
    messages = e.select("event_id", F.when(F.col("is_from_me"), F.lit(1).cast("long")).otherwise(F.col("a")).alias("sender"), said.alias("text"))
    members = e.select("event_id", F.explode(F.array("a", "b")).alias("person_id")).distinct()
    both = e.join(persons.select(F.col("person_id").alias("a")), "a", "left_semi").join(persons.select(F.col("person_id").alias("b")), "b", "left_semi").select("event_id")
    return linking.group_mentions(messages.join(both, "event_id"), members, persons, 1)


_FACETS = " UNION ALL ".join(
    f"SELECT event_id, '{facet}' AS facet, ({value})::VARCHAR AS value FROM rw WHERE source = '{source}' AND ({when})"
    for source, facet, value, when in [
        ("mail", "sender_domain", "CASE a % 9 WHEN 0 THEN 'shop.com' WHEN 1 THEN 'github.com' ELSE 'x.org' END", "a % 9 <> 2 AND NOT is_from_me"), ("mail", "is_automated", "true", "automated"), ("mail", "has_list_id", "true", "list_id"),
        ("mail", "email_category", "category", "category IS NOT NULL"), ("mail", "junk_level", "1", "junk_level = 1"), ("mail", "time_sensitive", "true", "high_impact"), ("mail", "is_noreply", "true", "noreply"),
        ("mail", "has_reply", "true", "replied"), ("mail", "is_from_me", "is_from_me", "true"), ("imessage", "is_filtered", "true", "is_filtered"), ("imessage", "delivered_quietly", "true", "delivered_quietly"),
        ("imessage", "is_auto_reply", "true", "is_auto_reply"), ("imessage", "is_from_me", "is_from_me", "true"), ("imessage", "is_group", "is_group", "true"), ("whatsapp", "is_group", "is_group", "true"),
        ("whatsapp", "group_size", "n_participants", "is_group"), ("whatsapp", "is_from_me", "is_from_me", "true"), ("whatsapp", "content_type", "CASE WHEN shared_document THEN 'document' ELSE 'url' END", "shared_document OR shared_url"),
        ("calendar", "calendar_noise", "calendar_type", "calendar_type <> 'work'"), ("calendar", "has_attendees", "true", "n_attendees > 0"), ("calendar", "organizer", "organizer", "true"),
        ("granola", "has_transcript", "true", "has_transcript"), ("granola", "participant_count", "n_participants", "true"), ("slack", "channel", "channel", "true"), ("slack", "has_thread", "true", "has_thread"),
        ("slack", "reply_count", "reply_count", "reply_count > 0"), ("slack", "is_from_me", "is_from_me", "true"),
    ]
)


@query(_FACETS)
def source_facets(t: Tables) -> DataFrame:
    return scoring.facets(t.store("rw"))


@query("SELECT facet, value, count(*) AS n FROM (" + _FACETS + ") GROUP BY ALL")
def facet_counts(t: Tables) -> DataFrame:
    """Facets of all events, written in one pass over them and counted."""
    return scoring.facets(t.store("rw")).groupBy("facet", "value").agg(F.count("*").alias("n"))


_MACHINE = """, mr AS (SELECT event_id, CASE WHEN source <> 'mail' OR replied OR is_from_me OR flagged OR body LIKE 'Your st%' OR subject LIKE 'App%' THEN ''
    WHEN automated AND list_id THEN 'automated+list' WHEN a % 9 = 0 THEN 'sender' WHEN a % 9 = 1 AND (automated OR noreply) THEN 'domain'
    WHEN k % 8 IN (0, 1, 3, 5) AND (automated OR noreply OR list_id) THEN 'subject' WHEN body LIKE 'http%' AND (automated OR list_id) THEN 'links' ELSE '' END AS reason FROM rw)"""


@query(_MACHINE + " SELECT event_id, reason FROM mr")
def machine_mail(t: Tables) -> DataFrame:
    return t.store("rw").select("event_id", scoring.machine_reason().alias("reason"))


@query("SELECT event_id, CASE WHEN is_from_me OR a % 9 = 2 THEN '' WHEN a % 9 = 0 THEN 'no-reply@shop.com' WHEN a % 9 = 1 THEN 'bo@github.com' ELSE 'c' || a || '@x.org' END AS address FROM rw")
def sender_addresses(t: Tables) -> DataFrame:
    return t.store("rw").select("event_id", scoring.sender_address(F.col("sender"), F.col("is_from_me")).alias("address"))


_ENGAGED = """, en AS (SELECT a, count(*) AS n, count(DISTINCT source) AS sources, avg(is_from_me::INT) AS mine FROM rw WHERE k % 3 > 0 AND a % 4 > 0 GROUP BY a)"""
_POINTS = """, pt AS (SELECT *, 300 + CASE source
    WHEN 'mail' THEN replied::INT * 400 + flagged::INT * 300 + (coalesce(category, 9) = 0)::INT * 150 + urgent::INT * 150 - CASE WHEN automated AND coalesce(category, 9) = 0 THEN 150 WHEN automated THEN 300 ELSE 0 END - list_id::INT * 200 - (coalesce(category, 9) IN (2, 3))::INT * 200 - junk_level * 300 - noreply::INT * 100
    WHEN 'imessage' THEN -is_filtered::INT * 100 - delivered_quietly::INT * 100 - is_auto_reply::INT * 150 WHEN 'whatsapp' THEN (shared_url::INT + shared_document::INT) * 100 - (is_group AND n_participants > 10)::INT * 150
    WHEN 'calendar' THEN (n_attendees > 0)::INT * 100 - (calendar_type <> 'work')::INT * 300 WHEN 'granola' THEN has_transcript::INT * 100 WHEN 'slack' THEN (has_thread::INT + (reply_count > 2)::INT) * 100 ELSE 0 END AS p,
    CASE source WHEN 'mail' THEN automated::INT + list_id::INT + (coalesce(category, 9) IN (2, 3))::INT + junk_level + noreply::INT WHEN 'imessage' THEN is_filtered::INT + delivered_quietly::INT + is_auto_reply::INT WHEN 'calendar' THEN (calendar_type <> 'work')::INT ELSE 0 END AS noise FROM rw),
cp AS (SELECT *, least(greatest(p, 0), 1000) AS q FROM pt), fl AS (SELECT *, CASE WHEN source = 'mail' AND high_impact AND NOT automated THEN greatest(CASE WHEN noise = 1 AND q < 100 THEN 100 ELSE q END, 400) WHEN noise = 1 AND q < 100 THEN 100 ELSE q END AS s FROM cp)"""


@query(_MACHINE + _ENGAGED + _POINTS + """, z AS (SELECT event_id, CASE WHEN event_type = 'reaction' OR reason <> '' THEN 0 ELSE greatest(greatest(s, CASE WHEN sources >= 3 THEN 450 WHEN sources >= 2 THEN 400 WHEN n >= 5 AND mine > 0 THEN 350 ELSE 0 END) + CASE WHEN sources >= 2 THEN 50 ELSE 0 END, CASE WHEN is_from_me THEN 300 ELSE 0 END) END AS score
    FROM fl JOIN mr USING (event_id) LEFT JOIN en USING (a))
SELECT event_id, score / 1000.0::DOUBLE AS score, CASE WHEN score < 100 THEN 'skip' WHEN score < 400 THEN 'low_priority' ELSE 'full_triage' END AS route FROM z""")
def scored_events(t: Tables) -> DataFrame:
    """Score and route of raw events: machine mail and reactions skipped, each source's flags, and the floor of people the user knows."""
    e = t.store("rw")
    known = e.filter("k % 3 > 0 and a % 4 > 0").groupBy("a").agg(F.count("*").alias("n_events"), F.countDistinct("source").alias("sources"), F.avg(F.col("is_from_me").cast("int")).alias("from_me"))
    return scoring.score(e.join(known, "a", "left")).select("event_id", "score", "route")


@query(_ENGAGED + " SELECT a AS person_id, CASE WHEN sources >= 3 THEN 0.45 WHEN sources >= 2 THEN 0.4 WHEN n >= 5 AND mine > 0 THEN 0.35 ELSE 0 END::DOUBLE AS floor FROM en")
def engagement_floors(t: Tables) -> DataFrame:
    known = t.store("rw").filter("k % 3 > 0 and a % 4 > 0").groupBy("a").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.avg(F.col("is_from_me").cast("int")).alias("mine"))
    return known.select(F.col("a").alias("person_id"), (scoring.engagement_floor(F.col("sources"), F.col("n"), F.col("mine")) / F.lit(1000.0)).alias("floor"))


@query("""SELECT event_id, round(CASE WHEN c IS NOT NULL AND NOT (a % 9 = 0) AND NOT (n <= 2 AND body LIKE 'Dear%') THEN greatest(s, 0.7) ELSE s END, 1)::DOUBLE AS score FROM (
    SELECT *, CASE WHEN tier = 1 THEN greatest(f, 0.3) ELSE f END AS s FROM (SELECT *, CASE source WHEN 'granola' THEN greatest(x, 0.5) WHEN 'calendar' THEN greatest(x, 0.3) ELSE x END AS f FROM (
        SELECT event_id, source, a, body, (k % 10) / 10.0::DOUBLE AS x, a % 4 AS tier, k % 4 AS n, CASE WHEN k % 7 < 3 THEN 'promise' END AS c FROM rw)))""")
def floored_scores(t: Tables) -> DataFrame:
    """A model's scores with their floors."""
    kind = F.when(F.col("source") == "granola", "meeting").when(F.col("source") == "calendar", "calendar_event").otherwise("message")
    s = triage.floored(F.col("k") % 10 / 10.0, kind, F.col("a") % 4, F.when(F.col("k") % 7 < 3, "promise"), F.col("sender"), F.col("k") % 4, F.col("body"))
    return t.store("rw").select("event_id", s.alias("score"))


@query("SELECT event_id, CASE WHEN now - ts <= 7 * 86400 THEN 1 WHEN now - ts <= 30 * 86400 THEN 2 ELSE 3 END AS bucket, a % 9 = 0 AS automatic, body LIKE 'Dear%' AS generic FROM rw, clock")
def triage_marks(t: Tables) -> DataFrame:
    e = t.store("rw").join(F.broadcast(t.now))
    return e.select("event_id", triage.age_bucket(F.col("ts"), F.col("now")).alias("bucket"), triage.automatic_sender(F.col("sender")).alias("automatic"), triage.generic_salutation(F.col("body")).alias("generic"))


@query("""SELECT thread_id, count(*) AS n, CASE WHEN max(CASE WHEN amount > 200 THEN 3 WHEN amount > 50 THEN 1 ELSE 2 END) >= 3 OR bool_and(route = 'low_priority') THEN CASE WHEN count(*) = 1 THEN 'msg_compact' ELSE 'msg_batch_compact' END ELSE 'thread_full' END AS strategy
    FROM ev JOIN pr USING (event_id) GROUP BY thread_id""")
def thread_strategies(t: Tables) -> DataFrame:
    e = t.events.join(t.store("pr").select("event_id", "route"), "event_id")
    level = F.when(F.col("amount") > 200, 3).when(F.col("amount") <= 50, None).otherwise(1)
    return triage.strategies(e.select("thread_id", "route", level.alias("sensitivity")))


@query("""SELECT thread_id, CASE WHEN k % 5 = 0 THEN 'fresh' WHEN k % 7 < 3 AND k % 2 > 0 THEN 'reactivated' ELSE 'incremental' END AS how FROM (SELECT DISTINCT thread_id, k FROM rw)""")
def thread_increments(t: Tables) -> DataFrame:
    """How threads that may have been read before are read again."""
    th = t.store("rw").select("thread_id", "k").distinct()
    prior = th.filter("k % 5 > 0").select("thread_id", (F.col("k") % 7 / 7.0).alias("score"), F.when(F.col("k") % 2 == 0, True).alias("gated"))
    return triage.increments(th.select("thread_id"), prior).select("thread_id", "how")


@query("SELECT thread_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY ts DESC, event_id DESC) <= 12")
def thread_tails(t: Tables) -> DataFrame:
    """The newest events of each thread, as many as are read at once."""
    return triage.tail(t.events, "thread_id", F.desc("ts"), F.desc("event_id"), most=12).select("thread_id", "event_id")


@query("SELECT claim_id, event_id, confidence FROM cl JOIN ce USING (claim_id) JOIN pr USING (event_id) WHERE confidence >= 0.7 AND (score >= 0.7 OR priority = 1)")
def deep_candidates(t: Tables) -> DataFrame:
    """Triaged events that are worth a second reading."""
    c = t.claims.filter("confidence >= 0.7").join(t.claim_events, "claim_id").join(t.store("pr").select("event_id", "score"), "event_id")
    return c.filter("score >= 0.7 or priority = 1").select("claim_id", "event_id", "confidence")


@query("SELECT DISTINCT event_id FROM ce JOIN cl USING (claim_id) WHERE status = 'done'")
def triaged_events(t: Tables) -> DataFrame:
    return t.claim_events.join(t.claims.filter("status = 'done'"), "claim_id", "left_semi").select("event_id").distinct()


@query("""SELECT event_id, CASE k % 4 WHEN 3 THEN NULL WHEN 2 THEN 1 ELSE k / 100.0 END::DOUBLE AS score, CASE WHEN k % 4 < 3 THEN 'because "x"' END AS reason, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE -1 END AS topics FROM rw""")
def triage_results(t: Tables) -> DataFrame:
    """A model's answers as JSON among other text: scores beyond 1, answers without topics, and broken ones."""
    k = F.col("k").cast("string")
    good = F.concat(F.lit('```json\n{"score": '), (F.col("k") / 100.0).cast("string"), F.lit(', "reason": "because \\"x\\"", "topics": '), F.when(F.col("k") % 4 == 0, '["a", "b"]').otherwise("[]"), F.lit("}\n```"))
    raw = F.when(F.col("k") % 4 < 2, good).when(F.col("k") % 4 == 2, '{"score": 7, "reason": "because \\"x\\"", "topics": []} end').otherwise(F.concat(F.lit('{"reason": '), k))
    return triage.parsed(t.store("rw").select("event_id", raw.alias("raw"))).select("event_id", "score", "reason", F.coalesce(F.size("topics"), F.lit(-1)).alias("topics"))


@query("SELECT event_id FROM rw WHERE k % 4 = 0 OR a % 10 = 3")
def sensitive_events(t: Tables) -> DataFrame:
    """Events whose triage names personal data or a sensitivity."""
    e = t.store("rw").select("event_id", F.when(F.col("k") % 4 == 0, F.array(F.lit("ssn"))).otherwise(F.array()).alias("pii"), F.when(F.col("a") % 10 == 3, F.array(F.lit("medical"))).alias("sensitivity"))
    return e.filter((F.size("pii") > 0) | (F.coalesce(F.size("sensitivity"), F.lit(0)) > 0)).select("event_id")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Work_Travel' WHEN 1 THEN 'region ' || n_regionkey WHEN 2 THEN 'finance' ELSE lower(p_name) END AS canonical FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25""")
def normalized_topics(t: Tables) -> DataFrame:
    """Topics by taxonomy, synonyms, seeds, or cleaned."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "Work_Travel").when(k % 4 == 1, F.concat(F.lit("Topic__"), (k % 25).cast("string"))).when(k % 4 == 2, " MONEY/matters").otherwise(F.regexp_replace(F.upper("p_name"), " ", "-"))
    topics = t.read("part").select("p_partkey", raw.alias("topic"))
    return triage.canonical_topics(topics, ["Work_Travel"], t.store("sy"), {"money matters": "finance"}).select("p_partkey", "canonical")


@query("""SELECT split_part(p_name, ' ', 2) AS word, p_name AS topic, n, (row_number() OVER (PARTITION BY split_part(p_name, ' ', 2) ORDER BY n DESC, p_name) - 1) // 3 AS batch FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)""")
def topic_batches(t: Tables) -> DataFrame:
    """Topics that share a word, in batches; each topic's first word is its own here, so components go by the second."""
    own = t.read("part").groupBy("p_name").agg(F.count("*").alias("n")).select(F.concat(F.translate("p_name", " ", "_"), F.lit(" "), F.substring_index("p_name", " ", -1)).alias("topic"), "n")
    b = triage.topic_batches(own, 3)
    return b.select(F.substring_index("component", " ", -1).alias("word"), F.translate(F.substring_index("topic", " ", 1), "_", " ").alias("topic"), "n", "batch")
