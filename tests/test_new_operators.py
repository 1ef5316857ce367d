"""Nulls, empty tables, ties and repeated rows of the store's, linking, scoring, triage, evidence and privacy operators."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import clusters, evidence, identity, joins, linking, privacy, scoring, store, triage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reads(spark):
    b = spark.createDataFrame([(1, "fact", "active", 0.9, 7), (2, "fact", "active", 0.9, None), (3, None, "gone", None, 7)], "belief_id long, belief_type string, status string, confidence double, subject long")
    assert [r["belief_id"] for r in store.beliefs(b).collect()] == [1, 2]
    assert [r["belief_id"] for r in store.beliefs(b, subject=7, status=None).collect()] == [1]
    assert store.beliefs(b.limit(0)).count() == 0 and store.find(b, belief_id=99).count() == 0
    r = spark.createDataFrame([(1, "@x.org", "mute", 1), (2, "A@x.org", "boost", 0), (3, "@x.org", "block", 2)], "rule_id long, pattern string, action string, created_at long")
    asked = spark.createDataFrame([("a@X.org",), ("b@x.org",), ("c@y.org",), (None,)], "identifier string")
    assert rows(store.matched_rules(asked, r)) == rows(spark.createDataFrame([("a@X.org", "boost"), ("b@x.org", "block"), ("c@y.org", None), (None, None)], "i string, a string"))
    pairs = spark.createDataFrame([(2, 1)], "a long, b long")
    assert rows(store.apart(pairs, spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a long, b long"))) == [(1, 2, True), (1, 3, False), (2, 1, True)]
    st = spark.createDataFrame([(1, "active", None, None, 5), (2, "active", 0, 9, 1), (3, "active", None, 3, 1), (4, "gone", 0, 0, 0)], "story_id long, status string, override int, priority int, updated_at long")
    assert [r["story_id"] for r in store.stories(st).collect()] == [2, 3, 1]


def test_samples_and_artifacts(spark):
    t = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 990, "a").when(F.col("id") < 999, "b").alias("k"))
    got = {r["k"]: r["n"] for r in store.proportional_sample(t.filter("k is not null"), ["k"], 100, F.col("id")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 99, "b": 1} and store.proportional_sample(t.limit(0), ["k"], 10, F.col("id")).count() == 0
    topics = spark.createDataFrame([(i, v) for i in range(4) for v in ("x", "y")] + [(9, "x"), (10, "z"), (10, "x")], "event_id long, value string")
    assert {r["event_id"] for r in store.without_artifacts(topics, 4).collect()} == {9, 10}


def test_links(spark):
    schema = "event_id long, source string, participants array<string>, is_from_me boolean, recent boolean, organizer string, originated boolean"
    ids = spark.createDataFrame([(1, "email", "me@x.org"), (2, "email", "ann@gmail.com"), (3, "phone", "+15551234567"), (4, "display_name", "Bo Lee")], "person_id long, id_type string, identifier string")
    e = [
        (1, "mail", ["Ann <A.nn@Gmail.com>; CC: me@x.org; CC: Bo Lee"], False, True, None, None), (2, "mail", ["me@x.org", "ann@gmail.com"], True, False, None, None), (3, "imessage", ["(555) 123-4567", "ann@gmail.com"], False, True, None, None),
        (4, "calendar", ["ann@gmail.com", "Bo Lee", "nobody", "#all", None, ""], False, True, "ANN@gmail.com", None), (5, "calls_x", ["5551234567"], False, True, None, True), (6, "slack", [], True, None, None, None), (7, "granola", None, False, None, None, None),
    ]
    got = set(map(tuple, linking.link(spark.createDataFrame(e, schema), ids, 1).collect()))
    assert got == {(1, 2, "sender"), (1, 4, "cc"), (3, 3, "sender"), (4, 2, "organizer"), (4, 4, "attendee"), (4, 1, "self"), (5, 3, "recipient"), (5, 1, "self"), (6, 1, "self"), (7, 1, "self")}
    assert linking.link(spark.createDataFrame([], schema), ids, 1).count() == 0


FLAGS = "source string, event_type string, is_from_me boolean, replied boolean, flagged boolean, category int, urgent boolean, automated boolean, list_id boolean, junk_level int, noreply boolean, high_impact boolean, is_filtered boolean, delivered_quietly boolean, is_auto_reply boolean, is_group boolean, n_participants int, shared_url boolean, shared_document boolean, n_attendees int, calendar_type string, has_transcript boolean, has_thread boolean, reply_count int, subject string, body string, sender string, sources int, n_events int, from_me double"


def scored(spark, **given):
    names = [f.split()[0] for f in FLAGS.split(", ")]
    df = spark.createDataFrame([tuple(given.get(n) for n in names)], FLAGS)
    r = scoring.score(df).first()
    return r["score"], r["route"]


def test_scores(spark):
    assert scored(spark, source="mail") == (0.3, "low_priority") and scored(spark, source="else") == (0.3, "low_priority")
    assert scored(spark, source="mail", replied=True, flagged=True, urgent=True, category=0) == (1.0, "full_triage")
    assert scored(spark, source="mail", junk_level=2) == (0.1, "low_priority") and scored(spark, source="mail", junk_level=2, noreply=True) == (0.0, "skip")
    assert scored(spark, source="mail", list_id=True, high_impact=True) == (0.4, "full_triage") and scored(spark, source="mail", automated=True, high_impact=True) == (0.1, "low_priority")
    assert scored(spark, source="mail", sender="Shop <no-reply@shop.com>") == (0.0, "skip") and scored(spark, source="mail", sender="no-reply@shop.com", subject="Flight 7 delayed") == (0.3, "low_priority")
    assert scored(spark, source="calendar", calendar_type="holiday") == (0.1, "low_priority") and scored(spark, source="whatsapp", is_group=True, n_participants=11) == (0.15, "low_priority")
    assert scored(spark, source="imessage", is_filtered=True, sources=3, n_events=9, from_me=0.1) == (0.5, "full_triage") and scored(spark, source="slack", event_type="reaction") == (0.0, "skip")
    assert scored(spark, source="imessage", is_filtered=True, is_auto_reply=True, is_from_me=True) == (0.3, "low_priority")


def test_triage(spark):
    e = spark.createDataFrame([("a", None, "low_priority"), ("b", 1, "low_priority"), ("b", 1, None), ("c", 3, "full_triage"), ("d", 1, "low_priority"), ("d", 2, "low_priority")], "thread_id string, sensitivity int, route string")
    assert rows(triage.strategies(e)) == [("a", 1, "msg_compact"), ("b", 2, "thread_full"), ("c", 1, "msg_compact"), ("d", 2, "msg_batch_compact")]
    assert {r["strategy"] for r in triage.strategies(e, cloud_all=True).collect()} == {"thread_full"} and triage.strategies(e.limit(0)).count() == 0
    a = spark.createDataFrame([('x {"score": -3, "topics": ["a"]} y',), ('{"reason": "no score"}',), ("broken {",), (None,), ("",)], "raw string")
    assert [(r["score"], r["topics"]) for r in triage.parsed(a).collect()] == [(0.0, ["a"]), (None, None), (None, None), (None, None), (None, None)]
    t = spark.createDataFrame([("red car", 5), ("red bus", 9), ("blue bus", 1), ("tea", 2)], "topic string, n long")
    got = {r["topic"]: (r["component"], r["batch"]) for r in triage.topic_batches(t, 2).collect()}
    assert got == {"red bus": ("blue bus", 0), "red car": ("blue bus", 0), "blue bus": ("blue bus", 1), "tea": ("tea", 0)}


@pytest.mark.parametrize("quote,source,least,most", [(None, "x", 0, 0), ("", "x", 0, 0), ("a", None, 0, 0), ("Send THE file", "please send the   file, now", 1, 1), ("send the fiel", "please send the file now", 0.8, 0.99), ("zebra", "please send the file now", 0, 0.4), ("cat", "concatenate", 0, 0.6)])
def test_quotes(quote, source, least, most):
    assert least <= evidence.quote_score(quote, source) <= most


def test_evidence(spark):
    df = spark.createDataFrame([("Hello  World", 0, 12, "hello world"), ("abc", 1, 9, "bc"), ("abc", -1, 2, "ab"), (None, 0, 1, "a")], "t string, a int, b int, q string")
    assert [r[0] for r in df.select(evidence.span_holds(F.col("t"), F.col("a"), F.col("b"), F.col("q"))).collect()] == [True, False, False, False]
    c = spark.createDataFrame([(1, "x", 0.5), (2, "x", 0.9), (3, "x", 0.9), (4, None, 0.1), (5, None, 0.1)], "claim_id long, k string, confidence double")
    assert rows(evidence.superseded(c, ["k"])) == [(1, 2), (3, 2), (5, 4)] and evidence.superseded(c.limit(0), ["k"]).count() == 0
    d = spark.createDataFrame([("2024-02-28",), ("2024-02-31",), (None,), ("soon",)], "d string")
    assert [r[0] for r in d.select(evidence.logistics_expiry(F.col("d"))).collect()] == [1709337600, None, None, None]
    p = spark.createDataFrame([("Ann Lee", 1), ("Ann Lee", 1), ("Bo X", 2), ("Bo Y", 1), ("Cy Z", 3)], "name string, tier int")
    got = {r["name"]: r["full"] for r in evidence.first_names(p, spark.createDataFrame([("ann",), ("Bo",), ("Cy",)], "name string")).collect()}
    assert got == {"ann": "Ann Lee", "Bo": "Bo", "Cy": "Cy"}


def test_privacy(spark):
    df = spark.createDataFrame([("roadmap", "mail", None), ("roadmap", "imessage", None), ("mom", "mail", None), ("lunch", "imessage", None), ("lunch", "mail", None), ("roadmap", "mail", "legal"), (None, "mail", None), ("sync", "calendar", None)], "t string, s string, l string")
    got = [r[0] for r in df.select(privacy.decision(F.col("t"), F.col("s"), F.col("l"), meetings=True)).collect()]
    assert got == ["share", "share", "block", "block", "review", "block", "review", "share"]
    assert privacy.redacted(spark.createDataFrame([("a", "b", "c")], "email string, body string, new string"), privacy.highest(content=True)).columns == ["email", "body", "new"]
    assert privacy.redacted(spark.createDataFrame([("a", "b", "c")], "source_name string, body string, new string"), privacy.highest()).columns == ["source_name"]


def test_names_and_phones(spark):
    names = spark.createDataFrame([(1, "Bob Smith Jones"), (2, "Robert Smith-Jones"), (3, "Rob Smith"), (4, ""), (5, None), (6, "Acme Inc"), (7, "acme llc")], "id long, name string")
    assert rows(identity.same_name(names).select("a", "b")) == [(1, 2)]
    raw = spark.createDataFrame([("（４１５） 555-1234 99",), ("(612) 207-2839",), ("no",), (None,), ("+٤٤ 20",)], "p string")
    assert [r[0] for r in raw.select(tx.normal_phone(F.col("p"))).collect()] == ["+415555123499", "+16122072839", None, None, "+٤٤20"]
    m = spark.createDataFrame([("Mail a.b@x.org, call 612-207-2839 or see https://x.org/a and https://github.com/y",), (None,)], "t string")
    assert m.select(tx.mask_contacts(F.col("t"))).first()[0] == "Mail [email], call[phone] or see [url] and https://github.com/y"
    parts = spark.createDataFrame([("Ann.Lee9@mail.shop.co.uk",), ("no-reply@mail.x.org",), ("nothing",), (None,)], "e string").select(identity.email_parts(F.col("e")).alias("p"))
    assert [(r["p"]["tokens"], r["p"]["domain"]) if r["p"] else None for r in parts.collect()] == [(["ann", "lee"], "shop.co.uk"), ([], "mail.x.org"), None, None]
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    assert rows(identity.small_components(links, 15)) == [(50, 50), (51, 50)]


def test_bursts_and_related(spark):
    e = spark.createDataFrame([(i, 1000, "a") for i in range(50)] + [(99, 1100, "b"), (100, 2000, "a"), (101, 2001, "a"), (102, 2002, "a")], "event_id long, ts long, source string")
    assert rows(clusters.bursts(e)) == [(3, 0, 1000, 51, 2)] and clusters.bursts(e.limit(0)).count() == 0
    ev = spark.createDataFrame([(1, 100, "m"), (2, 130, "x"), (3, 90, "x"), (4, 95, "m"), (5, 100, "y")], "event_id long, ts long, source string")
    keys = spark.createDataFrame([(1, "amount", 1, 1, "9"), (2, "amount", 1, 1, "9"), (3, "amount", 1, 1, "9"), (4, "amount", 1, 1, "9"), (1, "name", 2, 3, "n"), (2, "name", 2, 3, "n"), (3, "name", 2, 3, "n"), (5, "name", 2, 3, None)], "event_id long, kind string, place int, most int, v string")
    assert rows(joins.related(ev.filter("event_id = 1"), ev, keys, 10)) == [(1, 2, "x", "name", 30), (1, 3, "x", "amount", 10)]
