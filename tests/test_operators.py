"""Operators of the event model: edge cases, and plain loops for what SQL doesn't express."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import confidence as conf
from tidemark.functions import text as tx
from tidemark.operators import clusters, discovery, graph, identity, joins, propagate, tasks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", [("(212) 555-0100", "+12125550100"), ("+49 30 1", "+49301"), ("none", None), ("", None)])
def test_phone(spark, raw, expected):
    assert one(spark, tx.normal_phone(F.lit(raw))) == expected


@pytest.mark.parametrize("raw, expected", [(" A.B.C@GMail.com", "abc@gmail.com"), ("A.B@x.org", "a.b@x.org"), ("a.b@googlemail.com", "ab@googlemail.com")])
def test_email(spark, raw, expected):
    assert one(spark, tx.normal_email(F.lit(raw))) == expected


@pytest.mark.parametrize(
    "raw, kind, value, name",
    [
        ("", "noise", None, None), (None, "noise", None, None), ("#general", "group", "#general", None), ("Ann <A@x.org>; CC: b@y.org", "email", "a@x.org", "Ann"), ("a@x.org", "email", "a@x.org", None),
        ("Team <123456-789>", "group", "123456-789", "Team"), ("Bo <+1 212 555 0100>", "phone", "+12125550100", "Bo"), ("Room 1234567", "phone", "+1234567", None), ("Ann Lee", "name", "Ann Lee", None),
    ],
)
def test_participant(spark, raw, kind, value, name):
    assert tuple(one(spark, tx.participant(F.lit(raw).cast("string")))) == (kind, value, name)


def test_texts(spark):
    assert one(spark, tx.dollar_amounts(F.lit("$1,200.50 or $3.00, $1,200.50, $5"))) == ["1200.50", "3.00"]
    assert one(spark, tx.clean_mail_body(F.lit("hi\n\n\n\nyou\n> old\n"))) == "hi\n\nyou"
    assert one(spark, tx.mask_secrets(F.lit("export TOKEN=abc; curl -H 'Bearer x.y' https://u:pw@h/"))) == "export TOKEN=[REDACTED] curl -H 'Bearer [REDACTED]' https://u:[REDACTED]@h/"
    assert one(spark, tx.mask_contacts(F.lit("a@b.co +49 30 1234567 http://x.y/z"))) == "[email] +49 30 1234567 [url]"
    assert one(spark, tx.clean_name(F.lit("list >> LEE,  ANN (via Groups)"))) == "ANN LEE"
    assert one(spark, tx.name_tokens(F.lit("O'Neil X. Ann-Lee ann"))) == ["ann", "lee", "o'neil"]
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0


def test_confidence(spark):
    assert [one(spark, conf.confidence(F.lit(n), 20.0)) for n in (0, 5, 10, 20, 1000)] == [0.3, 0.4548, 0.5754, 0.7425, 0.95]
    assert one(spark, conf.confidence(F.lit(20), 20.0, age_days=F.lit(30.0))) == 0.3712
    assert one(spark, conf.aggregate(F.array(F.lit(0.5), F.lit(0.9)))) == pytest.approx(0.925)
    assert one(spark, conf.aggregate(F.array().cast("array<double>"))) == 0.0
    assert [one(spark, conf.route(F.lit(x))) for x in (0.0, 0.1, 0.399, 0.4)] == ["skip", "low_priority", "low_priority", "full_triage"]
    assert [(one(spark, conf.tier_two(F.lit(n))), one(spark, conf.tier_three(F.lit(n)))) for n in (4, 5, 10, 20, 50)] == [(3, 4), (3, 3), (2, 3), (2, 2), (1, 1)]


def test_time_joins(spark):
    rng = random.Random(0)
    a = [(i, rng.randint(0, 3), s := rng.randint(0, 5000), s + rng.randint(0, 900)) for i in range(80)]
    b = [(i, rng.randint(0, 3), s := rng.randint(0, 5000), s + rng.randint(0, 900)) for i in range(80)]
    x, y = spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, u long, v long")
    got = sorted(map(tuple, joins.band_join(x, y, "s", "u", 100, ("k",)).select("i", "j").collect()))
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and abs(p[2] - q[2]) <= 100)
    for slot in (50, 700, 10_000):
        got = sorted(map(tuple, joins.overlap_join(x, y, ("s", "e"), ("u", "v"), 60, slot, ("k",)).select("i", "j", "overlap").collect()))
        assert got == sorted((p[0], q[0], o) for p in a for q in b if p[1] == q[1] and (o := min(p[3], q[3]) - max(p[2], q[2])) + 60 > 0)


def test_anchored_clusters(spark):
    """Not gaps: a long chain breaks where the first is too far. Keys over many batches come out the same."""
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(0, 3000)) for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r["i"]: r["cluster"] for r in clusters.anchored_clusters(spark.createDataFrame(rows, "i long, k string, t long"), ["k"], "t", "i", 200).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in "ab":
        first, number = None, -1
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            if first is None or t - first > 200:
                first, number = t, number + 1
            assert got[i] == number


def test_fuzzy_pairs_miss_none(spark):
    rng = random.Random(2)
    words = "send the report to ann call bob about budget plan review draft of paper and".split()
    rows = [(i, i % 2, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(60, 0, "the of and"), (61, 0, "The of, and!"), (62, 1, "")]
    got = sorted(map(tuple, clusters.fuzzy_pairs(spark.createDataFrame(rows, "i long, k long, t string"), "i", "t", ["k"]).collect()))
    expected = []
    for a, k, s in rows:
        for b, m, t in rows:
            if a < b and k == m:
                x, y = clusters.content_words(s), clusters.content_words(t)
                votes = (s.lower()[:25] == t.lower()[:25]) + (bool(x and y) and len(x & y) / len(x | y) >= 0.4) + (SequenceMatcher(None, s.lower(), t.lower()).ratio() >= 0.65)
                if votes >= 2:
                    expected.append((a, b))
    assert got == expected


def test_greedy_distinct(spark):
    rows = [("k", 1, [1, 2, 3]), ("k", 2, [1, 2, 3, 4]), ("k", 3, [7]), ("k", 4, []), ("k", 5, [7, 8]), ("l", 6, [1])]
    got = clusters.greedy_distinct(spark.createDataFrame(rows, "k string, i long, w array<int>"), ["k"], "i", "w", ["i"], 3).collect()
    assert sorted(r["i"] for r in got) == [1, 3, 4, 6]


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 50), (7, 7)], "a long, b long")
    got = dict(map(tuple, graph.components(nodes, links).collect()))
    assert got == {i: 0 if i <= 20 else 30 if i in (30, 40, 50) else i for i in range(60)}


def test_resolve(spark):
    rows = [("A.nn@gmail.com", None, "Ann", 2), ("ann@gmail.com", "212 555 0100", "A. Lee", 1), (None, "+1 (212) 555-0100", "Ann Lee", 1), ("bo@x.org", None, None, 3), (None, None, "nobody", 0)]
    got = {tuple(r["emails"]): r for r in identity.resolve(spark.createDataFrame(rows, "email string, phone string, name string, rank int")).collect()}
    assert set(got) == {("ann@gmail.com",), ("bo@x.org",)} and got[("ann@gmail.com",)]["name"] == "Ann Lee" and got[("ann@gmail.com",)]["phones"] == ["+12125550100"]


def loop(items, now):
    """The five rules, one item at a time."""
    items = [dict(x) for x in items]
    for _ in range(3):
        before = [x["score"] for x in items]
        by = lambda key: [[x for x in items if x[key] == k] for k in {x[key] for x in items if x[key] is not None}]
        for group in by("sender"):
            s = sorted(x["score"] for x in group)
            med = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
            for x in group:
                if len(group) >= 5 and x["tier"] > 2 and not x["sender_is_user"] and x["score"] > med + 0.4:
                    x["score"] = min(x["score"], max(med + 0.2, 0.3))
        for group in by("thread_id"):
            s = [x["score"] for x in group]
            mean, top, deep = sum(s) / len(s), max(s), sum(v >= 0.7 for v in s)
            for x in group if len(group) >= 2 else []:
                old = new = x["score"]
                if old < mean - 0.2 and mean >= 0.3:
                    new = min(old + 0.4, top - 0.1, 0.7) if deep >= 2 and old < 0.7 else min(old + 0.2, mean)
                if old > mean + 0.4 and old >= top and not x["sender_is_user"]:
                    new = max(old - 0.2, mean + 0.1)
                x["score"] = max(0.0, min(1.0, new)) if new != old else old
        mine = {x["thread_id"] for x in items if x["event_type"] == "message" and x["sender_is_user"]} - {None}
        for x in items:
            if x["tier"] == 1 and 0.3 <= x["score"] <= 0.4 and x["ts"] > now - 30 * 86400:
                x["score"] = min(x["score"] + 0.1, 0.5)
            if x["score"] >= 0.5 and x["tier"] > 2 and (x["n_cc"] and x["event_type"] == "email" or x["recipients"] >= 5):
                x["score"] = max(x["score"] - 0.2, 0.3)
            floor = 0.3 if x["event_type"] == "message" and x["thread_id"] in mine else 0.5 if x["event_type"] == "meeting" else 0.0
            x["score"] = max(x["score"], floor)
        if sum(a != x["score"] for a, x in zip(before, items)) / len(items) < 0.01:
            break
    return {x["event_id"]: round(x["score"], 6) for x in items}


def test_propagation(spark):
    rng = random.Random(3)
    items = [
        {"event_id": i, "score": rng.randint(0, 100) / 101, "event_type": rng.choice(["email", "message", "meeting"]), "thread_id": rng.choice([None, *"abcdefgh"]), "sender": rng.choice([None, 1, 2, 3, 4, 5]), "n_cc": rng.randint(0, 1), "recipients": rng.randint(0, 8), "ts": rng.randint(0, 60 * 86400)}
        for i in range(300)
    ]
    for x in items:
        x |= {"tier": (x["sender"] or 3) % 4 + 1, "sender_is_user": x["sender"] == 4}
    schema = "event_id long, score double, event_type string, thread_id string, sender long, n_cc long, recipients long, ts long, tier long, sender_is_user boolean"
    df = spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in items], schema)
    got, rounds = propagate.propagate(df, 60 * 86400)
    assert {r["event_id"]: round(r["score"], 6) for r in got.collect()} == loop(items, 60 * 86400) and 1 <= rounds <= 3
    assert propagate.propagate(df.limit(0), 0)[0].count() == 0


@pytest.mark.parametrize("due, rule, expected", [("2024-01-31", "monthly", "2024-02-28"), ("2024-02-29", "yearly", None), ("2024-03-01", "yearly", "2025-03-01"), ("2024-12-31", "daily", "2025-01-01"), ("2024-01-01", "never", None)])
def test_recurrence(spark, due, rule, expected):
    got = one(spark, tasks.next_due(F.to_date(F.lit(due)), F.lit(rule)))
    assert (str(got) if got else None) == expected


def test_buckets_and_bands(spark):
    bucket = lambda d, p: one(spark, tasks.bucket(F.lit(d), F.lit("2024-05-15"), F.lit(p)))
    assert [bucket("2024-05-15", 3), bucket("2024-05-22", 3), bucket("2024-05-23", 3), bucket("2024-09-01", 1), bucket("2024-09-01", 2)] == ["immediate", "review", "background", "immediate", "review"]
    band = lambda d: one(spark, tasks.band(F.to_date(F.lit(d)), F.to_date(F.lit("2024-05-15"))))
    assert [band(d) for d in ("2024-05-15", "2024-05-16", "2024-05-19", "2024-05-20", "2024-05-30", "2024-06-30")] == ["today", "tomorrow", "this_week", "next_week", "rest_of_month", "later"]


def test_partners_and_latest(spark):
    edges = spark.createDataFrame([(1, 10, "self"), (1, 11, "sender"), (2, 10, "self"), (2, 11, "cc")], "event_id long, person_id long, role string")
    assert {tuple(r) for r in joins.partners(edges).collect()} == {(10, 11, 2, "cc,sender"), (11, 10, 2, "self")}
    assert [r["event_id"] for r in joins.latest_per(edges, ["person_id"], F.desc("event_id")).collect()] == [2, 2]


def test_parted_stories_and_overflow(spark):
    members = spark.createDataFrame([(1, t, p) for t, p in ((10, 0), (11, 1), (12, 2))] + [(2, 20, 0)], "story int, task int, place int")
    apart = spark.createDataFrame([(12, 10), (10, 20), (11, 99), (None, 10)], "a int, b int")
    assert sorted(map(tuple, discovery.part_stories(members, apart).collect()), key=str) == sorted([(1, None, 10), (1, None, 11), (1, 12, 12), (2, None, 20)], key=str)
    tasks = spark.createDataFrame([("x", i, "immediate") for i in range(5)] + [("x", 9, "review"), ("y", 1, "immediate")], "who string, task int, bucket string")
    left = discovery.overflow(tasks, "who", F.col("task"), most=2)
    assert {r["task"] for r in left.filter("who = 'x' and bucket = 'immediate'").collect()} == {0, 1} and left.count() == 7


def test_sourced_confidence(spark):
    df = spark.createDataFrame([("a", 1, "kg", 365.0, 1.0), ("a", 2, "web", -5.0, 2.0), ("b", 3, "unknown", 0.0, 1.0), ("a", 4, "kg", 0.0, None)], "who string, id int, kind string, age double, quality double")
    got = {r["who"]: tuple(r)[1:] for r in discovery.graded(discovery.sourced(df, "kind", "age", "quality"), "who", "id").collect()}
    assert got == {"a": ("A", 1, 0.99), "b": (None, None, 0.0)}
    assert discovery.graded(discovery.sourced(df.limit(0), "kind", "age", "quality"), "who", "id").count() == 0


def test_firm_names(spark):
    mails = ["a@x-y.com", "a@mail.big_co.org", "a@GMAIL.com", "nobody", "", None]
    df = spark.createDataFrame([(m,) for m in mails], "m string").select(discovery.firm(F.col("m")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["X Y", "Big Co", None, None, None, None]
