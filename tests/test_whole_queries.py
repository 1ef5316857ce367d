"""Queries that once looked at a part of their rows."""

import random
from difflib import SequenceMatcher
from types import SimpleNamespace

import duckdb
import pytest

from tidemark.operators import evidence
from tidemark.plans import agent_plans, belief_plans, event_plans, registry
from tidemark.plans.bridge import Tables

DAY = 86400


def test_all_claims_of_an_event(spark):
    ce = spark.createDataFrame([(1, c) for c in range(6)] + [(2, 9)], "event_id long, claim_id long")
    cl = spark.createDataFrame([(c, 0.5) for c in range(10)], "claim_id long, confidence double")
    got = event_plans.claims_for_event(SimpleNamespace(claim_events=ce, claims=cl)).collect()
    assert sorted((r["event_id"], r["claim_id"]) for r in got) == [(1, c) for c in range(6)] + [(2, 9)]


def test_events_of_all_claims(spark):
    ce = spark.createDataFrame([(1, c) for c in range(20)], "event_id long, claim_id long")
    ev = spark.createDataFrame([(1, "e", 5)], "event_id long, id string, ts long")
    got = event_plans.events_for_claim(SimpleNamespace(claim_events=ce, events=ev)).collect()
    assert sorted(r["claim_id"] for r in got) == list(range(20))


def test_beliefs_of_all_persons(spark):
    """Content and belief make 3 points, for a person beyond 150 as for any other."""
    ev = spark.createDataFrame([(p, 100 * DAY, "imessage", 50.0) for p in (7, 1499)], "person_id long, ts long, source string, amount double")
    cl = spark.createDataFrame([(7, 1), (1499, 1)], "person_id long, priority int")
    now = spark.createDataFrame([(100 * DAY,)], "now long")
    got = agent_plans.discovered_contacts(SimpleNamespace(events=ev, claims=cl, now=now)).collect()
    assert {(r["person_id"], r["signals"], r["score"]) for r in got} == {(7, 2, 3.0), (1499, 2, 3.0)}


def _most_rows(node) -> int:
    """The rows out of the busiest node of a plan that has run."""
    own = node.metrics().get("numOutputRows")
    below = node.children()
    return max([own.get().value() if own.isDefined() else 0] + [_most_rows(below.apply(i)) for i in range(below.size())])


def test_participation_of_a_crowded_thread(spark, tmp_path):
    """2,000 events with a person each in one thread: 4 million pairs, none of which need be made."""
    duckdb.sql(f"""copy (select i as event_id, timestamp '2024-01-01' as ts, i as user_id, 'click' as event_type, 1.0::double as value, '{{"k": 7}}' as props from range(2000) t(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = event_plans.participation(Tables(spark, str(tmp_path)))
        assert {(r["person_id"], r["n"]) for r in got.collect()} == {(i, 2000) for i in range(2000)}
        assert _most_rows(got._jdf.queryExecution().executedPlan()) <= 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_participation_of_repeated_events(spark, tmp_path):
    """An event_id in several threads counts once for a person of more than one of them; rows without id or thread count for nobody."""
    rows = [(1, 5, "click", 3), (1, 6, "view", 3), (1, 5, "click", 3), (2, 5, "click", 3), (2, 7, "click", 4), (3, 6, "view", 3), (4, 8, "error", None), (None, 9, "click", 3), (5, None, "click", 4), (6, 6, None, 4)]
    values = ", ".join(f"({'null' if i is None else i}, {'null' if u is None else u}, {'null' if e is None else repr(e)}, '{{}}')".replace("{}", "{}" if k is None else f'{{"k": {k}}}') for i, u, e, k in rows)
    duckdb.sql(f"copy (select i::bigint as event_id, timestamp '2024-01-01' as ts, u::bigint as user_id, e::varchar as event_type, 1.0::double as value, p as props from (values {values}) t(i, u, e, p)) to '{tmp_path}/events.parquet' (format parquet)")
    con = duckdb.connect()
    for name in ("events", "customer", "orders", "nation", "supplier", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path if name == 'events' else '/root/testdata/sf0.001'}/{name}.parquet'")
    got = event_plans.participation(Tables(spark, str(tmp_path))).collect()
    want = con.execute(registry.ORACLES["participation"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 5


def _plain_score(quote: str, source: str) -> float:
    """The rule of quote_score(), with every window compared."""
    q, s = evidence._plain(quote), evidence._plain(source)
    if not q or not s or f" {' '.join(q)} " in f" {' '.join(s)} ":
        return float(bool(q and s))
    windows = [(-len(set(q) & set(s[i : i + n])), i, n) for n in sorted({max(2, len(q) + d) for d in range(-2, 4)}) for i in range(0, len(s) - n + 1, max(1, n // 4))]
    best = sorted(w for w in windows if -w[0] >= max(1, int(len(set(q)) * 0.3)))[:200]
    return max((SequenceMatcher(None, " ".join(q), " ".join(s[i : i + n])).ratio() for _, i, n in best), default=0.0)


@pytest.mark.parametrize("words", [["a", "b", "c"], "we will send the signed contract for order to a supplier by friday and call".split(), ["x" * 40, "yx" * 9, "\u00e9\u4e16", "b"]])
def test_quote_scores_are_those_of_all_windows(words):
    r = random.Random(5)
    for _ in range(150):
        source, quote = " ".join(r.choices(words, k=r.choice([0, 1, 4, 30, 90]))), " ".join(r.choices([*words, "moon"], k=r.choice([0, 1, 3, 8, 25])))
        assert evidence.quote_score(quote, source) == _plain_score(quote, source), (quote, source)
    for a, b in (("", ""), ("", "x"), ("x", ""), ("abcabc", "bcabca"), ("ab" * 120, "ba" * 130)):
        assert evidence.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_few_windows_of_a_quote_are_compared(spark, monkeypatch):
    """75 windows share enough words with this quote; most can't beat the best, by length or characters. The rows of one file go to several tasks."""
    asked = []
    monkeypatch.setattr(evidence, "SequenceMatcher", lambda *a: asked.append(a) or SequenceMatcher(*a))
    if hasattr(evidence, "ratio"):
        whole = evidence.ratio
        monkeypatch.setattr(evidence, "ratio", lambda *a: asked.append(a) or whole(*a))
    source = "Hello all. We will send the signed contract for order 123456 to the supplier by Friday, and call them."
    assert evidence.quote_score("we send the contract for order", source) == _plain_score("we send the contract for order", source) >= 0.65
    assert 0 < len(asked) <= 10
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert belief_plans.supported_quotes(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
