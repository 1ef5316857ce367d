"""What makes an extracted commitment believable, and the beliefs that follow from claims."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Beginnings of actions that commit to nothing.
VAGUE = ["explore", "look into", "think about", "consider", "investigate", "evaluate", "research", "assess", "brainstorm", "revisit", "check out", "noodle on", "mull over", "keep in mind"]
#: Speech acts that commit somebody.
ACTS = ["promise", "request", "decision", "assignment"]


def _plain(s: str | None) -> list[str]:
    return re.sub(r"[^\w\s]", " ", (s or "").lower()).split()


def _matches(a: str, b: str) -> int:
    """The characters that SequenceMatcher(None, a, b) matches, for b of less than 200: longest common substrings, the earliest in a, then in b, and so on at both sides."""
    got, parts = 0, [(a, b)]
    while parts:
        a, b = parts.pop()
        at = n = 0
        for i in range(len(a)):
            while i + n < len(a) and a[i : i + n + 1] in b:
                at, n = i, n + 1
        if n:
            j = b.index(a[at : at + n])
            got += n
            if at and j:
                parts.append((a[:at], b[:j]))
            if at + n < len(a) and j + n < len(b):
                parts.append((a[at + n :], b[j + n :]))
    return got


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(); from 200 characters of b on it passes over frequent ones, so it is asked itself."""
    return SequenceMatcher(None, a, b).ratio() if len(b) >= 200 or not (a or b) else 2.0 * _matches(a, b) / (len(a) + len(b))


def quote_score(quote: str | None, source: str | None) -> float:
    """1 if the words of a quote stand in a source as they are, else the best likeness of a window of about as many words that shares three in ten of them.

    Windows are two words shorter to three longer, a quarter of their length apart; the 200 with most shared words are compared.
    Of these, windows whose length or characters leave no room for more than the best so far are passed over.
    """
    q, s = _plain(quote), _plain(source)
    if not q or not s:
        return 0.0
    if f" {' '.join(q)} " in f" {' '.join(s)} ":
        return 1.0
    words, found = set(q), []
    if words.isdisjoint(s):
        return 0.0
    least = max(1, int(len(words) * 0.3))
    for n in sorted({max(2, len(q) + d) for d in range(-2, 4)}):
        for i in range(0, len(s) - n + 1, max(1, n // 4)):
            shared = len(words.intersection(s[i : i + n]))
            if shared >= least:
                found.append((-shared, i, n))
    found.sort()
    text, best = " ".join(q), 0.0
    size, times = len(text), Counter(text).items()
    for _, i, n in found[:200]:
        window = " ".join(s[i : i + n])
        both = size + len(window)
        if 2.0 * min(size, len(window)) / both > best and 2.0 * sum([min(k, window.count(c)) for c, k in times]) / both > best:
            best = max(best, ratio(text, window))
    return best


def supported(items: DataFrame, key: str, quote: str = "quote", source: str = "source", threshold: float = 0.65) -> DataFrame:
    """(key, quote_score, found) of items; Python in Arrow batches, as no built-in function compares sequences so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [quote_score(q, s) for q, s in zip(b["q"].to_pylist(), b["s"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(scores, pa.float64()), pa.array([x >= threshold for x in scores], pa.bool_())], [key, "quote_score", "found"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key).alias("k"), F.col(quote).alias("q"), F.col(source).alias("s")).mapInArrow(run, f"{key} {kind}, quote_score double, found boolean")


def span_holds(text: Column, first: Column, end: Column, quote: Column) -> Column:
    """Whether characters first to end of a text are the quote, white space and case apart; false outside the text."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    inside = (first >= 0) & (first < end) & (end <= F.length(text))
    return F.coalesce(inside & (flat(F.substr(text, first + 1, end - first)) == flat(quote)), F.lit(False))


def vague(what: Column) -> Column:
    low = F.lower(F.trim(what))
    return reduce(lambda a, b: a | b, (low.startswith(v) for v in VAGUE))


def commits(act: Column, who: Column) -> Column:
    """A speech act that commits somebody; a delegation only where the user follows it up."""
    return act.isin(ACTS) | ((act == "delegation") & (who == "user"))


def sure_enough(flags: list[str], least: int = 2) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags)) >= least


def relation_type(channels: Column, ratio: Column) -> Column:
    """Three channels and more come first, then who begins: above 0.7 the user, below 0.3 the other; an unknown ratio is a half."""
    r = F.coalesce(ratio, F.lit(0.5))
    return F.when(channels >= 3, "multi_channel_contact").when(r > 0.7, "user_initiates_with").when(r < 0.3, "receives_from").otherwise("communicates_with")


def logistics_summary(kind: Column, get) -> Column:
    """One line for a fact; ``get`` gives a field by name, "?" stands for one that is missing."""
    f = lambda name: F.coalesce(get(name), F.lit("?"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    outing = F.concat_ws(" ", f("name"), F.when(get("location").isNotNull(), F.concat(F.lit("at "), get("location"))), F.concat(F.lit("on "), f("date")))
    return (
        F.when(kind == "reservation", line("Reservation at ", f("venue"), " on ", f("date"), " at ", f("time"))).when(kind == "travel", line("Travel to ", f("destination"), " on ", f("date")))
        .when(kind == "care_provider", F.trim(line(f("provider"), " on ", f("date"), " ", F.coalesce(get("hours"), F.lit(""))))).when(kind == "appointment", line("Appt with ", f("provider"), " on ", f("date")))
        .when(kind == "activity", line(f("name"), " on ", f("dates"))).when(kind == "outing", outing).when(kind == "childcare", line(f("child"), " at ", f("facility"), " on ", f("date"))).otherwise(get("summary"))
    )


def logistics_expiry(date: Column) -> Column:
    """Epoch seconds three days after a date; null if it is none."""
    return F.unix_timestamp(F.date_add(F.try_to_date(date, "yyyy-MM-dd"), 3).cast("timestamp"))


def first_names(persons: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (name) with ``full``: the one close person (name, tier) of that first name; as it was if there is none or more than one."""
    close = persons.filter(F.col("tier") <= 2).select(F.lower(F.substring_index("name", " ", 1)).alias("first"), F.col("name").alias("whole")).distinct()
    only = close.groupBy("first").agg(F.min("whole").alias("whole"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return asked.join(only, F.lower("name") == F.col("first"), "left").withColumn("full", F.coalesce("whole", "name")).drop("first", "whole")


def superseded(claims: DataFrame, group: list[str], key: str = "claim_id") -> DataFrame:
    """(key, superseded_by): of claims that are the same in all columns of a group, all but the surest (then the smallest) give way to it."""
    best = Window.partitionBy(*group).orderBy(F.desc("confidence"), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return claims.withColumn("superseded_by", F.first(key).over(best)).filter(F.col(key) != F.col("superseded_by")).select(key, "superseded_by")


def fresh_bundles(bundles: DataFrame, cited: DataFrame) -> DataFrame:
    """(thread_id): threads (thread_id, event_id) of which some event is not cited yet; the others need no second reading."""
    return bundles.join(cited.select("thread_id", "event_id").distinct(), ["thread_id", "event_id"], "left_anti").select("thread_id").distinct()


def joined_contexts(contexts: DataFrame) -> DataFrame:
    """(person, tier, contexts) of (person, tier, confidence, context): the closest tier of each, then its contexts, the surest first, each once."""
    closest = contexts.join(contexts.groupBy("person").agg(F.min("tier").alias("tier")), ["person", "tier"])
    each = closest.groupBy("person", "tier", "context").agg(F.max("confidence").alias("confidence"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "context"))), lambda x: x["context"])
    return each.groupBy("person", "tier").agg(F.array_join(texts, "; ").alias("contexts"))
