"""Contacts worth knowing: sourced confidence, signals, stages, focus, and stories that must stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import confidence as conf
from tidemark.functions import text as tx
from tidemark.operators import joins

#: Reliability letter, credibility number and half-life in days of each kind of source.
SOURCES = {
    "kg": ("A", 1, 365), "portfolio": ("A", 2, 180), "fund_status": ("A", 2, 180), "podcast": ("B", 2, 365),
    "blog": ("B", 3, 365), "profile": ("B", 3, 730), "twitter": ("C", 3, 90), "web": ("D", 4, 90),
}
RELIABILITY = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "E": 0.2, "F": 0.0}
CREDIBILITY = {1: 1.0, 2: 0.85, 3: 0.7, 4: 0.5, 5: 0.3, 6: 0.1}
#: What each kind of signal adds to a contact's score, which ends at 10.
SIGNALS = {"known_domain": 5.0, "email_domain": 3.0, "known_firm": 5.0, "belief": 2.0, "calendar": 2.5, "content": 1.0, "title": 4.0}
#: Domains that say nothing about a firm.
GENERIC_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com",
    "fastmail.com", "googlegroups.com", "substack.com", "google.com", "apple.com",
]


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key]


def sourced(fragments: DataFrame, kind: str, age_days: str, quality: str) -> DataFrame:
    """fragments with reliability, credibility and confidence: the source's two grades, halved by age, times the quality in 0..1 (null: 1). An unknown kind has null in all three."""
    letter, number = (_lookup({k: v[i] for k, v in SOURCES.items()}, F.col(kind)) for i in (0, 1))
    decay = F.pow(F.lit(2.0), -F.greatest(F.col(age_days), F.lit(0.0)) / _lookup({k: v[2] for k, v in SOURCES.items()}, F.col(kind)))
    sure = _lookup(RELIABILITY, letter) * _lookup(CREDIBILITY, number) * decay * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(quality)))
    return fragments.withColumns({"reliability": letter, "credibility": number, "confidence": F.round(sure, 4)})


def graded(sourced_fragments: DataFrame, subject: str, fragment: str) -> DataFrame:
    """(subject, reliability, credibility, confidence): the best letter and number of each subject, and its three best fragments together.

    Only three fragments of a subject are kept, on each side of the shuffle, so a subject with very many gathers no long list.
    """
    best = joins.latest_per(sourced_fragments, [subject], F.desc("confidence"), F.col(fragment), n=3)
    sure = best.groupBy(subject).agg(F.round(conf.aggregate(F.collect_list("confidence")), 4).alias("confidence"))
    return sourced_fragments.groupBy(subject).agg(F.min("reliability").alias("reliability"), F.min("credibility").alias("credibility")).join(sure, subject)


def firm(email: Column, known: dict[str, str] | None = None) -> Column:
    """A firm's likely name from an address, or as ``known`` has its domain; null for generic domains and strings without @."""
    domain = F.lower(F.get(F.split(email, "@"), F.lit(1)))
    parts = F.split(domain, r"\.")
    label = F.when(F.size(parts) <= 2, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.size(parts) - 2))
    given = _lookup(known, domain) if known else F.lit(None).cast("string")
    return F.when(email.contains("@") & ~domain.isin(GENERIC_DOMAINS), F.coalesce(given, tx.title_case(F.translate(label, "-_", "  "))))


def signal_score(signals: DataFrame, subject: str, kind: str) -> DataFrame:
    """(subject, signals, score): signals and their weights added up, at most 10; unknown kinds add 0."""
    return signals.groupBy(subject).agg(F.count("*").alias("signals"), F.least(F.lit(10.0), F.sum(F.coalesce(_lookup(SIGNALS, F.col(kind)), F.lit(0.0)))).alias("score"))


def stage(recency_days: Column, events: Column, has_calendar: Column) -> Column:
    """Ladder of how recently someone was seen: 14, 30, 60 and 90 days."""
    active = recency_days < 14
    return (
        F.when(active & has_calendar, "meeting_scheduled").when(active & (events >= 3), "in_progress").when(active, "contacted")
        .when(recency_days < 30, "follow_up").when(recency_days < 60, "inactive").when(recency_days < 90, "cold").otherwise("dormant")
    )


def focus(tech: Column, business: Column) -> Column:
    return F.when(tech > business * 1.5, "tech_forward").when(business > tech * 1.5, "business_forward").otherwise("generalist")


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains anywhere."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def part_stories(members: DataFrame, apart: DataFrame) -> DataFrame:
    """(story, part, task): members (story, task, place) where two tasks that must stay apart no longer share a part.

    Of a pair (a, b) in one story the one with the later place gets a part of its own, named by the task; all
    others stay in the part named null. Two equi-joins on the pairs, never all pairs of a story.
    """
    a, b = (members.select("story", F.col("task").alias(x), F.col("place").alias(f"{x}_at")) for x in "ab")
    meet = apart.join(a, "a").join(b, ["b", "story"])
    later = meet.select("story", F.when(F.col("a_at") > F.col("b_at"), F.col("a")).otherwise(F.col("b")).alias("task")).distinct().withColumn("part", F.col("task"))
    return members.join(later, ["story", "task"], "left").select("story", "part", "task")


def overflow(tasks: DataFrame, owner: str, *order: Column, most: int = 10) -> DataFrame:
    """tasks where an owner's immediate tasks beyond the first ``most`` are in review; ``order`` ends with a key, so nothing is left to chance."""
    now = F.col("bucket") == "immediate"
    first = joins.latest_per(tasks.filter(now), [owner], *order, n=most).select(owner, "task", F.lit(True).alias("stays"))
    return tasks.join(first, [owner, "task"], "left").withColumn("bucket", F.when(now & F.col("stays").isNull(), "review").otherwise(F.col("bucket"))).drop("stays")
