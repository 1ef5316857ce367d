"""What may leave: sensitivity of fields, decisions on beliefs and events, and their projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx

PUBLIC, PRIVATE, SENSITIVE, CRITICAL = range(4)
#: The sensitivity of each field; others are SENSITIVE.
FIELDS = {
    "display_name": PRIVATE, "phone": PRIVATE, "email": PRIVATE, "contact_jid": PRIVATE, "user_phone": CRITICAL, "body": SENSITIVE, "body_preview": SENSITIVE, "subject": SENSITIVE, "attachment_name": SENSITIVE,
    "timestamp": PRIVATE, "message_count": PRIVATE, "sent_count": PRIVATE, "recv_count": PRIVATE, "timing_histogram": SENSITIVE, "call_duration": SENSITIVE, "language": SENSITIVE, "response_time_avg": SENSITIVE,
    "relationship_type": CRITICAL, "behavioral_pattern": CRITICAL, "sentiment_analysis": CRITICAL, "communication_style": CRITICAL, "inferred_role": CRITICAL, "inferred_location": CRITICAL,
    "message_type_distribution": PRIVATE, "country_code": PRIVATE, "source_name": PUBLIC,
}
#: Sensitivities that never leave, and sources that are personal unless business is spoken of.
BLOCKED = ["financial", "medical", "legal", "credentials"]
PERSONAL_SOURCES = ["imessage", "whatsapp"]
#: Words of personal matters, and of business (names of companies are for the caller to add).
PERSONAL = [
    "family", "spouse", "wife", "husband", "partner", "child", "children", "daughter", "son", "mom", "dad", "mother", "father", "parent", "doctor", "medical", "health", "prescription",
    "therapy", "counselor", "diagnosis", "symptom", "bank", "mortgage", "rent", "salary", "tax", "irs", "password", "ssn", "social security", "credit card", "personal", "private", "secret",
]
BUSINESS = [
    "startup", "company", "product", "feature", "roadmap", "launch", "release", "deploy", "ship", "investor", "vc", "venture", "fundraise", "funding", "raise", "round", "seed", "series", "pre-seed",
    "valuation", "term sheet", "cap table", "dilution", "safe", "convertible", "pitch", "deck", "demo", "meeting", "call", "intro", "revenue", "traction", "metrics", "growth", "market", "customer", "user",
    "acquisition", "partnership", "architecture", "pipeline", "api", "model", "privacy", "knowledge graph", "agent", "llm", "briefing", "co-founder", "cofounder", "advisor", "board", "team",
]
#: What makes an appointment shareable.
MEETING = ["meeting", "call", "demo", "pitch", "interview", "sync"]


def highest(content: bool = False, identifiers: bool = False, metadata: bool = False, inferences: bool = False) -> int:
    """The highest sensitivity that a policy lets leave."""
    return CRITICAL if inferences else SENSITIVE if content else PRIVATE if identifiers or metadata else PUBLIC


def field_level(name: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv))[name], F.lit(SENSITIVE))


def redacted(table: DataFrame, most: int) -> DataFrame:
    """table without the columns that are more sensitive."""
    return table.select(*(c for c in table.columns if FIELDS.get(c, SENSITIVE) <= most))


def _any(x: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def decision(text: Column, source: Column, sensitivity: Column, names: tuple[str, ...] = (), meetings: bool = False) -> Column:
    """share, block or review. A blocked sensitivity blocks; a personal source needs business words; personal words block, business words share; with meetings so do appointments."""
    business = _any(text, [*BUSINESS, *names])
    rest = F.when(_any(text, PERSONAL), "block").when(business, "share")
    if meetings:
        rest = rest.when((source == "calendar") & _any(text, MEETING), "share")
    return F.when(F.coalesce(sensitivity.isin(BLOCKED), F.lit(False)), "block").when(source.isin(PERSONAL_SOURCES), F.when(business, "share").otherwise("block")).otherwise(rest.otherwise("review"))


def projected(items: DataFrame, key: str, text: str, source: str, sensitivity: str, meetings: bool = False) -> DataFrame:
    """(key, summary): what may be shared, its first 200 characters with addresses, numbers and links masked."""
    d = decision(F.col(text), F.col(source), F.col(sensitivity), meetings=meetings)
    return items.filter(d == "share").select(key, tx.mask_contacts(F.substring(text, 1, 200)).alias("summary"))
