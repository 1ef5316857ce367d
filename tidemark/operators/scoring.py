"""Heuristic scores of events from the flags of their sources, and what marks mail that machines wrote.

Scores are whole thousandths until the end, so sums of weights are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE, SKIP, HIGH = 300, 100, 400
#: Parts of a local part that mark an automatic sender.
AUTOMATIC = ["noreply", "no-reply", "donotreply", "do-not-reply", "notification", "notifications", "mailer-daemon", "postmaster", "bounce", "auto-confirm", "automated"]
#: Domains that send notifications.
NOTIFYING = [
    "linkedin.com", "facebookmail.com", "github.com", "accounts.google.com", "amazonses.com", "sendgrid.net", "mailchimp.com", "hubspot.com", "intercom.io", "slack.com", "asana.com",
    "atlassian.net", "zoom.us", "calendly.com", "stripe.com", "shopify.com", "squarespace.com", "substack.com", "notion.so", "figma.com", "vercel.com",
]
#: Subjects that machines write.
SUBJECTS = [
    r"^(re:\s*)?your .+ (receipt|order|invoice|statement|confirmation)", r"^(re:\s*)?verify your", r"^(re:\s*)?confirm your", r"^(re:\s*)?reset your password", r"^(re:\s*)?security alert",
    r"^(re:\s*)?sign.in .+ new (device|location|browser)", r"^(re:\s*)?\d+% off", r"^(re:\s*)?welcome to", r"^(re:\s*)?thanks for (signing up|registering|subscribing)",
    r"^(re:\s*)?your .+ has (shipped|been delivered)", r"^(re:\s*)?payment (received|processed|confirmed)",
]
#: What makes a machine's mail worth an answer.
ACTIONABLE = [
    r"flight.+(changed|cancelled|delayed)", r"your (appointment|reservation).+(changed|cancelled|rescheduled)", r"(confirm|confirmation).+(appointment|reservation|visit)",
    r"appointment.+(confirm|required|reminder|upcoming)", r"payment.+(failed|declined|overdue|past due|due today|due soon)", r"(bill|statement).+(ready|due|amount due|past due)",
    r"account.+(suspended|locked|compromised)",
]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _any(patterns: list[str], x: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(x.rlike(f"(?i){p}"), F.lit(False)) for p in patterns))


def sender_address(first: Column, is_from_me: Column) -> Column:
    """The address in an event's first participant, lower case; empty for the user's own events and names without one."""
    inner = F.regexp_extract(first, "<([^>]*)>", 1)
    return F.when(is_from_me | first.isNull(), "").when(inner != "", F.lower(inner)).when(first.contains("@"), F.lower(first)).otherwise("")


def machine_reason(first: str = "sender") -> Column:
    """Why a mail counts as written by a machine, empty if it doesn't.

    Only mail that the user neither answered, wrote nor flagged; signals in order: automatic and listed, local part, notifying domain
    or subject with another sign, many links with another sign. What asks for an answer is rescued.
    """
    mail = sender_address(F.col(first), _flag("is_from_me"))
    local, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    body, automated, listed, noreply = F.substring(F.coalesce("body", F.lit("")), 1, 500), _flag("automated"), _flag("list_id"), _flag("noreply")
    sign = reduce(lambda a, b: a | b, (local.contains(p) for p in AUTOMATIC))
    links = F.size(F.split(body, "http")) - 1
    why = (
        F.when(automated & listed, "automated+list").when((mail != "") & sign, "sender").when(domain.isin(NOTIFYING) & (automated | noreply), "domain")
        .when(_any(SUBJECTS, F.trim("subject")) & (automated | noreply | listed), "subject").when((links > 5) & (automated | listed), "links").otherwise("")
    )
    alive = (F.col("source") == "mail") & ~_flag("replied") & ~_flag("is_from_me") & ~_flag("flagged")
    rescued = _any(ACTIONABLE, F.concat_ws(" ", F.coalesce("subject", F.lit("")), body))
    return F.when(alive & ~rescued, why).otherwise("")


def _sum(*parts: tuple[Column, int]) -> Column:
    return reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), parts, F.lit(BASE))


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(1000))


def _one_noise(score: Column, *noise: Column) -> Column:
    """A single sign of noise alone doesn't push a score below the skip line."""
    count = reduce(lambda a, b: a + b, (n.cast("int") for n in noise))
    return F.when((count == 1) & (score < SKIP), SKIP).otherwise(score)


def mail_score() -> Column:
    primary, promoted, junk = F.coalesce(F.col("category") == 0, F.lit(False)), F.coalesce(F.col("category").isin(2, 3), F.lit(False)), F.coalesce(F.col("junk_level") > 0, F.lit(False))
    automated, listed, noreply = _flag("automated"), _flag("list_id"), _flag("noreply")
    score = _clamp(_sum((_flag("replied"), 400), (_flag("flagged"), 300), (primary, 150), (_flag("urgent"), 150), (automated & primary, -150), (automated & ~primary, -300), (listed, -200), (promoted, -200), (junk, -300), (noreply, -100)))
    score = _one_noise(score, automated, listed, promoted, junk, noreply)
    return F.when(_flag("high_impact") & ~automated, F.greatest(score, F.lit(HIGH))).otherwise(score)


def source_score() -> Column:
    """The score of an event by its source's flags; other sources have the base."""
    filtered, quiet, auto = _flag("is_filtered"), _flag("delivered_quietly"), _flag("is_auto_reply")
    holiday = F.coalesce(F.col("calendar_type").isin("holiday", "birthday"), F.lit(False))
    imessage = _one_noise(_clamp(_sum((filtered, -100), (quiet, -100), (auto, -150))), filtered, quiet, auto)
    whatsapp = _clamp(_sum((_flag("is_group") & (F.col("n_participants") > 10), -150), (_flag("shared_url"), 100), (_flag("shared_document"), 100)))
    calendar = _one_noise(_clamp(_sum((F.coalesce(F.col("n_attendees") > 0, F.lit(False)), 100), (holiday, -300))), holiday)
    slack = _sum((_flag("has_thread"), 100), (F.coalesce(F.col("reply_count") > 2, F.lit(False)), 100))
    by = F.when(F.col("source") == "mail", mail_score()).when(F.col("source") == "imessage", imessage).when(F.col("source") == "whatsapp", whatsapp).when(F.col("source") == "calendar", calendar)
    return by.when(F.col("source") == "granola", _sum((_flag("has_transcript"), 100))).when(F.col("source") == "slack", slack).otherwise(BASE)


def engagement_floor(sources: Column, events: Column, from_me: Column) -> Column:
    """In thousandths; null for nobody known."""
    return F.when(sources >= 3, 450).when(sources >= 2, 400).when((events >= 5) & (from_me > 0), 350).otherwise(0)


def score(events: DataFrame) -> DataFrame:
    """events with ``reason`` (machine), ``score`` and ``route``: noise by source, the floor of the best known person, and the user's own at the base.

    Besides the flags, events has event_type and, of the linked person with the highest floor, sources, n_events and from_me (null: none).
    """
    e = events.withColumn("reason", F.when(F.col("event_type").isin("identity", "reaction"), F.col("event_type")).otherwise(machine_reason()))
    s = F.greatest(source_score(), F.coalesce(engagement_floor(F.col("sources"), F.col("n_events"), F.col("from_me")), F.lit(0)))
    s = s + F.when(F.col("sources") >= 2, 50).otherwise(0)
    s = F.when(_flag("is_from_me"), F.greatest(s, F.lit(BASE))).otherwise(s)
    e = e.withColumn("score", F.when(F.col("reason") != "", 0).otherwise(s) / F.lit(1000.0))
    return e.withColumn("route", F.when(F.col("score") < 0.1, "skip").when(F.col("score") < 0.4, "low_priority").otherwise("full_triage"))


def facets(events: DataFrame) -> DataFrame:
    """(event_id, facet, value): the facets of each event that its source knows; none without a value."""
    f = lambda name, x: F.struct(F.lit(name).alias("facet"), x.cast("string").alias("value"))
    true = lambda name, x: f(name, F.when(x, "true"))
    mine = f("is_from_me", F.col("is_from_me"))
    mail = sender_address(F.col("sender"), _flag("is_from_me"))
    domain = F.when(mail.contains("@"), F.substring_index(mail, "@", -1))
    by = {
        "mail": [f("sender_domain", domain), true("is_automated", _flag("automated")), true("has_list_id", _flag("list_id")), f("email_category", F.col("category")), f("junk_level", F.when(F.col("junk_level") > 0, F.col("junk_level"))), true("time_sensitive", _flag("high_impact")), true("is_noreply", _flag("noreply")), true("has_reply", _flag("replied")), mine],
        "imessage": [true("is_filtered", _flag("is_filtered")), true("delivered_quietly", _flag("delivered_quietly")), true("is_auto_reply", _flag("is_auto_reply")), mine, f("is_group", F.col("is_group"))],
        "whatsapp": [f("is_group", F.col("is_group")), f("group_size", F.when(_flag("is_group"), F.col("n_participants"))), mine, f("content_type", F.when(_flag("shared_document"), "document").when(_flag("shared_url"), "url"))],
        "calendar": [f("calendar_noise", F.when(F.col("calendar_type").isin("holiday", "birthday"), F.col("calendar_type"))), true("has_attendees", F.col("n_attendees") > 0), f("organizer", F.col("organizer"))],
        "granola": [true("has_transcript", _flag("has_transcript")), f("participant_count", F.col("n_participants"))],
        "slack": [f("channel", F.col("channel")), true("has_thread", _flag("has_thread")), f("reply_count", F.when(F.col("reply_count") > 0, F.col("reply_count"))), mine],
    }
    none = F.array().cast("array<struct<facet:string,value:string>>")
    chosen = reduce(lambda a, kv: F.when(F.col("source") == kv[0], F.array(*kv[1])).otherwise(a), by.items(), none)
    return events.select("event_id", F.explode(chosen).alias("f")).filter("f.value is not null").select("event_id", "f.facet", "f.value")
