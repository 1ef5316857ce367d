"""Normalisers and extractors on text columns, all built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DOLLARS = r"\$[0-9,]+\.[0-9]{2}"
#: What a mail body is cut at.
QUOTES = r"(?m)^(>|-{3,} ?Original Message|_{10,}|Sent from my |On .{1,200} wrote:|From: )"
#: What marks a sender that nobody reads.
NO_REPLY = r"^(no-?reply|do-?not-?reply|notifications?|mailer-daemon|alerts?|updates?|newsletter)[@+._-]"
#: Assignments whose value is masked, in order.
SECRETS = [r"(?i)((?:password|passwd|token|secret|api_?key)\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^ \t\r\n]+)", r"(?i)(bearer )([A-Za-z0-9._-]+)", r"(://[^:/ @]+:)([^@/ ]+)"]


def title_case(x: Column) -> Column:
    """Each letter that follows no letter in upper case, all others in lower case (initcap goes by white space alone)."""
    parts = F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def _wide_digits() -> dict[str, str]:
    """Characters that compatibility decomposition turns into one digit, such as full-width and raised ones."""
    found = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(128, 0x11000))
    return {c: d for c, d in found if d != c and len(d) == 1 and d.isdigit()}


_WIDE = _wide_digits()


def normal_phone(x: Column) -> Column:
    """+ and digits of any script, full-width and raised ones as plain ones, ten digits get a leading 1; null without digits."""
    digits = F.regexp_replace(F.translate(x, "".join(_WIDE), "".join(_WIDE.values())), r"[^\p{Nd}]", "")
    return F.when(digits == "", None).when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(F.concat(F.lit("+"), digits))


def normal_email(x: Column) -> Column:
    """Lower case, trimmed; dots in the local part of two providers don't count."""
    low = F.lower(F.trim(x))
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.when(domain.isin("gmail.com", "googlemail.com"), F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@"), domain)).otherwise(low)


def participant(x: Column) -> Column:
    """struct(kind, value, name) of a participant string: noise, group, email, phone or name."""
    s = F.trim(F.regexp_replace(x, r"(?i);\s*CC:.*$", ""))
    inner = F.nullif(F.regexp_extract(s, r"<([^<>]*)>\s*$", 1), F.lit(""))
    name = F.when(inner.isNotNull(), F.nullif(F.trim(F.regexp_replace(s, r"<[^<>]*>\s*$", "")), F.lit("")))
    body = F.coalesce(inner, s)
    digits = F.regexp_replace(body, "[^0-9]", "")
    kind = (
        F.when(s.isNull() | (s == ""), "noise").when(s.startswith("#"), "group").when(body.rlike(rf"^{EMAIL}$"), "email")
        .when(inner.isNotNull() & body.rlike(r"^[0-9]+-[0-9]+$"), "group").when(inner.isNotNull() & (F.length(digits) > 15), "group")
        .when(F.length(digits) >= F.when(inner.isNotNull(), 8).otherwise(7), "phone").otherwise("name")
    )
    value = F.when(kind == "email", normal_email(body)).when(kind == "phone", normal_phone(body)).when(kind != "noise", body)
    return F.struct(kind.alias("kind"), value.alias("value"), name.alias("name"))


def clean_name(x: Column) -> Column:
    """Without wrappers such as "(via ...)" or "a >> b"; "LAST, FIRST" is turned round."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^.*>>\s*", ""), r"(?i)\s*\(?via [^)]*\)?\s*$", ""), r"\s+", " "))
    return F.when(s.rlike(r"^[^,]+, [^,]+$"), F.concat_ws(" ", F.trim(F.substring_index(s, ",", -1)), F.trim(F.substring_index(s, ",", 1)))).otherwise(s)


#: Words that say nothing about who bears a name.
NAME_STOPS = ["the", "and", "of", "for", "in", "at", "to", "from", "via", "a", "an", "inc", "llc", "ltd", "corp", "co", "group", "team"]


def name_tokens(x: Column, nicknames: dict[str, str] | None = None) -> Column:
    """Distinct words of at least two characters that are no stop words, nicknames as the names they stand for, sorted."""
    words = F.filter(F.split(F.lower(x), r"[\s,.\-_/]+"), lambda t: (F.length(t) > 1) & ~t.isin(NAME_STOPS))
    if nicknames:
        full = F.create_map(*(F.lit(v) for kv in nicknames.items() for v in kv))
        words = F.transform(words, lambda t: F.coalesce(full[t], t))
    return F.array_sort(F.array_distinct(words))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dollar_amounts(x: Column) -> Column:
    """Distinct amounts without sign and commas, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(DOLLARS), F.lit(0)), lambda m: F.regexp_replace(m, r"[$,]", "")))


def clean_mail_body(x: Column) -> Column:
    """Up to the first quote, without format characters and with blank lines collapsed."""
    cut = F.get(F.split(x, QUOTES, 2), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(cut, r"[\p{Cf}\p{Zl}\p{Zp}]", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


#: What the body of a mail should no longer hold, and the name of each.
LEAKS = {
    "quoted_reply": r"(?ms)^>.*^>", "attribution": r"(?m)^On .+ wrote:\s*$", "headers": r"(?ms)^From:.*^Sent:.*^To:.*^Subject:", "forwarded": r"(?i)-{5,}\s*forwarded message",
    "signature": r"(?im)^(best regards|kind regards|sent from my )", "html": r"(?i)<(div|html|body|table|span|br|p)\b[^>]*>", "invisible": r"[\u200B-\u200F\u2060\uFEFF\u00AD]",
}


def body_leaks(x: Column) -> Column:
    """The names of what a body still holds; null and empty hold nothing."""
    return F.array_compact(F.array(*(F.when(x.rlike(p), name) for name, p in LEAKS.items())))


def mask_secrets(x: Column) -> Column:
    for pattern in SECRETS:
        x = F.regexp_replace(x, pattern, "$1[REDACTED]")
    return x


#: What is masked in text that leaves, in this order, and the hosts whose URLs stay.
MASKED = [
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[email]"),
    (r"(?U)\b\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[phone]"),
    (r"(?U)https?://(?!(?:acme|loom|linkedin|github))\S+", "[url]"),
]


def mask_contacts(x: Column) -> Column:
    """E-mail addresses, then phone numbers, then URLs become marks."""
    for pattern, mark in MASKED:
        x = F.regexp_replace(x, pattern, mark)
    return x


def to_unix(x: Column) -> Column:
    """Seconds since 1970 from a number that may count from 1970 or 2001, in s, ms, us or ns, or from 1601 in us."""
    apple, windows = 978_307_200, 11_644_473_600
    return F.floor(
        F.when(x > 10**17, x / 10**9 + apple).when(x > 10**16, x / 10**6 - windows).when(x > 10**14, x / 10**6).when(x > 10**11, x / 10**3).when(x < 10**9 - 2 * 10**8, x + apple).otherwise(x)
    ).cast("long")
