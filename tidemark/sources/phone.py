"""Readers of the private stores of messages, calls, a second browser, mail recipients, meeting documents and profiles."""

from __future__ import annotations

import json
import re
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.sources.readers import reader, source_id, sqlite_query

#: Seconds from 1970 to 2001, what reactions are called, and kinds of calls.
SINCE_2001 = 978_307_200
REACTIONS = {2000: "liked", 2001: "loved", 2002: "disliked", 2003: "laughed", 2004: "emphasized", 2005: "questioned", 2006: "removed_reaction"}
#: Beginnings of addresses that nobody reads, and domains of applicant systems.
NO_REPLY = [
    "noreply@", "no-reply@", "no_reply@", "donotreply@", "do-not-reply@", "do_not_reply@", "notifications@", "notification@", "notify@", "mailer-daemon@", "postmaster@", "auto@", "automated@", "system@",
    "bounce@", "bounces@", "info@", "support@", "updates@",
]
APPLICANT_DOMAINS = [
    "greenhouse-mail.io", "greenhouse.io", "codesignal.com", "lever.co", "ashbyhq.com", "workday.com", "icims.com", "smartrecruiters.com", "jobvite.com", "myworkday.com",
]


def tables(spark: SparkSession, path: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """(path, missing, optional): of each SQLite file the required tables that it lacks and the optional ones that it has; a file that is no database lacks all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"]):
                have: set[str] = set()
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content)
                    f.flush()
                    try:
                        with sqlite3.connect(f.name) as con:
                            have = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
                    except sqlite3.DatabaseError:
                        pass
                out.append((p, [t for t in required if t not in have], [t for t in optional if t in have]))
            yield pd.DataFrame(out, columns=["path", "missing", "optional"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, missing array<string>, optional array<string>")


def no_reply(address: Column) -> Column:
    """Whether nobody reads what is sent to an address: by how it begins, or by its domain or one above it."""
    low = F.lower(address)
    host = F.substring_index(low, "@", -1)
    starts = "^(" + "|".join(re.escape(p) for p in NO_REPLY) + ")"
    ends = r"(^|\.)(" + "|".join(re.escape(d) for d in APPLICANT_DOMAINS) + ")$"
    return F.coalesce(low.rlike(starts) | (low.contains("@") & host.rlike(ends)), F.lit(False))


@reader("recipients")
def recipients(spark: SparkSession, path: str) -> DataFrame:
    """(message, to, cc, bcc) of a mail index: the addresses of each message in their order."""
    sql = "select r.message, r.type, r.position, a.address from recipients r left join addresses a on r.address = a.ROWID"
    rows = sqlite_query(spark, path, sql, "message long, type long, position long, address string").filter("address is not null and address <> ''")
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == k, F.struct("position", "address")))), lambda x: x["address"])
    return rows.groupBy("message").agg(of(0).alias("to"), of(1).alias("cc"), of(2).alias("bcc"))


@reader("text_messages")
def text_messages(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, ts, event_type, sender, is_from_me, thread_id, text, reaction) of a store of text messages.

    Spam, system and service messages are left out, so are reactions taken back; other reactions are events without text. A
    conversation of two has a thread named by the other's handle. Times are nanoseconds since 2001.
    """
    sql = """select m.ROWID as id, m.text, m.date, m.is_from_me, m.associated_message_type as kind, h.id as handle, c.ROWID as chat, c.display_name as chat_name
        from message m left join handle h on m.handle_id = h.ROWID left join chat_message_join j on j.message_id = m.ROWID left join chat c on c.ROWID = j.chat_id
        where m.is_spam = 0 and m.is_system_message = 0 and m.is_service_message = 0"""
    m = sqlite_query(spark, path, sql, "id long, text string, date long, is_from_me long, kind long, handle string, chat long, chat_name string")
    kind = F.coalesce("kind", F.lit(0))
    label = F.create_map(*(F.lit(x) for kv in REACTIONS.items() for x in kv))[kind]
    m = m.withColumn("reaction", F.when(kind != 0, F.coalesce(label, F.concat(F.lit("type_"), kind.cast("string"))))).filter("reaction is null or reaction <> 'removed_reaction'")
    thread = F.when(F.col("chat_name") != "", F.concat(F.lit("chat:"), F.col("chat").cast("string"))).otherwise(F.concat(F.lit("imessage:"), F.coalesce("handle", F.lit("unknown"))))
    return m.select(
        F.col("id").cast("string").alias("source_id"), F.floor(F.col("date") / 1e9 + SINCE_2001).alias("ts"), F.when(F.col("reaction").isNull(), "message").otherwise("reaction").alias("event_type"),
        F.when(F.col("is_from_me") == 0, F.col("handle")).alias("sender"), (F.col("is_from_me") == 1).alias("is_from_me"), F.when(F.col("reaction").isNull(), thread).alias("thread_id"),
        F.when(F.col("reaction").isNull(), F.col("text")).alias("text"), "reaction",
    )


@reader("chat_messages")
def chat_messages(spark: SparkSession, path: str, skipped: tuple[int, ...] = (10, 11, 14, 15, 23), reaction: int = 59) -> DataFrame:
    """(source_id, ts, event_type, sender, is_from_me, thread_id, is_group, text) of a chat store; kinds that are no messages are left out, one kind is reactions."""
    sql = """select m.Z_PK as id, m.ZTEXT as text, m.ZMESSAGEDATE as date, m.ZISFROMME as mine, m.ZMESSAGETYPE as kind, m.ZFROMJID as jid, s.ZCONTACTJID as chat, g.ZMEMBERJID as member
        from ZWAMESSAGE m left join ZWACHATSESSION s on m.ZCHATSESSION = s.Z_PK left join ZWAGROUPMEMBER g on m.ZGROUPMEMBER = g.Z_PK"""
    m = sqlite_query(spark, path, sql, "id long, text string, date double, mine long, kind long, jid string, chat string, member string").filter(~F.coalesce("kind", F.lit(0)).isin(*skipped))
    return m.select(
        F.col("id").cast("string").alias("source_id"), F.floor(F.col("date") + SINCE_2001).alias("ts"), F.when(F.col("kind") == reaction, "reaction").otherwise("message").alias("event_type"),
        F.when(F.col("mine") == 0, F.coalesce("member", "jid", "chat")).alias("sender"), (F.col("mine") == 1).alias("is_from_me"), F.col("chat").alias("thread_id"),
        F.coalesce(F.col("chat").endswith("@g.us"), F.lit(False)).alias("is_group"), F.when(F.coalesce(F.col("kind"), F.lit(0)) != reaction, F.col("text")).alias("text"),
    )


@reader("chat_names")
def chat_names(spark: SparkSession, path: str) -> DataFrame:
    """(jid, name): who an address of a chat store is, by the name of its conversation, else the name it gives itself, else its name in a group."""
    sql = """select ZCONTACTJID as jid, ZPARTNERNAME as name, 0 as rank from ZWACHATSESSION where ZCONTACTJID like '%@s.whatsapp.net'
        union all select ZJID, ZPUSHNAME, 1 from ZWAPROFILEPUSHNAME union all select ZMEMBERJID, coalesce(nullif(ZCONTACTNAME, ''), ZFIRSTNAME), 2 from ZWAGROUPMEMBER"""
    rows = sqlite_query(spark, path, sql, "jid string, name string, rank int").filter("jid is not null and name is not null and name <> ''")
    return rows.groupBy("jid").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


def own_address(members: DataFrame, least: int = 3) -> DataFrame:
    """(address, conversations): who of members (conversation, address) is in most conversations, if in three at least: the user."""
    n = members.groupBy("address").agg(F.countDistinct("conversation").alias("conversations"))
    return n.filter(F.col("conversations") >= least).orderBy(F.desc("conversations"), "address").limit(1)


@reader("calls")
def calls(spark: SparkSession, path: str, least_seconds: float = 10) -> DataFrame:
    """(source_id, ts, seconds, address, originated, answered, call_type) of a call log; short calls and those without an address are left out."""
    rows = sqlite_query(spark, path, "select Z_PK as id, ZDATE as date, ZDURATION as seconds, ZADDRESS as address, ZORIGINATED as o, ZANSWERED as a, ZCALLTYPE as kind from ZCALLRECORD", "id long, date double, seconds double, address string, o long, a long, kind long")
    rows = rows.filter((F.col("seconds") >= least_seconds) & (F.trim("address") != ""))
    kind = F.when(F.col("kind") == 8, "video").when(F.col("kind") == 16, "audio").otherwise("voice")
    return rows.select(source_id(F.lit("macos_call"), F.col("id").cast("string")).alias("source_id"), F.floor(F.col("date") + SINCE_2001).alias("ts"), F.round("seconds", 1).alias("seconds"), F.coalesce(tx.normal_phone(F.col("address")), F.trim("address")).alias("address"), (F.col("o") == 1).alias("originated"), (F.col("a") == 1).alias("answered"), kind.alias("call_type"))


@reader("tagged_visits")
def tagged_visits(spark: SparkSession, path: str) -> DataFrame:
    """(visit_id, ts, url, domain, tags) of the other browser history, each visit once with all its tags."""
    sql = "select v.id, v.visit_time, i.url, i.domain_expansion as domain, t.tag from history_visits v join history_items i on v.history_item = i.id left join history_tags t on v.history_item = t.history_item"
    rows = sqlite_query(spark, path, sql, "id long, visit_time double, url string, domain string, tag string").filter(~F.col("url").rlike("^(about|file|data|javascript):"))
    return rows.groupBy(F.col("id").alias("visit_id"), F.floor(F.col("visit_time") + SINCE_2001).alias("ts"), "url", "domain").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def document_text(node: dict | None) -> str:
    """A rich-text document as lines: headings with their marks, lists with theirs."""
    if not isinstance(node, dict):
        return ""
    kind, inner = node.get("type"), [document_text(c) for c in node.get("content") or []]
    if kind == "text":
        return node.get("text") or ""
    if kind in ("heading", "paragraph"):
        joined = "".join(inner)
        return "#" * int((node.get("attrs") or {}).get("level", 1)) + " " + joined if kind == "heading" and joined else joined
    if kind in ("bulletList", "orderedList"):
        items = ["".join(document_text(c) for c in item.get("content") or []) for item in node.get("content") or []]
        return "\n".join((f"{i}. " if kind == "orderedList" else "- ") + x for i, x in enumerate(items, 1) if x)
    return "\n".join(x for x in inner if x)


@reader("meeting_documents")
def meeting_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, title, ts, participants, text, has_transcript) of JSON lines (id, title, created_at, people, notes, transcript); notes are a rich-text document, transcripts lines of speech."""

    @F.pandas_udf("string")
    def flat(x: pd.Series) -> pd.Series:
        return x.map(lambda s: document_text(json.loads(s)) if s else "")

    rows = spark.read.schema("id string, title string, created_at long, people array<string>, notes string, transcript array<struct<speaker: string, text: string>>").json(path)
    said = F.array_join(F.transform("transcript", lambda t: F.concat(F.coalesce(t["speaker"], F.lit("?")), F.lit(": "), t["text"])), "\n")
    text = F.concat_ws("\n", F.nullif(flat("notes"), F.lit("")), F.nullif(said, F.lit("")))
    return rows.select(F.col("id").alias("source_id"), "title", F.col("created_at").alias("ts"), F.col("people").alias("participants"), text.alias("text"), F.coalesce(F.size("transcript") > 0, F.lit(False)).alias("has_transcript"))


@reader("calendar")
def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, ts, end_ts, title, attendees, organizer, body) of JSON lines (key, start, end, title, notes, location, status, organizer, attendees); cancelled ones are left out."""
    rows = spark.read.schema("key string, start long, end long, title string, notes string, location string, status string, organizer string, attendees array<string>").json(path)
    body = F.concat_ws("\n", "title", "location", "notes")
    return rows.filter("coalesce(status, '') <> 'cancelled'").select(source_id(F.lit("calendar"), "key", F.col("start").cast("string")).alias("source_id"), F.col("start").alias("ts"), F.col("end").alias("end_ts"), "title", "attendees", "organizer", body.alias("body"))


@reader("profile")
def profile(spark: SparkSession, path: str) -> DataFrame:
    """(name, emails, phones) of a user's profile: JSON, or lines ``name: x`` and lists in brackets or as "- x" below their key; empty without a name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["value"]:
                try:
                    got = json.loads(raw)
                    got = got.get("user", got)
                except ValueError:
                    got, key = {}, None
                    for line in raw.splitlines():
                        if m := re.match(r"^(\w+):\s*(.*)$", line):
                            key, rest = m[1], m[2].strip()
                            got[key] = [x.strip(" '\"") for x in rest[1:-1].split(",") if x.strip()] if rest.startswith("[") else rest.strip("'\"") or []
                        elif (m := re.match(r"^\s*-\s*(.+)$", line)) and isinstance(got.get(key), list):
                            got[key].append(m[1].strip(" '\""))
                if got.get("name"):
                    out.append((got["name"], list(got.get("emails") or []), [str(p) for p in got.get("phones") or []]))
            yield pd.DataFrame(out, columns=["name", "emails", "phones"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "name string, emails array<string>, phones array<string>")


def newest_undo(stack: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entry of an undo stack (id, created_at) that was put on last, and the stack without it."""
    top = stack.orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    return top, stack.join(top.select("id"), "id", "left_anti")


def next_position(table: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """table (key, position) with the rows of new (key) that it lacks, behind its last position in their order; others stay."""
    last = table.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("last"))
    fresh = new.select(key).distinct().join(table, key, "left_anti")
    placed = fresh.withColumn("r", F.row_number().over(Window.orderBy(key))).join(F.broadcast(last)).select(key, (F.col("last") + F.col("r")).cast(table.schema["position"].dataType).alias("position"))
    return table.select(key, "position").unionByName(placed)
