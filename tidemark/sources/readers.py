"""Readers of the sources that events come from. Each gives a DataFrame; files are read where they lie, by Spark.

Small private formats (SQLite files, mail files, gzip notes) are opened file by file in Arrow batches, so many files spread over the cluster.
"""

from __future__ import annotations

import gzip
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx

_READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _READERS[name] = f
        return f

    return add


def get_reader(name: str) -> Callable[..., DataFrame] | None:
    return _READERS.get(name)


def require_columns(df: DataFrame, required: list[str], optional: list[str] = ()) -> list[str]:
    """The optional columns that are there; ValueError names the required ones that aren't."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in optional if c in df.columns]


def source_id(*parts) -> Column:
    """A stable id for sources without one: 20 hex digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 20)


@reader("shell")
def shell_history(spark: SparkSession, path: str) -> DataFrame:
    """(ts, command) from lines ``: epoch:seconds;command``, continued after a backslash; secrets are masked."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"\\\n", "\u0001"), "\n")).alias("line"))
    m = lambda i: F.regexp_extract("line", r"(?s)^: ([0-9]+):[0-9]+;(.*)$", i)
    return lines.filter(F.col("line").rlike(r"^: [0-9]+:[0-9]+;")).select(m(1).cast("long").alias("ts"), tx.mask_secrets(F.replace(m(2), F.lit("\u0001"), F.lit("\n"))).alias("command"))


@reader("sqlite")
def sqlite_query(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of a query over each SQLite file under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content)
                    f.flush()
                    with sqlite3.connect(f.name) as con:
                        yield pd.read_sql(sql, con)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


@reader("browser")
def browser_visits(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, ts, domain, url, title) of a browser history of visits and urls; its own pages are left out."""
    rows = sqlite_query(spark, path, "select u.url, u.title, v.visit_time from visits v join urls u on u.id = v.url", "url string, title string, visit_time long")
    rows = rows.filter(~F.col("url").rlike("^(chrome|about|file|data|javascript)"))
    return rows.select(source_id(F.lit("visit"), "url", F.col("visit_time").cast("string")).alias("source_id"), tx.to_unix(F.col("visit_time").cast("double")).alias("ts"), F.lower(F.parse_url("url", F.lit("HOST"))).alias("domain"), "url", "title")


@reader("app_focus")
def app_focus(spark: SparkSession, path: str) -> DataFrame:
    """(app, ts, seconds) of focus intervals; times count from 2001."""
    rows = sqlite_query(spark, path, "select ZVALUESTRING as app, ZSTARTDATE as s, ZENDDATE as e from ZOBJECT where ZSTREAMNAME = '/app/usage'", "app string, s double, e double")
    return rows.filter("e > s").select("app", F.floor(F.col("s") + 978_307_200).alias("ts"), F.floor(F.col("e") - F.col("s")).alias("seconds"))


@reader("mail_files")
def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, sender, to, cc, subject, ts, body) of mail files, bodies without quotes; of equal (time, sender, subject) one stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["content"]:
                head = re.match(rb"^\d+\s*\n", raw)
                m = message_from_bytes(raw[head.end() :] if head else raw, policy=policy.default)
                part = m.get_body(("plain", "html"))
                date = m["date"].datetime if m["date"] is not None else None
                rows.append((str(m["from"] or ""), str(m["to"] or ""), str(m["cc"] or ""), str(m["subject"] or "").strip(), int(date.timestamp()) if date else None, part.get_content() if part else ""))
            yield pd.DataFrame(rows, columns=["sender", "to", "cc", "subject", "ts", "body"]).astype({"ts": "Int64"})

    mails = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "sender string, to string, cc string, subject string, ts long, body string")
    keyed = mails.withColumn("source_id", source_id(F.coalesce(F.col("ts").cast("string"), F.lit("")), F.lower("sender"), F.lower(F.trim("subject"))))
    newest = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("ts"), "subject", "body")
    return keyed.withColumn("r", F.row_number().over(newest)).filter("r = 1").drop("r").withColumn("body", tx.clean_mail_body(F.col("body")))


@reader("notes")
def gzip_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of gzip files; what isn't gzip has a null text."""

    @F.pandas_udf("string")
    def inflate(x: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            try:
                return gzip.decompress(b).decode("utf-8", "replace")
            except OSError:
                return None

        return x.map(one)

    return spark.read.format("binaryFile").load(path).select("path", inflate("content").alias("text"))


@reader("messages")
def channel_messages(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, thread_id, ts, sender, text) of JSON lines (channel, ts, thread_ts, user, text); a thread is its first message."""
    rows = spark.read.schema("channel string, ts string, thread_ts string, user string, text string").json(path)
    return rows.filter("ts is not null").select(F.concat_ws(":", "channel", "ts").alias("source_id"), F.concat_ws(":", "channel", F.coalesce("thread_ts", "ts")).alias("thread_id"), F.floor(F.col("ts").cast("double")).alias("ts"), F.col("user").alias("sender"), "text")


@reader("contacts")
def contacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, email, phone) of JSON lines (name, emails, phones): a row for each pairing of them, nulls where one is missing."""
    rows = spark.read.schema("name string, emails array<string>, phones array<string>").json(path)
    return rows.select("name", F.explode_outer("emails").alias("email"), "phones").select("name", "email", F.explode_outer("phones").alias("phone"))


@reader("golden")
def golden_records(spark: SparkSession, path: str, judgment: str | None = None) -> DataFrame:
    """(item_id, stage, judgment, reviewed_at) of JSON lines, the last of each item and stage."""
    rows = spark.read.schema("item_id string, stage string, judgment string, reviewed_at long").json(path)
    last = Window.partitionBy("stage", "item_id").orderBy(F.desc("reviewed_at"), "judgment")
    rows = rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")
    return rows if judgment is None else rows.filter(F.col("judgment") == judgment)
