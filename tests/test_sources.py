"""Readers, snapshot tables and streams."""

import gzip
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, snapshots
from tidemark.streaming import jobs


def test_shell(spark, tmp_path):
    (tmp_path / "h").write_text(": 1700000000:0;ls -l\njunk\n: 1700000005:0;echo a \\\nb\n: 1700000009:0;export API_KEY=abc\n")
    assert sorted(map(tuple, readers.shell_history(spark, str(tmp_path)).collect())) == [(1700000000, "ls -l"), (1700000005, "echo a \nb"), (1700000009, "export API_KEY=[REDACTED]")]


def test_browser_and_focus(spark, tmp_path):
    for k, base in (("a", 13_300_000_000_000_000), ("b", 13_300_000_001_000_000)):
        with sqlite3.connect(tmp_path / f"{k}.db") as con:
            con.executescript("create table urls(id, url, title); create table visits(id, url, visit_time)")
            con.execute("insert into urls values (1, 'https://Ex.org/x', 't'), (2, 'chrome://settings', null)")
            con.execute("insert into visits values (1, 1, ?), (2, 2, ?)", (base, base))
    rows = readers.browser_visits(spark, f"{tmp_path}/*.db").orderBy("ts").collect()
    assert [(r["ts"], r["domain"]) for r in rows] == [(1655526400, "ex.org"), (1655526401, "ex.org")]
    with sqlite3.connect(tmp_path / "f.sqlite") as con:
        con.execute("create table ZOBJECT(ZSTREAMNAME, ZVALUESTRING, ZSTARTDATE, ZENDDATE)")
        con.execute("insert into ZOBJECT values ('/app/usage', 'editor', 700000000, 700000090.5), ('/app/usage', 'bad', 5, 5), ('/other', 'x', 1, 2)")
    assert [tuple(r) for r in readers.app_focus(spark, f"{tmp_path}/f.sqlite").collect()] == [("editor", 1678307200, 90)]


def test_mails(spark, tmp_path):
    mail = "From: Ann <a@x.org>\nTo: b@y.org\nSubject: {}\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nhello\n> old\n"
    for k, subject in enumerate(("plan", " Plan ", "other")):
        body = mail.format(subject).encode()
        (tmp_path / f"{k}.emlx").write_bytes(b"%d\n" % len(body) + body)
    rows = readers.mail_files(spark, str(tmp_path)).collect()
    assert sorted((r["subject"].lower(), r["ts"], r["body"]) for r in rows) == [("other", 1704103200, "hello"), ("plan", 1704103200, "hello")]


def test_json_sources(spark, tmp_path):
    write = lambda name, rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    write("m", [{"channel": "c", "ts": "1700000000.5", "user": "u", "text": "hi"}, {"channel": "c", "ts": "1700000009.0", "thread_ts": "1700000000.5"}, {"channel": "c"}])
    assert sorted((r["thread_id"], r["ts"]) for r in readers.channel_messages(spark, f"{tmp_path}/m").collect()) == [("c:1700000000.5", 1700000000), ("c:1700000000.5", 1700000009)]
    write("c", [{"name": "Ann", "emails": ["a", "b"], "phones": []}, {"name": "Bo"}])
    assert {tuple(r) for r in readers.contacts(spark, f"{tmp_path}/c").collect()} == {("Ann", "a", None), ("Ann", "b", None), ("Bo", None, None)}
    write("g", [{"item_id": "1", "stage": "s", "judgment": "bad", "reviewed_at": 1}, {"item_id": "1", "stage": "s", "judgment": "good", "reviewed_at": 2}])
    assert [r["judgment"] for r in readers.golden_records(spark, f"{tmp_path}/g").collect()] == ["good"]
    assert readers.golden_records(spark, f"{tmp_path}/g", "bad").count() == 0
    (tmp_path / "n.gz.note").write_bytes(gzip.compress(b"text"))
    (tmp_path / "x.note").write_bytes(b"plain")
    assert sorted(r["text"] or "" for r in readers.gzip_notes(spark, f"{tmp_path}/*.note").collect()) == ["", "text"]
    assert readers.get_reader("shell") is readers.shell_history and readers.get_reader("none") is None
    with pytest.raises(ValueError, match="b"):
        readers.require_columns(spark.range(1), ["id", "b"])


def test_snapshots(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t", "id long, name string, tier int, prior_tier int, n long, at long", ["id"])
    df = lambda *rows: spark.createDataFrame(rows, "id long, name string, tier int, n long, at long")
    full = lambda d: d.withColumn("prior_tier", F.lit(None).cast("int"))
    assert t.read().count() == 0
    assert t.insert_new(full(df((1, "a", 1, 1, 5), (1, "z", 1, 1, 5), (2, "b", 2, 1, 5))), F.col("name")) == 2
    assert t.insert_new(full(df((2, "x", 2, 1, 5)))) == 0
    t.upsert(df((1, "", 3, 4, 2), (3, "c", 1, 1, 1)), keep=(), fill=("name",), add=("n",), most=("at",), prior={"prior_tier": "tier"})
    assert {tuple(r) for r in t.read().collect()} == {(1, "a", 3, 1, 5, 5), (2, "b", 2, None, 1, 5), (3, "c", 1, None, 1, 1)}
    t.update(F.col("id") == 2, name="q")
    t.delete(F.col("prior_tier") == 1)
    t.append(full(df((4, "d", 1, 1, 9))))
    t.keep_newest(2, F.desc("at"), F.col("id"))
    t.vacuum()
    assert {(r["id"], r["name"]) for r in t.read().collect()} == {(4, "d"), (2, "q")} and len(os.listdir(tmp_path / "t/data")) == 2


def test_merge_and_rename(spark):
    edges = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 2, "b")], "event_id long, person_id long, role string")
    assert {tuple(r) for r in snapshots.merge_person(edges, 1, 2).collect()} == {(1, 1, "a"), (2, 1, "b")}
    notes = spark.createDataFrame([(1, "topic", "AI"), (1, "topic", "ml"), (1, "x", "AI")], "event_id long, facet string, value string")
    names = spark.createDataFrame([("AI", "ml")], "raw string, canonical string")
    assert {tuple(r) for r in snapshots.rename_topics(notes, names).collect()} == {(1, "topic", "ml"), (1, "x", "AI")}


def test_streams(spark, tmp_path):
    """A stream fed twice with the same events ingests each once; windows and sessions equal the batch's."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t", jobs.EVENTS, ["event_id"])
    for _ in range(2):
        jobs.ingest(jobs.event_stream(spark, f"{tmp_path}/in", 1), table, f"{tmp_path}/cp").awaitTermination()
        assert table.read().count() == events.count()
    read = lambda: jobs.event_stream(spark, f"{tmp_path}/in")
    for name, stream in (("once", jobs.once_each(read(), "60 days")), ("tumbling", jobs.tumbling_counts(read())), ("sessions", jobs.sessions(read()))):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == events.count()
    for name, build in (("tumbling", jobs.tumbling_counts), ("sessions", jobs.sessions)):
        expected = {tuple(r)[:-1] for r in build(events).select(spark.table(name).columns).drop("n", "total").withColumn("x", F.lit(1)).collect()}
        got = {tuple(r)[:-1] for r in spark.table(name).drop("n", "total").withColumn("x", F.lit(1)).collect()}
        assert got and got <= expected  # windows that the watermark hasn't passed stay open
