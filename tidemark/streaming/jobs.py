"""Incremental ingest and windowed aggregates by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.snapshots import SnapshotTable

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 16, since: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream of events, from a time on if one is given."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows if since is None else rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))


def once_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, by its id; state of an id is dropped when the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def overlap_stream(meetings: DataFrame, calls: DataFrame, slack: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls (person_id, call_id, ts) within ``slack`` of a meeting (person_id, meet_id, ts); the time bound lets old state go."""
    m = meetings.select(F.col("person_id").alias("p"), "meet_id", F.col("ts").alias("m")).withWatermark("m", late)
    c = calls.select("person_id", "call_id", "ts").withWatermark("ts", late)
    return m.join(c, F.expr(f"p = person_id and ts between m - interval {slack} and m + interval {slack}")).select("person_id", "meet_id", "call_id")


def ingest(events: DataFrame, table: SnapshotTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Insert each micro-batch's new events into a snapshot table. Batches run one after the other, and what arrives meanwhile is one next batch.
    A batch that is run again finds its ids there, so nothing doubles. Without ``every`` it takes what is there and ends."""

    def write(batch: DataFrame, _: int) -> None:
        table.insert_new(batch)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
