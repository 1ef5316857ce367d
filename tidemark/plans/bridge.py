"""Canonical tables of the event model, derived from the driver's tables, and the same derivations in SQL.

``now`` is always the newest event's time, never the clock, so every query has one right answer.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds since 1970 of a timestamp without time zone, whatever the session's zone.
EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({} as timestamp_ntz))"
PEOPLE = 150

SQL = f"""
WITH ev AS (SELECT event_id, substr(sha256('events:' || event_id), 1, 24) AS id,
    CASE event_type WHEN 'click' THEN 'mail' WHEN 'view' THEN 'imessage' WHEN 'purchase' THEN 'whatsapp' WHEN 'signup' THEN 'calendar' ELSE 'slack' END AS source,
    event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS person_id, json_extract_string(props, '$.k') AS thread_id,
    event_id % 3 = 0 AS is_from_me, CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0 AS is_group, value AS amount FROM events),
ep AS (SELECT event_id, person_id, CASE WHEN is_from_me THEN 'self' ELSE 'sender' END AS role FROM ev
    UNION ALL SELECT event_id, (event_id * 7 + 3) % {PEOPLE} AS person_id, 'recipient' AS role FROM ev WHERE (event_id * 7 + 3) % {PEOPLE} <> person_id),
clock AS (SELECT max(ts) AS now FROM ev),
cl AS (SELECT o_orderkey AS claim_id, o_custkey AS person_id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS status,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, least(o_totalprice / 500000.0, 0.99::DOUBLE) AS confidence,
    strftime(o_orderdate, '%Y-%m-%d') AS deadline, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at FROM orders),
ce AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS event_id FROM lineitem),
today AS (SELECT max(created_at) - 30 * 86400 AS now, strftime(max(o_orderdate) - INTERVAL 30 DAY, '%Y-%m-%d') AS day FROM cl JOIN orders ON o_orderkey = claim_id)
"""


#: Tables of the store, of the same SQL in both engines: {{name}} is another table.
STORE = {
    "pe": "SELECT c_custkey AS person_id, c_name AS name, c_custkey = 1 AS is_user, c_nationkey AS place FROM {customer}",
    "pid": """SELECT c_custkey AS person_id, 'email' AS id_type, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.com' AS identifier FROM {customer}
        UNION ALL SELECT c_custkey, 'phone', '+1' || (2000000000 + c_custkey) FROM {customer} UNION ALL SELECT c_custkey, 'display_name', translate(c_name, '#0123456789', ' abcdefghij') FROM {customer}""",
    "be": """SELECT o_orderkey AS belief_id, CASE o_orderkey % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'relation' WHEN 2 THEN 'observation' ELSE 'entity' END AS belief_type, o_custkey AS subject,
        CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'active' END AS status, least(o_totalprice / CAST(500000 AS DOUBLE), CAST(0.99 AS DOUBLE)) AS confidence, o_orderkey AS claim_a, o_orderkey + 1 AS claim_b FROM {orders}""",
    "an": """SELECT event_id, 'topic' AS facet, 'topic ' || (CAST(thread_id AS INT) % 20) AS value, source FROM {ev}
        UNION ALL SELECT event_id, 'sender_domain', 'd' || (person_id % 13) || '.com', source FROM {ev} UNION ALL SELECT event_id, 'person_mention', 'name ' || (event_id * 31 % 211), source FROM {ev} WHERE amount > 40""",
    "sy": "SELECT 'topic ' || n_nationkey AS raw, 'region ' || n_regionkey AS canonical FROM {nation}",
    "pr": """SELECT event_id, 'default' AS lens, score, CASE WHEN score < 0.1 THEN 'skip' WHEN score < 0.4 THEN 'low_priority' ELSE 'full_triage' END AS route
        FROM (SELECT event_id, CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 AS score FROM {ev}) x""",
    "tk": """SELECT o_orderkey AS task_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'immediate' WHEN '2' THEN 'review' ELSE 'background' END AS bucket, o_orderkey * 7 % 1000 AS position,
        o_orderstatus = 'F' AS done, o_custkey AS person_id, o_custkey % 40 AS story_id FROM {orders}""",
    "ru": """SELECT s_suppkey AS rule_id, CASE s_suppkey % 2 WHEN 0 THEN '@d' || (s_suppkey % 26) || '.com' ELSE 'c' || s_suppkey || '@building.com' END AS pattern,
        CASE s_suppkey % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'boost' ELSE 'mute' END AS action, CAST(floor(s_acctbal * 100) AS BIGINT) AS created_at FROM {supplier}""",
    "st": """SELECT c_custkey AS story_id, CASE c_custkey % 3 WHEN 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 END AS override,
        CASE WHEN c_custkey % 7 > 0 THEN c_nationkey % 5 END AS priority, CAST(floor(c_acctbal * 100) AS BIGINT) AS updated_at FROM {customer}""",
    "rw": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'mail' WHEN 1 THEN 'mail' WHEN 2 THEN 'imessage' WHEN 3 THEN 'whatsapp' WHEN 4 THEN 'calendar' WHEN 5 THEN 'granola' WHEN 6 THEN 'calls' ELSE 'slack' END AS source,
        CASE WHEN amount > 130 THEN 'reaction' ELSE 'message' END AS event_type, ts, thread_id, person_id AS a, (person_id * 3 + 1) % 100 AS b, is_from_me, amount, CAST(thread_id AS INT) AS k,
        CAST(thread_id AS INT) % 5 = 0 AS replied, CAST(thread_id AS INT) % 11 = 0 AS flagged, CASE WHEN CAST(thread_id AS INT) % 6 < 4 THEN CAST(thread_id AS INT) % 6 END AS category, amount > 60 AS urgent,
        person_id % 4 = 0 AS automated, person_id % 5 = 0 AS list_id, CASE WHEN CAST(thread_id AS INT) % 13 = 0 THEN 1 ELSE 0 END AS junk_level, person_id % 6 = 0 AS noreply, amount BETWEEN 20 AND 40 AS high_impact,
        CAST(thread_id AS INT) % 4 = 0 AS is_filtered, person_id % 7 = 0 AS delivered_quietly, CAST(thread_id AS INT) % 9 = 0 AS is_auto_reply, CAST(thread_id AS INT) % 2 = 0 AS is_group, CAST(thread_id AS INT) % 17 AS n_participants,
        amount > 30 AS shared_url, person_id % 3 = 0 AS shared_document, CAST(thread_id AS INT) % 4 AS n_attendees, CASE person_id % 8 WHEN 0 THEN 'holiday' WHEN 1 THEN 'birthday' ELSE 'work' END AS calendar_type,
        CAST(thread_id AS INT) % 3 = 0 AS has_transcript, person_id % 2 = 0 AS has_thread, CAST(thread_id AS INT) % 6 AS reply_count, 'team ' || (person_id % 5) AS channel, 'o' || (person_id % 7) || '@x.org' AS organizer,
        CASE CAST(thread_id AS INT) % 8 WHEN 0 THEN 'Your order receipt' WHEN 1 THEN ' RE: Verify your address' WHEN 2 THEN 'Lunch' WHEN 3 THEN '50% off today' WHEN 4 THEN 'Appointment reminder' WHEN 5 THEN 'Welcome to the club' ELSE 'Notes' END AS subject,
        CASE CAST(floor(amount) AS INT) % 5 WHEN 0 THEN 'http1 http2 http3 http4 http5 http6' WHEN 1 THEN 'Your statement is READY' WHEN 2 THEN 'Dear Customer, hello' ELSE 'see you' END AS body,
        CASE person_id % 9 WHEN 0 THEN 'No-Reply@shop.com' WHEN 1 THEN 'Bo <Bo@GitHub.com>' WHEN 2 THEN 'Ann Lee' ELSE 'c' || person_id || '@x.org' END AS sender FROM {ev}""",
    "sp": """SELECT l_shipdate AS spent_at, 'provider ' || (l_suppkey % 3) AS provider, CASE WHEN l_linenumber = 1 THEN 'onboarding' ELSE 'triage' END AS source,
        'model ' || (l_partkey % 4) AS model, CAST(l_quantity * 1000 AS BIGINT) AS input_tokens, CAST(l_quantity * 100 AS BIGINT) AS output_tokens, CAST(l_quantity * 300 AS BIGINT) AS cached_tokens FROM {lineitem}""",
}
#: In the order in which they may use each other, for the SQL of DuckDB.
SQL = SQL.rstrip() + "".join(f",\n{name} AS ({text.format_map(type('Same', (dict,), {'__missing__': lambda self, key: key})())})" for name, text in STORE.items()) + "\n"


class Tables:
    """The driver's tables under their own names, and the canonical ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def store(self, name: str) -> DataFrame:
        """A table of STORE."""
        text = STORE[name]
        used = {x for x in ("customer", "orders", "nation", "supplier", "lineitem", "ev") if f"{{{x}}}" in text}
        return self.spark.sql(text, **{x: self.events if x == "ev" else self.read(x) for x in used})

    @cached_property
    def events(self) -> DataFrame:
        source = F.expr("case event_type when 'click' then 'mail' when 'view' then 'imessage' when 'purchase' then 'whatsapp' when 'signup' then 'calendar' else 'slack' end")
        k = F.get_json_object("props", "$.k")
        return self.read("events").select(
            "event_id", F.substring(F.sha2(F.concat(F.lit("events:"), F.col("event_id").cast("string")), 256), 1, 24).alias("id"), source.alias("source"), "event_type",
            F.expr(EPOCH.format("ts")).alias("ts"), F.col("user_id").alias("person_id"), k.alias("thread_id"), (F.col("event_id") % 3 == 0).alias("is_from_me"),
            (k.cast("int") % 4 == 0).alias("is_group"), F.col("value").alias("amount"),
        )

    @cached_property
    def event_persons(self) -> DataFrame:
        e, other = self.events, (F.col("event_id") * 7 + 3) % PEOPLE
        near = e.select("event_id", "person_id", F.when(F.col("is_from_me"), "self").otherwise("sender").alias("role"))
        return near.unionByName(e.filter(other != F.col("person_id")).select("event_id", other.alias("person_id"), F.lit("recipient").alias("role")))

    @cached_property
    def now(self) -> DataFrame:
        return self.events.agg(F.max("ts").alias("now"))

    @cached_property
    def claims(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.least(F.col("o_totalprice") / 500000.0, F.lit(0.99)).alias("confidence"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"), F.expr(EPOCH.format("o_orderdate")).alias("created_at"),
        )

    @cached_property
    def claim_events(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("event_id")).distinct()

    @cached_property
    def today(self) -> DataFrame:
        """One row: thirty days before the newest claim, as epoch seconds and as a date."""
        last = self.read("orders").agg(F.max("o_orderdate").alias("d"))
        return last.select((F.expr(EPOCH.format("d")) - 30 * 86400).alias("now"), F.date_format(F.expr("d - interval 30 days"), "yyyy-MM-dd").alias("day"))
