"""Gates, scouts, the task desk and contact discovery (survey 2.14, 2.19-2.22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import confidence as conf
from tidemark.operators import discovery as dis
from tidemark.operators import joins, tasks
from tidemark.plans.bridge import Tables
from tidemark.plans.claim_plans import _BUCKET, _SCORE, event_scores
from tidemark.plans.registry import query

DAY = 86400
_DATE = "(DATE '1970-01-01' + CAST({} // 86400 AS INT))"


def _date(ts: str):
    """The day of a time in epoch seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / DAY).cast("int"))


@query("""SELECT thread_id, CASE priority WHEN 1 THEN 'actionable' WHEN 2 THEN 'logistics' ELSE 'relational' END AS gate, count(DISTINCT claim_id) AS claims, count(DISTINCT event_id) AS events, max(ts) AS latest
    FROM cl JOIN ce USING (claim_id) JOIN ev USING (event_id) WHERE status = 'open' AND priority <= 3 GROUP BY ALL""")
def gated_threads(t: Tables) -> DataFrame:
    """Threads that passed a gate, with their claims and events."""
    gate = F.when(F.col("priority") == 1, "actionable").when(F.col("priority") == 2, "logistics").otherwise("relational")
    c = t.claims.filter("status = 'open' and priority <= 3").select("claim_id", gate.alias("gate")).join(t.claim_events, "claim_id").join(t.events.select("event_id", "thread_id", "ts"), "event_id")
    return c.groupBy("thread_id", "gate").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("event_id").alias("events"), F.max("ts").alias("latest"))


@query("SELECT person_id, thread_id FROM ev GROUP BY person_id, thread_id HAVING NOT bool_or(event_id IN (SELECT event_id FROM ce))")
def unattempted_threads(t: Tables) -> DataFrame:
    """A person's threads of which no event has led to a claim."""
    tried = t.events.select("event_id", "person_id", "thread_id").join(t.claim_events, "event_id", "left_semi").select("person_id", "thread_id")
    return t.events.select("person_id", "thread_id").distinct().join(tried, ["person_id", "thread_id"], "left_anti")


@query(_SCORE.rsplit("SELECT", 1)[0] + "SELECT thread_id, count(*) AS n, round(avg(score), 6) AS score FROM r JOIN (SELECT event_id, thread_id FROM ev) USING (event_id) GROUP BY thread_id HAVING round(avg(score), 6) >= 0.29")
def scored_threads(t: Tables) -> DataFrame:
    """Threads whose average score is high enough to go on."""
    s = event_scores(t).select("event_id", "score").join(t.events.select("event_id", "thread_id"), "event_id")
    return s.groupBy("thread_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score")).filter("score >= 0.29")


@query("""SELECT thread_id, string_agg('person ' || person_id || ' (' || n || ')', '; ' ORDER BY n DESC, person_id) AS people FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, person_id) AS r FROM (
    SELECT thread_id, ep.person_id, count(*) AS n FROM ep JOIN ev USING (event_id) WHERE role <> 'self' GROUP BY thread_id, ep.person_id)) WHERE r <= 5 GROUP BY thread_id""")
def thread_people(t: Tables) -> DataFrame:
    """The five busiest people of each thread as a line of text."""
    n = t.event_persons.filter("role <> 'self'").select("event_id", "person_id").join(t.events.select("event_id", "thread_id"), "event_id").groupBy("thread_id", "person_id").agg(F.count("*").alias("n"))
    top = joins.latest_per(n, ["thread_id"], F.desc("n"), F.col("person_id"), n=5)
    line = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "person_id", "n"))), lambda p: F.format_string("person %d (%d)", p["person_id"], p["n"]))
    return top.groupBy("thread_id").agg(F.array_join(line, "; ").alias("people"))


@query(f"SELECT event_id, '**' || source || '** ' || {_DATE.format('ts')}::VARCHAR || ' ' || CASE WHEN is_from_me THEN 'to' ELSE 'from' END || ' ' || person_id || ' [' || thread_id || ']' AS card FROM ev")
def event_cards(t: Tables) -> DataFrame:
    """Each event as a line for a reader or a model."""
    way = F.when(F.col("is_from_me"), "to").otherwise("from")
    return t.events.select("event_id", F.format_string("**%s** %s %s %d [%s]", "source", _date("ts").cast("string"), way, "person_id", "thread_id").alias("card"))


@query("""SELECT lower(subject) AS theme, min(subject) AS subject, count(*) AS n, round(avg(hour), 6) AS hour, CASE WHEN avg(hour) < 9 OR avg(hour) > 17 THEN 'life' ELSE 'work' END AS part FROM (
    SELECT CASE WHEN event_id % 2 = 0 THEN 'Topic ' ELSE 'TOPIC ' END || thread_id AS subject, ts % 86400 // 3600 AS hour FROM ev, clock WHERE source = 'calendar' AND ts >= now - 90 * 86400) GROUP BY lower(subject) HAVING count(*) >= 3""")
def recurring_meetings(t: Tables) -> DataFrame:
    """Calendar subjects seen three times in 90 days, whatever their case, and whether they lie outside office hours."""
    e = t.events.filter("source = 'calendar'").join(F.broadcast(t.now)).filter(f"ts >= now - 90 * {DAY}")
    e = e.select(F.concat(F.when(F.col("event_id") % 2 == 0, "Topic ").otherwise("TOPIC "), "thread_id").alias("subject"), F.floor(F.col("ts") % DAY / 3600).alias("h"))
    g = e.groupBy(F.lower("subject").alias("theme")).agg(F.min("subject").alias("subject"), F.count("*").alias("n"), F.avg("h").alias("a")).filter("n >= 3")
    return g.select("theme", "subject", "n", F.round("a", 6).alias("hour"), F.when((F.col("a") < 9) | (F.col("a") > 17), "life").otherwise("work").alias("part"))


@query(f"SELECT strftime({_DATE.format('ts')}, '%Y-%m') AS month, source, count(*) AS n, count(*) FILTER (amount > 50) AS large FROM ev WHERE source IN ('mail', 'whatsapp') GROUP BY ALL")
def money_landscape(t: Tables) -> DataFrame:
    """Messages about money, and those over large sums, by month and channel."""
    e = t.events.filter(F.col("source").isin("mail", "whatsapp"))
    return e.groupBy(F.date_format(_date("ts"), "yyyy-MM").alias("month"), "source").agg(F.count("*").alias("n"), F.count_if(F.col("amount") > 50).alias("large"))


_DIMENSIONS = """, found AS (SELECT 'channels' AS dimension, count(DISTINCT source) AS n FROM ev UNION ALL SELECT 'relationships', count(DISTINCT person_id) FROM ep WHERE role <> 'self'
    UNION ALL SELECT 'workstreams', count(*) FROM cl WHERE status = 'open' AND priority = 1 UNION ALL SELECT 'meetings', count(*) FROM ev WHERE source = 'calendar' UNION ALL SELECT 'goals', 0),
scored AS (SELECT dimension, n, CASE dimension WHEN 'channels' THEN 1.0 ELSE CASE WHEN n = 0 THEN 0.0 ELSE least(0.95, 0.3 + 0.7 * (1 - exp(-n / 50.0::DOUBLE))) END END::DOUBLE AS c FROM found)
SELECT dimension, n, round(c, 6) AS confidence, c < 0.3 AS gap FROM scored"""


@query(_DIMENSIONS)
def person_model(t: Tables) -> DataFrame:
    """The dimensions of the model of the user: evidence, confidence, whether it is a gap. A user's correction (channels) overrides the confidence."""
    row = lambda name, n: n.select(F.lit(name).alias("dimension"), F.col("n"))
    found = row("channels", t.events.agg(F.countDistinct("source").alias("n"))).unionByName(row("relationships", t.event_persons.filter("role <> 'self'").agg(F.countDistinct("person_id").alias("n"))))
    found = found.unionByName(row("workstreams", t.claims.agg(F.count_if(F.expr("status = 'open' and priority = 1")).alias("n")))).unionByName(row("meetings", t.events.agg(F.count_if(F.col("source") == "calendar").alias("n"))))
    found = found.unionByName(row("goals", t.spark.range(1).select(F.lit(0).cast("long").alias("n"))))
    own = F.when(F.col("n") == 0, 0.0).otherwise(conf.evidence(F.col("n"), 50.0))
    sure = F.coalesce(F.create_map(F.lit("channels"), F.lit(1.0))[F.col("dimension")], own)
    return found.select("dimension", "n", F.round(sure, 6).alias("confidence"), (sure < 0.3).alias("gap"))


@query(f""", b AS ({_BUCKET.replace('SELECT claim_id, deadline,', 'SELECT claim_id, person_id, priority, deadline,')}),
r AS (SELECT *, row_number() OVER (PARTITION BY person_id, bucket ORDER BY priority, deadline, claim_id) AS r FROM b)
SELECT person_id, claim_id AS task, CASE WHEN bucket = 'immediate' AND r > 10 THEN 'review' ELSE bucket END AS bucket FROM r""")
def task_desk(t: Tables) -> DataFrame:
    """Open tasks by bucket; more than ten immediate ones of a person overflow into review."""
    c = t.claims.filter("status = 'open'").join(F.broadcast(t.today))
    c = c.select("person_id", F.col("claim_id").alias("task"), "priority", "deadline", tasks.bucket(F.col("deadline"), F.col("day"), F.col("priority")).alias("bucket"))
    return dis.overflow(c, "person_id", F.col("priority"), F.col("deadline"), F.col("task")).select("person_id", "task", "bucket")


_OPEN = ", m AS (SELECT person_id AS story, claim_id AS task, priority, created_at, (claim_id * 7919) % 100003 * 1000000 + claim_id AS place FROM cl WHERE status = 'open'), apart AS (SELECT claim_id AS a, min(claim_id) OVER (PARTITION BY person_id) AS b FROM cl WHERE claim_id % 5 = 0), "
_PARTS = _OPEN + "later AS (SELECT DISTINCT x.story, CASE WHEN x.place > y.place THEN x.task ELSE y.task END AS task FROM apart JOIN m x ON x.task = a JOIN m y ON y.task = b AND y.story = x.story WHERE a <> b), parts AS (SELECT m.story, coalesce(l.task, 0) AS part, m.task, m.priority, m.created_at FROM m LEFT JOIN later l ON l.story = m.story AND l.task = m.task) "


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = t.claims.filter("status = 'open'").select(F.col("person_id").alias("story"), F.col("claim_id").alias("task"), "priority", "created_at", ((F.col("claim_id") * 7919) % 100003 * 1000000 + F.col("claim_id")).alias("place"))
    special = t.claims.filter("claim_id % 5 = 0").groupBy("person_id").agg(F.min("claim_id").alias("b"))
    apart = t.claims.filter("claim_id % 5 = 0").select("person_id", F.col("claim_id").alias("a")).join(special, "person_id").filter("a <> b").select("a", "b")
    return m, dis.part_stories(m.select("story", "task", "place"), apart).fillna(0, ["part"])


@query(_PARTS + "SELECT story, part, task FROM parts")
def split_stories(t: Tables) -> DataFrame:
    """Stories without tasks that the user keeps apart: the later of a pair stands alone."""
    return _parts(t)[1]


@query(_PARTS + "SELECT story, part, count(*) AS n, min(priority) AS priority, max(created_at) AS latest, max(created_at) >= (SELECT max(now) FROM today) - 86400 * 60 AS is_new FROM parts GROUP BY ALL")
def story_feed(t: Tables) -> DataFrame:
    """Each story after splitting: tasks, the most urgent priority, its newest task and whether that is recent."""
    m, parts = _parts(t)
    g = parts.join(m.select("story", "task", "priority", "created_at"), ["story", "task"]).groupBy("story", "part").agg(F.count("*").alias("n"), F.min("priority").alias("priority"), F.max("created_at").alias("latest"))
    return g.join(F.broadcast(t.today.select("now"))).select("story", "part", "n", "priority", "latest", (F.col("latest") >= F.col("now") - 60 * DAY).alias("is_new"))


@query("SELECT source, count(*) FILTER (ts > now - 7 * 86400) AS week, count(*) FILTER (ts <= now - 7 * 86400 AND ts > now - 14 * 86400) AS week_before, count(*) FILTER (ts > now - 7 * 86400) - count(*) FILTER (ts <= now - 7 * 86400 AND ts > now - 14 * 86400) AS delta FROM ev, clock GROUP BY source")
def pulse(t: Tables) -> DataFrame:
    """Events of the last seven days by source, against the seven before."""
    age = F.col("now") - F.col("ts")
    g = t.events.join(F.broadcast(t.now)).groupBy("source").agg(F.count_if(age < 7 * DAY).alias("week"), F.count_if((age >= 7 * DAY) & (age < 14 * DAY)).alias("week_before"))
    return g.withColumn("delta", F.col("week") - F.col("week_before"))


@query(f"""SELECT event_id, claim_id, due::VARCHAR AS due FROM (SELECT event_id, claim_id, due, row_number() OVER (PARTITION BY event_id ORDER BY priority, due, claim_id) AS r
    FROM (SELECT event_id, person_id AS p, {_DATE.format('ts')} AS d FROM ev WHERE source = 'calendar') e JOIN (SELECT *, DATE '2024-01-01' + (claim_id % 30)::INT AS due FROM cl WHERE status = 'open') c ON c.person_id = p AND due BETWEEN d - 7 AND d) WHERE r <= 5""")
def meeting_prep(t: Tables) -> DataFrame:
    """For each meeting the five most urgent tasks of its person that fall due in the week before: an equi-join on person and day."""
    days = F.sequence(F.date_sub(_date("ts"), 7), _date("ts"))
    e = t.events.filter("source = 'calendar'").select("event_id", "person_id", F.explode(days).alias("due"))
    c = t.claims.filter("status = 'open'").select("person_id", "claim_id", "priority", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("claim_id") % 30).cast("int")).alias("due"))
    few = joins.latest_per(c, ["person_id", "due"], F.col("priority"), F.col("claim_id"), n=5)  # no meeting needs more of one day
    return joins.latest_per(e.join(few, ["person_id", "due"]), ["event_id"], F.col("priority"), F.col("due"), F.col("claim_id"), n=5).select("event_id", "claim_id", F.col("due").cast("string").alias("due"))


@query("SELECT person_id, n, CASE WHEN r <= 5 THEN 'P1' ELSE 'P2' END AS rule FROM (SELECT person_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, person_id) AS r FROM ev WHERE NOT is_from_me GROUP BY person_id) WHERE r <= 15")
def sender_rules(t: Tables) -> DataFrame:
    """The fifteen busiest senders; the first five are proposed as most urgent."""
    top = t.events.filter("not is_from_me").groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_id").limit(15)
    place = F.expr("posexplode(array_sort(collect_list(struct(-n as least, person_id, n))))")
    return top.select(place.alias("pos", "x")).select("x.person_id", "x.n", F.when(F.col("pos") < 5, "P1").otherwise("P2").alias("rule"))


@query("""SELECT person_id, count(*) AS total, count(*) FILTER (is_from_me) AS sent, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN count(*) >= 10 THEN 0.9 WHEN count(*) >= 5 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
    FROM (SELECT event_id, person_id FROM ep) JOIN (SELECT event_id, source, is_from_me FROM ev) USING (event_id) GROUP BY person_id""")
def contact_ownership(t: Tables) -> DataFrame:
    """How surely someone is the user's contact, from the events they share."""
    g = t.event_persons.select("event_id", "person_id").join(t.events.select("event_id", "source", "is_from_me"), "event_id").groupBy("person_id")
    g = g.agg(F.count("*").alias("total"), F.count_if("is_from_me").alias("sent"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return g.withColumn("confidence", F.when(F.col("total") >= 10, 0.9).when(F.col("total") >= 5, 0.7).otherwise(0.5))


@query("""SELECT conv_id, turn, string_split(trim(text, chr(10) || ' '), chr(10))[1] AS opening, CASE WHEN contains(trim(text, chr(10) || ' '), chr(10)) THEN string_split(trim(text, chr(10) || ' '), chr(10))[-1] ELSE '' END AS closing, length(text) AS n
    FROM conversations WHERE role = 'user' AND length(text) > 50 AND length(text) < 3000 ORDER BY conv_id DESC, turn DESC LIMIT 10""")
def voice_samples(t: Tables) -> DataFrame:
    """First and last line of the ten newest texts of a fair length that the user wrote."""
    n, lines = F.length("text"), F.split(F.trim(F.col("text"), F.lit("\n ")), "\n")
    c = t.read("conversations").filter((F.col("role") == "user") & (n > 50) & (n < 3000)).orderBy(F.desc("conv_id"), F.desc("turn")).limit(10)
    return c.select("conv_id", "turn", F.element_at(lines, 1).alias("opening"), F.when(F.size(lines) > 1, F.element_at(lines, -1)).otherwise("").alias("closing"), n.cast("long").alias("n"))


@query("""SELECT person_id AS via, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, person_id) AS r FROM (
    SELECT b.person_id, 'direct' AS kind, count(DISTINCT b.event_id) AS n FROM ep a JOIN ep b ON a.event_id = b.event_id AND b.person_id <> 7 WHERE a.person_id = 7 GROUP BY b.person_id
    UNION ALL SELECT person_id, 'firm', count(*) FROM ep WHERE person_id % 10 = 7 AND person_id <> 7 GROUP BY person_id
    UNION ALL SELECT person_id, 'belief', count(*) FROM cl WHERE priority = 1 AND person_id % 10 = 7 GROUP BY person_id)) WHERE r <= CASE kind WHEN 'firm' THEN 10 ELSE 5 END""")
def warm_paths(t: Tables) -> DataFrame:
    """Who could introduce someone: people met together, people of the same firm, people of claims; at most 5, 10 and 5."""
    def top(df: DataFrame, kind: str, most: int) -> DataFrame:
        return df.orderBy(F.desc("n"), "person_id").limit(most).select(F.col("person_id").alias("via"), F.lit(kind).alias("kind"), "n")

    p = t.event_persons
    met = p.filter("person_id <> 7").join(p.filter("person_id = 7").select("event_id").distinct(), "event_id", "left_semi").groupBy("person_id").agg(F.countDistinct("event_id").alias("n"))
    firm = p.filter("person_id % 10 = 7 and person_id <> 7").groupBy("person_id").agg(F.count("*").alias("n"))
    said = t.claims.filter("priority = 1 and person_id % 10 = 7").groupBy("person_id").agg(F.count("*").alias("n"))
    return top(met, "direct", 5).unionByName(top(firm, "firm", 10)).unionByName(top(said, "belief", 5))


_SIGNALS = """, sig AS (SELECT DISTINCT person_id, CASE source WHEN 'calendar' THEN 'calendar' WHEN 'mail' THEN 'email_domain' ELSE 'content' END AS kind FROM ev WHERE amount > 40 UNION SELECT DISTINCT person_id, 'belief' FROM cl WHERE priority = 1),
seen AS (SELECT person_id, max(ts) AS last, count(*) AS n, bool_or(source = 'calendar') AS cal FROM ev GROUP BY person_id)
SELECT person_id, signals, score, CASE WHEN d < 14 AND cal THEN 'meeting_scheduled' WHEN d < 14 AND n >= 3 THEN 'in_progress' WHEN d < 14 THEN 'contacted' WHEN d < 30 THEN 'follow_up' WHEN d < 60 THEN 'inactive' WHEN d < 90 THEN 'cold' ELSE 'dormant' END AS stage
FROM (SELECT person_id, count(*) AS signals, least(10.0, sum(CASE kind WHEN 'calendar' THEN 2.5 WHEN 'email_domain' THEN 3.0 WHEN 'content' THEN 1.0 ELSE 2.0 END))::DOUBLE AS score FROM sig GROUP BY person_id)
JOIN (SELECT person_id, n, cal, (now + 20 * 86400 - last) / 86400.0 AS d FROM seen, clock) USING (person_id) WHERE score >= 3"""


@query(_SIGNALS)
def discovered_contacts(t: Tables) -> DataFrame:
    """People with enough signals from several scans, and how far things have come with each, twenty days on."""
    kind = F.when(F.col("source") == "calendar", "calendar").when(F.col("source") == "mail", "email_domain").otherwise("content")
    said = t.claims.filter("priority = 1").select("person_id", F.lit("belief").alias("kind"))
    signals = t.events.filter("amount > 40").select("person_id", kind.alias("kind")).unionByName(said).distinct()
    seen = t.events.groupBy("person_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.bool_or(F.col("source") == "calendar").alias("cal")).join(F.broadcast(t.now))
    stage = dis.stage((F.col("now") + 20 * DAY - F.col("last")) / DAY, F.col("n"), F.col("cal"))
    return dis.signal_score(signals, "person_id", "kind").filter("score >= 3").join(seen.select("person_id", stage.alias("stage")), "person_id")


@query("""SELECT person_id, CASE WHEN pass THEN 'pass' WHEN outs >= 2 AND ins = 0 AND now + 31 * 86400 - last_out > 30 * 86400 THEN 'ghosted' WHEN meets THEN 'meeting_scheduled' ELSE 'unchanged' END AS stage FROM (
    SELECT person_id, thread_id, bool_or(NOT is_from_me AND event_id % 29 = 0) AS pass, count(*) FILTER (is_from_me) AS outs, count(*) FILTER (NOT is_from_me) AS ins, max(ts) FILTER (is_from_me) AS last_out, bool_or(source = 'calendar') AS meets FROM ev GROUP BY person_id, thread_id), clock""")
def stage_overrides(t: Tables) -> DataFrame:
    """What a person's events in a thread say against the ladder: a refusal, silence after two messages, a meeting ahead."""
    mine, body = F.col("is_from_me"), F.when(F.col("event_id") % 29 == 0, "Sorry, we'll pass").otherwise("See you")
    g = t.events.withColumn("body", body).groupBy("person_id", "thread_id").agg(
        F.bool_or(~mine & F.lower("body").rlike("we'll pass|not a fit|not moving forward|decided not to")).alias("pass"), F.count_if(mine).alias("outs"), F.count_if(~mine).alias("ins"),
        F.max(F.when(mine, F.col("ts"))).alias("last"), F.bool_or(F.col("source") == "calendar").alias("meets"),
    )
    silent = (F.col("outs") >= 2) & (F.col("ins") == 0) & (F.col("now") + 31 * DAY - F.col("last") > 30 * DAY)
    return g.join(F.broadcast(t.now)).select("person_id", F.when(F.col("pass"), "pass").when(silent, "ghosted").when(F.col("meets"), "meeting_scheduled").otherwise("unchanged").alias("stage"))


_TECH, _BUSINESS = ["code", "data", "system", "infra"], ["market", "license", "email", "sales"]
_HITS = lambda words: " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(f"SELECT doc_id, tech, business, CASE WHEN tech > business * 1.5 THEN 'tech_forward' WHEN business > tech * 1.5 THEN 'business_forward' ELSE 'generalist' END AS focus, CASE WHEN tech > business * 1.5 THEN 'cto' ELSE 'ceo' END AS owner FROM (SELECT doc_id, {_HITS(_TECH)} AS tech, {_HITS(_BUSINESS)} AS business FROM documents)")
def focus_scores(t: Tables) -> DataFrame:
    """Whether a profile text leans to technology or to business, and who should write."""
    d = t.read("documents").select("doc_id", dis.hits(F.col("text"), _TECH).alias("tech"), dis.hits(F.col("text"), _BUSINESS).alias("business"))
    d = d.withColumn("focus", dis.focus(F.col("tech"), F.col("business")))
    return d.withColumn("owner", F.when(F.col("focus") == "tech_forward", "cto").otherwise("ceo"))


_KINDS = {"mail": "kg", "imessage": "portfolio", "whatsapp": "twitter", "calendar": "profile", "slack": "web"}
_GRADES = f""", g(source, letter, number, half, weight) AS (VALUES {', '.join(f"('{s}', '{a}', {n}, {h}, {dis.RELIABILITY[a] * dis.CREDIBILITY[n]}::DOUBLE)" for s, (a, n, h) in ((s, dis.SOURCES[k]) for s, k in _KINDS.items()))}),
f AS (SELECT person_id, event_id, source, letter, number, amount, round(weight * pow(2.0, -((now - ts) / 86400.0::DOUBLE) / half) * CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 1.0 END, 4) AS c FROM ev JOIN g USING (source), clock) """


def _fragments(t: Tables) -> DataFrame:
    e = t.events.join(F.broadcast(t.now)).withColumn("kind", F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("source")])
    return dis.sourced(e.withColumns({"age": (F.col("now") - F.col("ts")) / DAY, "quality": F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(1.0)}), "kind", "age", "quality")


@query(_GRADES + """SELECT person_id, min(letter) AS reliability, min(number) AS credibility, round(least(0.99, max(c) FILTER (r = 1) + 0.05 * (coalesce(max(c) FILTER (r = 2), 0) + coalesce(max(c) FILTER (r = 3), 0))), 4) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY c DESC, event_id) AS r FROM f) GROUP BY person_id""")
def graded_contacts(t: Tables) -> DataFrame:
    """What is known of each person: the best grades of its sources, and a confidence from the three best fragments."""
    return dis.graded(_fragments(t), "person_id", "event_id")


@query(_GRADES + "SELECT person_id, source AS field, event_id AS fragment, c AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY person_id, source ORDER BY c DESC, event_id) = 1")
def dossiers(t: Tables) -> DataFrame:
    """For each field of a person's dossier the surest fragment, and where it is from."""
    f = _fragments(t).groupBy("person_id", F.col("source").alias("field")).agg(F.max(F.struct("confidence", (-F.col("event_id")).alias("turned"))).alias("x"))
    return f.select("person_id", "field", (-F.col("x.turned")).alias("fragment"), "x.confidence")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Blue River' WHEN 2 THEN 'Fund' || c_custkey WHEN 3 THEN 'A' || c_custkey || 'Z' WHEN 4 THEN 'Known Partners' ELSE NULL END AS firm FROM customer""")
def firms(t: Tables) -> DataFrame:
    """Generic domains have no firm, letters after digits are upper case, known domains have the name given for them."""
    key = F.col("c_custkey").cast("string")
    mail = F.element_at(F.array(F.lit("a@GMail.com"), F.lit("b@mail.blue-river.org"), F.concat(F.lit("c@fund"), key, F.lit(".co")), F.concat(F.lit("d@a"), key, F.lit("z.com")), F.lit("e@kp.vc"), F.lit("no address")), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t.read("customer").select("c_custkey", dis.firm(mail, {"kp.vc": "Known Partners"}).alias("firm"))