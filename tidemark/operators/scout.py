"""Ad-hoc queries by name: a small vocabulary of reads over events, commitments and people, run from {tool, args}."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import store

DAY = 86400
#: Other names under which arguments are understood.
ALIASES = {"query": "keyword", "text": "keyword", "days": "days_back", "person": "name", "thread": "thread_id", "max": "limit"}
TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


@tool
def search_events(t: dict[str, DataFrame], source: str | None = None, keyword: str = "", days_back: int = 30, limit: int = 20) -> DataFrame:
    """The newest events of the last days, of a source, whose text has the keyword."""
    e = t["events"].join(F.broadcast(t["now"])).filter(F.col("ts") >= F.col("now") - days_back * DAY)
    e = store.find(e, source=source) if not keyword else store.find(e, source=source).filter(F.lower("text").contains(keyword.lower()))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit).select("event_id", "source", "ts")


@tool
def search_commitments(t: dict[str, DataFrame], keyword: str = "", limit: int = 20) -> DataFrame:
    """Open commitments whose wording has the keyword, the surest first."""
    c = t["commitments"].filter("status = 'open'").filter(F.lower("what").contains(keyword.lower()))
    return c.orderBy(F.desc("confidence"), "claim_id").limit(limit).select("claim_id", "what", "confidence")


@tool
def temporal_xref(t: dict[str, DataFrame], at: int, source: str | None = None, keyword: str = "", window_hours: int = 24) -> DataFrame:
    """Events within some hours of a time."""
    e = store.find(t["events"], source=source).filter(F.abs(F.col("ts") - at) <= window_hours * 3600).filter(F.lower("text").contains(keyword.lower()))
    return e.select("event_id", "source", "ts")


@tool
def get_thread(t: dict[str, DataFrame], thread_id: str, limit: int = 20) -> DataFrame:
    """The newest events of a thread."""
    return store.find(t["events"], limit, [F.desc("ts"), F.desc("event_id")], thread_id=thread_id).select("event_id", "source", "ts")


@tool
def person_context(t: dict[str, DataFrame], name: str, days_back: int = 30, limit: int = 15) -> DataFrame:
    """(kind, key): of the first person whose name has ``name`` the newest events and the surest open commitments."""
    who = t["persons"].filter(F.lower("name").contains(name.lower())).orderBy("name", "person_id").limit(1).select("person_id")
    e = t["events"].join(F.broadcast(t["now"])).filter(F.col("ts") >= F.col("now") - days_back * DAY).join(F.broadcast(who), "person_id", "left_semi").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
    c = t["commitments"].filter("status = 'open'").join(F.broadcast(who), "person_id", "left_semi").orderBy(F.desc("confidence"), "claim_id").limit(10)
    return e.select(F.lit("event").alias("kind"), F.col("event_id").alias("key")).unionByName(c.select(F.lit("commitment").alias("kind"), F.col("claim_id").alias("key")))


def execute(t: dict[str, DataFrame], query: dict) -> DataFrame:
    """The rows of a query {tool, args}; an unknown tool or wrong arguments give one row (error), never an exception."""
    name, args = query.get("tool", ""), {ALIASES.get(k, k): v for k, v in (query.get("args") or {}).items()}
    try:
        return TOOLS[name](t, **args)
    except KeyError:
        problem = f"unknown tool: {name}"
    except TypeError as e:
        problem = f"{name}: {e}"
    return t["events"].sparkSession.createDataFrame([(problem,)], "error string")


def run_all(t: dict[str, DataFrame], queries: list[dict], most: int = 10) -> DataFrame:
    """(query, row): the first ``most`` rows of each query as JSON, errors too."""
    out = None
    for i, q in enumerate(queries):
        rows = execute(t, q).limit(most)
        rows = rows.select(F.lit(i).alias("query"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def names_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): names (name) in texts (id, text) as whole words, longest first: what lies within a longer name found there is not found again.

    Names meet texts on their first word in an equi-join; then the whole name is looked for between characters that are no letters.
    """
    words = texts.select("id", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"(?U)[^\p{L}]+"))).alias("w"))
    keyed = names.select("name", F.split(F.lower("name"), r"(?U)[^\p{L}]+")[0].alias("w")).distinct()
    # Letters are folded to a space on both sides, so a name is found only between non-letters.
    plain = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"[^\p{L}]+", " "), F.lit(" "))
    met = words.join(keyed, "w").withColumn("flat", plain(F.col("text"))).withColumn("n", plain(F.trim(plain(F.col("name"))))).filter(F.col("flat").contains(F.col("n"))).select("id", "name", "flat", "n")
    longer = met.select("id", F.col("n").alias("long")).distinct()
    inside = met.join(longer, "id").filter((F.length("long") > F.length("n")) & F.col("long").contains(F.col("n")))
    # A part of a longer name counts only if it also stands elsewhere.
    gone = inside.groupBy("id", "name", "flat", "n").agg(F.collect_set("long").alias("longs"))
    rest = F.aggregate("longs", F.col("flat"), lambda a, x: F.replace(a, x, F.lit(" | ")))
    gone = gone.filter(~rest.contains(F.col("n"))).select("id", "name")
    return met.select("id", "name").distinct().join(gone, ["id", "name"], "left_anti")
