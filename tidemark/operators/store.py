"""Reads of the store: point lookups, filtered lists in a fixed order, and joins along its keys.

Each takes the tables that it reads. A filter that is None is left out. Lists are ordered and end with a key, so a limit always
keeps the same rows; ``limit`` None keeps all. Lookups of an unknown key give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find(table: DataFrame, limit: int | None = None, order: list[Column] | None = None, **equal) -> DataFrame:
    """Rows whose named columns have the values given; null-safe, None leaves a column out."""
    for name, value in equal.items():
        if value is not None:
            table = table.filter(F.col(name) == F.lit(value))
    if order:
        table = table.orderBy(*order)
    return table if limit is None else table.limit(limit)


def beliefs(table: DataFrame, subject=None, belief_type: str | None = None, status: str | None = "active", min_confidence: float = 0.0, limit: int | None = 100) -> DataFrame:
    return find(table.filter(F.col("confidence") >= min_confidence), limit, [F.desc("confidence"), F.col("belief_id")], subject=subject, belief_type=belief_type, status=status)


def beliefs_by_claims(table: DataFrame, wanted: DataFrame, claims: str = "claims", key: str = "belief_id") -> DataFrame:
    """Beliefs of which any source claim is wanted (claim_id), once each: an equi-join on the exploded claims, not a text search."""
    hit = table.select(key, F.explode(claims).alias("claim_id")).join(wanted.select("claim_id").distinct(), "claim_id", "left_semi").select(key).distinct()
    return table.join(hit, key, "left_semi")


def projections(table: DataFrame, lens: str, route: str | None = None, min_score: float = 0.0, limit: int | None = 1000) -> DataFrame:
    return find(table.filter(F.col("score") >= min_score), limit, [F.desc("score"), F.col("event_id")], lens=lens, route=route)


def resolved(identifiers: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id_type, identifier) with the person_id each stands for, null if it is unknown."""
    return asked.join(identifiers.select("id_type", "identifier", "person_id"), ["id_type", "identifier"], "left")


def matched_rules(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(identifier, action) for each identifier asked for: the rule for exactly it, else the one for its domain; the newest of several, none: null."""
    keys = asked.select("identifier", F.posexplode(F.array(F.lower("identifier"), F.concat(F.lit("@"), F.substring_index(F.lower("identifier"), "@", -1)))).alias("place", "pattern"))
    met = keys.join(rules.select(F.lower("pattern").alias("pattern"), "action", "created_at", "rule_id"), "pattern")
    best = met.groupBy("identifier").agg(F.min_by("action", F.struct("place", (-F.col("created_at")).alias("age"), "rule_id")).alias("action"))
    return asked.select("identifier").distinct().join(best, "identifier", "left")


def stories(table: DataFrame, status: str = "active") -> DataFrame:
    """Stories of a status with their place in the list: by override, else priority, else 99; newest first within it."""
    rank = F.coalesce("override", "priority", F.lit(99))
    return table.filter(F.col("status") == status).select("story_id", rank.alias("rank"), "updated_at").orderBy("rank", F.desc("updated_at"), "story_id")


def ordered_members(tasks: DataFrame, group: str, *order: Column) -> DataFrame:
    """tasks with ``at``, their place in their group from 0."""
    return tasks.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def apart(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (a, b) with ``apart``: whether the two, in either order, are a pair of the table."""
    both = lambda df: df.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    known = both(pairs).distinct().withColumn("hit", F.lit(True))
    return asked.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(known, ["x", "y"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("apart"))


def persons_of(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """(event_id, role, person_id, name): the people of each event."""
    return edges.join(persons.select("person_id", "name"), "person_id").select("event_id", "role", "person_id", "name").distinct()


def events_of(events: DataFrame, edges: DataFrame, role: str | None = None, source: str | None = None, since: int | None = None, most: int | None = None) -> DataFrame:
    """(person_id, event_id, ts, source): events of each person, with a role, of a source, since a time; the newest ``most`` of each."""
    own = find(edges, role=role).select("person_id", "event_id").distinct()
    e = find(events, source=source).select("event_id", "ts", "source")
    met = own.join(e if since is None else e.filter(F.col("ts") >= since), "event_id").select("person_id", "event_id", "ts", "source")
    if most is None:
        return met
    newest = Window.partitionBy("person_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return met.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= most).drop("r")


def person_detail(person_id, persons: DataFrame, identifiers: DataFrame, events: DataFrame, edges: DataFrame, beliefs_: DataFrame, most: int = 20) -> DataFrame:
    """(kind, key, text): one person's row, identifiers, newest events and beliefs."""
    row = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), text.cast("string").alias("text"))
    own = find(events_of(events, find(edges, person_id=person_id)), most, [F.desc("ts"), F.desc("event_id")])
    parts = [
        row(find(persons, person_id=person_id), "person", F.col("person_id"), F.col("name")), row(find(identifiers, person_id=person_id), "identifier", F.col("id_type"), F.col("identifier")),
        row(own, "event", F.col("event_id"), F.col("source")), row(find(beliefs_, subject=person_id), "belief", F.col("belief_id"), F.col("belief_type")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n): how many rows each table has."""
    first, *rest = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


def proportional_sample(table: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """About n rows: of each stratum its share of them, rounded, but one at least; ``order`` picks them and ends with a key."""
    sizes = table.groupBy(*by).agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("total"))
    quota = sizes.join(F.broadcast(total)).select(*by, F.greatest(F.lit(1), F.round(F.lit(float(n)) * F.col("c") / F.col("total"))).cast("int").alias("quota"))
    ranked = table.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.join(quota, by).filter(F.col("r") <= F.col("quota")).drop("r", "quota")


def cost(price: Column, input_tokens: Column, output_tokens: Column, cached: Column, thinking: Column, cached_rate: float = 0.1) -> Column:
    """Dollars of a call: price has the prices of a million input and output tokens, null for an unknown model, which costs 0."""
    fresh = F.greatest(input_tokens - cached, F.lit(0))
    return F.coalesce(F.round((fresh * price["input"] + cached * price["input"] * cached_rate + (output_tokens + thinking) * price["output"]) / 1e6, 8), F.lit(0.0))


def without_artifacts(topics: DataFrame, threshold: int = 100) -> DataFrame:
    """topics (event_id, value and more) without those of events whose sorted combination of two topics or more occurs ``threshold`` times."""
    combos = topics.groupBy("event_id").agg(F.array_sort(F.collect_set("value")).alias("combo")).filter(F.size("combo") >= 2)
    stamped = combos.groupBy("combo").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold).select("combo")
    return topics.join(combos.join(stamped, "combo", "left_semi").select("event_id"), "event_id", "left_anti")
