"""Named queries: (tables) -> DataFrame, each with the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.bridge import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The module that registered each query.
MODULES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name. sql may use the tables of bridge.SQL, and starts with SELECT or with more tables and a comma."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        MODULES[f.__name__] = f.__module__.rpartition(".")[2]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = SQL + sql
        return f

    return add


def load() -> None:
    import importlib

    for name in ("event_plans", "claim_plans", "graph_plans", "text_plans", "quality_plans", "agent_plans", "store_plans", "signal_plans", "belief_plans", "desk_plans"):
        importlib.import_module(f"tidemark.plans.{name}")
