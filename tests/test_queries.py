"""Every registered query of the event model against its SQL, on the small tables, and the entry's contract."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(str([None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLES:
        assert rows(got.toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())
    else:
        got.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
