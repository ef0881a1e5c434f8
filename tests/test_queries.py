import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from hashloom.plans import catalog

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    told = lambda x: "null" if x is None or pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.12g}" if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)
    return list(df.columns), sorted(tuple(map(told, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"\w+", n) for n in entry.queries())


def test_null_marks():
    """rows() writes every kind of missing value alike."""
    assert rows(pd.DataFrame({"a": [1.0, None]}))[1] == rows(pd.DataFrame({"a": pd.array([1, None], dtype="Float64")}))[1]
