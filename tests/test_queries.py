"""Every query that has SQL gives what DuckDB gives, on the smallest tables; the others run."""

import os

import pytest

import __spark_entry__ as entry

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="needs the driver's tables")
#: These are held against brute force in tests/llm.
SLOW = ("pipeline", "op")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{HERE}/{name}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, HERE).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith(SLOW)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, HERE).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
