"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

from meterlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    c.sql("set timezone = 'UTC'")
    return c


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if isinstance(x, float):
            return repr(round(x, 6))
        return x.isoformat() if isinstance(x, dt.date) else repr(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert values(df.collect(), df.columns) == values(expected.fetchall(), expected.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
