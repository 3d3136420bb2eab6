"""Driver contract: entry, queries and oracle_sql; every oracle matches Spark on sf0.001."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as se
from receivables.sources.fixtures import BASE_TABLES

from conftest import SF_SMALL


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    assert set(se.oracle_sql()) <= set(se.queries())
    assert len(se.queries()) >= 70


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_oracle_parity(spark, duck, name):
    df = se.queries()[name](spark, SF_SMALL)
    cur = duck.execute(se.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(ocols, cur.fetchall())
