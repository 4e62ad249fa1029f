"""Every registered query against its oracle at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from optelem.fixtures import TABLES
from tests.conftest import SMALL

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


def norm(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert found
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    a = sorted(tuple(norm(r[df.columns.index(c)]) for c in names) for r in found)
    b = sorted(tuple(norm(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    assert a == b


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
