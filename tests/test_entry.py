"""Driver contract: entry smoke check, and every query against its SQL oracle."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ticksmith.plans.catalog import QUERIES
from ticksmith.plans.oracle import ORACLE

from sf_paths import SF_SMALL

TABLES = ["orders", "events", "lineitem", "customer"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "MACD_hist" in df.columns and "RSI" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    exp = sorted((tuple(_norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(exp)
    assert got == exp
