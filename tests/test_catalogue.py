"""Queries against their SQL on the smallest data."""

import math

import duckdb
import pytest

from verispark.plans import catalogue


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        v = float(v)
        return None if math.isnan(v) else round(v, 5)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("events", "documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = sorted(str([plain(r[c]) for c in want.columns]) for r in got.collect())
    assert mine == sorted(str([plain(v) for v in r]) for r in want.fetchall())


def test_every_query_without_sql_runs(spark, sf):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)):
        out = catalogue.QUERIES[name](spark, sf)
        assert out.columns and len(out.collect()) > 0, name
