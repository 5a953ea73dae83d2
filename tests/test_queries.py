"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import SF
from tidewatch.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return str(float(v)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    own = registry.QUERIES[name](spark, sf_dir)
    sql = duck.sql(registry.ORACLE[name])
    columns = sorted(own.columns)
    assert columns == sorted(sql.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in own.collect())
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows_only(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
