"""Every query of both catalogs against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest
from panolake.plans import chains, documents  # noqa: F401  add their queries
from panolake.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str, datetime.date)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return float(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(mine) > 0 or name == "key_differences"
    assert mine == theirs
