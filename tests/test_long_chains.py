"""Chains of rivals longer than any fixed number of rounds are matched to their end."""

from __future__ import annotations

from panolake.operators.matching import greedy_one_to_one
from panolake.plans.catalog import keeper


def test_greedy_chain(spark):
    rows = [(i, i + d, float(2 * i + d)) for i in range(105) for d in (0, 1)]
    got = greedy_one_to_one(spark.createDataFrame(rows, "a long, b long, dist double").coalesce(1), keeper(spark))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(i, i) for i in range(105)}
