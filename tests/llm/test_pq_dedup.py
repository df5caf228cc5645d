"""Embedding near-dedup against all pairs, on loose, dense, copied and odd vectors."""

import duckdb
import numpy as np
import pytest

from panolake.llm import pq_dedup

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.93):
    """(vec_id, n_links, component_id) of each row by all pairs of double-precision cosines."""
    sound = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(np.float64(x)) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for size in {len(rows[k][1]) for k in sound}:
        own = [k for k in sound if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in own], float)
        x /= abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= threshold
        for i, j in zip(*np.nonzero(near)):
            if i != j and rows[own[i]][2] == rows[own[j]][2]:
                links[own[i]].add(own[j])
    root = {}
    for k in links:
        if k in root:
            continue
        todo, seen = [k], {k}
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        named = [rows[m][0] for m in seen if rows[m][0] is not None]
        root |= dict.fromkeys(seen, min(named) if named else None)
    return sorted(map(str, ((r[0], len(links[k]), root[k]) for k, r in enumerate(rows))))


def got(df):
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in df.collect())


def scene(rng, n, size=64):
    """Random directions, clusters of several widths, one dense ball and one common vector."""
    base = rng.normal(size=(40, size))
    rows = [(rng.normal(size=size), i % 3) for i in range(n)]
    for k, b in enumerate(base):
        width = (0.02, 0.1, 0.2, 0.25, 0.3, 0.4)[k % 6] * np.linalg.norm(b) / size**0.5
        rows += [(b + rng.normal(size=size) * width, k % 3) for _ in range(12)]
    rows += [(base[0] + rng.normal(size=size) * 0.1, 1) for _ in range(n // 2)]
    rows += [(base[5] * 7, 2)] * (n // 3)
    return [(i, (v * 10.0 ** rng.integers(-3, 4)).astype(np.float32).tolist(), label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize(("block", "lists"), [(4096, 4096), (50, 4096), (50, 1)])
def test_all_links_and_classes(spark, monkeypatch, block, lists):
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "LISTS", lists)
    rows = scene(np.random.default_rng(block + lists), 900)
    assert got(pq_dedup.near_duplicates(spark.createDataFrame(rows, ROW))) == plain(rows)


@pytest.mark.parametrize(("size", "threshold"), [(2, 0.93), (3, 0.99), (16, 0.8)])
def test_other_lengths_and_thresholds(spark, size, threshold):
    rows = scene(np.random.default_rng(size), 300, size)
    assert got(pq_dedup.near_duplicates(spark.createDataFrame(rows, ROW), threshold)) == plain(rows, threshold)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (1, one, 1), (2, [2.0, 4.0, 6.0], 1), (3, one, None), (None, one, 1), (None, one, 2), (4, one, 2), (None, [0.0, 1.0, 0.0], 5), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1)]
    rows += [(8, [1.0, None, 2.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [1.0, 2.0, 3.0, 0.0], 1), (12, [-1.0, -2.0, -3.0], 1), (13, [1e38, 2e38, 3e38], 1), (14, [1e-38, 2e-38, 3e-38], 1)]
    docs = spark.createDataFrame(rows, ROW).selectExpr("*", "1 as n", "'x' as rep", "2 as size", "0 as list")
    assert got(pq_dedup.near_duplicates(docs)) == plain(rows)
    assert pq_dedup.near_duplicates(spark.createDataFrame([], ROW)).collect() == []
    assert got(pq_dedup.near_duplicates(spark.createDataFrame([(5, None, 1), (None, None, None)], ROW))) == ["(5, 0, 5)", "(None, 0, None)"]


def test_the_query_equals_all_pairs_and_its_sql(spark):
    found = pq_dedup.op11_pq_dedup(spark, SF)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(found) == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    sql = con.execute(pq_dedup.OP11_SQL).df().sort_values("vec_id", ignore_index=True)
    assert sql.astype(str).equals(found.toPandas().sort_values("vec_id", ignore_index=True)[list(sql.columns)].astype(str))
