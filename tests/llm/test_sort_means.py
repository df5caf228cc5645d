"""Sort-means against plain Lloyd rounds, and its edge cases."""

import hashlib

import duckdb
import numpy as np
import pytest

from panolake.llm import sort_means

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, assign())), centroids


def got(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in df.collect())


def test_the_query_equals_plain_rounds_and_its_sql(spark):
    found = sort_means.op13_sort_means(spark, SF).toPandas().sort_values("vec_id", ignore_index=True)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected, centroids = plain(rows)
    assert sorted(zip(found.vec_id.astype(str), found.cluster, found.distance)) == expected
    assert set(found.inertia) == {sum(d for _, _, d in expected)}
    for c, group in found.groupby("cluster"):
        assert set(group.cluster_inertia) == {group.distance.sum()}
        assert set(group.centroid_sha256) == {hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    sql = con.execute(sort_means.OP13_SQL).df().sort_values("vec_id", ignore_index=True)
    assert sql[list(found.columns)].astype(str).equals(found.astype(str))


def test_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 64) / 1024).tolist(), 1) for i in range(60)]
    rows += [(7, rows[7][1], None), (None, rows[3][1], 2), (100, None, 1), (101, [1.0] * 63, 1), (102, [None] + [1.0] * 63, 1)]
    rows += [(103, [float("nan")] + [1.0] * 63, 1), (104, [float("inf")] + [1.0] * 63, 1), (105, [0.0] * 64, 1)]
    docs = spark.createDataFrame(rows, ROW).selectExpr("*", "'x' as cluster", "1 as q", "2 as distance")
    found, _ = sort_means.cluster(sort_means.whole_vectors(docs))
    assert got(found) == plain([(i, v) for i, v, _ in rows])[0]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_fewer_vectors_than_centroids_and_none(spark, k):
    rows = [(i, [float(i)] * 64, 1) for i in range(5)]
    found, centroids = sort_means.cluster(sort_means.whole_vectors(spark.createDataFrame(rows, ROW)), k)
    assert got(found) == plain([(i, v) for i, v, _ in rows], k)[0] and len(centroids) == min(k, 5)
    empty = sort_means.inertias(*sort_means.cluster(sort_means.whole_vectors(spark.createDataFrame([], ROW)), k))
    assert empty.collect() == [] and "inertia" in empty.columns


def test_large_components_are_exact_and_distances_beyond_a_long_null(spark):
    rows = [(i, [float(2**20 * (i % 4)) + i] * 64, 1) for i in range(20)] + [(30, [2.0**45] * 64, 1), (31, [-(2.0**45)] * 64, 1), (32, [2.0**60] * 64, 1)]
    docs = spark.createDataFrame(rows, ROW.replace("float", "double"))
    out, centroids = sort_means.cluster(sort_means.whole_vectors(docs), 2)
    expected = plain([(i, v) for i, v, _ in rows[:-1]], 2)[0]
    assert got(out) == [(i, c, d if d < 1 << 63 else None) for i, c, d in expected]
    assert {r["inertia"] for r in sort_means.inertias(out, centroids).collect()} == {None}


def test_scan_equals_full_search():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-500, 500, (400, 16)), rng.integers(-500, 500, (30, 16))
    every = ((q[:, None] - c[None]) ** 2).sum(2)
    best, least = sort_means.nearest(q, rng.integers(0, 30, 400), c)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
