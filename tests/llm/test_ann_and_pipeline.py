"""Nearest neighbours against brute force, and the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from panolake.llm import ann
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_hilbert_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[200:700] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [float("inf")] * 16), (2005, [1.0, 2.0]), (0, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = ann.search(table, F.col("vec_id") % 20 == 0, range_rows=64).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        score = x @ x[q]
        assert np.allclose(part.score, score[part.vec_id])
        assert list(zip(-part.score, part.vec_id, strict=True)) == sorted(zip(-part.score, part.vec_id, strict=True))
        score[q] = -np.inf
        hits += len(set(part.vec_id) & set(np.lexsort((np.arange(1500), -np.round(score, 9)))[:20]))
    assert hits >= 0.9 * 20 * got.query_id.nunique()
    few = ann.search(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.search(table.limit(0), F.col("vec_id") == 0).count() == 0


def brute(x: np.ndarray, q: int, keep: int) -> list[int]:
    score = x @ x[q]
    return [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:keep]


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 300)] + [(0, [1.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") == 0, range_rows=64, side=1.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21))
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, size=(700, 5)).astype(float)
    x[(x == 0).all(1)] = 1.0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = ann.search(table, F.col("vec_id") % 50 == 0, range_rows=32, side=1.0).toPandas()
    for q, part in got.groupby("query_id"):
        assert part.sort_values("rank").vec_id.tolist() == brute(x, q, 20)


def test_long_vectors_do_not_hide_others(spark):
    """Recall on clustered vectors with narrow windows, one vector a thousand times longer."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    x = np.repeat(centres, 50, axis=0) + 0.1 * rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = ann.search(table, F.col("vec_id") % 20 == 0, keep=10, range_rows=64, side=0.08).toPandas()
    hits = [len(set(part.vec_id) & set(brute(x, q, 10))) / 10 for q, part in got.groupby("query_id")]
    assert len(hits) == 150 and np.mean(hits) >= 0.9


@pytest.fixture(scope="module")
def stages(spark):
    from panolake.llm.common import table, written

    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_pipeline_columns(stages):
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns and docs.schema["n_chars"].dataType == stages[0].schema["n_chars"].dataType
        assert docs.where("n_chars <> char_length(text)").count() == 0


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = (df.join(labels, "doc_id").groupBy("toxic").count().collect() for df in stages[:2])
    before, after = ({r["toxic"]: r["count"] for r in x} for x in (before, after))
    assert after[0] >= 0.97 * before[0] and after.get(1, 0) <= 0.4 * before[1]


def test_one_of_each_class_stays(stages):
    """Against all pairs: Jaccard 0.8 and more over five-word shingles."""
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in stages[2].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    holders, root = {}, {i: i for i in sets}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        both = Counter(j for x in own for j in holders[x] if j > i)
        for j, n in both.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n) - 1e-9 and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert {r["doc_id"] for r in stages[3].select("doc_id").collect()} == {i for i in sets if top(i) == i}


def test_packing_holds_everything(stages):
    assert {r["doc_id"] for r in stages[-1].select("doc_id").distinct().collect()} == {r["doc_id"] for r in stages[-2].select("doc_id").collect()}
