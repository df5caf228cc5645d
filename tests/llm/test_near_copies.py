"""The near-copy stage against brute force over planted copies."""

from __future__ import annotations

import random

import pytest
from panolake.llm import near_copies

import corpus_pipeline

SCHEMA = "doc_id long, text string, n_chars long"


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def staged(spark, rows):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()]


def planted() -> list[tuple[int, str]]:
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(60):
        words = [word() for _ in range(r.choice([30, 100, 300, 1000]))]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            # One word in `apart` changed gives a similarity of about (1 - 5/apart) / (1 + 5/apart).
            edited, apart = list(words), r.choice([30, 40, 50, 70, 120])
            for p in range(r.randrange(apart), len(words), apart):
                edited[p] = word()
            rows.append((10 * k + j, " ".join(edited)))
    hub = [word() for _ in range(200)]
    rows += [(1000 + i, " ".join([*hub[:-i], *(word() for _ in range(i))])) for i in range(1, 60)]
    rows += [(2000, "a b"), (2001, "A  b"), (2002, "a b c"), (2003, ""), (2004, " \n")]
    return rows


@pytest.mark.parametrize("hot, block, thinned", [(3, 5, 0.8), (2, 4096, 0.0), (32, 4096, 0.8)])
def test_near_copies_go(spark, monkeypatch, hot, block, thinned):
    """Also where most keys are common ones, so that sets outside a key's largest class meet all others, in blocks and after one round alone."""
    monkeypatch.setattr(near_copies, "HOT", hot)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "THINNED", thinned)
    rows = planted()
    texts = dict(rows)
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    near = [(a, b, s) for a in texts for b in texts if a < b and (s := similarity(texts[a], texts[b])) >= 0.8]
    assert sum(s < 0.85 for *_, s in near) > 30 and sum(0.85 <= s < 0.95 for *_, s in near) > 30
    for a, b, _ in near:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert {i for i, _ in staged(spark, rows)} == {i for i in texts if top(i) == i}


def test_rows_without_id_stay(spark):
    r = random.Random(12)
    clean = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(5)]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (None, clean[2]), (7, clean[2]), (8, clean[2]), (9, clean[3]), (9, clean[3]), (9, clean[4]), (None, None)]
    want = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (9, clean[3]), (9, clean[4]), (None, None)]
    assert sorted(staged(spark, rows), key=str) == sorted(want, key=str)


def test_simhash_is_a_step(spark, monkeypatch):
    """Without any key of the exact step, close copies still go: SimHash finds them, and whole sets verify them."""
    r = random.Random(13)
    rows = []
    for k in range(20):
        words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(1500)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:-1], "end"])), (10 * k + 2, " ".join(words[:700]))]

    def no_keys(texts, nodes, words_each, least, keep):
        none = keep(nodes.where("false").select(near_copies.F.col("node").alias("key"), "node", near_copies.F.lit(0).alias("after")), "none")
        return none.select("key", "node"), none

    monkeypatch.setattr(near_copies, "prefixes", no_keys)
    left = {i for i, _ in staged(spark, rows)}
    assert left >= {i for i, _ in rows if i % 10 != 1} and len(left) < 43


def test_dense_ball_is_joined_in_little_memory():
    """A block whose fingerprints all lie near each other, and classes as all pairs give them, within a block and across two."""
    import tracemalloc

    from panolake.llm import simhash

    r = random.Random(14)
    ball = near_copies.np.unique(near_copies.np.array([(1 << r.randrange(40)) | (1 << r.randrange(40)) for _ in range(20000)], near_copies.np.int64))
    tracemalloc.start()
    edges = simhash._joins(ball, ball, 4, True)
    assert len(edges) == len(ball) - 1 and tracemalloc.get_traced_memory()[1] < 40 * len(ball) ** 2
    tracemalloc.stop()
    for same in (True, False):
        x = near_copies.np.unique(near_copies.np.array([r.randrange(1 << 12) << 20 for _ in range(60)], near_copies.np.int64))
        y = x if same else near_copies.np.unique(near_copies.np.array([r.randrange(1 << 12) << 20 for _ in range(60)], near_copies.np.int64))
        names = [(0, i) for i in x.tolist()] + ([] if same else [(1, i) for i in y.tolist()])

        def classes(pairs):
            root = {n: n for n in names}
            top = lambda n: n if root[n] == n else top(root[n])
            for a, b in pairs:
                root[top(a)] = top(b)
            return {frozenset(n for n in names if top(n) == k) for k in map(top, names)}

        other = 0 if same else 1
        got = [((0, a), (other, b)) if same or (0, a) in names and (1, b) in names and (a ^ b).bit_count() <= 2 else ((0, b), (1, a)) for a, b in simhash._joins(x, y, 2, same)]
        want = [((0, a), (other, b)) for a in x.tolist() for b in y.tolist() if (a ^ b).bit_count() <= 2]
        assert classes(got) == classes(want) and len(got) == len(names) - len(classes(want))
