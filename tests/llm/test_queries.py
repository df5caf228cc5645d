"""The registered queries on whole tables against brute force, column by column."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from panolake.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts() -> list[tuple[int, str]]:
    rows = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    return [(int(i), t or "") for i, t in zip(rows.doc_id, rows.text, strict=True)]


def got(spark, name: str) -> list[dict]:
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_op1(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack([np.asarray(v, float) for v in table.embedding])
    ids = table.vec_id.to_numpy()
    rows = got(spark, "op1_nearest")
    for q in ids[ids % 20 == 0]:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        score = x @ x[ids == q][0]
        want = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r["vec_id"] for r in mine] == ids[want].tolist() and np.allclose([r["score"] for r in mine], score[want], atol=1e-12)


def test_op2(spark, texts):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in got(spark, "op2_toxicity")}
    assert set(rows) == {i for i, _ in texts} and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert len(labels)


def test_op3(spark, texts):
    import tiktoken
    from panolake.llm.bpe import read_ranks

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {i: (len(ids := own.encode_ordinary(t)), digest(np.array(ids, "<u4").tobytes()), digest(t.encode())) for i, t in texts}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got(spark, "op3_bpe")} == want


def test_op4(spark, texts):
    prints = {}
    for i, t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got(spark, "op4_simhash")} == {i: (f"{p:016x}", top(i)) for i, p in prints.items()}


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got(spark, "op5_token_store")} == want


def test_op7(spark, texts):
    first: dict[tuple, int] = {}
    words = {i: WORD.findall(t) for i, t in texts}
    for i, w in words.items():
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = True
        want[i] = (len(w), int(gone.sum()), digest(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got(spark, "op7_substring_dedup")} == want


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    rows = pd.DataFrame(got(spark, "op9_packing"))
    for r in rows.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, part in rows.sort_values("start").groupby("doc_id"):
        assert part.start.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(ids[i])
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 4096
    assert set(rows.doc_id) == set(ids)
