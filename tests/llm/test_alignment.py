"""Alignment of two tokenizers against whole-text encoding and plain dictionaries."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panolake.llm import alignment

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """Rows by the contract, texts encoded whole."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = alignment.Plain(A).shown
    back = {c: x for x, c in shown.items()}
    linked, rows = [], []
    for text in texts:
        groups, own = [], []
        if text:
            raw = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            of_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
            of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(of_a) == raw == b"".join(of_b):
                ends_a = {sum(map(len, of_a[: k + 1])): k for k in range(len(of_a))} if len(of_a) < 500 else ends(of_a)
                ends_b = {sum(map(len, of_b[: k + 1])): k for k in range(len(of_b))} if len(of_b) < 500 else ends(of_b)
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a[end] + 1, ends_b[end] + 1
                    groups.append(f"{','.join(map(str, ids_a[i:p]))}|{','.join(map(str, ids_b[j:q]))}")
                    own.append((ids_a[p - 1], ids_b[q - 1]))
                    i, j = p, q
        linked.append(own)
        rows.append((len(ids_a), len(ids_b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()) if groups else (0, 0, 0, 0, ""))
    counts = Counter(p for own in linked for p in own)
    best = {}
    for (_, b_id), n in counts.items():
        best[b_id] = max(best.get(b_id, 0), n)
    return [(*r[:4], sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), r[4]) for r, own in zip(rows, linked)], counts


def ends(parts):
    out, at = {}, 0
    for k, p in enumerate(parts):
        at += len(p)
        out[at] = k
    return out


def key(rows):
    return sorted(map(str, rows))


def test_the_query_equals_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = alignment.op12_alignment(spark, SF)
    assert set(NAMES) <= set(found.columns)
    assert key(tuple(r[c] for c in NAMES) for r in found.collect()) == key((d["doc_id"], *r) for d, r in zip(docs, plain([d["text"] for d in docs])[0]))


ODD = [
    None, "", " ", "  ", " a", "a ", "  a  b ", "x▁y z", "the<|endoftext|>cat <|endoftext|> sat", "<s> hi </s><unk>", "a b 　c", "\n a \n\nb\t c", "naïve é😀 漢字かな",
    "\x00 zero \x1c one", "é combining", "word " * 3000, "nospaceatall" * 2000, "same same same", "same same same", "it's we'll 12345 6,7", "...!!! ??", "ends in space ", "▁", " ▁",
]


def test_odd_texts_repeats_and_nulls(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as stripe", "'s' as slice", "2 as n_a")
    found = alignment.align(docs, A, B)
    expected, counts = plain([t for _, t in rows])
    assert key(tuple(r[c] for c in NAMES) for r in found.documents.collect()) == key((i, *r) for (i, _), r in zip(rows, expected))
    pairs = found.pairs.collect()
    assert {(r["a"], r["b"]): r["n"] for r in pairs} == counts
    assert all(r["best"] == (r["n"] == max(n for (_, b), n in counts.items() if b == r["b"])) for r in pairs)


def test_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).documents.collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_counts_in_parts(spark, parts):
    docs = spark.createDataFrame([(i, f"the cat {i} saw it's naïve dog {i % 7}") for i in range(300)], "doc_id long, text string").repartition(6)
    size = len(alignment.Plain(A).bytes)
    packed = alignment.packed_links(docs, A, B, size).where("stripe is not null")
    counts = plain([f"the cat {i} saw it's naïve dog {i % 7}" for i in range(300)])[1]
    assert {(r["a"], r["b"]): r["n"] for r in alignment._pairs(alignment.stripe_counts(packed, size, parts)).collect()} == counts


def test_forgotten_units_come_back(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    aligner = alignment.Aligner(A, B)
    for words in (["a", "b"], ["c", "d"], ["a", "x▁"], ["e", "f", "g", "h", "i"]):
        at = aligner.places(words)
        assert [aligner.facts[i][0] for i in at] == [int("▁" not in w) for w in words]


def test_inner_units_keep_edge_spaces():
    texts = pa.array(["", " a b", "a b", "a b ", "c", "", "a  b c"])
    flat, n = alignment.inner_units(texts)
    assert (flat.to_pylist(), n.tolist()) == ([" a", "b", "a", "b", "a", "b ", "c", "a  b", "c"], [0, 2, 2, 2, 1, 0, 2])
