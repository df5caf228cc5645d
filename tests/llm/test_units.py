"""Added tokens in texts get their ids, as the tokenizers library gives them."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from panolake.llm import packing, token_store
from panolake.llm.units import Units

TEXTS = ["a b <|endoftext|> c", "plain text", "", "<|endoftext|>", "x<|startoftext|>y  é<|ENDOFTEXT|>\n<|endoftext|><|endoftext|>", "日本 <|endoftext|> Z", "after"]


@pytest.mark.parametrize(("name", "glued"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens(name, glued):
    from tokenizers import Tokenizer

    library, units = Tokenizer.from_file(public_tokenizers.path(name)), Units(public_tokenizers.path(name), glued)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    ids, counts = units.encode(pa.array(TEXTS))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert library.token_to_id("<|endoftext|>") in want[0]


def test_other_rules_get_whole_texts(tmp_path):
    """A file that cuts in another way is not cut here."""
    import json

    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        rules = json.load(file)
    assert Units(public_tokenizers.path("byte_bpe_50k.json"), True).by_rule and Units(public_tokenizers.path("word_bpe_49k.json"), False).by_rule
    rules["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "own.json").write_text(json.dumps(rules))
    units, library = Units(str(tmp_path / "own.json"), True), Tokenizer.from_file(str(tmp_path / "own.json"))
    ids, counts = units.encode(pa.array(TEXTS))
    assert not units.by_rule and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_memory_starts_anew(monkeypatch):
    """Ids stay right while units are forgotten and met again."""
    from panolake.llm import units as module
    from tokenizers import Tokenizer

    monkeypatch.setattr(module, "REMEMBERED", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Units(path, True), Tokenizer.from_file(path)
    for k in range(30):
        texts = [f"the same words and w{k} x{k * 7} again", f"y{k % 5} the end"]
        ids, counts = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.known) <= 40


def test_store_and_packing(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    at, _ = token_store.write_ids(docs, path, 50256)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read_ids(spark, at).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 50256] for i, t in enumerate(TEXTS)}
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in packing.pack(docs, path, 2).collect():
        ids = np.array([*library.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_pieces_equal_the_library(monkeypatch):
    """Cuts over whole batches give the library's ids, whatever stands beside what; plain texts need no cutting unit by unit."""
    import random

    from tokenizers import Tokenizer

    r = random.Random(5)
    plain = ["a", "b", "S", "s", "t", "re", "ve", "m", "ll", "d", "'", "'", "''", " ", " ", "  ", "\n", "\n\n", "1", "23", ".", ",", "-", "é", "ß", "À"]
    odd = ["×", "÷", "\t", "\r", "Ж", "日", "\u00a0", "\u2009", "\u3000", "\u0085", "\x1c", "\x00", "\x7f", "«", "—", "’", "\u0301", "٣", "<|endoftext|>"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Units(path, True), Tokenizer.from_file(path)
    for signs in (plain, plain * 3 + odd):
        texts = ["".join(r.choice(signs) for _ in range(r.choice([0, 1, 2, 3, 10, 40]))) for _ in range(2000)]
        if signs is plain:
            with monkeypatch.context() as only:
                only.setattr(Units, "_by_library", None)
                ids, counts = own.encode(pa.array(["x", *texts]).slice(1))
        else:
            ids, counts = own.encode(pa.array(["x", *texts]).slice(1))
        for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text
