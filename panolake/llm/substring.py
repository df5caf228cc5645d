"""Substring dedup: repeated windows of words found by recompression, verified by hashes of all their words.

Every window of ``window`` words has a key, the longest recompression symbol that its own words decide
(see ``recompression``); equal windows have equal keys. Keys that two documents share leave candidate
windows; those are grouped by 128 bits, two hashes of their words that share nothing (each word has 128 bits of
its own, half for each), and each window that also starts in a document with a smaller doc_id marks its words. Marked words go; all windows are judged on the input.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows that
share a doc_id never remove from each other, as no doc_id is smaller; rows with a null doc_id stay whole
and remove from no other; an empty table gives none. Extra columns stay as they are, whatever their names; with
counts, columns of the input named n_words or n_removed give way to the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panolake.llm.common import scratch, table
from panolake.llm.recompression import mixed, window_keys
from panolake.llm.units import slices

WINDOW = 50
#: Documents, and bytes of their texts, that a task parses at once; a longer text is taken alone.
ROWS, BYTES = 2000, 3 << 19


def row_key():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of every word of the texts, and how many words each text has."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    n = np.diff(lists.offsets.to_numpy())
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    digests = b"".join([xxhash.xxh3_128_digest(w.encode()) for w in words]) or bytes(16)
    halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    index = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:
        full = index != words.index("")
        doc = np.repeat(np.arange(len(n)), n)
        n = np.bincount(doc[full], minlength=len(n))
        index = index[full]
    return halves[index, 0], halves[index, 1], n


def window_hashes(names: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the words of every window, by doubling."""
    factor = np.uint64(0x8CB92BA72F3D8DD7)
    level, size = mixed(names ^ factor), 1
    total: np.ndarray | None = None
    at, rest = 0, window
    while rest:
        if rest & 1:
            part = level[at:]
            total = part if total is None else mixed(total[: len(part)] * factor + part)[: len(part)]
            at += size
        rest >>= 1
        if rest:
            level = mixed(level[: max(0, len(level) - size)] * factor + level[size:])
            size *= 2
    return total[: max(0, len(names) - window + 1)]


def shared_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key, at (array of first words): windows that also start in a document with a smaller doc_id."""
    docs = docs.where("doc_id is not null").select("doc_id", row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ROWS, BYTES):
            names, _, n = words_of(rows.column("text"))
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            found = window_keys(names, doc, window)
            new = found != 0
            new[1:] &= (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            pair = np.unique(np.stack([doc[new].astype(np.uint64), found[new]], 1), axis=0)
            at = pa.array(pair[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), rows.column("row_key").take(at), pa.array(pair[:, 1].copy().view(np.int64))], ["doc_id", "row_key", "key"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, ROWS, BYTES):
            names, others, n = words_of(rows.column("text"))
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            if not len(names):
                continue
            found = window_keys(names, doc, window)
            lists = rows.column("keys")
            owner = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy())
            wanted = lists.flatten().to_numpy().view(np.uint64)
            hit = (found != 0) & np.isin(mixed(found + doc.astype(np.uint64)), mixed(wanted + owner.astype(np.uint64)))
            at = np.flatnonzero(hit)
            first, second = window_hashes(names, window), window_hashes(others, window)
            begins = np.cumsum(n) - n
            d = pa.array(doc[at])
            columns = [rows.column("doc_id").take(d), rows.column("row_key").take(d), pa.array((at - begins[doc[at]]).astype(np.int32)), pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "at", "h1", "h2"])

    with scratch(docs.sparkSession) as keep:
        named = keep(docs.mapInArrow(keys, "doc_id long, row_key long, key long"), "window-keys")
        shared = named.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        shared = keep(shared.select("key"), "shared-keys")
        by_doc = keep(named.join(shared, "key").groupBy("doc_id", "row_key").agg(F.collect_list("key").alias("keys")), "keys-by-document")
        windows = docs.join(by_doc, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "keys")
        windows = keep(windows.mapInArrow(candidates, "doc_id long, row_key long, at int, h1 long, h2 long"), "windows")
        first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        first = keep(first.select("h1", "h2", "low"), "window-firsts")
        later = keep(windows.join(first, ["h1", "h2"]).where("doc_id > low").select("doc_id", "row_key", "at"), "later-windows")
        return keep.result(later.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("at")), "marked-windows")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, counts: bool = True) -> DataFrame:
    """``docs`` with marked words cut from ``text``, and n_words, n_removed unless ``counts`` is False."""
    marked = shared_windows(docs.select("doc_id", "text"), window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS, 4 * BYTES):
            sizes, gone, texts = [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                raw = (text or "").encode()
                words = raw.split()
                sizes.append(len(words))
                if not at:
                    gone.append(0)
                    texts.append(text)
                    continue
                edge = np.zeros(len(words) + window + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.array(at) + window, -1)
                out = np.cumsum(edge)[: len(words)] > 0
                gone.append(int(out.sum()))
                texts.append(_without(raw, words, out))
            columns = [batch.column("rest"), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(gone, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_words", "n_removed"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*others).alias("rest"), "text", "doc_id", row_key().alias("row_key"))
    joined = held.join(marked, ["doc_id", "row_key"], "left").select("rest", "text", "at")
    done = joined.mapInArrow(cut, T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_removed", T.IntegerType())]))
    counted = ["n_words", "n_removed"] if counts else []
    return done.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns if c not in counted], *counted)


def _without(raw: bytes, words: list[bytes], out: np.ndarray) -> str:
    """The text without the words marked; between kept words stands what stood before the later one."""
    kept, at, gap = [], 0, 0
    for word, gone in zip(words, out.tolist(), strict=True):
        begin = raw.index(word, at)
        at = begin + len(word)
        if not gone:
            space = raw[gap:begin] if kept or not gap else b""
            kept.append((space if space else b" " if kept else b"") + word)
        gap = at
    return b"".join(kept).decode() + ("" if len(out) and out[-1] else raw[gap:].decode())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the kept words' digest of every row of ``documents``."""
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(b" ".join((t.as_py() or "").encode().split())).hexdigest() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), pa.array(found)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return done.select("doc_id", "text", F.col("n_words").cast("long"), F.col("n_removed").cast("long")).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
