"""SimHash near-duplicates by deletion-variant signatures.

The 64 bits are cut into three segments, so of four differing bits one segment has at most one. Each
fingerprint is indexed under 64 keys: a segment with one of its bits wiped out. Two segments with at most
one differing bit share a key; an equality shuffle brings the holders of a key together, and whole
fingerprints are verified there. Within a key only edges that join something new are kept, so a dense
ball of near copies gives links in proportion to its size; the classes are what all links would give.

Defined results: null and empty texts (no words) have fingerprint zero and link like any other; rows that
share a fingerprint are one class; repeated rows stay; rows with a null doc_id link like others but name no
class unless all of it is null; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import partitions, table, text_of, written
from panolake.operators.components import connected_components

SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Fingerprints of one key that are compared at once; larger keys go on in blocks of this many.
BLOCK = 2048
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, words_each: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > words_each:
        spans = zip(begins.tolist(), ends[words_each - 1 :].tolist(), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_each: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words_each, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return text_of(docs).mapInArrow(each, "doc_id long, fp long")


def _joins(left: np.ndarray, right: np.ndarray, most: int, same: bool) -> list[tuple[int, int]]:
    """Edges enough to connect all that lie within ``most`` bits: a spanning forest of one block pair, grown side by side, as a dense ball has millions of pairs."""
    near = np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= most
    if same:
        np.fill_diagonal(near, False)
    sides = ((near, left, right), (near.T, right, left))
    new = [np.ones(len(left), bool), np.ones(len(right), bool)]
    if same:
        new[1] = new[0]
    edges = []
    for first in np.flatnonzero(near.any(1)).tolist():
        if not new[0][first]:
            continue
        new[0][first] = False
        open_ = [(0, first)]
        while open_:
            side, i = open_.pop()
            links_of, own, others = sides[side]
            found = np.flatnonzero(links_of[i] & new[1 - side])
            new[1 - side][found] = False
            edges += [(int(own[i]), b) for b in others[found].tolist()]
            open_ += [(1 - side, j) for j in found.tolist()]
    return edges


def links(fps: DataFrame, most: int = 4, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(a, b): edges between distinct fingerprints, all within ``most`` (at most 5) bits, that connect all such. ``keep`` writes what is read twice."""
    spark = fps.sparkSession
    segment = F.expr("case when p < 21 then 2097151L when p < 42 then 4398044413952L else -4398046511104L end")
    keys = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    keys = keys.select("fp", "p", F.col("fp").bitwiseAND(segment).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, p)"))).alias("v"))
    edge_type = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], schema=edge_type)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key that fills more than a block is passed on as blocks."""
        key, held, blocks = None, [], 0

        def close(last: bool) -> tuple[list, list]:
            nonlocal blocks, held
            values = np.unique(np.array(held, np.int64))
            held = []
            found = _joins(values, values, most, True) if len(values) > 1 else []
            block = [(key[0], key[1], blocks, values.tobytes())] if key and len(values) and (blocks or not last) else []
            blocks = 0 if last else blocks + 1
            return found, block

        for batch in batches:
            p, v, fp = (batch.column(c).to_numpy() for c in ("p", "v", "fp"))
            edges, passed = [], []
            starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (v[1:] != v[:-1])])) if len(p) else np.zeros(0, int)
            ends = np.concatenate([starts[1:], [len(p)]])
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                if key == (p[a], v[a]):
                    values = fp[a:b].tolist()
                elif b - a == 1 and 0 < i < len(starts) - 1:
                    continue
                else:
                    if key is not None:
                        found, block = close(True)
                        edges += found
                        passed += block
                    key, values = (int(p[a]), int(v[a])), fp[a:b].tolist()
                while len(held) + len(values) > BLOCK:
                    room = BLOCK - len(held)
                    held += values[:room]
                    values = values[room:]
                    found, block = close(False)
                    edges += found
                    passed += block
                held += values
            yield _mixed(edges, passed)
        if key is not None:
            yield _mixed(*close(True))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                yield edges_of(_joins(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), most, False))

    dealt = keys.repartition(partitions(spark), "p", "v").sortWithinPartitions("p", "v", "fp")
    first = keep(dealt.mapInArrow(within, "a long, b long, p int, v long, block int, held binary"), "simhash-links")
    blocks = first.where("held is not null").select("p", "v", "block", "held")
    right = blocks.select("p", "v", F.col("block").alias("other"), F.col("held").alias("y"))
    pairs = blocks.join(right, ["p", "v"]).where("block < other").select(F.col("held").alias("x"), "y")
    later = pairs.mapInArrow(across, "a long, b long")
    return first.where("a is not null").select("a", "b").union(later).distinct()


def _mixed(edges: list[tuple[int, int]], blocks: list[tuple]) -> pa.RecordBatch:
    n, m = len(edges), len(blocks)
    columns = [
        pa.array([e[0] for e in edges] + [None] * m, pa.int64()),
        pa.array([e[1] for e in edges] + [None] * m, pa.int64()),
        pa.array([None] * n + [x[0] for x in blocks], pa.int32()),
        pa.array([None] * n + [x[1] for x in blocks], pa.int64()),
        pa.array([None] * n + [x[2] for x in blocks], pa.int32()),
        pa.array([None] * n + [x[3] for x in blocks], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "p", "v", "block", "held"])


def near_duplicates(docs: DataFrame, most: int = 4, words_each: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (least doc_id of the class) of every row."""
    every = written(fingerprints(docs, words_each, seed), "simhash")
    nodes = written(every.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), most), lambda df: written(df, "simhash-round"))
    placed = written(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    least = written(placed.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    classes = written(placed.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return every.join(classes, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every row of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
