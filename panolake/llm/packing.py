"""Packing: order-preserving dynamic programming over the places where a text may be cut.

Documents in ascending doc_id form one stream of ids per range of doc_ids. It may be cut at the end of a
document (free), at the end of a sentence (``SENTENCE``) or, inside a sentence of over ``GAP`` ids, at every
GAP-th id (``WORD``): penalties in padding ids. best(j) is the least padding plus penalties of any way
to cut before j: the minimum of best(i) - (capacity - (j - i)) over the window i >= j - capacity, kept in a
monotone queue, or best(j - 2^k) as a sequence of a power of two needs no padding.

Defined results: null text is an empty text (its end id alone); rows with one doc_id stay separate rows;
documents longer than a sequence go on in the next; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from panolake.llm.common import partitions, table, text_of
from panolake.llm.units import slices, units_of

CAPACITY, GAP, SENTENCE, WORD = 4096, 512, 8.0, 64.0
#: Ids of one run of the dynamic programme; the stream starts anew after it, at the end of a document.
RUN_IDS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Of ascending ``places`` from 0 to the end, no two further apart than ``capacity``, those to cut at."""
    n = len(places)
    earlier = {}
    for k in range(capacity.bit_length() - 1):
        at = np.searchsorted(places, places - (1 << k))
        for j in np.flatnonzero((at < n) & (places[np.minimum(at, n - 1)] == places - (1 << k))).tolist():
            earlier.setdefault(j, []).append(int(at[j]))
    where, cost = places.tolist(), penalty.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        x = where[j]
        while where[queue[0][1]] < x - capacity:
            queue.popleft()
        low, i = queue[0]
        value = low + capacity - x
        for p in earlier.get(j, ()):
            if best[p] < value:
                value, i = best[p], p
        value += cost[j]
        best[j], back[j] = value, i
        key = value + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return places[cuts[::-1]]


def ends_sentence(token: str) -> bool:
    return token.removesuffix("</w>").rstrip("\"')]")[-1:] in (".", "!", "?")


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut a run of documents that end at ``ends``, with the penalty of each."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE
    penalty[ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty < np.inf)
    gaps = np.diff(places)
    for i in np.flatnonzero(gaps > GAP):
        penalty[places[i] + GAP : places[i + 1] : GAP] = WORD
    places = np.flatnonzero(penalty < np.inf)
    return places, penalty[places]


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its ids' checksum; see PIECES. Sequences number on within each range of doc_ids."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(tokenizer, False)
        vocabulary = units.library.get_vocab()
        stops = np.zeros(max(vocabulary.values()) + 1, bool)
        stops[[i for token, i in vocabulary.items() if ends_sentence(token)]] = True
        sequence = TaskContext.get().partitionId() << 40
        doc_ids: list[int] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence, held
            ids, n = np.concatenate(parts).astype("<u4"), np.concatenate(sizes)
            ends = np.cumsum(n)
            cuts = best_cuts(*cut_places(ids, ends, stops), capacity)
            edges = np.unique(np.concatenate([cuts, ends, [0]]))
            begins, lengths = edges[:-1], np.diff(edges)
            doc = np.searchsorted(ends, begins, side="right")
            bundle = np.searchsorted(cuts, begins, side="right") - 1
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(begins.tolist(), lengths.tolist(), strict=True)]
            columns = [np.array(doc_ids, object)[doc].tolist(), begins - (ends - n)[doc], lengths, crc, n[doc], sequence + bundle, begins - cuts[bundle]]
            sequence += len(cuts) - 1
            doc_ids.clear(), sizes.clear(), parts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

        for batch in slices(batches):
            ids, n = units.encode(batch.column("text"))
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id)
            n, at = n + 1, 0
            for k in range(0, len(n), 64):
                some = n[k : k + 64]
                doc_ids += batch.column("doc_id").slice(k, 64).to_pylist()
                sizes.append(some)
                parts.append(ids[at : at + int(some.sum())])
                at += int(some.sum())
                held += int(some.sum())
                if held >= RUN_IDS:
                    yield packed()
        if doc_ids:
            yield packed()

    ranged = text_of(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the whole of ``documents``."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
