"""Cross-tokenizer alignment: how the tokens of two vocabularies match over a corpus.

Both encodings of a text (A byte-level, B sentence pieces) are cut into groups where tokens of both end at one
byte. A pair of such tokens is a link, and a pair of ids counts as many as the corpus holds links of it.

Texts are cut at inner single spaces, which neither vocabulary merges across; a worker encodes and aligns each
distinct unit once (``Aligner``). Links go out packed by slice of documents and stripe of B ids. Counts are
striped by id: the rows of a stripe meet in one task, ``np.add.at`` adds them into the stripe's dense block of
B ids by A ids, and its row maxima are the best counts (``stripe_counts``). Where there are more shuffle
partitions than stripes, a stripe is first summed in salted parts. Scoring runs co-partitioned: links and their
stripe's counts meet by stripe and part, counts first, and each document's sums come back by slice.

Defined results: null and empty texts, and texts whose joined token bytes are not those of space and text (as
where they hold U+2581), have no tokens: zeros and an empty digest; repeated rows are documents of their own
and count again; null doc_ids stay; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import partitions, scratch, table, text_of
from panolake.llm.units import _BESIDE, _INNER, Units, slices, spread, split_units

#: B ids of one dense block.
STRIPE = 128
#: Documents of a slice, so that a document's place in it fits 12 bits.
ROWS = 3000
#: Distinct units that a worker remembers, and bytes of them; beyond it all go, which costs time only.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64 << 20

_LISTS = ("doc_ids", "n_a", "n_b", "n_groups", "n_links")
_PACKED = pa.schema(
    [("slice", pa.int64()), ("stripe", pa.int32()), *((c, pa.list_(pa.int64())) for c in _LISTS), ("digests", pa.list_(pa.string())), *((c, pa.binary()) for c in ("a", "b", "total", "entries", "places", "times"))]
)
_PACKED_DDL = f"slice long, stripe int, {', '.join(f'{c} array<long>' for c in _LISTS)}, digests array<string>, a binary, b binary, total binary, entries binary, places binary, times binary"


class Plain(Units):
    """Byte-level ids in which strings of special tokens are plain text, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path, True)
        self.library.encode_special_tokens = True
        self.added = []
        byte_of = {c: b for b, c in self.shown.items()}
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(byte_of.__getitem__, token))

    def ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole units (leading space included), and how many each has."""
        if self.by_rule:
            return self._by_library(units)
        return _flat([e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)])


class Pieces:
    """Sentence-piece ids and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.library.encode(units, num_threads=1))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())), n


class Aligner:
    """Aligned units, remembered between batches of one worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Plain(a_path), Pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        #: How an id is written inside a group, and at the end of its side of a group.
        self.a_shown = [[f"{i}{c}" for i in range(len(self.a.bytes))] for c in ",|"]
        self.b_shown = [[f"{i}{c}" for i in range(len(self.b.bytes))] for c in ",;"]
        self.known: dict[str, int] = {}
        self.held = 0
        #: Each unit's groups as text, ``;`` after each.
        self.names: list[str] = []
        #: Per unit: sound, ids of A and B, groups; and the first link and number of links.
        self.facts = np.zeros((0, 6), np.int64)
        self.links = np.zeros((0, 2), np.int64)
        self.again = np.zeros(0, bool)

    def places(self, units: list[str]) -> np.ndarray:
        """Where each of these distinct units is remembered."""
        size = sum(map(len, units))
        if self.known and (len(self.known) + len(units) > REMEMBERED or self.held + size > REMEMBERED_BYTES):
            self._forget()
        found = np.fromiter((-1 if i is None else i for i in map(self.known.get, units)), np.int64, len(units))
        self.again[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(self.facts), len(self.facts) + len(new))
            self._learn([units[i] for i in new.tolist()])
        return found

    def _forget(self) -> None:
        """Only units that were met again stay, or none if those alone are too many or too long."""
        stay = np.flatnonzero(self.again)
        units = list(self.known)
        if len(stay) > REMEMBERED // 2 or sum(len(units[i]) for i in stay.tolist()) > REMEMBERED_BYTES // 2:
            stay = stay[:0]
        self.known = {units[i]: k for k, i in enumerate(stay.tolist())}
        self.held = sum(map(len, self.known))
        self.names = [self.names[i] for i in stay.tolist()]
        facts = self.facts[stay]
        self.links = self.links[spread(facts[:, 4], facts[:, 5])]
        facts[:, 4] = np.cumsum(facts[:, 5]) - facts[:, 5]
        self.facts, self.again = facts, np.zeros(len(stay), bool)

    def _learn(self, units: list[str]) -> None:
        spaced = [f" {u}" for u in units]
        (a, a_n), (b, b_n) = self.a.ids_of(spaced), self.b.ids_of(units)
        a, b = a.astype(np.int64), b.astype(np.int64)
        raw = [u.encode() for u in spaced]
        sound = _sound(raw, a, a_n, self.a, self.a_sizes) & _sound(raw, b, b_n, self.b, self.b_sizes)
        a, b = a[np.repeat(sound, a_n)], b[np.repeat(sound, b_n)]
        a_n, b_n = np.where(sound, a_n, 0), np.where(sound, b_n, 0)
        # Sound units have as many bytes on either side, so their ends agree along the whole list.
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_last, b_last = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        groups = _sums(a_last.astype(np.int64), np.concatenate([[0], np.cumsum(a_n)]))
        at = len(self.links) + np.cumsum(groups) - groups
        self.known.update(zip(units, range(len(self.facts), len(self.facts) + len(units)), strict=True))
        self.facts = np.concatenate([self.facts, np.stack([sound, a_n, b_n, groups, at, groups], axis=1)])
        self.links = np.concatenate([self.links, np.stack([a[a_last], b[b_last]], axis=1)])
        self.again = np.concatenate([self.again, np.zeros(len(units), bool)])
        self.held += sum(map(len, units))
        # As text: group by group, its ids of A and then of B.
        order = np.argsort(np.concatenate([np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last]), kind="stable")
        shown = [self.a_shown[last][i] for i, last in zip(a.tolist(), a_last.tolist(), strict=True)]
        shown += [self.b_shown[last][i] for i, last in zip(b.tolist(), b_last.tolist(), strict=True)]
        shown = [shown[i] for i in order.tolist()]
        ends = np.cumsum(a_n + b_n).tolist()
        self.names += ["".join(shown[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]


def _sound(raw: list[bytes], ids: np.ndarray, n: np.ndarray, side: Plain | Pieces, sizes: np.ndarray) -> np.ndarray:
    """Whether the joined token bytes of each unit are the unit's own."""
    of = [side.bytes[i] for i in ids.tolist()]
    edges = np.concatenate([[0], np.cumsum(n)])
    same = _sums(sizes[ids], edges) == np.fromiter(map(len, raw), np.int64, len(raw))
    if same.all() and b"".join(of) == b"".join(raw):
        return same
    return np.array([b"".join(of[lo:hi]) == r for r, lo, hi in zip(raw, edges[:-1].tolist(), edges[1:].tolist(), strict=True)], bool)


def inner_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``split_units``, but a space at either end of a text stays in its first or last unit; empty texts have none."""
    edge = pc.match_substring_regex(texts, pattern="^ | $").to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    special = np.flatnonzero(edge | empty)
    if not len(special):
        return split_units(texts)
    units, n = [], np.zeros(len(texts), np.int64)
    bounds = [-1, *special.tolist(), len(texts)]
    for k, at in enumerate(bounds[:-1]):
        if at >= 0 and not empty[at]:
            text = texts[at].as_py()
            own = _INNER.split(text) if _BESIDE.search(text) or " " in text.strip(" ") else [text]
            units.append(pa.array(own, pa.large_string()))
            n[at] = len(own)
        if bounds[k + 1] > at + 1:
            flat, counts = split_units(texts.slice(at + 1, bounds[k + 1] - at - 1))
            units.append(flat)
            n[at + 1 : bounds[k + 1]] = counts
    return pa.chunked_array(units, pa.large_string()).combine_chunks() if units else pa.array([], pa.large_string()), n


_open: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligner(a_path, b_path)
    return _open[a_path, b_path]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])


def _packed(rows: pa.RecordBatch, number: int, aligner: Aligner, a_size: int) -> Iterator[pa.RecordBatch]:
    """One row with the facts of a slice's documents, and a row for each stripe with their links."""
    flat, n = inner_units(rows.column("text"))
    coded = flat.dictionary_encode()
    at = aligner.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    edges = np.concatenate([[0], np.cumsum(n)])
    facts = aligner.facts[at]
    sound = (_sums(facts[:, 0], edges) == n) & (n > 0)
    sums = [np.where(sound, _sums(facts[:, k], edges), 0) for k in (1, 2, 3)]
    digests, places, names = [], at.tolist(), aligner.names
    for lo, hi, good in zip(edges[:-1].tolist(), edges[1:].tolist(), sound.tolist(), strict=True):
        digests.append(hashlib.sha256("".join([names[i] for i in places[lo:hi]])[:-1].encode()).hexdigest() if good else "")
    columns = {"doc_ids": rows.column("doc_id").to_pylist(), "n_a": sums[0].tolist(), "n_b": sums[1].tolist(), "n_groups": sums[2].tolist(), "n_links": sums[2].tolist()}
    yield pa.RecordBatch.from_pylist([{"slice": number, "digests": digests} | columns], schema=_PACKED)

    doc = np.repeat(np.arange(len(n)), n)
    used = sound[doc]
    facts, doc = facts[used], doc[used]
    links = aligner.links[spread(facts[:, 4], facts[:, 5])]
    keys, times = np.unique((links[:, 1] * a_size + links[:, 0]) << 12 | np.repeat(doc, facts[:, 5]), return_counts=True)
    out = []
    starts = np.flatnonzero(np.diff((keys >> 12) // a_size // STRIPE, prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        pair, place, count = keys[lo:hi] >> 12, keys[lo:hi] & 4095, times[lo:hi]
        # An entry holds up to 255 links; those with more stand several times.
        copies = -(-count // 255)
        pair, place = np.repeat(pair, copies), np.repeat(place, copies)
        last = np.cumsum(copies) - 1
        count, rest = np.full(len(pair), 255), count - 255 * (copies - 1)
        count[last] = rest
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        own = pair[first]
        out.append(
            {
                "slice": number, "stripe": int(own[0] // a_size // STRIPE), "a": (own % a_size).astype("<i4").tobytes(), "b": (own // a_size).astype("<i4").tobytes(),
                "total": np.add.reduceat(count, first).astype("<i8").tobytes(), "entries": np.diff([*first, len(pair)]).astype("<i4").tobytes(),
                "places": place.astype("<u2").tobytes(), "times": count.astype("u1").tobytes(),
            }
        )
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PACKED)


def packed_links(docs: DataFrame, a_path: str, b_path: str, a_size: int) -> DataFrame:
    """Facts of documents and their links, packed by slice and stripe; a slice's number names a task and is final once written."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for rows in slices(batches, ROWS):
            yield from _packed(rows, number, aligner, a_size)
            number += 1

    return text_of(docs).mapInArrow(align, _PACKED_DDL)


def _numbers(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


_COUNTS = "stripe int, a binary, b binary, total binary, best binary"
_COUNTS_SCHEMA = pa.schema([("stripe", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "total", "best"))])


def stripe_counts(packed: DataFrame, a_size: int, parts: int = 1) -> DataFrame:
    """A packed row for each stripe: pairs of ids, how often each is linked, and 1 where that is its B id's highest count.

    ``packed`` has stripe, slice and the binary a, b, total; with ``parts`` > 1 the rows of a stripe are summed in so
    many parts first. A task holds one block of ``STRIPE`` by ``a_size`` counts, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = np.zeros((STRIPE, a_size), np.int64), None

        def close() -> pa.RecordBatch:
            b, a = np.nonzero(block)
            total = block[b, a]
            row = {"stripe": stripe, "a": a.astype("<i4").tobytes(), "b": (b + stripe * STRIPE).astype("<i4").tobytes(), "total": total.astype("<i8").tobytes(), "best": (total == block.max(axis=1)[b]).astype("u1").tobytes()}
            block[b, a] = 0
            return pa.RecordBatch.from_pylist([row], schema=_COUNTS_SCHEMA)

        for batch in batches:
            for k, own in enumerate(batch.column("stripe").to_pylist()):
                if own != stripe and stripe is not None:
                    yield close()
                stripe = own
                a, b, total = (_numbers(batch.column(c)[k], kind) for c, kind in (("a", "<i4"), ("b", "<i4"), ("total", "<i8")))
                np.add.at(block, (b - stripe * STRIPE, a), total)
        if stripe is not None:
            yield close()

    n = partitions(packed.sparkSession)
    rows = packed.select("stripe", "slice", "a", "b", "total")
    if parts > 1:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts))).repartition(n, "stripe", "part").sortWithinPartitions("stripe")
        rows = dealt.select("stripe", "a", "b", "total").mapInArrow(count, _COUNTS)
    return rows.repartition(n, "stripe").sortWithinPartitions("stripe").select("stripe", "a", "b", "total").mapInArrow(count, _COUNTS)


_SCORES = pa.schema([("slice", pa.int64()), ("places", pa.binary()), ("best", pa.binary()), ("total", pa.binary())])


def _scores(packed: DataFrame, counts: DataFrame, a_size: int, parts: int) -> DataFrame:
    """(slice, places, best, total): sums of each document's links within one stripe."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = totals = best = None
        for batch in batches:
            out = []
            for k, number in enumerate(batch.column("slice").to_pylist()):
                a, b = (_numbers(batch.column(c)[k], "<i4").astype(np.int64) for c in ("a", "b"))
                own = b * a_size + a
                if number is None:
                    keys, totals, best = own, _numbers(batch.column("total")[k], "<i8"), _numbers(batch.column("best")[k], "u1").astype(np.int64)
                    continue
                found = np.repeat(np.searchsorted(keys, own), _numbers(batch.column("entries")[k], "<i4"))
                place, times = _numbers(batch.column("places")[k], "<u2"), _numbers(batch.column("times")[k], "u1").astype(np.int64)
                sums = np.zeros((2, int(place.max()) + 1), np.int64)
                np.add.at(sums[0], place, times * best[found])
                np.add.at(sums[1], place, times * totals[found])
                docs = np.flatnonzero(sums[1])
                out.append({"slice": number, "places": docs.astype("<u2").tobytes(), "best": sums[0][docs].astype("<i8").tobytes(), "total": sums[1][docs].astype("<i8").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCORES)

    links = packed.select("stripe", "slice", F.pmod(F.xxhash64("slice"), F.lit(parts)).alias("part"), "a", "b", "total", "entries", "places", "times", F.lit(None).cast("binary").alias("best"))
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("entries", "places", "times")]
    ahead = counts.select("stripe", F.lit(None).cast("long").alias("slice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "a", "b", "total", *nothing, "best")
    met = links.unionByName(ahead).repartition(partitions(packed.sparkSession), "stripe", "part").sortWithinPartitions("stripe", "part", F.col("slice").asc_nulls_first())
    return met.drop("stripe", "part").mapInArrow(score, "slice long, places binary, best binary, total binary")


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _documents(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of documents; the facts of a slice come first, its scores after them."""
    names = [*(c for c in _LISTS if c != "doc_ids"), "n_best", "count_sum"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sums = None

        def close() -> pa.RecordBatch:
            columns = [held["doc_ids"], *(held[c] for c in names[:4]), sums[0], sums[1]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(held["digests"], pa.string())], ["doc_id", *names, "groups_sha256"])

        for batch in batches:
            facts_of = batch.column("n_a").is_valid().to_pylist()
            for k, fact in enumerate(facts_of):
                if fact:
                    if held:
                        yield close()
                    held = {c: batch.column(c)[k].as_py() for c in (*_LISTS, "digests")}
                    sums = np.zeros((2, len(held["n_a"])), np.int64)
                else:
                    place = _numbers(batch.column("places")[k], "<u2")
                    for row, c in enumerate(("best", "total")):
                        sums[row, place] += _numbers(batch.column(c)[k], "<i8")
        if held:
            yield close()

    met = facts.select("slice", *_LISTS, "digests").unionByName(scores, allowMissingColumns=True)
    dealt = met.repartition(partitions(facts.sparkSession), "slice").sortWithinPartitions("slice", F.col("n_a").isNull())
    return dealt.drop("slice").mapInArrow(gather, _DOCS)


class Alignment(NamedTuple):
    #: One row per document, see ``_DOCS``.
    documents: DataFrame
    #: (b, a, n, best): each linked pair of ids, its links, and whether no pair of its B id has more.
    pairs: DataFrame


def _pairs(counts: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, n, best = (_numbers(batch.column(c)[k], kind) for c, kind in (("a", "<i4"), ("b", "<i4"), ("total", "<i8"), ("best", "u1")))
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.array(n), pa.array(best == 1)], ["b", "a", "n", "best"])

    return counts.select("a", "b", "total", "best").mapInArrow(each, "b int, a int, n long, best boolean")


def align(docs: DataFrame, a_path: str, b_path: str) -> Alignment:
    """Aligns the tokens of the byte-level file ``a_path`` and the sentence-piece model ``b_path`` over whole texts."""
    spark = docs.sparkSession
    a, b = Plain(a_path), Pieces(b_path)
    a_size, stripes = len(a.bytes), -(-len(b.bytes) // STRIPE)
    parts = max(1, partitions(spark) // stripes)
    with scratch(spark) as keep:
        packed = keep(packed_links(docs, a_path, b_path, a_size), "aligned-links")
        links = packed.where("stripe is not null")
        counts = keep.result(stripe_counts(links, a_size, parts), "aligned-counts")
        scores = keep(_scores(links, counts, a_size, parts), "aligned-scores")
        found = keep.result(_documents(packed.where("stripe is null"), scores), "aligned-documents")
    return Alignment(found, _pairs(counts))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and scores of every whole text of ``documents``."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents
