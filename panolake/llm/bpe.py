"""Byte-level BPE by ranks, folded by Spark over distinct words.

A word here is a piece of the split pattern. ``fold_words`` is one Spark expression: a word becomes an array
of single bytes, each as its id, and an ``aggregate`` merges the leftmost pair of the least rank until no
pair has one. The ranks are a literal: of every two tokens whose bytes together are a token, its rank, in
an array of small maps, one per hash bucket, so that a look-up is one step.

Texts are cut once, in groups of ``GROUP_BYTES``, into distinct words and codes that say which stands where. From
the groups words are counted over the whole corpus; the ``KEPT`` most frequent of at most ``SHORT`` bytes are
folded once and go to all tasks (a bound in rows and bytes that does not grow). Each other distinct word of a
group is folded once, by the same expression, in the row of its group. Decoding concatenates the bytes that
ids stand for.

Defined results: null and empty texts have no ids; repeated rows give repeated rows; words of over
``LONGEST`` bytes, for which a fold's copying grows too much, are merged with a heap in the task. A text
longer than a group is a group of its own.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import scratch, table, text_of, written
from panolake.llm.units import glue, slices, split_units, spread

KEPT, SHORT, LONGEST, BUCKETS, TIMES = 400_000, 32, 1000, 1 << 15, 31
#: Bytes of text cut at once, and of texts whose words are folded together.
SLICE_BYTES, GROUP_BYTES = 2 << 20, 4 << 20
NO_PAIR = (1 << 20) - 1
#: Fixed value: white space as Unicode has it, for a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def spelled_out(pattern: str) -> str:
    """The split pattern with white space spelled out, as engines differ on it."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Ranks:
    """A rank table, and the Spark expressions over it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    buckets[(left * TIMES + right) % BUCKETS][str(left << 20 | right)] = rank
        self.pairs = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>").cast("array<map<bigint,int>>")
        self.single = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")

    @staticmethod
    def fold_piece(piece: Column, literals: Column) -> Column:
        """Ids of one piece: bytes, then the leftmost pair of the least rank merged, again and again.

        Each part is one number: rank of its pair with the next part, where it begins, its id.
        The least number is then the leftmost pair of the least rank.
        """
        none, low, own = F.lit(NO_PAIR << 36), F.lit((1 << 36) - 1), F.lit((1 << 20) - 1)

        def pair(left: Column, right: Column) -> Column:
            """The rank of two ids together, where the number has it."""
            bucket = F.pmod(left * F.lit(TIMES) + right, F.lit(BUCKETS)).cast("int")
            return F.coalesce(F.shiftleft(F.get(literals["pairs"], bucket)[F.shiftleft(left, 20).bitwiseOR(right)].cast("long"), 36), none)

        def step(parts: Column, _: Column) -> Column:
            def merged(at: Column, least: Column) -> Column:
                token, before = F.shiftright(least, 36), F.get(parts, at - 2)
                one = pair(token, F.get(parts, at + 1).bitwiseAND(own)).bitwiseOR(least.bitwiseAND(F.lit(((1 << 16) - 1) << 20))).bitwiseOR(token)
                both = F.when(at > 1, F.array(pair(before.bitwiseAND(own), token).bitwiseOR(before.bitwiseAND(low)), one)).otherwise(F.array(one))
                return F.concat(F.slice(parts, 1, F.greatest(at - 2, F.lit(0))), both, F.slice(parts, at + 2, F.size(parts)))

            def chosen(least: Column) -> Column:
                place = F.array(F.array_position(parts, least).cast("int"))
                return F.when(least >= none, parts).otherwise(F.get(F.transform(place, lambda at: merged(at, least)), 0))

            return F.get(F.transform(F.array(F.array_min(parts)), chosen), 0)

        letters = F.split(F.decode(F.encode(piece, "utf-8"), "iso-8859-1"), "")
        ids = F.transform(letters, lambda x: F.get(literals["single"], F.ascii(x)))
        start = F.get(F.transform(F.array(ids), lambda ids: F.transform(ids, lambda x, i: pair(x, F.get(ids, i + 1)).bitwiseOR(F.shiftleft(i.cast("long"), 20)).bitwiseOR(x))), 0)
        return F.aggregate(F.slice(letters, 2, F.size(letters)), start, step, lambda parts: F.transform(parts, lambda x: x.bitwiseAND(own).cast("int")))

    def fold_words(self, words: Column, longest: int = LONGEST) -> Column:
        """Ids of each word of an array; null for words of over ``longest`` bytes. The literal stands in the plan once."""
        every = lambda literals: F.transform(words, lambda w: F.when(F.octet_length(w) <= longest, self.fold_piece(w, literals)))
        return F.get(F.transform(F.array(F.struct(self.pairs.alias("pairs"), self.single.alias("single"))), every), 0)


def merged_by_heap(word: str, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for very long words: pairs in a heap by rank and place."""
    raw = word.encode()
    tokens = [raw[i : i + 1] for i in range(len(raw))]
    after, before, gone = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1)), [False] * len(raw)
    heap = [(r, i, tokens[i] + tokens[i + 1]) for i in range(len(raw) - 1) if (r := ranks.get(tokens[i] + tokens[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= len(raw) or tokens[i] + tokens[j] != pair:
            continue
        tokens[i], gone[j], after[i] = pair, True, after[j]
        if after[j] < len(raw):
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(raw) and (r := ranks.get(tokens[a] + tokens[after[a]])) is not None:
                heapq.heappush(heap, (r, a, tokens[a] + tokens[after[a]]))
    return [ranks[t] for t, dead in zip(tokens, gone, strict=True) if not dead]


def coded_words(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, which of them stand where, and how many each text has.

    Texts are cut between inner single spaces first, where no word reaches across; only distinct parts meet
    the pattern.
    """
    units, per_text = split_units(texts)
    first = np.zeros(len(units), bool)
    first[(np.cumsum(per_text) - per_text)[per_text > 0]] = True
    coded = glue(units, first).dictionary_encode()
    cut = regex.compile(spelled_out(pattern)).findall
    words: list[str] = []
    sizes = np.ones(len(coded.dictionary), np.int64)
    for i, unit in enumerate(coded.dictionary.to_pylist()):
        if (unit[1:] if unit[:1] == " " else unit).isalpha():
            words.append(unit)
        else:
            found = cut(unit)
            sizes[i] = len(found)
            words += found
    distinct = pa.array(words, pa.large_string()).dictionary_encode()
    starts, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
    counts = sizes[index]
    at = distinct.indices.to_numpy()[spread(starts[index], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
    return distinct.dictionary, at, np.diff(ends)


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """word: at most ``most`` words, those above a count that a histogram in eighths of powers of two gives."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = (sizes[0][0] + 1 if sizes else 0), 0
    for at, size in sizes:
        total += size
        if total > most:
            break
        least = at
    return counts.where(step >= least).select("word")


GROUPS = "doc_ids array<long>, lengths array<int>, codes binary, words array<string>, counts array<int>"
PARTS = "doc_ids array<long>, lengths array<int>, codes binary, of binary, words array<string>, long array<string>"


def grouped(docs: DataFrame, pattern: str) -> DataFrame:
    """Texts in groups: doc_ids, how many words each text has, the words' codes, the distinct words and their counts."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(GROUPS.split(", "), kinds, strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        lengths, codes = [], []
        own: dict[str, int] = {}
        size = 0

        def group() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            counts = np.bincount(flat, minlength=len(own))
            order = np.argsort(-counts, kind="stable")  # small codes are common, which packs well
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            words = pa.array(own, pa.string()).take(pa.array(order))
            row = [[doc_ids[:]], [np.concatenate(lengths)], [place[flat].tobytes()], None, [counts[order]]]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words) if x is None else pa.array(x, f.type) for x, f in zip(row, schema, strict=True)]
            doc_ids.clear(), lengths.clear(), codes.clear(), own.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for rows in slices(batches, 5000, SLICE_BYTES):
            more = pc.sum(pc.binary_length(rows.column("text"))).as_py()
            if doc_ids and size + more > GROUP_BYTES:
                yield group()
                size = 0
            words, index, per_text = coded_words(rows.column("text"), pattern)
            of = np.array([own.setdefault(w, len(own)) for w in words.to_pylist()], np.int32)
            codes.append(of[index])
            lengths.append(per_text.astype(np.int32))
            doc_ids += rows.column("doc_id").to_pylist()
            size += more
        if doc_ids:
            yield group()

    return docs.mapInArrow(cut, GROUPS)


def word_counts(groups: DataFrame) -> DataFrame:
    """word, n: all words of all texts."""
    one = groups.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return one.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))


def told_apart(groups: DataFrame, known: pa.Array) -> DataFrame:
    """The groups with ``of`` (for each word its place in ``known``, or counting down from -1 one in ``words``).

    Words of over ``LONGEST`` bytes are null in ``words`` and stand, in order, in ``long``.
    """
    held = groups.sparkSession.sparkContext.broadcast(known)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                words = row.column("words").flatten()
                of = pc.index_in(words, value_set=held.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                new = np.flatnonzero(of < 0)
                of[new] = -1 - np.arange(len(new), dtype=np.int32)
                words = words.take(pa.array(new))
                too_long = pc.greater(pc.binary_length(words), LONGEST)
                short, long = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pc.if_else(too_long, pa.scalar(None, pa.string()), words), words.filter(too_long)))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("doc_ids", "lengths", "codes")), pa.array([of.tobytes()], pa.binary()), short, long], [c.split()[0] for c in PARTS.split(", ")])

    return groups.select("doc_ids", "lengths", "codes", "words").mapInArrow(look_up, PARTS)


DECODED = "doc_id long, ids binary, bytes binary"


class Decoder:
    """Adds to Arrow batches of ids the bytes that they stand for: the binary pieces of the ids, one after another."""

    def __init__(self, spark: SparkSession, ranks: Ranks):
        tokens = [b""] * (max(ranks.ranks.values()) + 1)
        for token, rank in ranks.ranks.items():
            tokens[rank] = token
        self.held = spark.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int64)))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, lengths = self.held.value
        starts = np.cumsum(lengths) - lengths
        for rows in slices(batches, 500, SLICE_BYTES, "ids"):
            ids = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("ids")]
            flat = np.concatenate(ids)
            counts = lengths[flat]
            ends = np.concatenate([[0], np.cumsum(counts)])
            edges = ends[np.concatenate([[0], np.cumsum(list(map(len, ids)))])]
            held_bytes = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[spread(starts[flat], counts)])])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("ids"), held_bytes], ["doc_id", "ids", "bytes"])


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """doc_id, ids, bytes of every row of ids."""
    return encoded.select("doc_id", "ids").mapInArrow(Decoder(encoded.sparkSession, ranks), DECODED)


def encode(docs: DataFrame, ranks: Ranks, kept: int = KEPT, then: Decoder | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text; ``then`` decodes them in the same tasks."""
    spark = docs.sparkSession
    groups = written(grouped(text_of(docs), ranks.pattern), "bpe-groups")
    with scratch(spark) as keep:
        counts = keep(word_counts(groups).where(F.octet_length("word") <= SHORT), "word-counts")
        folded = frequent_words(counts, kept).repartition(spark.sparkContext.defaultParallelism)
        folded = folded.select("word", F.get(ranks.fold_words(F.array("word")), 0).alias("ids")).toArrow()  # at most `kept` words of SHORT bytes
    known, ids = folded["word"].combine_chunks().cast(pa.string()), folded["ids"].combine_chunks()
    held = spark.sparkContext.broadcast((ids.flatten().to_numpy().astype(np.uint32), pc.list_value_length(ids).to_numpy().astype(np.int64)))
    by_rank = spark.sparkContext.broadcast(ranks.ranks)
    del folded, ids

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_ids, known_lengths = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                words = row.column("folded").flatten()
                if long := row.column("long")[0].as_py():
                    given = iter([merged_by_heap(w, by_rank.value) for w in long])
                    words = pa.array([next(given) if w is None else w for w in words.to_pylist()], pa.list_(pa.int32()))
                own, own_lengths = words.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.diff(words.offsets.to_numpy()).astype(np.int64)
                # Own words stand last first, so that code -1 is the last place of all.
                lengths = np.concatenate([known_lengths, own_lengths[::-1]])
                starts = np.cumsum(known_lengths) - known_lengths
                starts = np.concatenate([starts, (len(known_ids) + np.cumsum(own_lengths) - own_lengths)[::-1]])
                flat = np.concatenate([known_ids, own])
                of, codes = (np.frombuffer(row.column(c)[0].as_buffer(), "<i4") for c in ("of", "codes"))
                per_text = row.column("lengths").flatten().to_numpy()
                doc_ids = row.column("doc_ids").flatten()
                edges = np.concatenate([[0], np.cumsum(per_text)])
                for a in range(0, len(per_text), 500):
                    part = of[codes[edges[a] : edges[min(a + 500, len(per_text))]]]
                    counts = lengths[part]
                    ends = np.concatenate([[0], np.cumsum(counts)])[edges[a : a + 501] - edges[a]]
                    found = flat[spread(starts[part], counts)].astype("<u4", copy=False)
                    held_ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(found)])
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, 500), held_ids], ["doc_id", "ids"])

    groups = told_apart(groups, known)
    groups = groups.select("doc_ids", "lengths", "codes", "of", ranks.fold_words(F.col("words")).alias("folded"), "long")
    if then is None:
        return groups.mapInArrow(put_together, "doc_id long, ids binary")
    return groups.mapInArrow(lambda batches: then(put_together(batches)), DECODED)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of the whole of ``documents``, as digests."""
    import public_tokenizers

    ranks = Ranks(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    both = encode(table(spark, sf_dir, "documents"), ranks, then=Decoder(spark, ranks))
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
