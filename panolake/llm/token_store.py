"""Token-id output: canonical length-limited Huffman coding of ids from global counts.

``write_ids`` tokenizes every whole text, counts all ids over the corpus, gives each id that occurs a
canonical code of at most ``max_bits`` bits and writes blocks in ascending doc_id order.
``read_ids`` decodes them with one table of 2^max_bits entries. Each block holds whole documents and can
be decoded on its own; inside it a bit offset every ``EVERY`` ids lets the decoder run many lanes at once.

Defined results: null text is an empty text (its end id alone); rows that share a doc_id stay separate
rows in the order of their ids; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import partitions, shared_dir, table, text_of, written
from panolake.llm.units import slices, units_of

#: Ids between two bit-offset checkpoints, and the ids after which a block is closed.
EVERY, BLOCK_IDS = 512, 1 << 17
BLOCKS = "shard int, first long, doc_ids array<long>, lengths array<int>, bits array<long>, payload binary"


@dataclass(frozen=True)
class Code:
    """A canonical code: ``lengths[id]`` bits (0: the id does not occur); codes follow from the lengths."""

    lengths: np.ndarray
    max_bits: int

    def codes(self) -> np.ndarray:
        order = self._order()
        bits = self.lengths[order].astype(np.int64)
        steps = np.left_shift(1, self.max_bits - bits)
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[order] = (np.cumsum(steps) - steps) >> (self.max_bits - bits)
        return codes

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each string of max_bits bits, the id that begins it and the length of its code."""
        order = self._order()
        repeats = np.left_shift(1, self.max_bits - self.lengths[order].astype(np.int64))
        ids = np.repeat(order, repeats)
        ids = np.pad(ids, (0, (1 << self.max_bits) - len(ids)))
        return ids.astype(np.uint32), self.lengths[ids].astype(np.uint8)

    def _order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.lexsort((used, self.lengths[used]))]


def limited_code(counts: dict[int, int], max_bits: int = 18) -> Code:
    """Optimal code lengths of at most ``max_bits`` bits, by merging packages of the cheapest pairs level by level."""
    ids = np.array(sorted(counts), np.int64)
    n = len(ids)
    max_bits = max(max_bits, n.bit_length())
    lengths = np.zeros(int(ids.max()) + 1 if n else 1, np.uint8)
    if n == 1:
        lengths[ids] = 1
    if n < 2:
        return Code(lengths, max_bits)
    weights = np.array([counts[int(i)] for i in ids], np.float64)
    order = np.argsort(weights, kind="stable")
    single = weights[order]
    levels: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([single, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank)
        ranked = merged[rank]
        packages = ranked[: len(ranked) // 2 * 2].reshape(-1, 2).sum(1)
    taken = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for rank in reversed(levels):
        chosen = rank[:taken]
        own = chosen < n
        bits[order[chosen[own]]] += 1
        taken = 2 * int((~own).sum())
    lengths[ids] = bits
    return Code(lengths, max_bits)


def id_type(path: str) -> str:
    """Unsigned 16 bits where all ids of a tokenizer file fit, else 32."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def token_rows(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, ids (little-endian of type ``kind``, the end id last) of every whole text; last a row of a task's ``counts`` of each id alone."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(path, True)
        width = np.dtype(kind).itemsize
        total = np.zeros(0, np.int64)
        for rows in slices(batches):
            ids, n = units.encode(rows.column("text"))
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id).astype(kind)
            total = _sum(total, np.bincount(ids))
            edges = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
            held = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), held, pa.nulls(len(n), pa.binary())], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()])], ["doc_id", "ids", "counts"])

    return text_of(docs).mapInArrow(encode, "doc_id long, ids binary, counts binary")


def _sum(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sums of counts, which may be of different length."""
    if len(more) > len(total):
        total, more = more.copy(), total
    total[: len(more)] += more
    return total


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in the whole table; at most as many entries as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own in batch.column("counts").to_pylist():
                total = _sum(total, np.frombuffer(own, "<i8"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of ids, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) for x in rows], np.int64) // np.dtype(kind).itemsize


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` end to end, and the bit at which each id begins."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    begins = ends - bits
    wide = codes[ids] << (64 - (begins & 31) - bits).astype(np.uint64)
    word = begins >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(ends[-1] >> 5) + 3 if len(ids) else 2, np.uint32)
    out[word[first]] |= np.bitwise_or.reduceat((wide >> np.uint64(32)).astype(np.uint32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(wide.astype(np.uint32), first)
    return out.astype(">u4").tobytes(), begins


def encode_blocks(tokens: DataFrame, code: Code, kind: str) -> DataFrame:
    """Blocks of whole documents in ascending doc_id; ``first`` counts the shard's ids before the block."""
    spark = tokens.sparkSession
    held = spark.sparkContext.broadcast((code.lengths, code.codes()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths_of, codes_of = held.value
        shard, first, held_ids = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal first, held_ids
            payload, begins = pack_bits(np.concatenate(parts), lengths_of, codes_of)
            row = {"shard": shard, "first": first, "doc_ids": docs[:], "lengths": sizes[:], "bits": begins[::EVERY].tolist(), "payload": payload}
            first, held_ids = first + held_ids, 0
            docs.clear(), sizes.clear(), parts.clear()
            schema = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64())), ("payload", pa.binary())])
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            flat, n = _flat(batch.column("ids"), kind)
            edges = np.concatenate([[0], np.cumsum(n)])
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                docs.append(doc)
                sizes.append(int(n[i]))
                parts.append(flat[edges[i] : edges[i + 1]])
                held_ids += sizes[-1]
                if held_ids >= BLOCK_IDS:
                    yield block()
        if docs:
            yield block()

    ranged = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return ranged.mapInArrow(encode, BLOCKS)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, to: str | None = None, max_bits: int = 18) -> tuple[str, Code]:
    """Writes the store to the folder ``to`` (the shared one if None); returns where, and the code."""
    kind = id_type(tokenizer)
    tokens = written(token_rows(docs, tokenizer, end_id, kind), "token-ids")
    code = limited_code(id_counts(tokens), max_bits)
    to = to or f"{shared_dir(docs.sparkSession)}/tables/token-store-{uuid.uuid4().hex}"
    encode_blocks(tokens.where("ids is not null").select("doc_id", "ids"), code, kind).write.option("compression", "none").parquet(f"{to}/blocks")
    spark = docs.sparkSession
    spark.createDataFrame([(code.max_bits, bytearray(code.lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{to}/code")
    return to, code


def unpack_bits(blocks: list[tuple[np.ndarray, np.ndarray, int]], ids_of: np.ndarray, bits_of: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Decodes blocks (payload bytes, bit offsets, number of ids) together: one lane per checkpoint."""
    base = np.cumsum([0, *(len(p) for p, _, _ in blocks)])
    data = np.concatenate([*(p for p, _, _ in blocks), np.zeros(8, np.uint8)]).astype(np.uint64)
    window = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
    at = np.concatenate([offsets.astype(np.int64) + 8 * b for (_, offsets, _), b in zip(blocks, base, strict=False)])
    left = np.concatenate([np.minimum(EVERY, n - EVERY * np.arange(len(o))) for _, o, n in blocks])
    out = np.zeros((len(at), EVERY), np.uint32)
    mask = np.uint64((1 << max_bits) - 1)
    by_length = np.argsort(-left, kind="stable")
    at, out_rows, left = at[by_length], by_length, left[by_length]
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))
        here = at[:live]
        peek = (window[here >> 3] >> (40 - max_bits - (here & 7)).astype(np.uint64)) & mask
        out[out_rows[:live], step] = ids_of[peek]
        at[:live] += bits_of[peek]
    found, lane = [], 0
    for _, offsets, n in blocks:
        found.append(out[lane : lane + len(offsets)].reshape(-1)[:n])
        lane += len(offsets)
    return found


def read_ids(spark: SparkSession, at: str, rows_at_once: int = 8) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: decoded from the store's blocks."""
    stored = spark.read.schema("max_bits int, lengths binary").parquet(f"{at}/code").first()
    code = Code(np.frombuffer(bytes(stored["lengths"]), np.uint8), stored["max_bits"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{at}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, so_far = {}, 0
    for r in sorted(totals.collect(), key=lambda r: r["shard"]):
        before[r["shard"]] = so_far
        so_far += r["n"]
    held = spark.sparkContext.broadcast((code.table(), before))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids_of, bits_of), shard_start = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                rows = batch.slice(k, rows_at_once).to_pylist()
                found = unpack_bits([(np.frombuffer(r["payload"], np.uint8), np.array(r["bits"]), sum(r["lengths"])) for r in rows], ids_of, bits_of, code.max_bits)
                for r, ids in zip(rows, found, strict=True):
                    n = np.array(r["lengths"], np.int64)
                    edges = np.concatenate([[0], np.cumsum(n)])
                    held_ids = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    starts = shard_start[r["shard"]] + r["first"] + edges[:-1]
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), held_ids], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, ids binary")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of the store over the whole of ``documents``."""
    import public_tokenizers

    at, _ = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    ids = read_ids(spark, at)
    return ids.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
