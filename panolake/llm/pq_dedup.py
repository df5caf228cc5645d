"""Embedding near-dedup by product quantisation: pairs of equal label whose cosine reaches a threshold.

Unit vectors lie in coarse inverted lists (nearest of the fitted centroids) and are coded there: each subspace
of the residual by its nearest code word, with the length of what the code leaves over. A vector probes every
list across whose border a partner may lie: of two vectors at most ``r`` apart in different lists, one is at
most r/2 from the border between the two centroids, so that probing all borders within r/2 loses nothing.
Within a list, table look-ups give the distance from an exact vector to each coded one; only where it is within
``r`` and the code's own error is the cosine worked out on the vectors. So no link is lost and none is false.

Scale: equal vectors are one row, with their number. Vectors within r/2 of their centroid are all linked with
each other, so a dense list's core is counted and never paired. Lists that hold more than a partition's share
are dealt to blocks, and only what is not core meets all blocks. Links leave a task as sums and as edges
enough to connect what is linked, never as pairs.

Fit: centroids and code words come from about ``SAMPLE`` distinct vectors, those with the smallest hashes; every
vector is indexed. ``LISTS`` bounds the centroids. Both bounds cost time, never links.

Defined results: vectors that are null, empty, zero, without a label, or hold a null or non-finite component
link with nothing; only vectors of equal length are compared; repeated rows are vectors of their own and link;
rows with a null vec_id link and name no class unless all of it is null; an empty table gives no rows; extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import partitions, scratch, table
from panolake.operators.components import connected_components

#: Distinct vectors that the fit sees, more or less, and the most centroids that it makes.
SAMPLE, LISTS = 65_536, 4096
SUBSPACES, WORDS = 8, 256
#: Residents that a block holds at least before a list is split.
BLOCK = 4096
#: Distances worked out at once.
AT_ONCE = 1 << 21
_SLACK = 1e-9


class Fit(NamedTuple):
    """Centroids of the inverted lists and code words of each subspace, for vectors of one length."""

    centroids: np.ndarray
    words: list[np.ndarray]
    bounds: np.ndarray


def _means(points: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        own = _nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    step = max(1, AT_ONCE // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, np.int64), *((points[k : k + step] @ centroids.T - half).argmax(1) for k in range(0, len(points), step))])


def _apart(points: np.ndarray, least: float) -> np.ndarray:
    """Points in order, without those closer than ``least`` to an earlier one that stays."""
    kept = points[:1]
    for p in points[1:]:
        if ((kept - p) ** 2).sum(1).min() > least**2:
            kept = np.vstack([kept, p])
    return kept


def fit(sample: np.ndarray, rows: float, radius: float, seed: int = 7) -> Fit:
    """A fit to unit vectors; ``rows`` is how many vectors it stands for. Centroids stay ``radius`` apart, so a dense ball is one list."""
    size = sample.shape[1]
    bounds = np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int)
    if len(sample) == 0:
        return Fit(np.zeros((1, size)), [np.zeros((1, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)], bounds)
    rng = np.random.default_rng(seed)
    wanted = int(np.clip(2 ** np.floor(np.log2(max(1.0, rows**0.5 / 4))), 1, LISTS))
    some = sample[rng.permutation(len(sample))]
    centroids = _apart(some[: 4 * wanted], radius)[:wanted]
    centroids = _means(sample, _apart(_means(sample, centroids, 8), radius), 2)
    left = (some - centroids[_nearest(some, centroids)])[: 64 * WORDS]
    words = [_means(left[:, a:b], np.unique(left[:WORDS, a:b], axis=0), 5) for a, b in zip(bounds, bounds[1:], strict=False)]
    return Fit(centroids, words, bounds)


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, by way of their largest component, so that no square overflows."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows_of(cells: pa.Array, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(-1, size)


_PLACED = "rep long, label string, size int, n long, vector binary, list int, rho double, error double, code binary, probes array<int>"


def _placed(reps: DataFrame, fits, kind: str, radius: float) -> DataFrame:
    """Each distinct vector with its list, distance from the centroid, code, the code's error, and the lists it probes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                of = fits.value.get(size) or fit(np.zeros((0, size)), 0, radius)
                step = max(1, AT_ONCE // max(len(of.centroids), size))
                for k in range(0, part.num_rows, step):
                    yield _place(part.slice(k, step), of, kind, size, radius)

    return reps.select("rep", "label", "size", "n", "vector").mapInArrow(place, _PLACED)


def _place(part: pa.RecordBatch, of: Fit, kind: str, size: int, radius: float) -> pa.RecordBatch:
    x = unit(_rows_of(part.column("vector"), kind, size))
    c, squares = of.centroids, (of.centroids**2).sum(1)
    far = squares - 2 * x @ c.T
    own = far.argmin(1)
    near = far[np.arange(len(x)), own]
    between = np.sqrt(np.maximum(0, squares[own][:, None] + squares - 2 * c[own] @ c.T))
    probes = (far - near[:, None] <= between * radius + _SLACK) & (between > 0)
    probes[np.arange(len(x)), own] = False
    left = x - c[own]
    code = np.stack([_nearest(left[:, a:b], w) for w, a, b in zip(of.words, of.bounds, of.bounds[1:], strict=False)], axis=1)
    told = np.concatenate([w[code[:, s]] for s, w in enumerate(of.words)], axis=1)
    ends = np.concatenate([[0], np.cumsum(probes.sum(1))]).astype(np.int32)
    codes = code.astype(np.uint8)
    columns = [*(part.column(k) for k in ("rep", "label", "size", "n", "vector")), pa.array(own.astype(np.int32)), pa.array(np.sqrt((left**2).sum(1)))]
    columns += [pa.array(np.sqrt(((left - told) ** 2).sum(1))), pa.array([row.tobytes() for row in codes], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(probes)[1].astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, ["rep", "label", "size", "n", "vector", "list", "rho", "error", "code", "probes"])


class Residents:
    """The coded vectors of one block of a list, and what their links add up to."""

    def __init__(self, rows: pa.Table, of: Fit, kind: str, size: int, home: int, threshold: float, radius: float):
        self.of, self.kind, self.size, self.home, self.threshold, self.radius = of, kind, size, home, threshold, radius
        self.rep, self.n, self.error = (rows.column(c).to_numpy() for c in ("rep", "n", "error"))
        self.x = unit(_rows_of(rows.column("vector").combine_chunks(), kind, size))
        self.code = _rows_of(rows.column("code").combine_chunks(), "u1", len(of.words))
        self.core = rows.column("rho").to_numpy() <= radius / 2 - _SLACK
        probes = rows.column("probes").combine_chunks()
        lists = len(of.centroids)
        self.probed = np.sort(np.repeat(np.arange(len(self.rep)), np.diff(probes.offsets.to_numpy())) * lists + probes.flatten().to_numpy()) if len(self.rep) else np.zeros(0, np.int64)
        self.links, self.root = np.zeros(len(self.rep), np.int64), self.rep.copy()
        self.edges: list[tuple[int, int]] = []
        core_n, center = (rows.column(c).to_pylist() for c in ("core_n", "core"))
        if self.core.any():
            first = int(self.rep[self.core].min())
            every = core_n[0] if core_n[0] is not None else int(self.n[self.core].sum())
            self.links[self.core] = every - self.n[self.core]
            self.edges += [(first, r) for r in self.rep[self.core].tolist() if r != first]
            self.root[self.core] = first
            if center[0] is not None and center[0] != first:
                self.edges.append((center[0], first))

    def meet(self, movers: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Movers that are linked here, and with how many vectors."""
        rep, n, own = (movers.column(c).to_numpy() for c in ("rep", "n", "list"))
        x = unit(_rows_of(movers.column("vector"), self.kind, self.size))
        counts = np.zeros(len(rep), np.int64)
        step = max(1, AT_ONCE // max(1, len(self.rep)))
        for k in range(0, len(rep), step):
            i, j = self._linked(rep[k : k + step], own[k : k + step], x[k : k + step])
            np.add.at(counts, i + k, self.n[j])
            np.add.at(self.links, j, n[i + k])
            for lo, hi in pairwise([*np.flatnonzero(np.diff(i, prepend=-1)).tolist(), len(i)]):
                me, roots = int(rep[i[lo] + k]), np.unique(self.root[j[lo:hi]])
                self.edges += [(me, r) for r in roots.tolist() if r != me]
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
        return rep[counts > 0], counts[counts > 0]

    def _linked(self, rep: np.ndarray, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = x - self.of.centroids[self.home]
        told = np.zeros((len(x), len(self.rep)), np.float32)
        for s, words in enumerate(self.of.words):
            part = left[:, self.of.bounds[s] : self.of.bounds[s + 1]]
            looked_up = ((part**2).sum(1)[:, None] + (words**2).sum(1) - 2 * part @ words.T).astype(np.float32)
            told += looked_up[:, self.code[:, s]]
        near = told <= ((self.radius + self.error) ** 2 + 1e-4).astype(np.float32)
        i, j = np.nonzero(near)
        here = own[i] == self.home
        once = ~here | (rep[i] != self.rep[j]) & (self.core[j] | (rep[i] < self.rep[j]))
        i, j = i[once], j[once]
        if len(i) * 16 > near.size:
            cosine = (x @ self.x.T)[i, j]
        else:
            cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[k : k + 65536]], self.x[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
        i, j = i[cosine >= self.threshold], j[cosine >= self.threshold]
        # A pair of two lists that probe each other counts in the list of the larger number.
        key = j * len(self.of.centroids) + own[i]
        at = np.searchsorted(self.probed, key)
        mutual = (at < len(self.probed)) & (self.probed[np.minimum(at, len(self.probed) - 1)] == key) if len(self.probed) else np.zeros(len(i), bool)
        once = (own[i] == self.home) | ~mutual | (own[i] < self.home)
        return i[once], j[once]


_FOUND = pa.schema([(c, pa.int64()) for c in ("rep", "links", "a", "b")])


def _found(rep: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    n, e = len(rep), np.array(edges, np.int64).reshape(-1, 2)
    columns = [np.concatenate([rep, np.zeros(len(e), np.int64)]), np.concatenate([links, np.zeros(len(e), np.int64)]), np.concatenate([np.zeros(n, np.int64), e[:, 0]]), np.concatenate([np.zeros(n, np.int64), e[:, 1]])]
    is_edge = np.arange(n + len(e)) >= n
    return pa.RecordBatch.from_arrays([pa.array(c, mask=is_edge if k < 2 else ~is_edge) for k, c in enumerate(columns)], schema=_FOUND)


def _met(placed: DataFrame, fits, kind: str, threshold: float, radius: float, rows: int) -> DataFrame:
    """(rep, links) sums and (a, b) edges of all lists."""
    n = partitions(placed.sparkSession)
    share = max(BLOCK, -(-rows // n))
    core = F.col("rho") <= radius / 2 - _SLACK
    per_list = placed.groupBy("label", "size", "list").agg(F.count(F.lit(1)).alias("held"), F.sum(F.when(core, F.col("n"))).alias("core_n"), F.min(F.when(core, F.col("rep"))).alias("core"))
    # Fewer lists than there are partitions hold more than a partition's share.
    large = F.broadcast(per_list.where(F.col("held") > share).withColumn("blocks", F.ceil(F.col("held") / share).cast("int")).drop("held"))
    slot = F.concat_ws("/", "size", "target", "block", "label").alias("slot")
    facts = ["rep", "n", "vector", "size", "list"]

    residents = placed.withColumn("target", F.col("list")).join(large, ["label", "size", "list"], "left")
    residents = residents.withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))))
    residents = residents.select(slot, F.lit(0).alias("kind"), "target", *facts, "rho", "error", "code", "probes", "core_n", "core")
    movers = placed.withColumn("target", F.explode(F.when(core, F.col("probes")).otherwise(F.array_append("probes", F.col("list")))))
    movers = movers.join(large.select("label", "size", F.col("list").alias("target"), "blocks"), ["label", "size", "target"], "left")
    movers = movers.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    movers = movers.select(slot, F.lit(1).alias("kind"), "target", *facts)
    dealt = residents.unionByName(movers, allowMissingColumns=True).repartition(n, "slot").sortWithinPartitions("slot", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, waiting, here, edge = None, [], None, ("", 0)

        def settle() -> Residents | None:
            if not waiting:
                return None
            size, home = edge
            of = fits.value.get(size) or fit(np.zeros((0, size)), 0, radius)
            return Residents(pa.Table.from_batches(waiting), of, kind, size, home, threshold, radius)

        def close() -> pa.RecordBatch:
            used = here.links > 0
            return _found(here.rep[used], here.links[used], here.edges)

        for batch in batches:
            slots = np.array(batch.column("slot").to_pylist(), object)
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (slots[1:] != slots[:-1]) | (kinds[1:] != kinds[:-1])])) if len(slots) else np.zeros(0, int)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slots)], strict=True):
                if slots[lo] != slot:
                    here = here or settle()
                    if here:
                        yield close()
                    slot, waiting, here = slots[lo], [], None
                    edge = (batch.column("size")[lo].as_py(), batch.column("target")[lo].as_py())
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    waiting.append(part)
                    continue
                here = here or settle()
                if here:
                    yield _found(*here.meet(part), [])
        here = here or settle()
        if here:
            yield close()

    return dealt.mapInArrow(meet, "rep long, links long, a long, b long")


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x and, for vectors that may link, size and two hashes of the components."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    takes_part: Column = F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"), takes_part.alias("takes_part"))
    return rows.withColumns({"size": F.size("x"), "h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x", F.lit(2))})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    kind, radius = ("<f8" if double else "<f4"), float(np.sqrt(2 - 2 * threshold))
    keys = ["label", "size", "h1", "h2"]
    rows = _keyed(vectors)
    with scratch(spark) as keep:
        whole = rows.where("takes_part").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("x").alias("x"))
        reps = keep(_with_bytes(whole.withColumn("rep", F.monotonically_increasing_id()), kind), "pq-distinct")
        count = reps.count()
        fits = spark.sparkContext.broadcast(_fits(reps, kind, count, radius))
        placed = keep(_placed(reps, fits, kind, radius), "pq-placed")
        met = keep(_met(placed, fits, kind, threshold, radius, count), "pq-links")
        roots = connected_components(met.where("a is not null").select("a", "b"), lambda df: keep(df, "pq-round"))
        links = met.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
        facts = reps.select("rep", *keys, "n", "least").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        facts = keep(facts.select(*keys, "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")), "pq-facts")
        least = facts.groupBy("root").agg(F.min("least").alias("component_id"))
        facts = keep(facts.join(least, "root").select(*keys, "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "pq-classes")
        # Fewer distinct vectors than there are partitions hold more rows than a partition's share; those are sent to all tasks.
        share = max(1000, rows.where("takes_part").count() // partitions(spark))
        hot, sound = F.broadcast(facts.where(F.col("n") > share)), rows.where("takes_part").select("vec_id", *keys)
        found = [
            sound.join(hot, keys).select("vec_id", "n_links", "component_id"),
            sound.join(hot.select(*keys), keys, "left_anti").join(facts.where(F.col("n") <= share), keys).select("vec_id", "n_links", "component_id"),
            rows.where("not takes_part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")),
        ]
        return keep.result(found[0].union(found[1]).union(found[2]), "pq-result")


def _with_bytes(whole: DataFrame, kind: str) -> DataFrame:
    """The components as packed numbers, so that Python reads a batch of vectors as one block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            raw, ends = x.flatten().to_numpy().astype(kind), x.offsets.to_numpy().astype(np.int64)
            ends = (ends - ends[0]) * raw.itemsize
            held = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), held], [*names, "vector"])

    names = ["rep", "label", "size", "h1", "h2", "n", "least"]
    return whole.select(*names, "x").mapInArrow(pack, "rep long, label string, size int, h1 long, h2 long, n long, least long, vector binary")


def _fits(reps: DataFrame, kind: str, count: int, radius: float) -> dict[int, Fit]:
    """A fit for each length among the sample."""
    share = int(min(1.0, SAMPLE / max(1, count)) * (1 << 30))
    sample = reps.where(F.pmod("h2", F.lit(1 << 30)) < share).select("size", "vector").toArrow()
    sizes = sample.column("size").to_numpy()
    out = {}
    for size in np.unique(sizes).tolist():
        own = sample.filter(pa.array(sizes == size)).column("vector").combine_chunks()
        out[size] = fit(unit(_rows_of(own, kind, size)), count * len(own) / len(sizes), radius)
    return out


def op11_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector of ``embeddings``: equal labels, cosine 0.93 and more."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP11_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
), s AS MATERIALIZED (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS len FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.len * b.len) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY node
)
SELECT c.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = c.vec_id
"""
