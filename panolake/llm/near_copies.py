"""Near copies by the Jaccard similarity of word shingles: SimHash first, prefix filtering for what it leaves.

Each set of shingles has a SimHash fingerprint. Sets whose fingerprints link (``simhash.links``, ``MOST`` bits) are
verified on their whole sets, each against the least it links to, and the similar ones joined to classes. Similar sets may lie further apart than any
number of bits that can be searched (at 0.8 about ten of 64), so the rest is found exactly, among sets of different classes:
in any order of all shingles, two sets of similarity ``least`` or more share one of the first
``n - ceil(least * n) + 1`` of each (n its size). So an equality shuffle of these prefixes brings all such
pairs together; no pair is left to chance, as it would be with signatures. The order is by hash, but
shingles that over ``HOT`` sets hold come last, so that common passages make no pairs. It is found level by
level of the hash's range: all sets give their shingles of the first level, which are counted; sets that are
left with too few uncommon ones go on to the next. What still lacks any (near copies of texts with over HOT
copies, mostly) takes common ones.

These pairs are first each key's sets with one of them, which joins dense balls of near copies at a cost in
proportion to their size; common keys go on with rounds of this kind as long as these thin out what is left.
Then pairs of a key that are in different classes. A pair goes on if sizes and parities of the sets' bits let
it be similar, and for a common key if the places of the key in both sets leave room for enough common
shingles after it, as those of the first shared key of similar sets do (bounds that never err). It is verified
on its whole sets. The sets of a key are dealt to blocks, so that no task holds all of one.

Defined results: words are split at ASCII white space, ASCII letters in lower case; texts of fewer words
than a shingle are one shingle; null and empty texts are one class. Classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panolake.llm import simhash
from panolake.llm.common import scratch, text_of
from panolake.llm.recompression import mixed
from panolake.llm.substring import window_hashes, words_of
from panolake.llm.units import slices
from panolake.operators.components import connected_components

#: Least similarity of near copies, and words of a shingle.
LEAST = 0.8
WORDS_EACH = 5
#: Fingerprints of at most so many differing bits give pairs to verify.
MOST = 5
#: Sets of one key whose pairs are made; where the levels of the hash's range begin; bits of a set's parities.
HOT, LEVELS, BITS = 32, (0.0, 0.3, 0.65), 1024
#: Sets of a common key that one task holds, about, where classes' pairs are made.
BLOCK = 4096
#: Rounds of common keys go on while a round leaves at most this share of the pairs that were left before it.
THINNED = 0.8
#: Ids that are sent to all tasks instead of shuffling texts to them.
SENT = 500_000
#: Guards the bounds against rounding; pairs are verified by whole numbers.
_SLACK = 1e-9


def row_key() -> Column:
    """Tells rows apart by doc_id and text; null has its own keys."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def shingles(texts: pa.Array, words_each: int = WORDS_EACH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles, one text after another, and how many each has."""
    first, second, n = words_of(pc.ascii_lower(texts))
    words, ends = first ^ mixed(second), np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    hashes = window_hashes(words, words_each)
    inside = np.flatnonzero(np.arange(words_each, len(hashes) + words_each) <= ends[doc[: len(hashes)]])
    few = np.flatnonzero(n < words_each)
    own = mixed(n[few].astype(np.uint64) + np.uint64(1))
    for k in range(words_each - 1):
        more = n[few] > k
        own[more] = mixed(own[more] * np.uint64(31) + words[(ends - n)[few[more]] + k])
    hashes, doc = np.concatenate([hashes[inside], own]), np.concatenate([doc[inside], few])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(n))


def level_of(hashes: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([int(x * 2**64) for x in LEVELS[1:]], np.uint64), hashes, side="right")


def shingled(docs: DataFrame, words_each: int = WORDS_EACH) -> DataFrame:
    """row, doc_id, node (hash of the whole set), n (its size), fp (its SimHash), levels (its shingles in each), bits (their parities)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2000):
            hashes, n = shingles(part.column("text"), words_each)
            doc = np.repeat(np.arange(len(n)), n)
            cuts = np.cumsum(n)[:-1]
            sets = np.split(hashes, cuts)
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            odd = np.bincount(doc * BITS + (hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=len(n) * BITS) & 1
            bits = np.packbits(odd.reshape(-1, BITS).astype(np.uint8), axis=1).view(np.int64)
            levels = np.bincount(doc * len(LEVELS) + level_of(hashes), minlength=len(n) * len(LEVELS)).reshape(len(n), -1)
            columns = [part.column("row"), part.column("doc_id"), pa.array(nodes), pa.array(n.astype(np.int32)), pa.array(fps), pa.array(list(levels.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(bits), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "n", "fp", "levels", "bits"])

    return text_of(docs, row_key().alias("row")).mapInArrow(each, "row string, doc_id long, node long, n int, fp long, levels array<int>, bits array<long>")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the given nodes (node, row), one row each."""
    texts = docs.select(row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(nodes.select("node", "row"), "row").dropDuplicates(["row"]).select("node", "text")


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the nodes in ``ids``, a written table of distinct nodes; sent to all tasks if it is small."""
    return texts.join(F.broadcast(ids) if ids.count() <= SENT else ids, "node", "left_semi")


def keys_of(texts: DataFrame, level: int, words_each: int) -> DataFrame:
    """(key, node, at): the shingles of a level, and their places in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2000):
            hashes, n = shingles(part.column("text"), words_each)
            doc = np.repeat(np.arange(len(n)), n)
            own = level_of(hashes) == level
            hashes, doc = hashes[own], doc[own]
            n = np.bincount(doc, minlength=len(n))
            at = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part.column("node").take(pa.array(doc)), pa.array(at.astype(np.int32))], ["key", "node", "at"])

    return texts.mapInArrow(each, "key long, node long, at int")


def prefixes(texts: DataFrame, nodes: DataFrame, words_each: int, least: float, keep) -> tuple[DataFrame, DataFrame]:
    """Two tables (key, node) of the prefixes' keys that sets share: those of HOT sets at most, and common ones with the places left ``after`` them in the prefix."""
    short = nodes.select("node", "levels", (F.col("n") - F.ceil(least * F.col("n") - _SLACK) + 1).cast("int").alias("need"))
    taken, common = [], []
    for level in range(len(LEVELS)):
        keys = keys_of(only(texts, short.select("node")) if level else texts, level, words_each)
        with scratch(texts.sparkSession) as own:
            counts = own(keys.groupBy("key").agg(F.count("*").cast("int").alias("many")).where("many > 1"), "near-counts")
            held = own(keys.join(counts, "key"), "near-shared")
            hot = keep(held.where(F.col("many") > HOT).select("key", "node", "at"), "near-common")
            before = Window.partitionBy("node").orderBy("at")
            placed = held.join(short.select("node", "need"), "node").withColumn("hot", (F.col("many") > HOT).cast("int"))
            placed = placed.withColumn("place", F.col("at") - F.sum("hot").over(before)).where("hot = 0 and place < need")
            taken.append(keep(placed.select("key", "node"), "near-prefix"))
        left = short.join(hot.groupBy("node").agg(F.count("*").cast("int").alias("hot")), "node", "left")
        left = left.withColumn("need", F.col("need") - F.get("levels", level) + F.coalesce("hot", F.lit(0))).where("need > 0")
        short = keep(left.select("node", "levels", "need"), "near-short")
        common.append(hot.withColumn("level", F.lit(level)))
    every = common[0].union(common[1]).union(common[2]).join(short.select("node", "need"), "node")
    ranked = every.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("level", "at"))).where("k <= need")
    return taken[0].union(taken[1]).union(taken[2]), keep(ranked.select("key", "node", (F.col("need") - F.col("k")).alias("after")), "near-last")


def may_be(least: float, n: str = "n", m: str = "m", x: str = "x", y: str = "y") -> Column:
    """Sizes and parities let two sets be similar: they differ in as many shingles as parities at least."""
    both = F.ceil(least / (1 + least) * (F.col(n) + F.col(m)) - _SLACK)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    return (F.least(n, m) >= both) & (apart <= F.col(n) + F.col(m) - 2 * both)


def room(least: float, n: str = "n", m: str = "m", after: str = "after", later: str = "later") -> Column:
    """A key's places let it be the first that two similar sets share. A set's prefix leaves out ``ceil(least * n) - 1`` of its shingles; all before the prefix's common keys are shared with none."""
    both = F.ceil(least / (1 + least) * (F.col(n) + F.col(m)) - _SLACK)
    rest = lambda size, left: F.ceil(least * F.col(size) - _SLACK) + F.col(left)
    return F.least(rest(n, after), rest(m, later)) >= both


def possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may be similar; if ``nodes`` have a root, of different classes."""
    root = F.col("root" if "root" in nodes.columns else "node")
    one = nodes.select(F.col("node").alias("a"), F.col("n"), F.col("bits").alias("x"), root.alias("p"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"), root.alias("q"))
    return pairs.join(one, "a").join(two, "b").where((F.col("p") != F.col("q")) & may_be(least)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words_each: int, least: float, keep) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Sets are worked out again for nodes of pairs alone, as all of them fill more disk than the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2000):
            hashes, n = shingles(part.column("text"), words_each)
            own = [s.tobytes() for s in np.split(hashes, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary())], ["node", "own"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fit.append(both >= least * (len(x) + len(y) - both) - _SLACK)
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    with scratch(texts.sparkSession) as once:
        ends = once(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-ends")
        own = once(only(texts, ends).mapInArrow(sets, "node long, own binary"), "near-sets")
        left, right = (own.select(F.col("node").alias(k), F.col("own").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(each, "a long, b long"), "near-found")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def still_open(rooted: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that hold several classes, and such keys' sets, classes and largest class."""
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("own"))
    sizes = each.groupBy("key").agg(F.max_by("root", F.struct("own", "root")).alias("major"), F.max("own").alias("most"), F.sum("own").alias("sets"), F.count("*").alias("classes"))
    sizes = keep(sizes.where("classes > 1"), "near-sizes")
    return keep(rooted.join(sizes.select("key"), "key"), "near-rooted"), sizes


def pairs_left(sizes: DataFrame) -> float:
    """Pairs that the keys would make: sets outside the largest class with all."""
    return sizes.agg(F.coalesce(F.sum(F.expr("double(sets - most) * sets")), F.lit(0.0)).alias("left")).first()["left"]


def alike(nodes: DataFrame, keep) -> DataFrame:
    """(a, b): pairs of distinct sets whose SimHash differs in ``MOST`` bits or less: sets of one fingerprint meet its least, a fingerprint the least one that it links to (one pair each, however many copies lie close)."""
    fps = keep(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("sets")), "near-prints")
    same = nodes.join(fps.where("sets > 1"), "fp").where("lead <> node").select(*ordered("lead", "node"))
    one, two = (fps.select(F.col("fp").alias(k), F.col("lead").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    with scratch(nodes.sparkSession) as own:
        near = simhash.links(fps.select("fp"), MOST, own).select(*ordered("a", "b")).groupBy("b").agg(F.min("a").alias("a"))
        return keep(same.union(near.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select(*ordered("x", "y"))), "near-alike")


def links(texts: DataFrame, nodes: DataFrame, words_each: int, least: float, keep) -> DataFrame:
    """(a, b): similar pairs of distinct sets that connect all similar ones."""
    tried = keep(possible(alike(nodes, keep), nodes, least), "near-met")
    edges = verified(tried, texts, words_each, least, keep)
    roots = connected_components(edges, lambda df: keep(df, "near-round"))
    rooted = lambda df: df.join(roots, "node", "left").select(*df.columns, F.coalesce("root", "node").alias("root"))
    rare, common = prefixes(texts, nodes, words_each, least, keep)
    every = rare.union(common.select("key", "node"))
    leads = every.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    stars = every.join(leads, "key").where("lead <> node").select(*ordered("lead", "node")).distinct().join(tried, ["a", "b"], "left_anti")
    stars = keep(possible(stars, rooted(nodes), least), "near-stars")
    edges, tried = edges.union(verified(stars, texts, words_each, least, keep)), tried.union(stars)
    roots = connected_components(edges, lambda df: keep(df, "near-round"))
    # Common keys: all sets of other classes against one more set of each key, by another order each time.
    held, sizes = still_open(rooted(common), keep)
    left, k = pairs_left(sizes), 0
    while left:
        lead = F.min_by(F.struct(F.col("node").alias("lead"), F.col("root").alias("one")), F.xxhash64("node", F.lit(k)))
        leads = held.groupBy("key").agg(lead.alias("l")).select("key", "l.*")
        more = held.join(leads, "key").where("root <> one").select(*ordered("lead", "node")).distinct().join(tried, ["a", "b"], "left_anti")
        more = keep(possible(more, nodes, least), "near-stars")
        tried = tried.union(more)
        edges = edges.union(verified(more, texts, words_each, least, keep))
        roots = connected_components(edges, lambda df: keep(df, "near-round"))
        held, sizes = still_open(rooted(common), keep)
        before, left, k = left, pairs_left(sizes), k + 1
        if left > THINNED * before:
            break
    # Keys of HOT sets at most: their pairs of different classes.
    groups = rooted(rare).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("own")).where(F.size("own") > 1)
    later = lambda x, i: F.filter(F.slice("own", i + 2, HOT), lambda y: y["root"] != x["root"])
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    met = possible(groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), nodes, least)
    # Common keys: sets outside the key's largest class against all others; what cannot be similar does not leave the join.
    open_keys = keep(held.join(sizes.withColumn("parts", F.ceil(F.col("sets") / BLOCK)).select("key", "major", "parts"), "key").join(nodes.select("node", "n", "bits"), "node"), "near-open")
    minor = open_keys.where("root <> major").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("one"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("bits").alias("y"), F.col("after").alias("later"))
    every = open_keys.select("key", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", "root", "n", F.col("bits").alias("x"), "after")
    same = (minor["key"] == every["key"]) & (minor["part"] == every["part"])
    across = minor.join(every, same & (F.col("root") != F.col("other")) & room(least) & may_be(least)).select(*ordered("one", "node"))
    rest = keep(met.union(across).distinct().join(tried, ["a", "b"], "left_anti"), "near-rest")
    return edges.union(verified(rest, texts, words_each, least, keep))


def near_copies(docs: DataFrame, least: float = LEAST, words_each: int = WORDS_EACH) -> DataFrame:
    """row (its row_key), doc_id, component_id (least doc_id of the class), root (the class) of every row."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(shingled(docs, words_each), "near-rows")
        nodes = keep(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("levels").alias("levels"), F.first("bits").alias("bits"), F.min("row").alias("row"), F.min("doc_id").alias("first")), "near-nodes")
        texts = keep(texts_of(docs, nodes), "near-texts")
        roots = connected_components(links(texts, nodes, words_each, least, keep), lambda df: keep(df, "near-round"))
        classes = keep(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "near-classes")
        least_ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
        found = rows.select("row", "doc_id", "node").join(classes.join(least_ids, "root"), "node")
        return keep.result(found.select("row", "doc_id", "component_id", "root"), "near-copies")
