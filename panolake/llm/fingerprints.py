"""Document fingerprints by winnowing, DataFrame functions only.

Words get 28-bit hashes (of MD5, so that other engines give the same); polynomial k-gram hashes roll over them
(by doubling: a 4-gram is two 2-grams); of every ``WINDOW`` neighbouring grams the least hash is kept, the
rightmost on ties, with its position. Any run of WINDOW + GRAM - 1 words that two texts share leaves a common hash.

Defined results: null text is empty and has an empty fingerprint; a text of fewer words than a gram has
one gram of all its words; likeness of two empty fingerprints is 1. Rows with a null doc_id come first;
rows that share a doc_id follow one another by a hash of their text; one row alone is its own next document;
extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panolake.llm.common import let, partitions, table, written

GRAM, WINDOW = 4, 8
PRIME, BASE = (1 << 31) - 1, 1_000_003


def winnow(text: Column) -> Column:
    """Array of longs: kept gram hash in the high 31 bits, then 2^32 - 1 - position; in order of position."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long"))
    ahead = lambda a, i, n: F.coalesce(F.get(a, i + n), F.lit(0).cast("long"))
    low = F.lit((1 << 32) - 1)

    def grams(h: Column) -> Column:
        twos = F.transform(h, lambda x, i: (x * BASE + ahead(h, i, 1)) % PRIME)
        fours = let(twos, lambda t: F.transform(t, lambda x, i: F.shiftleft((x * (BASE * BASE % PRIME) + ahead(t, i, 2)) % PRIME, 32).bitwiseOR(low - i)))
        return F.slice(fours, 1, F.greatest(F.size(h) - (GRAM - 1), F.least(F.size(h), F.lit(1))))

    least = lambda a, step: F.transform(a, lambda x, i: F.least(x, F.get(a, i + step)))

    def windows(g: Column) -> Column:
        of = let(least(g, 1), lambda a: let(least(a, 2), lambda b: least(b, 4)))
        return F.array_distinct(F.slice(of, 1, F.greatest(F.size(g) - (WINDOW - 1), F.least(F.size(g), F.lit(1)))))

    return let(hashes, lambda h: let(grams(h), windows))


def kept_hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def positions(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.lit((1 << 32) - 1) - x.bitwiseAND(F.lit((1 << 32) - 1)))


def likeness(one: Column, other: Column) -> Column:
    """Twice the common hashes over all hashes of both; 1 for two empty fingerprints."""
    both = F.size(one) + F.size(other)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(one, other)) / both)


def ranged(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text, k (doc_id, null least), h (hash of the text), part: about ``n`` ranges of equal rows by (k, h).

    A doc_id of more rows than a range holds is split by h, so that no range grows with it.
    """
    k = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.select("doc_id", k.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000), F.count("*")).first() if n > 1 else [None, 0]
    bounds = sorted(set(cuts[0] or []))
    # Cuts that fall together name the doc_ids that may fill a range or more: at most n of them.
    counts = rows.groupBy("k").count().where(F.col("count") * n > cuts[1]) if bounds else None
    split = {r["k"]: -(-r["count"] * n // cuts[1]) for r in counts.where(F.col("k").isin(bounds)).collect()} if counts is not None else {}
    at = F.size(F.filter(F.lit(bounds), lambda c: c < F.col("k"))) if bounds else F.lit(0)
    rows = rows.withColumn("h", F.xxhash64("text"))
    share = F.lit(0)
    for key, times in split.items():
        share = F.when(F.col("k") == key, F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * times), F.lit(times - 1)).cast("int") + 1).otherwise(share)
    rows = rows.withColumn("range", F.struct(at.alias("at"), F.col("k").isin(list(split)).alias("alone") if split else F.lit(False).alias("alone"), share.alias("share")))
    # A hot doc_id ends its range, as ranges hold their upper cut; it comes after the others there.
    firsts = written(rows.groupBy("range").agg(F.min(F.struct("k", "h")).alias("least")), "ranges")
    every = Window.orderBy("range")  # a few rows per partition of the shuffle
    numbered = firsts.select("range", "least", F.row_number().over(every).alias("part"))
    return rows.join(F.broadcast(written(numbered, "range-numbers")), "range").select("doc_id", "text", "k", "h", "part", "least")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: each row with the next by doc_id, the last with the first.

    Each range of rows gets a copy of the row that begins the next one; a window then looks ahead.
    """
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    rows = ranged(docs, n)
    parts = rows.where(F.struct("k", "h") == F.col("least")).select("part", "k", "h", "text")
    copies = parts.groupBy("part").agg(F.min(F.struct("k", "h", "text")).alias("one"))
    last = copies.agg(F.max("part").alias("parts"))
    copies = copies.join(F.broadcast(last)).select((F.pmod(F.col("part") - 2, F.col("parts")) + 1).alias("part"), "one.text")
    own = rows.select("part", F.lit(0).alias("copy"), "doc_id", "k", "h", "text")
    both = own.unionByName(copies.select("part", F.lit(1).alias("copy"), "text"), allowMissingColumns=True)
    dealt = both.repartitionByRange(n, "part").withColumn("fp", winnow(F.col("text")))
    ahead = Window.partitionBy("part").orderBy("copy", "k", "h", "text")
    seen = dealt.select("copy", "doc_id", "text", "fp", F.lead("text").over(ahead).alias("next_text"), F.lead("fp").over(ahead).alias("next_fp"))
    return seen.where("copy = 0").drop("copy")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text, with likenesses."""
    held = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = held.select("*", n.cast("long").alias("n_chars"), F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.substr("next_text", F.lit(1), half)).alias("edited"))
    edited = edited.withColumn("edited_fp", winnow(F.col("edited")))
    shown = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    own = kept_hashes(F.col("fp"))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"),
        likeness(own, kept_hashes(F.col("edited_fp"))).alias("near_edited"), likeness(own, kept_hashes(F.col("next_fp"))).alias("near_next"),
    )


def _sql_fingerprint(text: str) -> str:
    words = f"list_transform(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+'), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT)"
    two = lambda i: f"((coalesce(h[{i}], 0) * {BASE} + coalesce(h[{i} + 1], 0)) % {PRIME})"
    grams = f"list_transform(range(1, greatest(len(h) - {GRAM - 1}, least(len(h), 1)) + 1), lambda i: ({two('i')} * {BASE * BASE % PRIME} + {two('i + 2')}) % {PRIME} * 4294967296 + 4294967296 - i)"
    least = f"list_transform(range(1, greatest(len(g) - {WINDOW - 1}, least(len(g), 1)) + 1), lambda j: list_min(g[j : j + {WINDOW - 1}]))"
    return words, grams, f"list_transform(list_sort(list_transform(list_distinct({least}), lambda x: {{'p': 4294967295 - (x & 4294967295), 'x': x}})), lambda s: s.x)"


def _sql() -> str:
    like = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    (w1, grams, fp), (w2, _, _) = _sql_fingerprint("text"), _sql_fingerprint("edited")
    kept = "list_distinct(list_transform(fp, lambda x: x >> 32))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
f AS (SELECT doc_id, {fp} AS fp FROM (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {w1} AS h FROM d))),
k AS (SELECT doc_id, {fp} AS fp FROM (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {w2} AS h FROM e))),
fk AS (SELECT doc_id, fp, {kept} AS kept FROM f), kk AS (SELECT doc_id, fp, {kept} AS kept FROM k)
SELECT e.doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(a.fp, ',')) AS fingerprint, sha256(array_to_string(b.fp, ',')) AS edited_fingerprint,
{like('a.kept', 'b.kept')} AS near_edited, {like('a.kept', 'c.kept')} AS near_next
FROM e JOIN fk a ON e.doc_id = a.doc_id JOIN kk b ON e.doc_id = b.doc_id JOIN fk c ON e.next_id = c.doc_id"""


OP10_SQL = _sql()
