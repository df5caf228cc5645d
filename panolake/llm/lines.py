"""Line dedup by content-defined chunks of lines.

A rolling hash over two neighbouring lines' hashes ends a chunk where it is divisible by ``EACH``, so
boundaries depend on nearby lines alone and survive shifts. Chunks of at least two lines that occur more
than once are compared by their bytes (they are grouped and joined by their text itself); all but the first,
by doc_id, row and place, are removed. Work and memory grow with a text's lines, not their square.

Defined results: null text is empty, one empty line; a null doc_id comes after all others; rows that share
doc_id and text keep and lose the same lines, of rows that share doc_id alone one keeps a repeated chunk; a
chunk that repeats inside one document keeps its first place. Extra columns stay as they are, whatever their
names; with counts, columns of the input named n_lines or n_removed give way to the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import let, scratch, table

EACH = 3


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def lines_in(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1


def chunks_of(text: Column, each: int = EACH) -> Column:
    """The chunks of a text in order, each the text of its lines.

    Lines are marked as the first of a chunk or a later one and joined again; no line holds a line end, so the
    marks after line ends alone tell where to split.
    """
    starts = lambda hs, i: (i == 0) | ((i > 1) & ((F.get(hs, i - 1) + 31 * F.get(hs, i - 2)) % each == 0))
    marked = lambda ls: let(F.transform(ls, line_hash), lambda hs: F.transform(ls, lambda line, i: F.concat(F.when(starts(hs, i), "#").otherwise("|"), line)))
    joined = F.array_join(let(F.split(text, "\n", -1), marked), "\n")
    return F.transform(F.split(F.substring(joined, 2, (1 << 31) - 1), "\n#", -1), lambda c: F.replace(c, F.lit("\n|"), F.lit("\n")))


def whole(text: str = "text") -> Column:
    return F.coalesce(text, F.lit(""))


def chunks(docs: DataFrame, each: int = EACH) -> DataFrame:
    """doc_id, row_key, pos, n (lines), chunk (text): one row per chunk."""
    # The text must not stand in the rows that posexplode makes, so all that needs it comes before.
    own = docs.select("doc_id", row_key().alias("row_key"), chunks_of(whole(), each).alias("own"))
    rows = own.select("doc_id", "row_key", F.posexplode("own").alias("pos", "chunk"))
    return rows.select("doc_id", "row_key", "pos", lines_in(F.col("chunk")).alias("n"), "chunk")


def row_key() -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dedup_lines(docs: DataFrame, each: int = EACH, counts: bool = True) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and n_lines, n_removed unless ``counts`` is False."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"), F.col("pos").alias("pos"))
    many = chunks(docs.select("doc_id", "text"), each).where("n >= 2").select(F.xxhash64("chunk").alias("h"), "chunk", place.alias("place"))
    with scratch(docs.sparkSession) as keep:
        repeated = many.groupBy("h", "chunk").agg(F.count("*").alias("times"), F.min("place").alias("first")).where("times > 1")
        repeated = keep(repeated.select("h", "chunk", "first"), "line-chunks")
        found = keep(many.join(repeated, ["h", "chunk"]).where("place <> first").select("place.doc_id", "place.row_key", "place.pos"), "line-places")
        gone = keep.result(found.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    held = docs.select(F.struct(*others).alias("rest"), "text", F.col("doc_id").alias("id"), row_key().alias("row_key"))
    held = held.join(gone.withColumnRenamed("doc_id", "other"), F.col("id").eqNullSafe(F.col("other")) & (held["row_key"] == gone["row_key"]), "left")
    left = lambda cs: F.transform(F.array_except(F.sequence(F.lit(0), F.size(cs) - 1), F.col("gone")), lambda pos: F.get(cs, pos))
    kept = F.when(F.col("gone").isNotNull(), let(chunks_of(whole(), each), left))
    held = held.select("rest", "text", lines_in(whole()).alias("n_lines"), kept.alias("kept")).select("*", F.array_join("kept", "\n").alias("left"))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.col("left"))
    removed = F.when(F.col("kept").isNull(), 0).when(F.size("kept") == 0, F.col("n_lines")).otherwise(F.col("n_lines") - lines_in(F.col("left")))
    counted = {"n_lines": F.col("n_lines"), "n_removed": removed} if counts else {}
    return held.select(*[(text if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns if c not in counted], *[x.alias(c) for c, x in counted.items()])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the kept text's digest of every row of ``documents``."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS total FROM lines),
ends AS (SELECT *, CASE WHEN i = total OR (i > 1 AND (h + 31 * lag(h) OVER (PARTITION BY doc_id ORDER BY i)) % {EACH} = 0) THEN 1 ELSE 0 END AS stop FROM hashed),
placed AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ends),
chunk AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM placed GROUP BY doc_id, pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) AS k FROM chunk),
gone AS (SELECT doc_id, pos, n FROM ranked WHERE n >= 2 AND k > 1 AND chunk IN (SELECT chunk FROM chunk WHERE n >= 2)),
kept AS (SELECT p.doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS INTEGER) AS n_lines,
       CAST(coalesce((SELECT sum(n) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS INTEGER) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
