"""The corpus pipeline: stages that each apply one operator to all that the stage before it kept.

toxicity (rejected documents go), line dedup, near-dedup (SimHash, then what it leaves exactly: five-word shingles of Jaccard
similarity 0.8 and more; of each class one row stays, that of the least doc_id; null ids come last), substring dedup, packing. Clean documents stay, if shorter; texts that change get a new n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm import lines, near_copies, packing, substring, toxicity
from panolake.llm.common import Scratch, table, written


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, n_chars worked out anew."""
    return docs.select(*[F.char_length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.remainder() != 0)
    return toxicity.kept(docs, lexicon)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(lines.dedup_lines(docs, counts=False), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_copies.near_copies(docs)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("one"))
    marked = docs.select(F.struct(*docs.columns).alias("doc"), near_copies.row_key().alias("row"))
    kept = marked.join(first.select("one.row"), "row", "left_semi").dropDuplicates(["row"])
    return kept.select("doc.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(substring.dedup_substrings(docs, counts=False), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and reread as the next one's documents; the tables between are dropped once the next is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        keep = Scratch(spark)
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        before = keep
    name, stage = STAGES[-1]
    docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    before.drop()
    return docs
