"""Shared helpers: reading tables, cutting lineage in the shared folder, whole-text units."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only in a local session that names none (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator: ``keep(df, what)`` is dropped when the operator ends, ``keep.result`` stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(path := f"{shared_dir(self.spark)}/tables/{what}-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, what: str) -> DataFrame:
        return written(df, what)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(conf).delete(path, True)
        self.paths.clear()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Drops an operator's tables at its end; what it returns must be a ``result``, not read from them later."""
    keep = Scratch(spark)
    try:
        yield keep
    finally:
        keep.drop()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (null text is empty), so that clashing extra columns never matter."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


#: Fixed value: the ASCII white space of the word contracts, as a Java and Python character class.
WORD = r"[^\x20\x09-\x0D]+"
