"""Tables kept once, and rows dealt to ranges of an order that every reader sees alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Cuts lineage by a table in the folder that the session names for checkpoints, or by checkpoint() into the folder set on its context."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))

    def keep(df: DataFrame) -> DataFrame:
        if where is None:
            return df.checkpoint()
        path = f"{where}/tables/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``part``, the number of their range of ``order``, written once.

    Bounds of ranges come from a sample that each evaluation draws anew, and small ranges are merged by size: two
    evaluations number and cut them differently, so what is worked out on one does not fit the other.
    """
    return keeper(rows.sparkSession)(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def places(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``place``, their place in order from 0; no task holds more than a range."""
    ranged = dealt(rows, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    return inside.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("k")).drop("part", "k", "start")


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with ``columns``, each row's worked out once.

    Filters are pushed below plain columns and take their whole expressions along, each time they name them; below
    what is exploded they are not, here a list of one.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("settled")
    return rows.select(*[c for c in rows.columns if c not in columns], one).select(*[c for c in rows.columns if c not in columns], "settled.*")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks (by ``keys``, if any) for work that is long for each row: a small file of many packed rows, or a shuffle merged by its bytes, leaves it to a task or two."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
