"""Control against a reference layer: tags for export, heat map, counts of nearby points, review thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panolake.operators.spatial import distance_pairs, grid_cells


def exported(tags: DataFrame) -> DataFrame:
    """Tags in the words of the control layer."""
    words = F.when(F.col("tag") == "TP", "confirmed").when(F.col("tag") == "FP", "new detection").otherwise("missing")
    return tags.withColumn("status", words).withColumnRenamed("label_id", "cadaster_id").drop("tag")


def heat_map(points: DataFrame, size: float = 100.0) -> DataFrame:
    """Problem points (tag FN or FP, x, y) per cell and tag."""
    cells = grid_cells(points.where(F.col("tag").isin("FN", "FP")), size)
    return cells.groupBy(F.concat((F.col("ix") * size).cast("long"), F.lit(", "), (F.col("iy") * size).cast("long")).alias("id"), "tag").agg(F.count("*").alias("n"))


def heat_grid(points: DataFrame, size: float, minx: float, miny: float, columns: int, rows: int) -> DataFrame:
    """Every cell (ix, iy) of a grid with its FN and FP points, 0 where there are none."""
    spark = points.sparkSession
    cells = spark.range(columns).select(F.col("id").alias("ix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("iy"))
    counts = grid_cells(points.where(F.col("tag").isin("FN", "FP")), size, minx, miny).groupBy("ix", "iy").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in ("FN", "FP")])
    return cells.join(counts, ["ix", "iy"], "left").na.fill(0, ["FN", "FP"])


def seen_often(objects: DataFrame, frames: DataFrame, within: float = 15.0, least: int = 3) -> DataFrame:
    """(id, n): objects with at least ``least`` trajectory points within a distance."""
    return distance_pairs(objects, frames, within, closed=True).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def match_statistics(matches: DataFrame) -> DataFrame:
    stats = {"mean": F.avg, "std": F.stddev_pop, "least": F.min, "most": F.max, "median": lambda c: F.percentile(c, 0.5), "n": F.count}
    return matches.agg(*[f("dist").alias(k) for k, f in stats.items()])


def review(rows: DataFrame) -> DataFrame:
    """Untagged rows become ``oth``; all below the least score of tagged rows go, rows without a score too."""
    least = rows.where(F.col("tag").isNotNull()).agg(F.min("score").alias("least"))
    return rows.join(F.broadcast(least)).where("score >= least").withColumn("tag", F.coalesce("tag", F.lit("oth"))).drop("least")


def latest_status(events: DataFrame, keep: str, remove: str) -> DataFrame:
    """ann_id, validated, removed from the last keep or remove event of each annotation."""
    rank = Window.partitionBy("ann_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.where(F.col("action").isin(keep, remove)).withColumn("k", F.row_number().over(rank)).where("k = 1")
    return last.select("ann_id", F.lit(True).alias("validated"), (F.col("action") == remove).alias("removed"))


def best_trials(log: DataFrame) -> DataFrame:
    """Per trial the best precision, F1 and mAP."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return log.withColumn("f1", f1).groupBy("trial").agg(F.max("precision").alias("precision"), F.max("f1").alias("f1"), F.max("map50").alias("map50"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of the best F1, the lower number on ties."""
    return trials.orderBy(F.desc("f1"), "trial").limit(1)


def capped(rows: DataFrame, group: str, most: int, *order) -> DataFrame:
    """At most ``most`` rows of each group, in a given order: a review sample."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("k") <= most).drop("k")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty where both agree."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def looked_up(rows: DataFrame, images: DataFrame, name: str) -> DataFrame:
    """Rows with the image of their name; a name that no or several images bear raises an error."""
    unique = images.groupBy(name).agg(F.count("*").alias("found"), F.min("image_id").alias("image_id"))
    message = F.concat(F.lit("no single image is named "), F.col(name))
    joined = rows.join(unique, name, "left")
    return joined.withColumn("image_id", F.when(F.coalesce("found", F.lit(0)) == 1, F.col("image_id")).otherwise(F.raise_error(message))).drop("found")


def filled(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nulls and zeros take the group's median of the other values."""
    known = F.when(F.col(value) != 0, F.col(value))
    medians = rows.groupBy(group).agg(F.percentile(known, 0.5).alias("median"))
    return rows.join(medians, group).withColumn(value, F.coalesce(known, "median")).drop("median")
