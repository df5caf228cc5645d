"""Assessment tables: labels with categories, segmentations of tagged rows, metrics by class, thresholds, areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ground_truth(labels: DataFrame, categories: DataFrame, images: DataFrame, aoi: str | None = None) -> DataFrame:
    """Labels with the category of their class (null where there is none), of one area of interest if given."""
    named = labels.join(categories.select(F.col("id").alias("label_class"), F.col("name").alias("category")), "label_class", "left")
    return named if aoi is None else named.join(images.where(F.col("aoi") == aoi).select("image_id"), "image_id", "left_semi")


def with_segments(tags: DataFrame, labels: DataFrame, dets: DataFrame, *columns: str) -> DataFrame:
    """Tagged rows with ``columns`` of their detection, missing ones with those of their label."""
    missed = tags.where("tag = 'FN'").join(labels.select("label_id", *columns), "label_id", "left")
    return missed.unionByName(tags.where("tag <> 'FN'").join(dets.select("det_id", *columns), "det_id", "left"))


def with_class(tags: DataFrame) -> DataFrame:
    """``class`` of a tagged row, counting from 1: that of the label, of a false detection its own."""
    return tags.withColumn("class", F.coalesce("label_class", F.col("det_class") + 1))


def categories_of(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """det_id, category of every detection."""
    names = categories.select((F.col("id") - 1).alias("det_class"), F.col("name").alias("category"))
    return tags.where("det_id is not null").select("det_id", "det_class").join(names, "det_class", "left").select("det_id", "category")


def resolved_threshold(sweep: DataFrame | None, configured: float | None, spark) -> DataFrame:
    """threshold: the configured one, else that of the sweep's greatest F1; without either an error."""
    if configured is not None:
        return spark.range(1).select(F.lit(float(configured)).alias("threshold"))
    if sweep is None:
        raise ValueError("no threshold is configured and there is no validation set to find one on")
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold")


def class_list(categories: DataFrame) -> DataFrame:
    """place, name: class names in order, each once, ``background`` last."""
    names = categories.agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select(F.posexplode(F.concat("names", F.array(F.lit("background")))).alias("place", "name"))


def validated_ids(valid: DataFrame, shifted: DataFrame) -> DataFrame:
    """Validated images (aoi, original_id) with the shifted ``image_id``; one that is unknown raises an error when it is read."""
    joined = valid.join(shifted.select("aoi", "original_id", "image_id"), ["aoi", "original_id"], "left")
    message = F.concat(F.lit("not among the original images: "), F.col("original_id").cast("string"))
    return joined.withColumn("image_id", F.coalesce("image_id", F.raise_error(message).cast("bigint")))


def inside_any(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points (x, y) in one or more of the boxes (minx, miny, maxx, maxy), edges included; joined by cells, no union of areas is built."""
    of = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.withColumn("cx", F.explode(F.sequence(of("minx"), of("maxx")))).withColumn("cy", F.explode(F.sequence(of("miny"), of("maxy"))))
    p, b = points.withColumn("cx", of("x")).withColumn("cy", of("y")).alias("p"), cells.alias("b")
    return p.join(b, F.expr("p.cx = b.cx and p.cy = b.cy and p.x between b.minx and b.maxx and p.y between b.miny and b.maxy"), "left_semi").drop("cx", "cy")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Rows that equal another in all but ``key``, the least of which stays out."""
    others = [c for c in rows.columns if c != key]
    least = rows.groupBy(*others).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = rows[others[0]].eqNullSafe(least[others[0]])
    for c in others[1:]:
        same = same & rows[c].eqNullSafe(least[c])
    return rows.join(least, same).where(F.col("first") < F.col(key)).select(rows[key].alias("key"), "first")


def by_sensor(points: DataFrame) -> DataFrame:
    """Image points listed by sensor and face, in their own order."""
    listed = points.groupBy("frame_id", "sensor", "face").agg(F.array_sort(F.collect_list(F.struct("place", "u", "v"))).alias("points"))
    return listed.withColumn("points", F.transform("points", lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"))))
