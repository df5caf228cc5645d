"""Detections of overlapping tiles merged: components of overlaps, one annotation per component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panolake.functions import overlay
from panolake.functions.geometry import segmentation_box
from panolake.operators import ranges
from panolake.operators.components import connected_components
from panolake.operators.spatial import box_pairs, overlap_pairs


def to_panorama(tile_boxes: DataFrame, buffer: int = 1) -> DataFrame:
    """Boxes of tiles (columns min_x, min_y) moved to their panorama and grown by ``buffer`` on each side."""
    moved = {"x": F.col("x") + F.col("min_x") - buffer, "y": F.col("y") + F.col("min_y") - buffer, "w": F.col("w") + 2 * buffer, "h": F.col("h") + 2 * buffer}
    return tile_boxes.withColumns(moved)


def overlap_groups(boxes: DataFrame, keep) -> DataFrame:
    """det_id, root: the least det_id of the component of overlapping boxes; det_id is unique over datasets."""
    return connected_components(overlap_pairs(boxes).select("a", "b"), keep).select(F.col("node").alias("det_id"), "root")


def merged_boxes(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """One box per component: its extent, its members and the median of their scores, each once."""
    rows = boxes.join(groups, "det_id")
    out = rows.groupBy(F.col("root").alias("id")).agg(
        F.min("image_id").alias("image_id"), F.min("dataset").alias("dataset"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("members"), F.percentile("score", 0.5).alias("score"),
    )
    return out.select("id", "image_id", "dataset", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "members", "score")


def outlines_to_panorama(tiles: DataFrame, buffer: float = 1.0) -> DataFrame:
    """Segmentations of tiles (columns min_x, min_y) moved to their panorama, and ``grown`` by ``buffer`` so that parts cut by tiles meet."""
    shift = lambda ring: F.transform(ring, lambda v, i: v + F.when(i % 2 == 0, F.col("min_x")).otherwise(F.col("min_y")))
    moved = ranges.spread(tiles).withColumn("segmentation", F.transform("segmentation", shift))
    return moved.withColumn("grown", overlay.buffered("segmentation", F.lit(float(buffer))))


def outline_groups(moved: DataFrame, keep, cell: float = 512.0) -> DataFrame:
    """det_id, root: the least det_id of the component of ``grown`` outlines of one dataset and image that share area."""
    rows = moved.select("dataset", "image_id", "det_id", "grown", segmentation_box("grown").alias("box")).where("box is not null").select("*", "box.*").drop("box")
    rows = keep(rows)
    pairs = box_pairs(rows, rows, cell, "dataset", "image_id").where("l_det_id < r_det_id")
    touching = ranges.spread(pairs.select("l_det_id", "r_det_id", "l_grown", "r_grown")).where(overlay.share_area("l_grown", "r_grown")).select(F.col("l_det_id").alias("a"), F.col("r_det_id").alias("b"))
    alone = rows.select(F.col("det_id").alias("a"), F.col("det_id").alias("b"))
    return connected_components(keep(touching).union(alone), keep).select(F.col("node").alias("det_id"), "root")


def merged_outlines(moved: DataFrame, groups: DataFrame, keep, buffer: float = 1.0, once: bool = True, at_once: int = 32) -> DataFrame:
    """One annotation per component: the union of its grown outlines, shrunk again, with holes and parts.

    id, image_id, dataset, category_id of the least det_id; segmentation, box (x, y, w, h), area, members, median score. Unions
    are made of ``at_once`` outlines, and again of their unions, so that no task takes a whole large component at once.
    ``once``: each score counts once in the median; else once for each overlapping pair and side, a detection with itself included.
    """
    rows = keep(moved.join(groups, "det_id"))
    parts = rows.select("root", F.col("det_id").alias("part"), F.col("grown").alias("outline"))
    while not parts.groupBy("root").count().where(F.col("count") > at_once).isEmpty():
        numbered = parts.withColumn("k", F.floor((F.row_number().over(Window.partitionBy("root").orderBy("part")) - 1) / at_once))
        merged = numbered.groupBy("root", "k").agg(F.collect_list("outline").alias("outlines"))
        parts = keep(ranges.spread(merged).select("root", F.col("k").alias("part"), overlay.united("outlines").alias("outline")))
    merged = parts.groupBy("root").agg(F.collect_list("outline").alias("outlines"))
    outline = ranges.spread(merged).select("root", overlay.united_buffered("outlines", F.lit(-float(buffer))).alias("segmentation"))
    outline = ranges.settled(outline, {"segmentation": F.col("segmentation")})  # else the area takes the union along and works it out again
    outline = outline.select("*", segmentation_box("segmentation").alias("box"), overlay.area("segmentation").alias("area"))
    first = F.min(F.struct("det_id", "image_id", "dataset", "category_id")).alias("first")
    scores = F.percentile("score", 0.5) if once else F.percentile("score", 0.5, F.col("times"))
    if not once:
        rows = rows.join(_times(rows, keep), "det_id")
    facts = rows.groupBy("root").agg(first, F.count("*").alias("members"), scores.alias("score"))
    return facts.join(outline, "root").select(F.col("root").alias("id"), "first.image_id", "first.dataset", "first.category_id", "segmentation", "box.*", "area", "members", "score")


def _times(rows: DataFrame, keep, cell: float = 512.0) -> DataFrame:
    """det_id, times: sides of overlapping pairs a detection stands on, twice for itself."""
    boxes = keep(rows.select("dataset", "image_id", "det_id", "grown", segmentation_box("grown").alias("box")).select("*", "box.*").drop("box"))
    pairs = box_pairs(boxes, boxes, cell, "dataset", "image_id").where("l_det_id <= r_det_id")
    touching = pairs.where((F.col("l_det_id") == F.col("r_det_id")) | overlay.share_area("l_grown", "r_grown"))
    sides = touching.select(F.explode(F.array("l_det_id", "r_det_id")).alias("det_id"))
    return sides.groupBy("det_id").agg(F.count("*").alias("times"))
