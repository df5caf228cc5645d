"""Review of annotations: the steps between open ones, outlines moved by hand, and what goes into the export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panolake.functions import geometry
from panolake.operators import ranges


def with_status(annotations: DataFrame, status: DataFrame) -> DataFrame:
    """Annotations (id) with validated and removed; those that nobody decided on have neither."""
    flags = status.select(F.col("ann_id").alias("id"), "validated", "removed")
    joined = annotations.join(flags, "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("validated", "removed")})


def exported(annotations: DataFrame, status: DataFrame) -> DataFrame:
    """The annotations that were kept: validated and not removed."""
    return annotations.join(status.where("validated AND NOT removed").select(F.col("ann_id").alias("id")), "id", "left_semi")


def neighbours(annotations: DataFrame, *order: str) -> DataFrame:
    """id, next_open, previous_open of every annotation (id, validated, removed) in a list's order.

    The next open annotation (neither validated nor removed) is the first after this one, or else the first of the
    list before this one; the previous one is that of the largest id among the open ones before. Null where there
    is none. The list is dealt to ranges, whose ends are carried over in a table of one row a range, so no task
    holds the whole list. ``order`` must be unique.
    """
    is_open = ~(F.col("validated") | F.col("removed"))
    rows = annotations.select("id", *[c for c in order if c != "id"], F.when(is_open, F.col("id")).alias("open"))
    ranged = ranges.dealt(rows, *order)
    first = F.min_by("open", F.when(F.col("open").isNotNull(), F.struct(*order)))
    ends = ranged.groupBy("part").agg(first.alias("first"), F.max("open").alias("most"))
    parts = Window.orderBy("part")  # one row per range
    later, earlier = parts.rowsBetween(1, Window.unboundedFollowing), parts.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select("part", F.first("first", True).over(later).alias("after"), F.first("first", True).over(whole).alias("start"), F.max("most").over(earlier).alias("before"))
    # Frames that end at the last row are summed anew for each row; those that begin at the first are carried on, also backwards.
    behind, ahead = (Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in (order, [F.desc(c) for c in order]))
    placed = ranged.withColumns({"ahead": F.last("open", True).over(ahead), "behind": F.max("open").over(behind)}).join(F.broadcast(carried), "part")
    wrapped = F.when(F.col("start") != F.col("id"), F.col("start"))
    return placed.select("id", F.coalesce("ahead", "after", wrapped).alias("next_open"), F.greatest("behind", "before").alias("previous_open"))


def moved(ring: Column, dx: Column, dy: Column, factor: float, width: Column | float, height: Column | float) -> Column:
    """Struct segmentation (one flat list of whole numbers) and bbox of an outline that was scaled about the mean of its
    vertices and shifted by hand: vertices stay inside the image, and the box is that of the rounded vertices."""
    into = lambda value, size: F.rint(F.least(F.greatest(value, F.lit(0.0)), F.lit(size) - 1.0))
    placed = F.transform(geometry.scale(ring, factor), lambda p: F.struct(into(p["x"] + dx, width).alias("x"), into(p["y"] + dy, height).alias("y")))

    def shape(points: Column) -> Column:
        b = geometry.bounds(points)
        return F.struct(F.array(geometry.flat(points)).alias("segmentation"), F.array(b["x"], b["y"], b["w"], b["h"]).alias("bbox"))

    return F.get(F.transform(F.array(placed), shape), 0)
