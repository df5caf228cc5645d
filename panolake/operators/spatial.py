"""Spatial joins with equality keys: cells for distances, images for overlaps, arithmetic for grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance_pairs(left: DataFrame, right: DataFrame, within: float, closed: bool = False) -> DataFrame:
    """(a, b, dist): points (id, x, y) of both sides nearer than ``within``; in space where both sides have z.

    Left points go to the nine cells around them, right points to their own; the join is on the cell, so
    it shuffles by place and needs no nested loop. Each pair meets in exactly one cell.
    """
    axes = "xyz" if "z" in left.columns and "z" in right.columns else "xy"
    cell = lambda c: F.floor(F.col(c) / within)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    own = lambda df, side: df.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}{c}") for c in axes], cell("x").alias("cx"), cell("y").alias("cy"))
    spread = own(left, "a").withColumn("ex", around).withColumn("ey", around)
    spread = spread.withColumns({"cx": F.col("cx") + F.col("ex"), "cy": F.col("cy") + F.col("ey")}).drop("ex", "ey")
    apart = [F.col(f"a{c}") - F.col(f"b{c}") for c in axes]
    far = F.sqrt(sum((d * d for d in apart[1:]), apart[0] * apart[0]))
    met = spread.join(own(right, "b"), ["cx", "cy"]).select("a", "b", far.alias("dist"))
    return met.where(F.col("dist") <= within if closed else F.col("dist") < within)


def overlap_pairs(boxes: DataFrame) -> DataFrame:
    """(dataset, image_id, a, b): overlapping boxes of one image, each pair once, and each box with itself."""
    l, r = boxes.alias("l"), boxes.alias("r")  # noqa: E741
    touch = F.expr("l.x <= r.x + r.w and r.x <= l.x + l.w and l.y <= r.y + r.h and r.y <= l.y + l.h")
    on = F.expr("l.dataset = r.dataset and l.image_id = r.image_id and l.det_id <= r.det_id") & touch
    return l.join(r, on).select("l.dataset", "l.image_id", F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b"))


def box_pairs(left: DataFrame, right: DataFrame, cell: float, *keys: str, crowded: int = 10_000, finer: int = 16) -> DataFrame:
    """Rows of both sides (columns l_* and r_*) whose boxes (x, y, w, h) touch and that agree in ``keys``; no image needed.

    Boxes are dealt to all cells of a grid that they touch; an equality join brings a cell's boxes together, and of
    the cells that two boxes share the one that holds the upper left corner of their common part gives the pair,
    so each comes once. Cells with over ``crowded`` boxes (and over a partition's share, so fewer than there are
    partitions) are dealt again to finer ones. ``cell`` should not be far below the usual size of a box.
    """
    cells = [*keys, "cx", "cy"]

    def spans(low: Column, high: Column, size: float) -> Column:
        return F.sequence(F.floor(low / size), F.floor(high / size))

    def dealt(side: DataFrame, p: str) -> DataFrame:
        rows = side.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in side.columns])
        for axis, length, out in (("x", "w", "cx"), ("y", "h", "cy")):
            rows = rows.withColumn(out, F.explode(spans(F.col(f"{p}{axis}"), F.col(f"{p}{axis}") + F.col(f"{p}{length}"), cell)))
        return rows

    def split(rows: DataFrame, hot: DataFrame, p: str) -> DataFrame:
        rows, size = rows.join(hot, cells, "left"), cell / finer
        for axis, length, own, out in (("x", "w", "cx", "fx"), ("y", "h", "cy", "fy")):
            low, high = F.col(f"{p}{axis}"), F.col(f"{p}{axis}") + F.col(f"{p}{length}")
            inner = F.sequence(F.greatest(F.floor(low / size), F.col(own) * finer), F.least(F.floor(high / size), F.col(own) * finer + finer - 1))
            rows = rows.withColumn(out, F.explode(F.when(F.col("hot"), inner).otherwise(F.array(F.lit(-1).cast("long")))))
        return rows

    one, other = dealt(left, "l_"), dealt(right, "r_")
    share = max(crowded, other.count() // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(other.groupBy(*cells).count().where(F.col("count") > share).select(*cells, F.lit(True).alias("hot")))
    met = split(one, hot, "l_").join(split(other, hot, "r_").drop("hot"), [*cells, "fx", "fy"])
    touch = F.expr("l_x <= r_x + r_w and r_x <= l_x + l_w and l_y <= r_y + r_h and r_y <= l_y + l_h")
    corner = lambda c, size: F.floor(F.greatest(f"l_{c}", f"r_{c}") / size)
    once = (corner("x", cell) == F.col("cx")) & (corner("y", cell) == F.col("cy"))
    finely = F.col("hot").isNull() | ((corner("x", cell / finer) == F.col("fx")) & (corner("y", cell / finer) == F.col("fy")))
    return met.where(touch & once & finely).drop(*cells, "fx", "fy", "hot")


def grid_cells(points: DataFrame, size: float, minx: float = 0.0, miny: float = 0.0) -> DataFrame:
    """Points with the cells that hold them; edges belong to both sides, as a closed intersection has it."""
    places = lambda c, low: F.array_distinct(F.array(F.floor((F.col(c) - low) / size), F.ceil((F.col(c) - low) / size) - 1))
    return points.withColumn("ix", F.explode(places("x", minx))).withColumn("iy", F.explode(places("y", miny))).where("ix >= 0 and iy >= 0")
