"""Tiles over images, annotations clipped to tiles, negative tiles, splits and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panolake.functions.geometry import clip_span
from panolake.operators.ranges import keeper


def tiles(images: DataFrame, size: int = 512, overlap_x: int = 44, overlap_y: int = 8, padding: int = 736) -> DataFrame:
    """One row per tile corner of every image: columns from 0, rows from the padding."""
    across = F.sequence(F.lit(0), F.col("width") - overlap_x - 1, F.lit(size - overlap_x))
    down = F.sequence(F.lit(padding), F.col("height") - padding - overlap_y - 1, F.lit(size - overlap_y))
    rows = images.withColumn("base", F.regexp_replace("file_name", r"\.\w+$", ""))  # once an image
    rows = rows.withColumn("min_x", F.explode(across)).withColumn("min_y", F.explode(down))
    return rows.withColumn("tile", F.concat("base", F.lit("_"), F.col("min_x"), F.lit("_"), F.col("min_y"), F.lit(".jpg"))).drop("base")


def tiles_of_boxes(boxes: DataFrame, size: int = 512, overlap_x: int = 44, overlap_y: int = 8, padding: int = 736, width: int = 8000, height: int = 4000) -> DataFrame:
    """Each box with every tile that it truly overlaps, by arithmetic instead of a range join, and clipped to it."""
    def corners(low: Column, length: Column, start: int, step: int, stop: int) -> Column:
        first = F.greatest(F.floor((low - start - size) / step) + 1, F.lit(0))
        last = F.least(F.ceil((low + length - start) / step) - 1, F.lit(max(0, -(-(stop - start) // step) - 1)))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: (start + i * step).cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = boxes.withColumn("min_x", F.explode(corners(F.col("x"), F.col("w"), 0, size - overlap_x, width - overlap_x)))
    rows = rows.withColumn("min_y", F.explode(corners(F.col("y"), F.col("h"), padding, size - overlap_y, height - padding - overlap_y)))
    rows = rows.withColumn("cx", clip_span(F.col("x") - F.col("min_x"), F.col("w"), size)).withColumn("cy", clip_span(F.col("y") - F.col("min_y"), F.col("h"), size))
    return rows.select("*", F.col("cx.origin").alias("tile_x"), F.col("cy.origin").alias("tile_y"), F.col("cx.length").alias("tile_w"), F.col("cy.length").alias("tile_h")).drop("cx", "cy")


def blackened(origin: Column, length: Column, size: int = 512, by: float = 1.1) -> Column:
    """Far side of a rejected box, enlarged and capped at the tile."""
    return F.least(origin + F.rint(length * by).cast("int"), F.lit(size))


def extent_grid(extent: DataFrame, cell: float, overlap: float = 0.0) -> DataFrame:
    """Cells that cover each extent (minx, miny, maxx, maxy), named by their rounded lower corner."""
    step = cell - overlap
    n = lambda low, high: F.ceil((F.col(high) - F.col(low) - overlap) / step).cast("int")
    rows = extent.withColumn("ix", F.explode(F.sequence(F.lit(0), n("minx", "maxx") - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), n("miny", "maxy") - 1)))
    rows = rows.withColumn("cell_x", F.col("minx") + F.col("ix") * step).withColumn("cell_y", F.col("miny") + F.col("iy") * step)
    return rows.withColumn("id", F.concat(F.bround("cell_x").cast("long"), F.lit(", "), F.bround("cell_y").cast("long")))


def low_tiles(rows: DataFrame, ratio: float = 0.5) -> DataFrame:
    return rows.where(F.col("min_y") >= F.col("height") * ratio)


def negatives_needed(n: Column, share: float) -> Column:
    return F.ceil(n * share / (1 - share))


def order_key(*columns: str, seed: int = 42) -> Column:
    """A fixed pseudo-random order that both engines can work out."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def first_rows(rows: DataFrame, keys: list[str], counts: DataFrame, cuts: list[str], key: str, after: Column | None = None, below_only: bool = False) -> DataFrame:
    """``rows`` with ``below``: for each of ``cuts``, columns of numbers in ``counts`` (one row per ``keys``), whether
    a row is among so many first rows of its keys, in the fixed order of ``key``; those with ``after`` true come last.

    A histogram of the order's first four digits tells in which bucket a cut lies; rows are ranked inside
    buckets, so that no group of rows is sorted as a whole. With ``below_only`` later buckets go before that.
    """
    order = order_key(key)
    bucket = F.conv(F.substring(order, 1, 4), 16, 10).cast("int") + F.when(after, 1 << 16).otherwise(0) if after is not None else F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    rows = rows.withColumn("bucket", bucket)
    running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    held = histogram.join(counts, keys)
    places = [F.max(F.when(F.col("before") < F.col(c), F.struct("bucket", "before"))).alias(f"at_{c}") for c in cuts]
    cut = held.groupBy(*keys).agg(*places, *[F.first(c).alias(c) for c in cuts])
    marked = rows.join(F.broadcast(cut), keys)
    if below_only:
        marked = marked.where(F.col("bucket") <= F.greatest(*[F.col(f"at_{c}.bucket") for c in cuts], F.lit(-1)))
    every = marked.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(order, key)))
    below = [F.coalesce((F.col("bucket") < F.col(f"at_{c}.bucket")) | ((F.col("bucket") == F.col(f"at_{c}.bucket")) & (F.col(f"at_{c}.before") + F.col("k") <= F.col(c))), F.lit(False)) for c in cuts]
    return every.withColumn("below", F.array(*below)).drop("bucket", "k", *cuts, *[f"at_{c}" for c in cuts])


def sample_negatives(empty: DataFrame, positives: DataFrame, keys: list[str], share: float, low: Column) -> DataFrame:
    """Per key as many empty tiles as needed for ``share``, low ones first, in the fixed order."""
    keep = keeper(empty.sparkSession)
    need = keep(positives.groupBy(*keys).agg(negatives_needed(F.count("*"), share).alias("need")))
    lowest = empty.where(F.coalesce(low, F.lit(True)))
    # Few of many tiles are taken: where the low ones suffice, those early enough in the order are hashed and kept once.
    bounds = keep(need.join(lowest.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left"))
    if bounds.where("need > coalesce(n, 0)").isEmpty():
        first = F.conv(F.substring(order_key("tile"), 1, 4), 16, 10).cast("int")
        upto = ((F.col("need") + 6 * F.sqrt("need") + 10) / F.col("n") * (1 << 16)).alias("upto")
        early = keep(lowest.join(F.broadcast(bounds.select(*keys, upto)), keys).where(first <= F.col("upto")).select(*empty.columns))
        if need.join(early.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").where("need > coalesce(n, 0)").isEmpty():
            empty = early
    return first_rows(empty, keys, need, ["need"], "tile", ~low, below_only=True).where(F.get("below", 0)).drop("below")


def split(images: DataFrame, key: str, group: str, train: float = 0.7) -> DataFrame:
    """trn, val, tst per group: 70 % of the rows, then halves of the rest, in the fixed order."""
    n = images.groupBy(group).agg(F.count("*").alias("n")).withColumn("trn", F.rint(F.col("n") * train))
    n = n.select(group, "trn", (F.col("trn") + F.rint((F.col("n") - F.col("trn")) * 0.5)).alias("val"))
    rows = first_rows(images, [group], n, ["trn", "val"], key)
    return rows.withColumn("dataset", F.when(F.get("below", 0), "trn").when(F.get("below", 1), "val").otherwise("tst")).drop("below")


def split_modes(images: DataFrame, valid: DataFrame, key: str, group: str, test_only: bool = False) -> DataFrame:
    """``dataset`` of every image: that of the split of the validated ones (all ``tst`` with ``test_only``), ``oth`` for the rest."""
    known = images.join(valid.select(key).distinct(), key, "left_semi")
    placed = known.withColumn("dataset", F.lit("tst")) if test_only else split(known, key, group)
    return images.join(placed.select(key, group, "dataset"), [key, group], "left").na.fill("oth", ["dataset"])


def shifted_ids(images: DataFrame, group: str, key: str) -> DataFrame:
    """Ids made unique over groups: each group's ids start after the running sum of the earlier maxima."""
    most = images.groupBy(group).agg((F.max(key) + 1).alias("next"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    offset = most.select(group, F.coalesce(F.sum("next").over(before), F.lit(0)).alias("offset"))
    return images.join(F.broadcast(offset), group).withColumn("new_id", F.col(key) + F.col("offset"))


def clip_chain(images: DataFrame, boxes: DataFrame, valid: DataFrame, width: int = 8000, height: int = 4000, size: int = 512, overlap_x: int = 44, overlap_y: int = 8, padding: int = 736) -> DataFrame:
    """Every annotation (image_id, ann_id, x, y, w, h) and what becomes of it, tile by tile.

    A validated annotation of the same image and id takes the place of the original; one without is rejected.
    ``outcome`` is ``outside`` the image or ``padding`` (one row without a tile), ``border`` (all corners near
    the same pair of tile edges), ``rejected`` or ``kept``. Boxes are cut to their tile.
    """
    sides = ["x", "y", "w", "h"]
    own = valid.select("image_id", "ann_id", *[F.col(c).alias(f"valid_{c}") for c in sides])
    rows = boxes.join(images.select("image_id"), "image_id", "left_semi").join(own, ["image_id", "ann_id"], "left").withColumn("known", F.col("valid_x").isNotNull())
    rows = rows.select("image_id", "ann_id", "known", *[F.coalesce(f"valid_{c}", c).alias(c) for c in sides])
    outside = (F.col("x") + F.col("w") <= 0) | (F.col("x") >= width) | (F.col("y") + F.col("h") <= 0) | (F.col("y") >= height)
    rows = rows.withColumn("early", F.when(outside, "outside").when(F.col("y") > height - padding, "padding"))
    tiled = tiles_of_boxes(rows.where("early is null"), size, overlap_x, overlap_y, padding, width, height)
    near = lambda low, length: F.forall(F.array(low, low + length), lambda v: (v <= 0.02 * size) | (v >= 0.98 * size))
    border = near(F.col("tile_x"), F.col("tile_w")) | near(F.col("tile_y"), F.col("tile_h"))
    tiled = tiled.withColumn("outcome", F.when(border, "border").when(~F.col("known"), "rejected").otherwise("kept"))
    columns = ["image_id", "ann_id", "outcome", "min_x", "min_y", "tile_x", "tile_y", "tile_w", "tile_h"]
    return tiled.select(*columns).unionByName(rows.where("early is not null").select("image_id", "ann_id", F.col("early").alias("outcome")), allowMissingColumns=True)
