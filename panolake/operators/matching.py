"""Detections against labels: candidate pairs, two-stage best match, tags, metrics, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panolake.functions import overlay
from panolake.functions.geometry import box_iou, boxes_overlap, half_even, segmentation_box
from panolake.operators.ranges import settled, spread
from panolake.operators.spatial import box_pairs

SIDES = ("x", "y", "w", "h")


def candidate_pairs(dets: DataFrame, labels: DataFrame) -> DataFrame:
    """det_id, label_id, iou, score, dataset of overlapping boxes of one image; an equality join on the image."""
    d, l = dets.alias("d"), labels.alias("l")  # noqa: E741
    a, b = ({s: F.col(f"{t}.{s}") for s in SIDES} for t in "dl")
    on = (F.col("d.image_id") == F.col("l.image_id")) & (F.col("d.dataset") == F.col("l.dataset")) & boxes_overlap(a, b)
    return d.join(l, on).select("d.det_id", "l.label_id", "d.dataset", "d.image_id", "d.score", "l.label_class", "d.det_class", box_iou(a, b).alias("iou"))


def polygon_pairs(dets: DataFrame, labels: DataFrame, cell: float, *keys: str) -> DataFrame:
    """As ``candidate_pairs`` for outlines (``segmentation``) that share area, found by place: no image is needed.

    ``keys`` (the image in panoramas, none on the map) must agree beside the dataset; boxes meet by cells of size ``cell``, IoU is that of the outlines.
    """
    extra = [k for k in keys if k != "image_id"]
    image = [F.col("image_id")] if "image_id" in keys else [F.lit(None).cast("long").alias("image_id")]
    def boxed(rows: DataFrame, *names: str) -> DataFrame:
        # Outlines and their boxes are worked out once, by all tasks: dealing to cells names each side of a box several times.
        rows = settled(spread(rows.select("dataset", *image, *extra, *names)), {"segmentation": F.col("segmentation")})
        rows = settled(rows, {"box": segmentation_box("segmentation")})
        return rows.where("box is not null").select("*", "box.*").drop("box")

    pairs = box_pairs(boxed(dets, "det_id", "score", "det_class", "segmentation"), boxed(labels, "label_id", "label_class", "segmentation"), cell, "dataset", *keys)
    names = ["l_det_id", "r_label_id", "l_dataset", "l_image_id", "l_score", "r_label_class", "l_det_class"]
    found = pairs.select(*[F.col(c).alias(c[2:]) for c in names], "l_segmentation", "r_segmentation")
    return settled(found, {"iou": overlay.iou("l_segmentation", "r_segmentation")}).drop("l_segmentation", "r_segmentation").where("iou > 0")


def best_label(pairs: DataFrame, least_iou: float = 0.25) -> DataFrame:
    """Each detection commits to its best label, ties to the smaller label_id; then the IoU threshold holds."""
    rank = Window.partitionBy("dataset", "det_id").orderBy(F.desc("iou"), "label_id")
    return pairs.withColumn("k", F.row_number().over(rank)).where((F.col("k") == 1) & (F.col("iou") >= least_iou)).drop("k")


def best_detection(chosen: DataFrame, *more_keys: str) -> DataFrame:
    """Each label keeps its best detection, ties to the smaller det_id; losers stay unmatched."""
    rank = Window.partitionBy("dataset", "image_id", "label_id", *more_keys).orderBy(F.desc("iou"), "det_id")
    return chosen.withColumn("k", F.row_number().over(rank)).where("k = 1").drop("k")


def tagged(dets: DataFrame, labels: DataFrame, least_iou: float = 0.25, pairs: DataFrame | None = None) -> DataFrame:
    """dataset, tag (TP, FP, FN), label_id, det_id, score, iou, label_class, det_class: every detection and every label once.

    Classes count from 1 in labels and from 0 in detections; a match of two classes is a false and a missing one.
    ``pairs`` are those of outlines (``polygon_pairs``), else boxes of one image meet.
    """
    matched = best_detection(best_label(candidate_pairs(dets, labels) if pairs is None else pairs, least_iou))
    right_class = F.col("label_class") == F.col("det_class") + 1
    matched = matched.where(right_class).select("dataset", "det_id", "label_id", half_even(F.col("iou"), 3).alias("iou"), "label_class")
    of_dets = dets.join(matched, ["dataset", "det_id"], "left").select("dataset", F.when(F.col("label_id").isNull(), "FP").otherwise("TP").alias("tag"), "label_id", "det_id", "score", "iou", "label_class", "det_class")
    missed = labels.join(matched, ["dataset", "label_id"], "left_anti")
    return of_dets.unionByName(missed.select("dataset", F.lit("FN").alias("tag"), "label_id", "label_class"), allowMissingColumns=True)


def ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 from counts; 0 where a denominator is 0."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a.cast("double") / b)
    return [share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]


def metrics(tags: DataFrame, *keys: str) -> DataFrame:
    count = lambda tag: F.count_if(F.col("tag") == tag).alias(tag)
    counted = tags.groupBy(*keys).agg(count("TP"), count("FP"), count("FN"))
    return counted.select(*keys, "TP", "FP", "FN", *ratios(F.col("TP"), F.col("FP"), F.col("FN")))


def averages(by_class: DataFrame) -> DataFrame:
    """Macro, weighted macro and micro averages of per-class counts (class, TP, FP, FN).

    The weighted average multiplies by a class's share of labels and divides by the number of classes,
    as the metric is defined; with one class the two divisions agree.
    """
    p, r, _ = ratios(F.col("TP"), F.col("FP"), F.col("FN"))
    totals = by_class.agg(F.sum(F.col("TP") + F.col("FN")).alias("labels"), F.count("*").alias("classes"))
    rows = by_class.select("*", p.alias("p"), r.alias("r")).join(F.broadcast(totals))
    share = (F.col("TP") + F.col("FN")) / F.col("labels")
    summed = rows.agg(F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.sum(F.col("p") * share / F.col("classes")).alias("weighted_p"), F.sum(F.col("r") * share / F.col("classes")).alias("weighted_r"), F.sum("TP").alias("TP"), F.sum("FP").alias("FP"), F.sum("FN").alias("FN"))
    micro_p, micro_r, _ = ratios(F.col("TP"), F.col("FP"), F.col("FN"))
    return summed.select("macro_p", "macro_r", "weighted_p", "weighted_r", micro_p.alias("micro_p"), micro_r.alias("micro_r"))


def threshold_sweep(dets: DataFrame, labels: DataFrame, first: int = 5, last: int = 95, step: int = 5, least_iou: float = 0.25, pairs: DataFrame | None = None) -> DataFrame:
    """Counts and ratios at each score threshold (hundredths). Pairs are found once; the second stage of
    the match is done again for each threshold, as its winner depends on who is left."""
    chosen = best_label(candidate_pairs(dets, labels) if pairs is None else pairs, least_iou)
    scores = lambda df: df.withColumn("t", F.explode(F.sequence(F.lit(first), F.least(F.floor(F.col("score") * 100 + 1e-9).cast("int"), F.lit(last)), F.lit(step)))).where("score >= t / 100d")
    enough = F.col("score") >= first / 100
    tp = best_detection(scores(chosen.where(enough)), "t").groupBy("t").agg(F.count("*").alias("TP"))
    # Detections at or above a threshold: count per score step, then a running sum over the few steps.
    steps = dets.where(enough).groupBy((F.least(F.floor((F.col("score") * 100 + 1e-9 - first) / step), F.lit((last - first) // step)) * step + first).cast("int").alias("t")).agg(F.count("*").alias("n"))
    grid = dets.sparkSession.range(first, last + 1, step).select(F.col("id").cast("int").alias("t"))
    above = grid.join(steps, "t", "left").select("t", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("t"))), F.lit(0)).alias("dets"))
    total = labels.agg(F.count("*").alias("labels"))
    rows = above.join(tp, "t", "left").join(F.broadcast(total)).select("t", F.coalesce("TP", F.lit(0)).alias("TP"), "dets", "labels")
    rows = rows.select((F.col("t") / 100).alias("threshold"), "TP", (F.col("dets") - F.col("TP")).alias("FP"), (F.col("labels") - F.col("TP")).alias("FN"))
    return rows.select("threshold", "TP", "FP", "FN", *ratios(F.col("TP"), F.col("FP"), F.col("FN")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the greatest F1, the lowest threshold on ties."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def confusion(tags: DataFrame, classes: list[str]) -> DataFrame:
    """Rows of true classes, columns of predicted ones, ``background`` for missing and false ones; ``classes`` in order of their numbers."""
    names = F.array(*map(F.lit, classes))
    true = F.when(F.col("tag") == "FP", "background").otherwise(F.get(names, (F.col("label_class") - 1).cast("int")))
    predicted = F.when(F.col("tag") == "FN", "background").otherwise(F.get(names, F.col("det_class").cast("int")))
    return tags.select(true.alias("true_class"), predicted.alias("predicted")).groupBy("true_class").pivot("predicted", [*classes, "background"]).count().na.fill(0)


def greedy_one_to_one(pairs: DataFrame, keep) -> DataFrame:
    """(a, b, dist): pairs taken by ascending distance while both ends are free.

    Rounds take every pair that is the least of both its ends; the order (dist, a, b) is total, so the
    result is that of the one-by-one walk. A round settles the least pair left at least, and rounds go on
    until none is left: as many as the longest chain of pairs that wait for each other. Pairs of a null end
    match nothing. ``keep`` cuts lineage between rounds.
    """
    left, taken = keep(pairs.where("a is not null and b is not null").select("a", "b", "dist")), None
    while True:
        order = ["dist", "a", "b"]
        ranked = left.withColumn("ka", F.row_number().over(Window.partitionBy("a").orderBy(*order))).withColumn("kb", F.row_number().over(Window.partitionBy("b").orderBy(*order)))
        now = keep(ranked.where("ka = 1 and kb = 1").select("a", "b", "dist"))
        taken = now if taken is None else taken.unionByName(now)
        left = keep(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
        if left.isEmpty():
            break
    return taken
