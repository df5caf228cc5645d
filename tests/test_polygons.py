"""Spatial merge join, polygon matching and merging against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panolake.operators import matching, merging, spatial
from panolake.plans.catalog import keeper


def boxes(rng, n, size, wide):
    return [(i, float(x), float(y), float(w), float(h), int(k)) for i, (x, y, w, h, k) in enumerate(zip(*(rng.random((2, n)) * size - size / 3), *(rng.random((2, n)) * wide), rng.integers(0, 2, n)))]


@pytest.mark.parametrize(("crowded", "cell"), [(10_000, 10.0), (5, 40.0), (1, 200.0)])
def test_each_pair_of_touching_boxes_comes_once(spark, crowded, cell):
    rng = np.random.default_rng(crowded)
    left, right = boxes(rng, 250, 100, 12), boxes(rng, 300, 100, 30)
    schema = "id int, x double, y double, w double, h double, k int"
    one, other = (spark.createDataFrame(rows, schema) for rows in (left, right))
    pairs = spatial.box_pairs(one, other, cell, "k", crowded=crowded)
    got = sorted((r["l_id"], r["r_id"]) for r in pairs.collect())
    expected = sorted((a[0], b[0]) for a in left for b in right if a[5] == b[5] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4])
    assert got == expected
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def square(x, y, w, h=None):
    h = h or w
    return [float(c) for c in (x, y, x + w, y, x + w, y + h, x, y + h)]


def test_matching_by_outlines_needs_no_image(spark):
    diamond = lambda x, y, r: [[float(c) for c in (x - r, y, x, y - r, x + r, y, x, y + r)]]
    # The boxes of 1 and 10 overlap by a ninth, their outlines do not; 2 lies over 11 and 12, better over 12.
    dets = spark.createDataFrame([("a", 1, 0.9, 0, diamond(0, 0, 3)), ("a", 2, 0.8, 0, diamond(50, 0, 4)), ("b", 3, 0.7, 0, [square(0, 0, 2)]), ("b", 4, 0.7, 0, None)], "dataset string, det_id int, score double, det_class int, segmentation array<array<double>>")
    labels = spark.createDataFrame([("a", 10, 1, diamond(4, 4, 3)), ("a", 11, 1, diamond(53, 0, 4)), ("a", 12, 1, diamond(51, 0, 4)), ("b", 13, 2, [square(0, 0, 2)])], "dataset string, label_id int, label_class int, segmentation array<array<double>>")
    pairs = matching.polygon_pairs(dets, labels, 10.0)
    got = {(r["det_id"], r["label_id"]): r["iou"] for r in pairs.collect()}
    assert set(got) == {(2, 11), (2, 12), (3, 13)} and got[(3, 13)] == pytest.approx(1) and got[(2, 12)] == pytest.approx(24.5 / 39.5)
    tags = {(r["tag"], r["det_id"], r["label_id"]) for r in matching.tagged(dets, labels, pairs=pairs).collect()}
    assert tags == {("FP", 1, None), ("TP", 2, 12), ("FP", 3, None), ("FP", 4, None), ("FN", None, 10), ("FN", None, 11), ("FN", None, 13)}


def test_merged_outlines_keep_holes_and_count_scores(spark):
    # Four bars make a frame with a hole; 5 stands alone; 6 and 7 touch only once grown; 8 is another dataset's.
    parts = {1: square(0, 0, 30, 5), 2: square(0, 25, 30, 5), 3: square(0, 0, 5, 30), 4: square(25, 0, 5, 30), 5: square(100, 100, 4), 6: square(200, 0, 5), 7: square(206, 0, 5), 8: square(0, 0, 5)}
    rows = [(i, "b" if i == 8 else "a", 1, 1 + i % 2, i / 10, [s], 0, 0) for i, s in parts.items()]
    tiles = spark.createDataFrame(rows, "det_id int, dataset string, image_id int, category_id int, score double, segmentation array<array<double>>, min_x int, min_y int")
    keep = keeper(spark)
    moved = keep(merging.outlines_to_panorama(tiles.withColumns({"min_x": F.lit(10), "min_y": F.lit(20)})))
    groups = keep(merging.outline_groups(moved, keep))
    got = {r["id"]: r for r in merging.merged_outlines(moved, groups, keep, at_once=2).collect()}
    assert {i: r["members"] for i, r in got.items()} == {1: 4, 5: 1, 6: 2, 8: 1}
    assert got[1]["area"] == pytest.approx(30 * 30 - 20 * 20 + 4 * (1 - np.pi / 4), rel=1e-3) and len(got[1]["segmentation"]) == 2
    assert (got[1]["x"], got[1]["y"], got[1]["w"], got[1]["h"]) == pytest.approx((10, 20, 30, 30), abs=0.01) and got[1]["category_id"] == 2
    assert got[6]["area"] == pytest.approx(55, rel=0.02) and got[1]["score"] == pytest.approx(0.25)
    # Bars 1 and 2 meet 3 and 4: with pairs counted, each bar has two sides of its own and two of others.
    again = {r["id"]: r["score"] for r in merging.merged_outlines(moved, groups, keep, once=False).collect()}
    assert again[1] == pytest.approx(0.25) and again[6] == pytest.approx(0.65)
