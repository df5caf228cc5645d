"""Hand cases, properties and plans of the detection engine."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panolake.fixtures import view
from panolake.functions import camera, fitting, geometry
from panolake.operators import control, matching, merging, spatial, tiling, triangulation
from panolake.plans.catalog import ORACLE, QUERIES, keeper
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def box(*v):
    return {s: F.lit(x) for s, x in zip("xywh", v, strict=True)}


def test_hand_cases(spark):
    got = one(
        spark,
        geometry.clip_span(F.lit(-10), F.lit(50), 512), geometry.clip_span(F.lit(500), F.lit(50), 512), geometry.clamp(F.lit(600), F.lit(0), 512), geometry.clamp(F.lit(10), F.lit(20), 512),
        tiling.negatives_needed(F.lit(2), 0.33), geometry.parse_frame_name(F.lit("102-lb4-0-35582.jpg")), geometry.nearest_nonzero(F.array(*map(F.lit, (0, 5, 0, 0, 7)))),
        geometry.box_iou(box(0, 0, 2, 2), box(1, 0, 2, 2)), F.size(geometry.ring(F.array(*map(F.lit, (1, 2, 3, 4))))), geometry.half_even(F.lit(0.0005), 3), geometry.parse_frame_name(F.lit("a-b.jpg")),
        geometry.parse_tile_name(F.lit("x/y_dig_468_736.jpg")),
    )
    assert tuple(got[0]) == (0, 40) and tuple(got[1]) == (500, 12) and got[2:5] == (512, 0, 1)
    assert tuple(got[5]) == ("102-35582", "lb4", "0") and got[6] == [5, 5, 5, 7, 7] and got[7] == pytest.approx(2 / 6)
    assert got[8] == 0 and got[9] == 0.0 and tuple(got[10]) == (None, None, None) and tuple(got[11]) == ("y_dig", 468, 736)


def test_tile_count(spark):
    image = spark.createDataFrame([("a.jpg", 8000, 4000)], "file_name string, width int, height int")
    got = tiling.tiles(image)
    assert got.count() == 85 and got.select("min_x").distinct().count() == 17 and got.select("min_y").distinct().count() == 5


def test_two_stage_match(spark):
    side = "dataset string, image_id long, x int, y int, w int, h int"
    dets = spark.createDataFrame([("trn", 1, 0, 0, 100, 95, 1, 0, 0.9), ("trn", 1, 0, 0, 100, 80, 2, 0, 0.8)], f"{side}, det_id long, det_class int, score double")
    labels = spark.createDataFrame([("trn", 1, 0, 0, 100, 100, 1, 1), ("trn", 1, 0, 0, 100, 45, 2, 1)], f"{side}, label_id long, label_class int")
    tags = {(r["tag"], r["label_id"], r["det_id"]) for r in matching.tagged(dets, labels).collect()}
    assert tags == {("TP", 1, 1), ("FP", None, 2), ("FN", 2, None)}
    nothing = matching.tagged(dets, labels.limit(0))
    assert [r["tag"] for r in nothing.collect()] == ["FP", "FP"]


def test_conservation(spark):
    tags = QUERIES["match_tagged"](spark, SF)
    n = {r["tag"]: r["count"] for r in tags.groupBy("tag").count().collect()}
    assert n["TP"] + n["FP"] == 900 and n["TP"] + n["FN"] == 200 and 0 < n["TP"] < 180
    heat = QUERIES["heatmap_grid"](spark, SF).agg(F.sum("n")).first()[0]
    assert heat >= n["FP"] + n["FN"]
    assert set(ORACLE) <= set(QUERIES)


def test_clipped_boxes_stay_in_tiles(spark):
    rows = QUERIES["tile_annotations"](spark, SF).toPandas()
    assert (rows.tile_x >= 0).all() and (rows.tile_y >= 0).all() and (rows.tile_w > 0).all() and (rows.tile_x + rows.tile_w <= 512).all() and (rows.tile_y + rows.tile_h <= 512).all()


def test_split_is_exact(spark):
    counts = {(r["aoi"], r["dataset"]): r["count"] for r in QUERIES["dataset_split"](spark, SF).groupBy("aoi", "dataset").count().collect()}
    for aoi in ("NE", "SZH"):
        n = sum(v for k, v in counts.items() if k[0] == aoi)
        assert counts[aoi, "trn"] == round(n * 0.7)


@pytest.mark.parametrize("name", ["match_metrics", "overlap_pairs", "nearby_gt", "distance_count", "ray_pairs", "tile_annotations"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_camera_round_trips(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(-1, 1, (50, 9))], ", ".join(f"v{i} double" for i in range(9)))
    p, q, a = (tuple(F.col(f"v{i}") * 10 for i in range(k, k + 3)) for k in (0, 3, 6))
    turn = tuple(F.col(f"v{i}") for i in range(6, 9))
    back = camera.to_local(camera.to_camera(p, q, *a), q, *a)
    world = camera.frame_to_world(camera.world_to_frame(p, q, turn), q, turn)
    u, v = camera.spherical_pixel(p, 8000, 4000)
    seen = camera.spherical_point(u, v, camera.length(p), 8000, 4000)
    opk = camera.opk_of(camera.opk_matrix(*turn))
    gaps = [F.abs(x - y) for got, want in ((back, p), (world, p), (seen, p), (opk, turn)) for x, y in zip(got, want, strict=True)]
    assert rows.agg(*[F.max(g) for g in gaps]).first() == pytest.approx([0] * 12, abs=1e-8)
    level = one(spark, *camera.spherical_pixel((F.lit(0.0), F.lit(0.0), F.lit(1.0)), 8000, 4000))
    assert level == (4000.0, 2000.0)
    u, v = camera.pinhole_pixel(camera.pinhole_ray(F.lit(300.0), F.lit(1500.0), 2048), 2048)
    assert one(spark, u, v) == pytest.approx((300.0, 1500.0))


def test_parallel_rays_never_meet(spark):
    rows = [(i, i, 5.0 * i, 0.0, 3.0, 0.0, 1.0, 0.0) for i in range(4)]
    rays = spark.createDataFrame(rows, "frame_id long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert triangulation.ray_pairs(rays).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=3))
def test_slab_areas(boxes):
    rings = [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float) for x, y, w, h in boxes]
    cells = [{(i, j) for i in range(x, x + w) for j in range(y, y + h)} for x, y, w, h in boxes]
    union, common = fitting.slab_areas(rings)
    assert union == pytest.approx(len(set.union(*cells))) and common == pytest.approx(len(set.intersection(*cells)))


def test_fits():
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    turn = 0.4
    x, y = 5 * np.cos(t), 2 * np.sin(t)
    points = np.stack([100 + x * math.cos(turn) - y * math.sin(turn), 50 + x * math.sin(turn) + y * math.cos(turn)], 1)
    cx, cy, a, b, angle = fitting.ellipse(points)
    assert (cx, cy) == pytest.approx((100, 50)) and sorted((a, b)) == pytest.approx([2, 5])
    assert fitting.ellipse(points[:4]) is None
    normal, far = fitting.plane(np.array([(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1.1)], float))
    assert abs(normal[2]) > 0.9 and far < 0.05
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert abs(fitting.shoelace(fitting.clip_convex(square, square + 1))) == pytest.approx(1)


def test_arrow_functions(spark):
    square = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    rows = spark.createDataFrame([(square(0.0), square(1.0))], f"a {fitting.RING}, b {fitting.RING}")
    got = rows.select(fitting.polygon_iou("a", "b"), fitting.union_area(F.array("a", "b")), fitting.fit_ellipse("a")["cx"], geometry.area(F.col("a"))).first()
    assert got[0] == pytest.approx(2 / 6) and got[1] == pytest.approx(6) and got[3] == 4


def test_greedy_matches_one_by_one(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(rng.integers(0, 20)) / 10) for a in range(15) for b in range(15) if rng.random() < 0.4]
    used_a, used_b, want = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in rows):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    got = matching.greedy_one_to_one(spark.createDataFrame(rows, "a long, b long, dist double"), keeper(spark))
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_review_and_status(spark):
    rows = spark.createDataFrame([(0.2, None), (0.5, "TP"), (0.7, None), (None, "FN")], "score double, tag string")
    assert sorted((r["score"], r["tag"]) for r in control.review(rows).collect()) == [(0.5, "TP"), (0.7, "oth")]


def test_merge_of_tiles(spark):
    boxes = spark.createDataFrame([(1, "a", 7, 0, 0, 10, 10, 468, 736, 0.5), (2, "a", 7, 8, 0, 10, 10, 468, 736, 0.9), (3, "a", 7, 200, 0, 5, 5, 468, 736, 0.4)], "det_id long, dataset string, image_id long, x int, y int, w int, h int, min_x int, min_y int, score double")
    moved = merging.to_panorama(boxes)
    got = merging.merged_boxes(moved, merging.overlap_groups(moved, keeper(spark))).orderBy("id").collect()
    assert [(r["id"], r["x"], r["w"], r["members"], r["score"]) for r in got] == [(1, 467, 20, 2, pytest.approx(0.7)), (3, 667, 7, 1, 0.4)]


def test_grid_edges(spark):
    points = spark.createDataFrame([(100.0, 50.0), (150.0, 150.0)], "x double, y double")
    assert spatial.grid_cells(points, 100.0).count() == 3


def test_frame_order_draws_in_a_second_pass(spark):
    rows = [(0, i, 5.0 * i, 0.0, 0.0, i) for i in range(6)] + [(0, 10 + i, 5.0 * i + 1, 0.0, 0.0, 100 + i) for i in range(6)]
    frames = spark.createDataFrame(rows, "trajectory long, frame_id long, x double, y double, z double, t long")
    got = [r["frame_id"] for r in triangulation.frame_order(frames).orderBy("place").collect()]
    assert sorted(got) == sorted(r[1] for r in rows) and got.index(10) < got.index(5) and got[0] == 0


def test_views_reach_the_scan(spark):
    plan = view(spark, SF, "fx_labels").select("label_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan
