"""What shows on larger tables only: evaluations that part, values worked out again, rounds over rows still to come."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from panolake.fixtures import view
from panolake.functions import camera, fitting, geometry, overlay
from panolake.operators import areas, drive, fits, merging, ranges, rays, tiling, triangulation, truth, validation
from panolake.plans import chains, documents
from panolake.sources import coco, flatgeobuf, tables, united
from pyspark.sql import functions as F


def test_review_steps_do_not_go_over_all_later_rows_again(spark):
    rows = spark.range(9).select("id", (F.col("id") % 3 == 0).alias("validated"), F.lit(False).alias("removed"))
    steps = validation.neighbours(rows, "id")
    plan = steps._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"windowspecdefinition\(part#\d+, [^()]*, specifiedwindowframe\(RowFrame, 1, unboundedfollowing", plan)
    assert [tuple(r) for r in steps.orderBy("id").collect()] == [(0, 1, None), (1, 2, None), (2, 4, 1), (3, 4, 2), (4, 5, 2), (5, 7, 4), (6, 7, 5), (7, 8, 5), (8, 1, 7)]


def test_outlines_are_worked_out_once(spark):
    for use in (geometry.area, geometry.bounds):
        assert use(geometry.point_buffer(F.col("x"), F.col("y"), 1.0))._jc.toString().count("sequence") == 1


def test_every_nth_of_more_rows_than_a_sample_holds(spark):
    rows = spark.range(0, 600_000, 1, 8).select((F.col("id") * 7919 % 600_000).alias("t"), F.repeat(F.lit("x"), 300).alias("pad"))
    found = tables.every_nth(rows, 4, "t").select("t")
    assert "RepartitionByExpression" not in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 150_000 and found.where("t % 4 <> 0").count() == 0


def test_first_image_of_a_name_over_all_parts(spark, tmp_path):
    images = spark.range(40).select("id", F.concat(F.lit("i"), F.col("id") % 20).alias("file_name"))
    none = spark.createDataFrame([], "det_id long, image_id long")
    united.write_coco_parts(images.orderBy(F.desc("id")), none, spark.createDataFrame([(1, "cover")], "id int, name string"), path := str(tmp_path / "parts"), each=3)
    assert sum(1 for p in (tmp_path / "parts").glob("part-*") if json.loads(p.read_text())["images"]) > 1
    found, _ = united.read_tagged(spark, {"one": path})
    assert sorted(r["id"] for r in found.collect()) == list(range(20))


def test_small_shares_are_plain_decimals(spark):
    values = [0.0, 0.000125, -0.00025, 0.000001, 0.0000001, 0.001, 0.5, 1.0, None, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(coco.share(F.col("v")).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["0.0", "0.000125", "-0.00025", "0.000001", "0.0", "0.001", "0.5", "1.0", None, "NaN"]


def test_fits_never_bring_all_keys_to_the_driver(spark):
    points = spark.range(60).select((F.col("id") % 5).alias("k"), *[F.cos(F.col("id") * s).alias(c) for c, s in zip("xyz", (1, 2, 3), strict=True)])
    for found in (fits.flatness(points, "k"), fits.levelled(points, "k"), fits.ellipses(points, "k")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_filters_stay_above_settled_columns(spark):
    rows = ranges.settled(spark.range(9), {"v": F.sqrt("id")}).where("v > 1 AND v < 2")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 1
    assert sorted(r["id"] for r in rows.collect()) == [2, 3]


def test_a_walk_works_out_neighbours_and_middles_once(monkeypatch):
    made, middles = [], []
    plain, middle = drive._meet_neighbours, drive.Drive._middle

    def counted(near, meetings, eps):
        made.extend(i for i in meetings if i not in near)
        plain(near, meetings, eps)

    monkeypatch.setattr(drive, "_meet_neighbours", counted)
    monkeypatch.setattr(drive.Drive, "_middle", lambda self, members: middles.append(frozenset(members)) or middle(self, members))
    state = drive.Drive()
    for frame in range(30):
        state.step(frame, [(1000 + frame, 0, 0.1, frame, 5.0 * frame, 0.0, 0.0, 1.0)], set())
        state.forget()
    assert made == list(range(30)) and sorted(map(min, middles)) == list(range(30))
    assert state.near.keys() == state.meetings.keys()


def test_pairs_of_rays_work_out_each_column_once(spark):
    rays = spark.range(20).select((F.col("id") % 2).alias("drive"), F.col("id").alias("frame_id"), F.col("id").alias("ray_id"), *[F.col("id").cast("double").alias(c) for c in ("ox", "oy", "oz", "dx", "dy", "dz")])
    plan = triangulation.ray_pairs(rays, group="drive")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") <= 2 and len(re.findall(r"a_dx#\d+ \* b_dx#\d+", plan)) == 1


def test_outlines_of_a_batch_may_lie_far_apart():
    square = lambda x: [[x, 0.0, x + 10.0, 0.0, x + 10.0, 10.0, x, 10.0]]
    at = [3e7, 0.0, 2e7, 9e6, 4e7, 1e6] * 50
    left, right = (pa.array([square(x + by) for x in at], pa.list_(pa.list_(pa.float64()))) for by in (0.0, 5.0))
    assert np.allclose(overlay.iou.func(left, right).to_numpy(), 1 / 3)


def test_outlines_and_their_boxes_are_worked_out_once(spark):
    assert geometry.segmentation_box("s")._jc.toString().count("filter(") == 2
    ring = geometry.scale(geometry.ring(F.col("s")), 1.1)._jc.toString()
    assert ring.count("aggregate(") == 2 and ring.count("sequence(") == 2


def test_cells_of_many_areas_come_in_few_batches():
    rings = overlay.rings_of(pa.array([[[0.0, 0.0, 9.0, 0.0, 9.0, 9.0], [1.0, 1.0, 2.0, 1.0, 2.0, 2.0]], [], None, [[20.0, 0.0, 29.0, 0.0, 29.0, 9.0]]], pa.list_(pa.list_(pa.float64()))))
    sides = [np.stack(s, 1).tolist() for s in areas._sides_of(rings)]
    assert [len(s) for s in sides] == [6, 3] and sides[1][2] == [29.0, 9.0, 20.0, 0.0] and sides[0][5] == [2.0, 2.0, 1.0, 1.0]


def test_a_task_writes_several_files_of_features(spark, tmp_path):
    flatgeobuf.register(spark)
    for n, files in ((10, 4), (9, 3), (0, 1)):
        rows = spark.range(0, n, 1, 1).select("id", F.array(F.array(*[F.lit(v) + F.col("id") for v in (0.0, 0.0, 4.0, 0.0, 4.0, 2.0)])).alias("geometry"))
        rows.write.format("fgb").option("each", 3).mode("append").save(path := str(tmp_path / f"f{n}"))
        assert len(list((tmp_path / f"f{n}").glob("part-*"))) == files
        assert sorted(r["id"] for r in spark.read.format("fgb").load(path).collect()) == list(range(n)) if n else True


def test_detections_are_written_by_all_tasks(spark, monkeypatch):
    monkeypatch.delattr(tables, "write_records")
    found = chains.detection_files(spark, "/root/testdata/sf0.001")
    assert found.count() == view(spark, "/root/testdata/sf0.001", "fx_dets").where("score >= 0.5").count()


def test_negatives_hash_only_early_low_tiles(spark, monkeypatch):
    empty = spark.range(20_000).select(F.lit("a").alias("aoi"), F.concat(F.lit("t"), "id").alias("tile"), (F.col("id") % 4).alias("min_y"))
    sizes, plain = [], tiling.first_rows
    monkeypatch.setattr(tiling, "first_rows", lambda rows, *a, **k: sizes.append(rows.count()) or plain(rows, *a, **k))
    for n, most in ((60, 500), (60_000, 20_000)):
        need = n // 2 if n < 1000 else 30_000
        found = tiling.sample_negatives(empty, empty.limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))), ["aoi"], 1 / 3, F.col("min_y") >= 3)
        order = empty.orderBy((F.col("min_y") >= 3).cast("int").desc(), tiling.order_key("tile"), "tile").limit(need)
        assert {r["tile"] for r in found.collect()} == {r["tile"] for r in order.collect()} and sizes[-1] <= most


def steps(n, by=(3, 2)):
    """Boxes that overlap in steps, so many a group of four, as segmentations."""
    box = lambda x, y, w, h: [[float(c) for c in (x, y, x + w, y, x + w, y + h, x, y + h)]]
    return pa.array([box(1000 * (b % 7) + by[0] * j, by[1] * j, 40 + b % 60, 30 + b % 50) for b in range(n) for j in range(4)], pa.list_(pa.list_(pa.float64())))


def test_outlines_that_overlap_in_steps_need_few_overlays(monkeypatch):
    cuts, pairs, plain, chunks = [], [], overlay._cut, overlay._chunks
    monkeypatch.setattr(overlay, "_cut", lambda e: cuts.append(len(e.group)) or plain(e))
    monkeypatch.setattr(overlay, "_chunks", lambda counts: pairs.append(int(counts.sum())) or chunks(counts))
    grown = overlay.buffered.func(steps(40), pa.array(np.ones(160)))
    left, right = (grown.take(pa.array([4 * b + k[side] for b in range(40) for k in ((0, 1), (0, 3), (2, 3))])) for side in (0, 1))
    assert overlay.share_area.func(left, right).to_pylist() == [True] * 120 and sum(cuts) == 0
    united = overlay.united.func(pa.ListArray.from_arrays(pa.array(np.arange(0, 161, 4, dtype=np.int32)), grown))
    monkeypatch.setattr(overlay, "_walked", lambda e: rest.append(e) or walked(e))
    walked, rest = overlay._walked, []
    pairs.clear()
    shrunk = overlay.buffered.func(united, pa.array(-np.ones(40)))
    assert sum(pairs) < 40 * 10_000 and not rest
    wide, high = (np.array([c + b % m for b in range(40)]) for c, m in ((40, 60), (30, 50)))
    expected = wide * high + 3 * (wide * high - (wide - 3) * (high - 2)) + 6 * (1 - 8 * np.sin(np.pi / 32))
    assert np.allclose(overlay.area.func(shrunk).to_numpy(), expected, atol=0.05)


def test_convex_rings_grow_as_others_do(monkeypatch):
    rng = np.random.default_rng(7)
    rings = []
    for k in range(60):
        at = np.sort(rng.random(3 + k % 9)) * 2 * np.pi
        ring = np.stack([50 + 20 * np.cos(at), 9 + 7 * np.sin(at)], 1)[:: 1 if k % 2 else -1]
        rings.append([np.concatenate([ring, ring[:1]]).reshape(-1).tolist()])
    rows, by = pa.array(rings, pa.list_(pa.list_(pa.float64()))), np.where(np.arange(60) % 3, 2.5, 0.75)
    found = overlay.buffered_rings(overlay.rings_of(rows), by)
    on_grid = overlay._on_grid
    assert on_grid(overlay.rings_of(rows))[1].sum() > 40
    monkeypatch.setattr(overlay, "_on_grid", lambda r: (on_grid(r)[0], np.zeros(len(r.size), bool)))
    plain = overlay.buffered_rings(overlay.rings_of(rows), by)
    points = lambda r: {(int(k), round(x, 4), round(y, 4)) for k, x, y in zip(np.repeat(r.row, r.size), r.x, r.y, strict=True)}
    assert np.allclose(*(np.bincount(r.row, overlay._signed(r), 60) for r in (found, plain)), atol=1e-3)
    assert len(points(found) ^ points(plain)) <= 0.01 * len(plain.x)


def test_shared_area_is_told_without_its_size():
    rng = np.random.default_rng(8)
    kinds = pa.list_(pa.list_(pa.float64()))
    wild = lambda cx: [(rng.random(16) * 10 + np.tile([cx, 0.0], 8)).tolist()]
    left, right = [wild(0) for _ in range(300)], [wild(rng.random() * 12) for _ in range(300)]
    frame, square = [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0], [1.0, 1.0, 8.0, 1.0, 8.0, 8.0, 1.0, 8.0]], [[3.0, 3.0, 5.0, 3.0, 5.0, 5.0, 3.0, 5.0]]
    left += [frame, square, None, square, [[]], square, square]
    right += [square, [[5.0, 3.0, 7.0, 3.0, 7.0, 5.0]], square, None, square, [[4.999, 4.999, 9.0, 5.0, 9.0, 9.0]], square]
    a, b = pa.array(left, kinds), pa.array(right, kinds)
    found = overlay.share_area.func(a, b).to_pylist()
    assert found == [s > 0 for s in overlay.shared_area.func(a, b).to_pylist()]
    assert found[-7:] == [False, False, False, False, False, True, True] and 0 < sum(found[:300]) < 300


def test_rings_of_one_place_and_missing_rows_leave_others_whole(monkeypatch):
    box = lambda w: [0.0, 0.0, w, 0.0, w, w, 0.0, w]
    rows = pa.array([[box(2.0), [5.0] * 8], [[1.0] * 6], None, [[7.0] * 6, box(3.0)], [], [[5.0] * 8, box(1.0), box(4.0)], [[0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, 2.0]]] * 40, pa.list_(pa.list_(pa.float64())))
    sizes = [4.0, 0.0, 0.0, 9.0, 0.0, 15.0, 2.0] * 40
    for most in (overlay.BYTES, 1):
        monkeypatch.setattr(overlay, "BYTES", most)
        assert overlay.area.func(rows).to_pylist() == sizes
        assert overlay.shared_area.func(rows, rows).to_pylist() == sizes and overlay.share_area.func(rows, rows).to_pylist() == [s > 0 for s in sizes]
        assert overlay.area.func(overlay.united.func(pa.array([[r, r] for r in rows.to_pylist()], pa.list_(rows.type)))).to_pylist() == sizes


def test_ellipses_of_many_masks_are_fitted_together():
    rng = np.random.default_rng(9)
    sums = {p: [] for p in fits.POWERS}
    for k in range(60):
        at = rng.random(4 + k % 9) * 2 * np.pi
        x, y = (np.cos(at), 0.6 * np.sin(at)) if k % 3 else (rng.random((2, len(at))) if k % 2 else (at * 0, at * 0))
        for i, j in sums:
            sums[i, j].append(float((x**i * y**j).sum()) if k != 7 else float("nan"))
    stacked, mean, size = {p: np.array(v) for p, v in sums.items()}, rng.random((60, 2)) * 1000, rng.random(60) * 50
    found = fitting.ellipses_of_moments(stacked, mean, size)
    for k in range(60):
        one = fitting.ellipse_of_moments({p: v[k] for p, v in sums.items()}, mean[k], size[k])
        assert np.isnan(found[k]).all() if one is None else np.allclose(found[k], one, rtol=1e-6)
    assert 20 < np.isfinite(found[:, 0]).sum() < 60


def test_bounds_settle_what_masks_share_with_their_ellipses(monkeypatch):
    rng = np.random.default_rng(10)
    masks, kinds = [], pa.list_(pa.list_(pa.float64()))
    for k in range(240):
        at = np.arange(n := 12 + k % 30) * (2 * np.pi / n) * (-1 if k % 2 else 1)
        wild = (0.0, 0.05, 0.2, 0.45, 1.5)[k % 5] * rng.random(n)
        masks.append([np.stack([500 + k + 25 * np.cos(at) * (1 - wild), 900 + 9 * np.sin(at) * (1 - wild)], 1).reshape(-1).tolist()])
    masks += [masks[0] + [[0.0, 0.0, 90.0, 0.0, 90.0, 90.0]], None, [], [[1.0, 1.0, 2.0, 2.0, 3.0, 3.0]]]
    rows, asked, plain = pa.array(masks, kinds), [], overlay.shares
    fitted = rays.mask_ellipse.func(rows)
    at = np.arange(99) * 2 * np.pi / 99
    outline = lambda e: [np.stack([e["cx"] + e["a"] * np.cos(at) * np.cos(e["angle"]) - e["b"] * np.sin(at) * np.sin(e["angle"]), e["cy"] + e["a"] * np.cos(at) * np.sin(e["angle"]) + e["b"] * np.sin(at) * np.cos(e["angle"])], 1).reshape(-1).tolist()]
    share = overlay.iou.func(pa.array([e and outline(e) for e in fitted.to_pylist()], kinds), rows).to_numpy()
    monkeypatch.setattr(overlay, "shares", lambda a, b, n: asked.append(n) or plain(a, b, n))
    for least in (0.3, 0.85, 0.95):
        found = rays.shared_ellipse.func(rows, pa.array(np.full(len(rows), least))).to_pylist()
        assert [e is not None for e in found] == [e is not None and s >= least for e, s in zip(fitted.to_pylist(), share, strict=True)]
        assert all(e is None or e == f for e, f in zip(found, fitted.to_pylist(), strict=True))
    assert 0 < asked[0] < 80
    asked.clear()
    rays.shared_ellipse.func(pa.array(masks[:240:5], kinds), pa.array(np.full(48, 0.85)))
    assert not asked


def test_truth_images_bring_no_objects_or_cameras_to_the_driver(spark, monkeypatch):
    monkeypatch.delattr(ranges, "places")
    found = documents.truth_images(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan and "collect_list" not in plan
    ids = [r["id"] for r in found.select("id").collect()]
    assert len(ids) == len(set(ids)) > 100


def test_faces_of_cameras_are_those_of_their_definition(spark):
    places = spark.createDataFrame([(k, float(v), x, y, z) for k, (v, x, y, z) in enumerate((1, float(a), float(b), float(c)) for a in (-3, 0, 2) for b in (-2, 0, 3) for c in (-4, 0, 4))], "camera_id long, r double, x double, y double, z double")
    outline = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(p, "xyz")]) for p in ((0, 0, 0), (1, 0, 0), (1, 1, 0.5), (0, 1, -2))])
    objects = spark.range(1).select(F.col("id").alias("object_id"), F.lit(1).alias("category_id"), outline.alias("outline"))
    cameras = places.select("camera_id", F.lit("lb7").alias("model"), "x", "y", "z", F.lit(0.3).alias("rx"), (F.col("camera_id") * 0.2).alias("ry"), F.lit(-0.4).alias("rz"), F.lit(2000).alias("size"), F.array(*[F.lit(f"f{k}") for k in range(6)]).alias("image_path"))
    seen = truth._vertices(objects, cameras, 20.0, ()).select("face", camera.face_of(tuple(F.col(f"f{c}") for c in "xyz")).alias("defined"), "camera_id", "at")
    rows = seen.collect()
    assert len(rows) == 27 * 4 and all(r["face"] == r["defined"] for r in rows) and len({r["face"] for r in rows}) == 6


def test_unions_are_shrunk_as_they_come():
    rng = np.random.default_rng(11)
    kinds = pa.list_(pa.list_(pa.float64()))
    star = lambda n, cx: np.stack([cx + 12 * (r := 0.4 + 0.6 * rng.random(n)) * np.cos(at := np.sort(rng.random(n)) * 2 * np.pi), 12 * r * np.sin(at)], 1).reshape(-1).tolist()
    groups = [[[star(9, 6.0 * k)] for k in range(n % 5)] for n in range(60)] + [None, [None, [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0]]]]
    rows = pa.array(groups, pa.list_(kinds))
    for by in (-0.5, -1.5, 0.75):
        found, plain = overlay.united_buffered.func(rows, pa.array(np.full(62, by))), overlay.buffered.func(overlay.united.func(rows), pa.array(np.full(62, by)))
        assert np.allclose(overlay.area.func(found).to_numpy(), overlay.area.func(plain).to_numpy(), atol=1e-3)
    assert overlay._union(rows)[1].sum() > 40


def test_outlines_are_united_once_and_pairs_found_once(spark):
    tiles = spark.range(12).select(F.col("id").alias("det_id"), F.lit("a").alias("dataset"), F.lit(1).alias("image_id"), F.lit(1).alias("category_id"), F.lit(0.5).alias("score"), F.lit(0).alias("min_x"), F.lit(0).alias("min_y"), F.array(F.array(*[F.lit(v) + F.col("id") * (3.0 * (k % 2 == 0)) for k, v in enumerate((0.0, 0.0, 9.0, 0.0, 9.0, 5.0, 0.0, 5.0))])).alias("segmentation"))
    kept, keep = [], ranges.keeper(spark)
    counted = lambda rows: kept.append(rows._jdf.queryExecution().analyzed().toString()) or keep(rows)
    moved = keep(merging.outlines_to_panorama(tiles))
    groups = merging.outline_groups(moved, counted)
    assert sum(plan.count("share_area(") for plan in kept) == 1
    for at_once in (32, 5):
        merged = merging.merged_outlines(moved, groups, keep, at_once=at_once)
        assert merged._jdf.queryExecution().executedPlan().toString().count("united_buffered(") == 1
        row = merged.first()
        assert (row["members"], round(row["area"]), round(row["w"]), round(row["h"])) == (12, 42 * 5, 42, 5)
