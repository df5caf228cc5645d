"""Hand cases of scans, sinks, polygons, orders and the tile chain."""

from __future__ import annotations

import json
import struct

import pytest
from panolake.functions import camera, geometry
from panolake.operators import assessment, control, matching, tiling, triangulation
from panolake.sources import tables
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_frames_behind_the_anchor(spark):
    rows = [("d", k, float(k), x, 0.0, 0.0) for k, x in enumerate([0.0, 10.0, 8.0, 30.0])]
    frames = spark.createDataFrame(rows, "trajectory string, frame_id long, t double, x double, y double, z double")
    got = triangulation.frame_order(frames, radius=5.0).orderBy("place").collect()
    assert [r["frame_id"] for r in got] == [0, 2, 1, 3]


def test_confusion_of_two_classes(spark):
    tags = spark.createDataFrame([("TP", 1, 0), ("TP", 2, 1), ("TP", 2, 1), ("FP", None, 1), ("FN", 1, None)], "tag string, label_class int, det_class int")
    got = {r["true_class"]: (r["a"], r["b"], r["background"]) for r in matching.confusion(tags, ["a", "b"]).collect()}
    assert got == {"a": (1, 0, 1), "b": (0, 2, 0), "background": (0, 1, 0)}


def test_first_rows(spark):
    """Cuts of any size take the rows of the least order, also all or none, and low rows before others."""
    import hashlib

    rows = [(g, f"n{k}", k % 3 == 0) for g in "ab" for k in range(500)]
    table = spark.createDataFrame(rows, "g string, name string, low boolean")
    order = lambda r: (not r[2], hashlib.md5(f"42|{r[1]}".encode()).hexdigest())
    for need in (0, 1, 100, 170, 499, 500, 900):
        counts = spark.createDataFrame([("a", need), ("b", 7)], "g string, need long")
        got = tiling.first_rows(table, ["g"], counts, ["need"], "name", ~F.col("low")).where(F.get("below", 0)).collect()
        for g, n in (("a", need), ("b", 7)):
            assert {r["name"] for r in got if r["g"] == g} == {r[1] for r in sorted((r for r in rows if r[0] == g), key=order)[:n]}


def test_binary_of_a_ring(spark):
    values = [(0.0, 0.0), (1.5, -2.25), (1e-7, 123456.789), (3.0, 0.1)]
    got = bytes(one(spark, geometry.well_known_binary(ring(*values)))[0])
    assert got == struct.pack(">bIII10d", 0, 3, 1, 5, *[v for p in [*values, values[0]] for v in p])


def test_points_and_rings(spark):
    square, apart, within, crossing = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((5, 5), (6, 5), (6, 6)), ring((1, 1), (2, 1), (2, 2)), ring((-1, 2), (5, 2), (5, 3))
    touching = ring((4, 4), (6, 4), (6, 6))
    got = one(spark, *[geometry.rings_intersect(square, r) for r in (apart, within, crossing, touching)], *[geometry.inside(F.lit(x), F.lit(y), square) for x, y in ((2.0, 2.0), (4.0, 2.0), (4.1, 2.0), (0.0, 0.0))])
    assert tuple(got) == (False, True, True, True, True, True, False, True)


def test_poles_of_rotations(spark):
    down = camera.euler_matrix(F.lit(0.3), F.lit(1.5707963267948966), F.lit(0.0))
    got = one(spark, *camera.opk_of_world_to_camera(down), *camera.opk_degrees_of(tuple(F.lit(float(v)) for v in (0, 0, 1, 0, 1, 0, -1, 0, 0))))
    assert got[1] == pytest.approx(1.5707963, abs=1e-6) and got[3] == 0.0 and got[4] == pytest.approx(-90.0)


def test_faces_are_rotations(spark):
    v = (F.lit(0.2), F.lit(-0.5), F.lit(0.7))
    for face in range(6):
        back = camera.turned_by_face(F.lit(face), camera.turned_by_face(F.lit(face), v), back=True)
        assert tuple(one(spark, *back)) == pytest.approx((0.2, -0.5, 0.7))
    ahead = camera.turned_by_face(F.lit(0), (F.lit(0.0), F.lit(0.0), F.lit(-1.0)))
    assert one(spark, camera.face_of(ahead))[0] == 0
    # The upper mosaic spans a whole turn, which leaves a width of 0: only its first longitude is in it.
    for rig in camera.RIGS.values():
        seen = [one(spark, camera.sensor_of(F.lit(lat), F.lit(lon), rig))[0] for lat, lon in ((0.0, 0.0), (0.0, 72.0), (0.0, 144.0), (0.0, -144.0), (0.0, -72.0), (80.0, 180.0), (-89.0, 0.0))]
        assert seen == [0, 1, 2, 3, 4, 5, -1]


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 300, 500, 1)
    for name, data in {"a.png": png, "b.jpg": jpeg, "c.jpg": b"broken", "d.txt": png, "e.jpg": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {(r["file_name"], r["width"], r["height"]) for r in tables.listed_images(spark, str(tmp_path)).collect()}
    assert got == {("a.png", 640, 480), ("b.jpg", 500, 300)}


def test_lists_and_documents(spark, tmp_path):
    one_file, two_file = tmp_path / "a.json", tmp_path / "b.json"
    one_file.write_text(json.dumps([{"det_id": 1, "image_id": 5, "score": 0.5, "det_class": 0, "bbox": [1, 2, 3, 4]}]))
    two_file.write_text(json.dumps({"images": [], "annotations": [{"id": 2, "file_name": "x.jpg", "score": 0.7, "category_id": 1}]}))
    rows = tables.read_detections_any(spark, str(one_file)).unionByName(tables.read_detections_any(spark, str(two_file)))
    assert sorted((r["det_id"], r["det_class"]) for r in rows.collect()) == [(1, 0), (2, 1)]
    tiles = spark.createDataFrame([("x.jpg", 9), ("y.jpg", 5)], "file_name string, image_id long")
    assert sorted((r["det_id"], r["image_id"]) for r in tables.with_image_ids(rows, tiles).collect()) == [(1, 5), (2, 9)]


def test_features_without_outline(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type": "Feature", "geometry": null, "properties": {"a": "1"}}\n{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}, "properties": {"a": "2"}}\n')
    assert tables.read_features(spark, str(tmp_path)).count() == 2
    kept = tables.read_features(spark, str(tmp_path), projected=False).collect()
    assert [(r["geometry"], r["properties"]) for r in kept] == [([0.0, 0.0, 1.0, 0.0, 1.0, 1.0], {"a": "2"})]


def test_errors_are_raised(spark):
    with pytest.raises(ValueError):
        assessment.resolved_threshold(None, None, spark)
    with pytest.raises(ValueError):
        tables.with_category_names(spark.range(1))
    assert assessment.resolved_threshold(None, 0.4, spark).first()[0] == 0.4
    valid, known = spark.createDataFrame([("a", 1)], "aoi string, original_id long"), spark.createDataFrame([("a", 2, 7)], "aoi string, original_id long, image_id long")
    with pytest.raises(Exception, match="not among"):
        assessment.validated_ids(valid, known).collect()


def test_best_trial(spark):
    log = spark.createDataFrame([(1, 0.5, 0.5, 0.1), (2, 0.9, 0.9, 0.2), (3, 0.9, 0.9, 0.3)], "trial int, precision double, recall double, map50 double")
    assert control.best_trial(control.best_trials(log)).first()["trial"] == 2
