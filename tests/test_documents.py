"""Documents of several areas, review steps and exports, and ground truth on cube faces, in small."""

from __future__ import annotations

import json
import random

import pytest
from panolake.operators import truth, validation
from panolake.sources import coco, united
from pyspark.sql import functions as F


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def document(*images, annotations=()):
    return {"images": [{"id": i, "file_name": n, "width": 8, "height": 4} for i, n in images], "annotations": list(annotations), "categories": [{"id": 1, "name": "cover", "supercategory": "street"}]}


def test_areas_get_ids_of_their_own(spark, tmp_path):
    paths = {
        "B": write(tmp_path / "b.json", document((0, "a.jpg"), (4, "b.jpg"), annotations=[{"id": 1, "image_id": 4, "bbox": [0, 0, 1, 1]}, {"id": 2, "image_id": 7}])),
        "A": write(tmp_path / "a.json", document((7, "a.jpg"), annotations=[{"id": 1, "image_id": 7}])),
        "C": write(tmp_path / "c.json", document()),
    }
    found = united.read_areas(spark, paths)
    assert sorted(tuple(r) for r in found["ids"].collect()) == [("A", 12, 7), ("B", 0, 0), ("B", 4, 4)]
    assert sorted((r["aoi"], r["id"], r["image_id"], r["original_id"]) for r in found["annotations"].collect()) == [("A", 1, 12, 7), ("B", 1, 4, 4)]
    assert [(r["aoi"], r["id"]) for r in found["orphans"].collect()] == [("B", 2)]
    assert {r["file_name"] for r in found["images"].where("aoi = 'B'").collect()} == {"a.jpg", "b.jpg"}


def test_tagged_documents_and_lists(spark, tmp_path):
    one = write(tmp_path / "one.json", document((1, "x.jpg"), (2, "x.jpg"), (3, "y.jpg"), annotations=[{"det_id": 5, "tag": "TP", "dataset": "trn"}]))
    two = write(tmp_path / "two.json", [{"det_id": 6, "tag": "FP"}, {"det_id": None, "tag": "FN", "label_id": 9}])
    names = write(tmp_path / "names.json", document((8, "y.jpg"), (9, "z.jpg")))
    images, rows = united.read_tagged(spark, {"p": one, "q": two}, [names])
    assert sorted((r["file_name"], r["id"]) for r in images.collect()) == [("x.jpg", 1), ("y.jpg", 3), ("z.jpg", 9)]
    assert sorted((r["dataset"], r["tag"], r["det_id"]) for r in rows.collect() if r["det_id"]) == [("q", "FP", 6), ("trn", "TP", 5)] and rows.count() == 3


@pytest.mark.parametrize("each", [1, 3, 1000])
def test_documents_in_parts_lose_no_row(spark, tmp_path, each):
    images = spark.range(5).select("id", F.concat(F.lit("i"), "id").alias("file_name"))
    annotations = spark.range(12).select("id", (F.col("id") % 4).alias("image_id"), F.lit(1).alias("category_id"))
    names = spark.createDataFrame([(1, "cover")], "id int, name string")
    united.write_coco_parts(images, annotations, names, str(tmp_path / "out"), each=each)
    back = coco.read_coco(spark, str(tmp_path / "out"))
    assert sorted(r["image_id"] for r in back["images"].collect()) == list(range(5))
    assert sorted((r["id"], r["image_id"]) for r in back["annotations"].collect()) == [(i, i % 4) for i in range(12)]
    files = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert all(f["categories"] == [{"id": 1, "name": "cover"}] for f in files) and (len(files) > 1) == (each < 1000)
    empty = str(tmp_path / "empty")
    united.write_coco_parts(images.limit(0), annotations.limit(0), names, empty)
    assert coco.read_coco(spark, empty)["images"].count() == 0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.97, 1.0])
def test_review_steps(spark, share):
    """Against the walk that a reviewer's keys make."""
    r = random.Random(int(share * 100))
    ids = r.sample(range(1000), 60)
    done = {i: r.random() < share for i in ids}
    rows = spark.createDataFrame([(i, k, done[i], False) for k, i in enumerate(ids)], "id long, place long, validated boolean, removed boolean").repartition(4)
    got = {x["id"]: (x["next_open"], x["previous_open"]) for x in validation.neighbours(rows, "place").collect()}
    for k, i in enumerate(ids):
        after = [j for j in [*ids[k + 1 :], *ids[:k]] if not done[j]]
        before = [j for j in ids[:k] if not done[j]]
        assert got[i] == (after[0] if after else None, max(before, default=None))


def test_moved_outlines(spark):
    ring = "array(named_struct('x', 2D, 'y', 2D), named_struct('x', 6D, 'y', 2D), named_struct('x', 6D, 'y', 6D), named_struct('x', 2D, 'y', 6D))"
    s = spark.range(1).select(validation.moved(F.expr(ring), F.lit(3.0), F.lit(-3.0), 1.5, 10, 10).alias("s")).first()["s"]
    assert s["segmentation"] == [[4.0, 0.0, 9.0, 0.0, 9.0, 4.0, 4.0, 4.0]] and s["bbox"] == [4.0, 0.0, 5.0, 4.0]


def test_exported(spark):
    rows = spark.range(4)
    status = spark.createDataFrame([(0, True, False), (1, True, True), (2, False, False), (9, True, False)], "ann_id long, validated boolean, removed boolean")
    assert [r["id"] for r in validation.exported(rows, status).collect()] == [0]
    assert [(r["validated"], r["removed"]) for r in validation.with_status(rows, status).orderBy("id").collect()] == [(True, False), (True, True), (False, False), (False, False)]


def test_truth_on_faces_leaves_out(spark):
    """Coarse outlines, far or unknown cameras and null outlines give nothing; a face that holds a vertex is an image."""
    disk = "transform(sequence(0, {n} - 1), i -> struct(4 + {r} * cos(2 * pi() * i / {n}) as x, {r} * sin(2 * pi() * i / {n}) as y, 0D as z))"
    objects = spark.sql(f"select 1L object_id, 1 category_id, {disk.format(n=64, r=0.3)} outline union all select 2L, 1, {disk.format(n=40, r=0.3)} union all select 3L, 1, {disk.format(n=64, r=0.02)} union all select 4L, 1, null")
    pose = lambda i, model, x: (i, model, float(x), 0.0, 2.0, 1.5707963267948966, 0.0, 0.0, 2048, [f"{i}-{k}" for k in range(6)])
    cameras = spark.createDataFrame([pose(1, "lb4", 0), pose(2, "lb4", 30), pose(3, "other", 0)], "camera_id long, model string, x double, y double, z double, rx double, ry double, rz double, size int, image_path array<string>")
    images, rows = truth.on_faces(objects, cameras)
    found = rows.collect()
    assert [r["object_id"] for r in found] == [1] and found[0]["id"] == 1 and len(found[0]["segmentation"][0]) == 128
    assert {r["id"] for r in images.collect()} == {found[0]["image_id"]}
    assert truth.on_faces(objects, cameras, corners=10, least=0.0)[1].count() == 3
    assert truth.on_faces(objects, cameras, skipped=(found[0]["image_id"] - 4, 4, 5))[0].isEmpty()
    assert truth.on_faces(objects.limit(0), cameras)[1].isEmpty() and truth.on_faces(objects, cameras.limit(0))[1].isEmpty()
