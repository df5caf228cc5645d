from __future__ import annotations

import json

from panolake.sources import coco, config
from panolake.streaming import candidates, status


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_coco_round_trip(spark, tmp_path):
    document = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 8, "height": 4}, {"id": 2, "file_name": "b.jpg", "width": 8, "height": 4}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 4, 0, 4, 2]], "bbox": [0, 0, 4, 2]}, {"id": 6, "image_id": 9, "category_id": 1}],
        "categories": [{"id": 1, "name": "manhole", "supercategory": "object"}],
    }
    got = coco.read_coco(spark, write(tmp_path / "in.json", document))
    assert got["images"].count() == 2 and [r["id"] for r in got["annotations"].collect()] == [5] and [r["id"] for r in got["orphans"].collect()] == [6]
    lists = {r["image_id"]: r["annotations"] for r in coco.with_annotations(got["images"], got["annotations"]).collect()}
    assert len(lists[1]) == 1 and lists[2] is None
    coco.write_coco(got["images"].withColumnRenamed("image_id", "id"), got["annotations"], got["categories"], str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert {x["id"] for x in back["images"]} == {1, 2} and back["annotations"][0]["segmentation"] == [[0, 0, 4, 0, 4, 2]]
    coco.write_yolo(got["annotations"], 8, 4, str(tmp_path / "yolo"))
    assert spark.read.text(str(tmp_path / "yolo")).first()["value"] == "1 0.0 0.0 0.5 0.0 0.5 0.5"


def test_detections_and_trajectory(spark, tmp_path):
    paths = {d: write(tmp_path / f"{d}.json", [{"det_id": i, "image_id": 1, "score": s} for i, s in enumerate((0.1, 0.6))]) for d in ("trn", "val")}
    assert sorted((r["dataset"], r["det_id"]) for r in coco.read_detections(spark, paths, 0.5).collect()) == [("trn", 1), ("val", 1)]
    items = {"items": [{"dataSourceId": "lb4", "x": 1.0}, {"dataSourceId": "lb7", "x": 2.0}, {"dataSourceId": "gps", "x": 3.0}]}
    rows = coco.read_trajectory(spark, write(tmp_path / "t.json", items)).collect()
    assert sorted((r["dataSourceId"], r["size"]) for r in rows) == [("lb4", 2048), ("lb7", 4016)]


def test_config(tmp_path):
    path = write(tmp_path / "c.json", {"step": {"in": "<DATA>/x", "n": 1, "list": ["<DATA>"]}, "global": {"n": 2}})
    assert config.load(path, "step", {"DATA": "/d"}) == {"in": "/d/x", "n": 2, "list": ["<DATA>"]}


def test_status_stream(spark, tmp_path):
    schema = "ann_id long, event_id long, ts timestamp, action string"
    folder = tmp_path / "events"
    first = [(1, 1, "keep"), (1, 2, "remove"), (2, 3, "keep"), (3, 4, "other")]
    later = [(1, 0, "keep"), (2, 9, "remove")]
    out = {}
    for rows in (first, later):
        spark.createDataFrame([(a, e, None, x) for a, e, x in rows], schema).selectExpr("ann_id", "event_id", "timestamp_seconds(event_id) ts", "action").coalesce(1).write.mode("append").parquet(str(folder))
        stream = status.latest_status(spark.readStream.schema(schema).parquet(str(folder)), "keep", "remove")

        def take(df, _):
            out.update({r["ann_id"]: r["removed"] for r in df.collect()})

        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(take).trigger(availableNow=True).start().awaitTermination(120)
    assert out == {1: True, 2: True}


def test_candidate_stream(spark, tmp_path):
    schema = "trajectory long, frame_id long, x double, y double, z double"
    folder, out = tmp_path / "points", {}
    for part in ([(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.2, 0.0, 0.0), (0, 2, 30.0, 0.0, 0.0)], [(0, 3, 0.1, 0.0, 0.0), (0, 20, 0.1, 0.0, 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        tracked = candidates.track(spark.readStream.schema(schema).parquet(str(folder)))

        def take(df, _):
            for r in df.collect():
                out[r["candidate"]] = max(out.get(r["candidate"], (0, 0)), (r["n"], r["last_seen"]))

        tracked.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(take).trigger(availableNow=True).start().awaitTermination(120)
    assert out[0][0] == 4 and out[1] == (1, 2)
