"""Queries of documents of several areas, of the review and of ground truth on cube faces, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.fixtures import view
from panolake.functions import camera, geometry
from panolake.operators import control, truth, validation
from panolake.operators.ranges import spread
from panolake.plans.catalog import FRAME, MATRIX, _flat, query
from panolake.plans.chains import categories, folder
from panolake.sources import coco, united

# Documents


def _document(labels: DataFrame, spark: SparkSession, images: DataFrame) -> str:
    """Labels (id, image_id, category_id, x, y, w, h) and images (id, file_name) as a folder of documents."""
    box = F.array(*[F.col(c).cast("double") for c in "xywh"])
    rows = labels.select("id", "image_id", "category_id", F.array(_flat().cast("array<double>")).alias("segmentation"), (F.col("w") * F.col("h")).cast("double").alias("area"), box.alias("bbox"))
    united.write_coco_parts(images, rows, categories(spark), path := folder(spark), each=2000)
    return path


AREAS = """places AS (SELECT *, CASE aoi WHEN 'SZH' THEN 0 WHEN 'NE' THEN 1 ELSE 2 END AS place FROM (SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'NE' WHEN 1 THEN 'SZH' ELSE 'LU' END AS aoi FROM fx_images)),
most AS (SELECT place, max(image_id) + 1 AS n FROM places GROUP BY place), shifts AS (SELECT place, coalesce(sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM most)"""


@query(f"WITH {AREAS} SELECT p.aoi, l.label_id, p.image_id AS original_id, CAST(p.image_id + shift AS BIGINT) AS image_id, CAST(l.w * l.h AS DOUBLE) AS area, CAST(l.x AS DOUBLE) AS x FROM fx_labels l JOIN places p ON l.image_id = p.image_id JOIN shifts USING (place)")
def area_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three areas, written in parts and read as one table of annotations under shifted image ids."""
    aoi = F.when(F.col("id") % 3 == 0, "NE").when(F.col("id") % 3 == 1, "SZH").otherwise("LU")
    images = view(spark, sf_dir, "fx_images").select(F.col("image_id").alias("id"), "file_name", "width", "height").withColumn("aoi", aoi)
    labels = view(spark, sf_dir, "fx_labels").select(F.col("label_id").alias("id"), "image_id", F.col("label_class").alias("category_id"), *"xywh")
    paths = {}
    for name in ("SZH", "NE", "LU"):
        own = images.where(F.col("aoi") == name).drop("aoi")
        paths[name] = _document(labels.join(own.select(F.col("id").alias("image_id")), "image_id", "left_semi"), spark, own)
    found = united.read_areas(spark, paths)["annotations"]
    return found.select("aoi", F.col("id").alias("label_id"), "original_id", "image_id", "area", F.get("bbox", 0).alias("x"))


@query("""WITH named AS (SELECT image_id, image_id // 3 AS k, image_id % 2 AS half FROM fx_images), firsts AS (SELECT 'pano_' || k || '.jpg' AS file_name, min(half * 1000000000000 + image_id) AS first FROM named GROUP BY k), i AS (SELECT first % 1000000000000 AS image_id, file_name FROM firsts)
SELECT d.det_id, d.image_id, CASE d.det_id % 2 WHEN 0 THEN 'one' ELSE 'two' END AS dataset, i.file_name, d.score FROM fx_dets d LEFT JOIN i ON d.image_id = i.image_id""")
def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged document and a bare tagged list, whose images come from a third file, as one table of annotations with the first image of each name."""
    images = view(spark, sf_dir, "fx_images").select(F.col("image_id").alias("id"), F.concat(F.lit("pano_"), F.floor(F.col("image_id") / 3), F.lit(".jpg")).alias("file_name"), "width", "height")
    dets = view(spark, sf_dir, "fx_dets").select("det_id", "image_id", "score", "det_class")
    united.write_coco_parts(images.where("id % 2 = 0"), dets.where("det_id % 2 = 0").withColumn("dataset", F.lit("one")), categories(spark), one := folder(spark))
    united.write_list_parts(dets.where("det_id % 2 = 1"), two := folder(spark), each=2000)
    united.write_coco_parts(images.where("id % 2 = 1"), dets.limit(0), categories(spark), names := folder(spark))
    found, rows = united.read_tagged(spark, {"one": one, "two": two}, [names])
    return rows.join(found.select(F.col("id").alias("image_id"), "file_name"), "image_id", "left").select("det_id", "image_id", "dataset", "file_name", "score")


# Review

STATUS = "k AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_status WHERE action IN ('click', 'purchase')), s AS (SELECT ann_id, action = 'purchase' AS removed FROM k WHERE n = 1)"


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest_status(view(spark, sf_dir, "fx_status"), "click", "purchase")


@query(f"""WITH {STATUS}, m AS (SELECT l.*, x AS x0, least(x + w, 7999) AS x1, least(y + label_id % 5 * 700, 3999) AS y0, least(y + h + label_id % 5 * 700, 3999) AS y1 FROM fx_labels l JOIN s ON l.label_id = s.ann_id AND NOT s.removed)
SELECT label_id, image_id, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM m""")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a review kept, some moved down and cut at the image's edge, exported as documents and read back."""
    images = view(spark, sf_dir, "fx_labels").select(F.col("image_id").alias("id")).distinct().select("id", F.concat(F.lit("pano_"), "id", F.lit(".jpg")).alias("file_name"), F.lit(8000).alias("width"), F.lit(4000).alias("height"))
    outline = geometry.ring(_flat().cast("array<double>"))
    shape = validation.moved(outline, F.lit(0.0), (F.col("label_id") % 5 * 700).cast("double"), 1.0, 8000, 4000)
    rows = view(spark, sf_dir, "fx_labels").select(F.col("label_id").alias("id"), "image_id", F.col("label_class").alias("category_id"), shape.alias("s")).select("id", "image_id", "category_id", "s.segmentation", "s.bbox")
    united.write_coco_parts(images, validation.exported(rows, _status(spark, sf_dir)), categories(spark), path := folder(spark), each=2000)
    found = coco.read_coco(spark, path)["annotations"]
    area = geometry.area(geometry.ring(F.get("segmentation", 0)))
    return found.select(F.col("id").alias("label_id"), "image_id", *[F.get("bbox", i).alias(c) for i, c in enumerate("xywh")], area.alias("area"))


@query(f"""WITH {STATUS}, r AS (SELECT label_id, image_id % 3 AS shelf, CASE WHEN s.ann_id IS NULL THEN label_id END AS open FROM fx_labels LEFT JOIN s ON label_id = s.ann_id),
w AS (SELECT label_id, first_value(open IGNORE NULLS) OVER (ORDER BY shelf, label_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead, first_value(open IGNORE NULLS) OVER (ORDER BY shelf, label_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS start, max(open) OVER (ORDER BY shelf, label_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_open FROM r)
SELECT label_id, coalesce(ahead, nullif(start, label_id)) AS next_open, previous_open FROM w""")
def review_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open labels that a review goes to from each label, in a list by shelves."""
    labels = view(spark, sf_dir, "fx_labels").select(F.col("label_id").alias("id"), (F.col("image_id") % 3).alias("shelf"))
    steps = validation.neighbours(validation.with_status(labels, _status(spark, sf_dir)), "shelf", "id")
    return steps.withColumnRenamed("id", "label_id")


# Ground truth on cube faces

_CASES = " ".join(f"WHEN '{name}' THEN CASE " + " ".join(f"WHEN ((lon - {lo % 360}) % 360 + 360) % 360 <= {(hi - lo % 360) % 360} AND lat >= {a} AND lat <= {b} THEN {pos}" for pos, *_, a, b, lo, hi in rig) + " ELSE -1 END" for name, rig in camera.RIGS.items())


def _seats(axis: int) -> str:
    return "CASE " + " ".join(f"WHEN model = '{name}' AND sensor = {s[0]} THEN {s[axis]}::DOUBLE" for name, rig in camera.RIGS.items() for s in rig) + " ELSE 0 END"


def _turned(axis: int) -> str:
    term = lambda k: " ".join(f"{'+' if f > 0 else '-'} w{'xyz'[i]}" for i in range(3) if (f := camera.face_matrix(k)[3 * i + axis]))
    return "CASE face " + " ".join(f"WHEN {k} THEN {term(k)}" for k in range(4)) + " END"


TRUTH = f"""a AS (SELECT frame_id, 1.4::DOUBLE + frame_id % 7 * 0.05::DOUBLE AS o, frame_id % 5 * 0.03::DOUBLE - 0.06::DOUBLE AS p, frame_id % 13 * 0.4::DOUBLE - 2.4::DOUBLE AS k, x AS fx, y AS fy, z AS fz, CASE frame_id % 4 WHEN 0 THEN 'lb4' WHEN 1 THEN 'lb7' WHEN 2 THEN 'lb8' ELSE 'lb10' END AS model, CASE frame_id % 4 WHEN 0 THEN 2048 ELSE 4016 END AS size FROM fx_frames),
m AS (SELECT *, {MATRIX} FROM a), near AS (SELECT m.*, ob.k AS object_id, ob.x AS ox, ob.y AS oy, ob.z AS oz FROM m JOIN fx_objects ob ON sqrt((ob.x - fx) * (ob.x - fx) + (ob.y - fy) * (ob.y - fy)) < 20),
v AS (SELECT *, ox + 0.35::DOUBLE * cos(2 * pi() * i / 64) - fx AS vx, oy + 0.35::DOUBLE * sin(2 * pi() * i / 64) - fy AS vy, oz - fz AS vz FROM near, range(65) r(i)), c AS (SELECT *, {FRAME} FROM v),
d AS (SELECT *, [-cz, cz, -cx, cx, cy, -cy] AS dots, degrees(atan2(cy, sqrt(cx * cx + cy * cy))) AS lat, degrees(atan2(cx, -cz)) AS lon FROM c), e AS (SELECT *, list_position(dots, list_max(dots)) - 1 AS face, CASE model {_CASES} END AS sensor FROM d),
f AS (SELECT *, cx - {_seats(1)} AS wx, cy - {_seats(2)} AS wy, cz - {_seats(3)} AS wz FROM e WHERE face < 4), g AS (SELECT *, {_turned(0)} AS mx, {_turned(1)} AS my, {_turned(2)} AS mz FROM f),
h AS (SELECT frame_id, object_id, face, size, i, size / 2 - size / 2 * mx / mz AS u, size / 2 + size / 2 * my / mz AS w FROM g),
n AS (SELECT *, coalesce(lead(u) OVER t, first_value(u) OVER t) AS un, coalesce(lead(w) OVER t, first_value(w) OVER t) AS wn FROM h WINDOW t AS (PARTITION BY frame_id, object_id, face ORDER BY i)),
shapes AS (SELECT frame_id, object_id, face, count(*) AS corners, abs(sum(u * wn - un * w)) / 2 AS area, min(u) AS x, min(w) AS y, max(u) - min(u) AS width, max(w) - min(w) AS height, sum(CAST(trunc(u) AS BIGINT) + 3 * CAST(trunc(w) AS BIGINT)) AS pixels FROM n GROUP BY frame_id, object_id, face)"""


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    disk = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.struct((F.col("x") + 0.35 * F.cos(2 * math.pi * i / 64)).alias("x"), (F.col("y") + 0.35 * F.sin(2 * math.pi * i / 64)).alias("y"), F.col("z").alias("z")))
    objects = spread(view(spark, sf_dir, "fx_objects")).select(F.col("k").alias("object_id"), F.lit(1).alias("category_id"), disk.alias("outline"))
    n = F.col("frame_id")
    model = F.element_at(F.array(*map(F.lit, ("lb4", "lb7", "lb8", "lb10"))), (n % 4 + 1).cast("int"))
    paths = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(n, F.lit("-"), k, F.lit(".jpg")))
    cameras = view(spark, sf_dir, "fx_frames").select(n.alias("camera_id"), model.alias("model"), "x", "y", "z", (1.4 + n % 7 * 0.05).alias("rx"), (n % 5 * 0.03 - 0.06).alias("ry"), (n % 13 * 0.4 - 2.4).alias("rz"), F.when(n % 4 == 0, 2048).otherwise(4016).alias("size"), paths.alias("image_path"))
    return objects, cameras


@query(f"WITH {TRUTH} SELECT row_number() OVER (ORDER BY frame_id, object_id, face) AS id, object_id, 4 * frame_id + face AS image_id, corners, CAST(pixels AS BIGINT) AS pixels, round(area, 2) AS area, round(x, 3) AS x, round(y, 3) AS y, round(width, 3) AS w, round(height, 3) AS h FROM shapes WHERE corners > 50 AND area > 200")
def truth_on_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth disks on the cube faces of all cameras within 20 m, with their attitude and each rig's sensors."""
    _, rows = truth.on_faces(*_truth(spark, sf_dir))
    ring = F.get("segmentation", 0)
    pixels = F.aggregate(F.transform(ring, lambda v, i: v * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0).cast("long"), lambda s, v: s + v)
    box = [F.round(F.get("bbox", i), 3).alias(c) for i, c in enumerate("xywh")]
    return rows.select("id", "object_id", "image_id", (F.size(ring) / 2).cast("long").alias("corners"), pixels.alias("pixels"), F.round("area", 2).alias("area"), *box)


@query(f"WITH {TRUTH} SELECT DISTINCT 4 * s.frame_id + face AS id, s.frame_id || '-' || face || '.jpg' AS file_name, a.size AS width FROM shapes s JOIN a ON s.frame_id = a.frame_id")
def truth_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faces that hold any part of an object."""
    return truth.images_of(*_truth(spark, sf_dir)).select("id", "file_name", "width")
