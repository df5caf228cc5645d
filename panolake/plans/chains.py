"""Queries of assessment, scans and sinks, the tile chain, polygons and the cube-map chain over the derived scenes, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panolake.fixtures import view
from panolake.functions import camera, geometry, mapping, overlay
from panolake.operators import areas, assessment, control, fits, matching, merging, rays, tiling, triangulation
from panolake.operators.ranges import settled, spread
from panolake.operators.spatial import distance_pairs
from panolake.plans.catalog import ANGLES, DRIVE_PAIRS, FAR, FRAME, MATRIX, PAIRS, PROBLEM, RATIOS, RAYS, SCENE, SENSOR, SWEEP, TAGS, _angles, _flat, _in_frame, _peeled, _problems, _scene, keeper, query, r6, tags_of, threshold_sweep
from panolake.sources import flatgeobuf, geopackage, tables, united

CATEGORIES = [(1, "cover", "street"), (3, "valve", "street")]


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "id int, name string, supercategory string")


CATEGORY_SQL = "cats AS (SELECT * FROM (VALUES (1, 'cover', 'street'), (3, 'valve', 'street')) v(id, name, supercategory))"


def folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    keeper(spark)
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{where}/files/{uuid.uuid4().hex}"


# Assessment


@query(f"WITH {CATEGORY_SQL} SELECT l.label_id, l.image_id, l.label_class, c.name AS category FROM fx_labels l LEFT JOIN cats c ON l.label_class = c.id WHERE l.image_id IN (SELECT image_id FROM fx_images WHERE aoi = 'NE')")
def assessed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessment.ground_truth(view(spark, sf_dir, "fx_labels"), categories(spark), view(spark, sf_dir, "fx_images"), "NE")
    return rows.select("label_id", "image_id", "label_class", "category")


@query("SELECT d.det_id, i.image_id, d.det_class, d.score FROM (SELECT *, CASE WHEN det_id % 2 = 0 THEN image_id END AS known, concat('pano_', image_id, '.jpg') AS file_name FROM fx_dets) d JOIN fx_images i ON CASE WHEN d.known IS NULL THEN d.file_name = i.file_name ELSE d.known = i.image_id END")
def assessed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = view(spark, sf_dir, "fx_dets").withColumn("file_name", F.concat(F.lit("pano_"), "image_id", F.lit(".jpg"))).withColumn("image_id", F.when(F.col("det_id") % 2 == 0, F.col("image_id")))
    return tables.with_image_ids(dets.select("det_id", "image_id", "file_name", "det_class", "score"), view(spark, sf_dir, "fx_images")).select("det_id", "image_id", "det_class", "score")


@query(f"WITH {TAGS} SELECT t.tag, t.label_id, t.det_id, coalesce(d.w, l.w) AS w, coalesce(d.h, l.h) AS h FROM tags t LEFT JOIN fx_dets d ON t.det_id = d.det_id LEFT JOIN fx_labels l ON t.tag = 'FN' AND t.label_id = l.label_id")
def tagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessment.with_segments(tags_of(spark, sf_dir), view(spark, sf_dir, "fx_labels"), view(spark, sf_dir, "fx_dets"), "w", "h")
    return rows.select("tag", "label_id", "det_id", "w", "h")


COUNTS = "count(*) FILTER (tag = 'TP') AS tp, count(*) FILTER (tag = 'FP') AS fp, count(*) FILTER (tag = 'FN') AS fn"


@query(f"""WITH {TAGS}, k AS (SELECT dataset, coalesce(label_class, det_class + 1) AS class, {COUNTS} FROM tags GROUP BY 1, 2), g AS (SELECT dataset, {COUNTS} FROM tags GROUP BY dataset),
m AS (SELECT dataset, {RATIOS} FROM g) SELECT k.dataset, CAST(k.class AS BIGINT) AS class, k.tp AS tp_k, k.fp AS fp_k, k.fn AS fn_k, m."precision", m.recall, m.f1 FROM k JOIN m ON k.dataset = m.dataset""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each class beside the metrics of its dataset, as the report has them, sorted and read back from it."""
    tags = assessment.with_class(tags_of(spark, sf_dir))
    by_class = matching.metrics(tags, "dataset", "class").select("dataset", F.col("class").cast("bigint").alias("class"), F.col("TP").alias("tp_k"), F.col("FP").alias("fp_k"), F.col("FN").alias("fn_k"))
    rows = by_class.join(matching.metrics(tags, "dataset").select("dataset", "precision", "recall", "f1"), "dataset")
    tables.write_csv(rows, path := folder(spark), "dataset", "class", single=True)
    return tables.read_csv(spark, path, "dataset string, class bigint, tp_k bigint, fp_k bigint, fn_k bigint, precision double, recall double, f1 double")


@query(f"{SWEEP} SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1")
def confidence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.resolved_threshold(threshold_sweep(spark, sf_dir), None, spark)


@query("WITH n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS place FROM (SELECT DISTINCT action AS name FROM fx_status)) SELECT CAST(place AS INTEGER) AS place, name FROM n UNION ALL SELECT CAST(count(*) AS INTEGER), 'background' FROM n")
def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that a table holds, in order, and the background after them."""
    return assessment.class_list(view(spark, sf_dir, "fx_status").select(F.col("action").alias("name")))


@query(f"WITH {CATEGORY_SQL} SELECT d.det_id, c.name AS category FROM fx_dets d LEFT JOIN cats c ON d.det_class + 1 = c.id")
def detected_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.categories_of(tags_of(spark, sf_dir), categories(spark))


@query('SELECT label_id AS id, dataset AS "CATEGORY", concat(\'group \', label_class) AS "SUPERCATEGORY" FROM fx_labels')
def category_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_labels")
    return tables.with_category_names(rows.select(F.col("label_id").alias("id"), F.col("dataset").alias("Category"), F.concat(F.lit("group "), "label_class").alias("supercategory")))


# Scans and sinks


@query("""WITH m AS (SELECT aoi, max(image_id) + 1 AS n FROM fx_images GROUP BY aoi), o AS (SELECT aoi, coalesce(sum(n) OVER (ORDER BY aoi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM m)
SELECT i.aoi, i.image_id AS original_id, CAST(i.image_id + o.shift AS BIGINT) AS image_id FROM fx_images i JOIN o ON i.aoi = o.aoi WHERE i.image_id % 3 = 0""")
def validated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated images of all areas, re-keyed by the table of original ids, which is written and read as CSV."""
    images = view(spark, sf_dir, "fx_images")
    shifted = tiling.shifted_ids(images, "aoi", "image_id").select("aoi", F.col("new_id").alias("image_id"), F.col("image_id").alias("original_id"))
    tables.write_csv(shifted, path := folder(spark))
    known = tables.read_csv(spark, path, "aoi string, image_id bigint, original_id bigint")
    return assessment.validated_ids(images.where("image_id % 3 = 0").select("aoi", F.col("image_id").alias("original_id")), known).select("aoi", "original_id", "image_id")


@query("SELECT label_id, 'pano_' || image_id || '.jpg' AS file_name, 'clipped' AS dataset FROM fx_labels WHERE image_id IN (SELECT image_id FROM fx_images) UNION ALL SELECT label_id, NULL, 'clipped' FROM fx_labels WHERE image_id NOT IN (SELECT image_id FROM fx_images)")
def clipped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "fx_images").select("image_id", "file_name")
    return view(spark, sf_dir, "fx_labels").join(images, "image_id", "left").select("label_id", "file_name", F.lit("clipped").alias("dataset"))


@query("SELECT 'pano_' || k || '.jpg' AS file_name, min(image_id) AS image_id FROM (SELECT image_id, image_id // 3 AS k FROM fx_images) GROUP BY k")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "fx_images").withColumn("file_name", F.concat(F.lit("pano_"), F.floor(F.col("image_id") / 3), F.lit(".jpg")))
    return tables.first_wins(images.select("file_name", "image_id"), ["file_name"], F.col("image_id"))


@query("SELECT frame_id, x, y, z FROM fx_frames")
def camera_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera coordinates written tab-separated, and read back."""
    tables.write_csv(view(spark, sf_dir, "fx_frames").select("frame_id", "x", "y", "z"), path := folder(spark), "frame_id", sep="\t")
    return tables.read_csv(spark, path, "frame_id bigint, x double, y double, z double", sep="\t")


@query("SELECT det_id, image_id, score, CAST(det_class AS INTEGER) AS det_class, x, w FROM fx_dets WHERE score >= 0.5")
def detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as lists and under documents' annotations, read back as one table."""
    dets = view(spark, sf_dir, "fx_dets").select("det_id", "image_id", "score", "det_class", F.array("x", "y", "w", "h").alias("bbox"))
    united.write_list_parts(dets.where("det_id % 2 = 0"), one := folder(spark))
    named = dets.where("det_id % 2 = 1").withColumnRenamed("det_id", "id").withColumnRenamed("det_class", "category_id")
    images = view(spark, sf_dir, "fx_images").select(F.col("image_id").alias("id")).limit(0)
    united.write_coco_parts(images, named, categories(spark), two := folder(spark))
    rows = tables.read_detections_any(spark, one).unionByName(tables.read_detections_any(spark, two)).where("score >= 0.5")
    return rows.select("det_id", "image_id", "score", "det_class", F.get("bbox", 0).cast("bigint").alias("x"), F.get("bbox", 2).cast("bigint").alias("w"))


@query("SELECT label_id, w * h AS area, CAST(x AS DOUBLE) AS x, CAST(y + h AS DOUBLE) AS bottom FROM fx_labels")
def feature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as vector features, read back, kept where they touch an area of interest."""
    labels = view(spark, sf_dir, "fx_labels").select("label_id", (F.col("w") * F.col("h")).alias("area"), _flat().cast("array<double>").alias("outline"))
    tables.write_features(labels, "outline", path := folder(spark))
    rows = tables.read_features(spark, path, projected=False).select(F.col("properties.label_id").cast("bigint").alias("label_id"), F.col("properties.area").cast("bigint").alias("area"), geometry.bounds(geometry.ring(F.col("geometry"))).alias("b"), geometry.ring(F.col("geometry")).alias("ring"))
    everywhere = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (8000.0, 0.0), (8000.0, 4000.0), (0.0, 4000.0))])
    return rows.where(geometry.rings_intersect(F.col("ring"), everywhere)).select("label_id", "area", "b.x", (F.col("b.y") + F.col("b.h")).alias("bottom"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_status WHERE action IN ('click', 'purchase')) SELECT ann_id, true AS validated, action = 'purchase' AS removed FROM k WHERE n = 1""")
def status_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.write_status(control.latest_status(view(spark, sf_dir, "fx_status"), "click", "purchase"), path := folder(spark))
    return tables.read_status(spark, path)


LOG = "SELECT image_id % 6 AS trial, (det_id % 97) / 100.0::DOUBLE AS p, (det_id % 89) / 100.0::DOUBLE AS r, (det_id % 83) / 100.0::DOUBLE AS m FROM fx_dets"


@query(f"""WITH log AS ({LOG}), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM log), b AS (SELECT concat('train_yolo_', trial) AS trial, max(p) AS "precision", round(max(f1), 6) AS f1, max(m) AS map50 FROM f GROUP BY 1) SELECT * FROM b ORDER BY f1 DESC, trial LIMIT 1""")
def trial_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trial over the progress files of all trials, written in their folders and read back."""
    log = view(spark, sf_dir, "fx_dets").select((F.col("image_id") % 6).alias("trial"), F.col("det_id").cast("int").alias("epoch"), (F.col("det_id") % 97 / 100).alias("precision"), (F.col("det_id") % 89 / 100).alias("recall"), (F.col("det_id") % 83 / 100).alias("map50"))
    root = folder(spark)
    for k in range(6):
        log.where(F.col("trial") == k).drop("trial").coalesce(1).write.csv(f"{root}/train_yolo_0/train_yolo_{k}/progress.csv", header=True)
    logs = spark.read.schema("epoch int, precision double, recall double, map50 double").csv(f"{root}/train_yolo_*/train_yolo_*/progress.csv", header=True)
    logs = logs.withColumn("trial", F.regexp_extract(F.input_file_name(), r"/(train_yolo_[^/]*)/progress\.csv", 1))
    return control.best_trial(control.best_trials(logs).withColumn("f1", F.round("f1", 6)))


@query("SELECT frame_id, x FROM (SELECT frame_id, x, row_number() OVER (ORDER BY t, frame_id) - 1 AS k FROM fx_frames) WHERE k % 4 = 0")
def every_fourth_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.every_nth(view(spark, sf_dir, "fx_frames"), 4, "t", "frame_id").select("frame_id", "x")


# Joins and groups


@query("SELECT d.det_id, f.x AS frame_x, d.x AS det_x, i.aoi FROM fx_frames f RIGHT JOIN fx_dets d ON f.frame_id = d.image_id LEFT JOIN fx_images i ON d.image_id = i.image_id")
def frame_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with their frame and image; columns of one name are told apart."""
    frames, dets, images = (view(spark, sf_dir, n) for n in ("fx_frames", "fx_dets", "fx_images"))
    rows = frames.join(dets, frames.frame_id == dets.image_id, "right").select("det_id", "image_id", frames.x.alias("frame_x"), dets.x.alias("det_x"))
    return rows.join(images.select("image_id", "aoi"), "image_id", "left").select("det_id", "frame_x", "det_x", "aoi")


@query(f"""{PROBLEM}, c AS (SELECT tag, unnest(list_distinct([x // 500, (x + 499) // 500 - 1])) AS ix, y FROM p), cc AS (SELECT tag, ix, unnest(list_distinct([y // 500, (y + 499) // 500 - 1])) AS iy FROM c),
n AS (SELECT ix, iy, count(*) FILTER (tag = 'FN') AS fn, count(*) FILTER (tag = 'FP') AS fp FROM cc WHERE ix >= 0 AND iy >= 0 GROUP BY 1, 2)
SELECT a.ix, b.iy, coalesce(n.fn, 0) AS "FN", coalesce(n.fp, 0) AS "FP" FROM range(16) a(ix) CROSS JOIN range(9) b(iy) LEFT JOIN n ON a.ix = n.ix AND b.iy = n.iy""")
def heat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.heat_grid(_problems(spark, sf_dir), 500.0, 0.0, 0.0, 16, 9)


AREAS = [(0.0, 0.0, 400.0, 90.0), (300.0, -10.0, 900.0, 1.0), (1200.0, -5.0, 1300.0, 5.0)]


@query("SELECT frame_id, x FROM fx_frames WHERE (x BETWEEN 0 AND 400) OR (x BETWEEN 300 AND 900) OR (x BETWEEN 1200 AND 1300)")
def inside_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame(AREAS, "minx double, miny double, maxx double, maxy double")
    return assessment.inside_any(view(spark, sf_dir, "fx_frames"), boxes, 250.0).select("frame_id", "x")


@query("SELECT image_id, min(det_id) AS det_id, arg_min(score, det_id) AS score FROM fx_dets GROUP BY image_id")
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_wins(view(spark, sf_dir, "fx_dets").select("image_id", "det_id", "score"), ["image_id"], F.col("det_id"))


@query("SELECT frame_id % 50 AS frame_id, frame_id % 6 AS sensor, frame_id % 3 AS face, list([x, y] ORDER BY frame_id) AS points FROM fx_frames GROUP BY 1, 2, 3")
def points_by_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "fx_frames").select((F.col("frame_id") % 50).alias("frame_id"), (F.col("frame_id") % 6).alias("sensor"), (F.col("frame_id") % 3).alias("face"), F.col("frame_id").alias("place"), F.col("x").alias("u"), F.col("y").alias("v"))
    return assessment.by_sensor(points).select("frame_id", "sensor", "face", F.transform("points", lambda p: F.array(p["u"], p["v"])).alias("points"))


@query("""WITH k AS (SELECT det_id, det_id % 400 AS k, CASE WHEN det_id % 3 = 0 THEN NULL ELSE det_id % 5 END AS c FROM fx_dets), f AS (SELECT k, c, min(det_id) AS first FROM k GROUP BY k, c)
SELECT k.det_id AS key, f.first FROM k JOIN f ON k.k = f.k AND k.c IS NOT DISTINCT FROM f.c WHERE f.first < k.det_id""")
def duplicated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_dets").select("det_id", (F.col("det_id") % 400).alias("k"), F.when(F.col("det_id") % 3 != 0, F.col("det_id") % 5).alias("c"))
    return assessment.duplicates(rows, "det_id")


@query("SELECT image_id, len(list_distinct(list(CAST(det_class AS INTEGER)))) AS classes, bool_or(det_class = 1) AS has_grid FROM fx_dets GROUP BY image_id")
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = view(spark, sf_dir, "fx_dets").groupBy("image_id").agg(F.collect_set(F.col("det_class").cast("int")).alias("own"))
    return sets.select("image_id", F.size(F.array_union("own", "own")).cast("bigint").alias("classes"), F.arrays_overlap("own", F.array(F.lit(1))).alias("has_grid"))


@query("SELECT label_id AS id, label_class AS class, NULL::DOUBLE AS score FROM fx_labels UNION ALL SELECT det_id, det_class + 1, score FROM fx_dets")
def united_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "fx_labels").select(F.col("label_id").alias("id"), F.col("label_class").alias("class"))
    return labels.unionByName(view(spark, sf_dir, "fx_dets").select(F.col("det_id").alias("id"), (F.col("det_class") + 1).alias("class"), "score"), allowMissingColumns=True)


@query("SELECT (SELECT count(*) FROM fx_images) AS images, (SELECT count(*) FROM fx_images WHERE image_id IN (SELECT image_id FROM fx_labels)) AS labelled, (SELECT count(*) FROM fx_labels) AS labels")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "fx_labels")
    images = view(spark, sf_dir, "fx_images").join(labels.select("image_id").distinct().withColumn("labelled", F.lit(1)), "image_id", "left")
    return images.agg(F.count("*").alias("images"), F.count("labelled").alias("labelled")).join(labels.agg(F.count("*").alias("labels")))


# The tile chain

CHAIN = """src AS (SELECT image_id, label_id AS ann_id, CASE WHEN label_id % 50 = 7 THEN -500 ELSE x END AS x0, CASE WHEN label_id % 50 = 9 THEN 3300 ELSE y END AS y0, w AS w0, h AS h0 FROM fx_labels WHERE image_id IN (SELECT image_id FROM fx_images)),
ann AS (SELECT image_id, ann_id, ann_id % 5 <> 0 AS known, CASE WHEN ann_id % 5 <> 0 THEN x0 + ann_id % 3 ELSE x0 END AS x, y0 AS y, w0 AS w, h0 AS h FROM src),
early AS (SELECT *, CASE WHEN x + w <= 0 OR x >= 8000 OR y + h <= 0 OR y >= 4000 THEN 'outside' WHEN y > 3264 THEN 'padding' END AS early FROM ann),
cut AS (SELECT image_id, ann_id, known, c * 468 AS min_x, 736 + r * 504 AS min_y, greatest(x - c * 468, 0) AS tile_x, greatest(y - 736 - r * 504, 0) AS tile_y,
CASE WHEN x < c * 468 THEN least(w + x - c * 468, 512) WHEN x - c * 468 + w > 512 THEN 512 - (x - c * 468) ELSE w END AS tile_w, CASE WHEN y < 736 + r * 504 THEN least(h + y - 736 - r * 504, 512) WHEN y - 736 - r * 504 + h > 512 THEN 512 - (y - 736 - r * 504) ELSE h END AS tile_h
FROM early, range(17) a(c), range(5) b(r) WHERE early IS NULL AND x < c * 468 + 512 AND x + w > c * 468 AND y < 736 + r * 504 + 512 AND y + h > 736 + r * 504),
outcome AS (SELECT image_id, ann_id, CASE WHEN (least(tile_x, 512) <= 10.24 OR tile_x >= 501.76) AND (tile_x + tile_w <= 10.24 OR tile_x + tile_w >= 501.76) OR (tile_y <= 10.24 OR tile_y >= 501.76) AND (tile_y + tile_h <= 10.24 OR tile_y + tile_h >= 501.76) THEN 'border' WHEN NOT known THEN 'rejected' ELSE 'kept' END AS outcome, min_x, min_y, tile_x, tile_y, tile_w, tile_h FROM cut
UNION ALL SELECT image_id, ann_id, early, NULL, NULL, NULL, NULL, NULL, NULL FROM early WHERE early IS NOT NULL)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "fx_labels").withColumn("ann_id", F.col("label_id"))
    boxes = labels.withColumn("x", F.when(F.col("ann_id") % 50 == 7, -500).otherwise(F.col("x"))).withColumn("y", F.when(F.col("ann_id") % 50 == 9, 3300).otherwise(F.col("y"))).select("image_id", "ann_id", "x", "y", "w", "h")
    valid = boxes.where("ann_id % 5 <> 0").withColumn("x", F.col("x") + F.col("ann_id") % 3)
    return tiling.clip_chain(view(spark, sf_dir, "fx_images"), boxes, valid)


@query(f"WITH {CHAIN} SELECT * FROM outcome")
def clip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("image_id", "ann_id", "outcome", *[F.col(c).cast("bigint").alias(c) for c in ("min_x", "min_y", "tile_x", "tile_y", "tile_w", "tile_h")])


@query(f"WITH {CHAIN} SELECT outcome, count(*) AS n, count(DISTINCT ann_id) AS annotations FROM outcome GROUP BY outcome")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("ann_id").alias("annotations"))


SPLIT = """v AS (SELECT image_id, aoi FROM fx_images WHERE image_id % 3 = 0), r AS (SELECT image_id, aoi, row_number() OVER (PARTITION BY aoi ORDER BY md5(concat('42|', image_id)), image_id) AS k, count(*) OVER (PARTITION BY aoi) AS n FROM v), t AS (SELECT *, round_even(n * 0.7::DOUBLE, 0) AS trn FROM r),
s AS (SELECT image_id, CASE WHEN k <= trn THEN 'trn' WHEN k <= trn + round_even((n - trn) * 0.5, 0) THEN 'val' ELSE 'tst' END AS dataset FROM t)"""


@query(f"WITH {SPLIT} SELECT i.image_id, i.aoi, coalesce(s.dataset, 'oth') AS dataset FROM fx_images i LEFT JOIN s ON i.image_id = s.image_id")
def split_with_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "fx_images")
    return tiling.split_modes(images, images.where("image_id % 3 = 0"), "image_id", "aoi").select("image_id", "aoi", "dataset")


@query("SELECT image_id, aoi, CASE WHEN image_id % 3 = 0 THEN 'tst' ELSE 'oth' END AS dataset FROM fx_images")
def split_test_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "fx_images")
    return tiling.split_modes(images, images.where("image_id % 3 = 0"), "image_id", "aoi", test_only=True).select("image_id", "aoi", "dataset")


@query("SELECT d.det_id, i.image_id, d.x % 468 + 467 AS x, d.y % 504 + 735 AS y, d.w + 2 AS w, d.h + 2 AS h, round_even(d.score * 1000, 0) / 1000 AS score FROM fx_dets d JOIN fx_images i ON d.image_id = i.image_id")
def panorama_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on tiles moved to the image that their tile's name tells, grown by a pixel."""
    images = view(spark, sf_dir, "fx_images")
    dets = view(spark, sf_dir, "fx_dets").join(images.select("image_id"), "image_id", "left_semi").drop("image_id", "dataset").withColumn("k", F.floor(F.col("det_id") / 80))
    dets = dets.withColumn("tile", geometry.tile_name(F.concat(F.lit("pano_"), F.col("k"), F.lit(".jpg")), F.lit(468), F.lit(736)))
    name = geometry.parse_tile_name(F.col("tile"))
    dets = dets.select("det_id", "score", "w", "h", (F.col("x") % 468).alias("x"), (F.col("y") % 504).alias("y"), name["x"].alias("min_x"), name["y"].alias("min_y"), F.concat(name["image"], F.lit(".jpg")).alias("file_name"))
    rows = merging.to_panorama(control.looked_up(dets, images, "file_name"))
    return rows.select("det_id", "image_id", "x", "y", "w", "h", geometry.half_even(F.col("score"), 3).alias("score"))


CLAMPED = "SELECT label_id, c * 468 AS min_x, 736 + r * 504 AS min_y, least(greatest(x - c * 468, 0), 512) AS x0, least(greatest(y - 736 - r * 504, 0), 512) AS y0, least(greatest(x + w - c * 468, 0), 512) AS x1, least(greatest(y + h - 736 - r * 504, 0), 512) AS y1 FROM fx_labels, range(17) a(c), range(5) b(r) WHERE x < c * 468 + 512 AND x + w > c * 468 AND y < 736 + r * 504 + 512 AND y + h > 736 + r * 504"


@query(f"""WITH p AS ({CLAMPED}), e AS (SELECT *, (x0 IN (0, 512)) AS ex0, (x1 IN (0, 512)) AS ex1, (y0 IN (0, 512)) AS ey0, (y1 IN (0, 512)) AS ey1 FROM p),
a AS (SELECT *, NOT (ex1 AND x1 = x0 OR ey0) AS k1 FROM e), b AS (SELECT *, CASE WHEN k1 THEN x1 ELSE x0 END AS lx, y0 AS ly FROM a),
c AS (SELECT *, NOT (ex1 AND x1 = lx OR ey1 AND y1 = ly OR k1 AND x1 = x1 AND y1 = y0) AS k2 FROM b), d AS (SELECT *, CASE WHEN k2 THEN x1 ELSE lx END AS mx, CASE WHEN k2 THEN y1 ELSE ly END AS my FROM c),
f AS (SELECT *, NOT (ex0 AND x0 = mx OR ey1 AND y1 = my OR k1 AND x0 = x1 AND y1 = y0 OR k2 AND x0 = x1) AS k3 FROM d),
g AS (SELECT *, list_filter([{{'x': x0, 'y': y0, 'k': true}}, {{'x': x1, 'y': y0, 'k': k1}}, {{'x': x1, 'y': y1, 'k': k2}}, {{'x': x0, 'y': y1, 'k': k3}}], lambda v: v.k) AS ring FROM f)
SELECT label_id, min_x, min_y, CAST(len(ring) AS INTEGER) AS corners, abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: CAST(ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y AS DOUBLE)))) / 2 AS area,
len(list_filter(ring, lambda v: v.x > 10.24 AND v.x < 501.76)) = 0 OR len(list_filter(ring, lambda v: v.y > 10.24 AND v.y < 501.76)) = 0 AS borderline FROM g""")
def seg_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiling.tiles_of_boxes(view(spark, sf_dir, "fx_labels"))
    clipped = geometry.clip_ring(geometry.ring(_flat()), F.col("min_x"), F.col("min_y"), 512)
    rows = rows.select("label_id", F.col("min_x").cast("bigint").alias("min_x"), F.col("min_y").cast("bigint").alias("min_y"), clipped.alias("ring"))
    return rows.select("label_id", "min_x", "min_y", F.size("ring").alias("corners"), geometry.area(F.col("ring")).alias("area"), geometry.on_border(F.col("ring"), 512).alias("borderline"))


# From masks to rays


def _mask(u, v, a: float, b: float, turn: float, points: int = 40):
    """The outline of an ellipse around a pixel, as a mask."""
    at = [2 * math.pi / points * i for i in range(points)]
    return _around(u, v, [(a * math.cos(t) * math.cos(turn) - b * math.sin(t) * math.sin(turn), a * math.cos(t) * math.sin(turn) + b * math.sin(t) * math.cos(turn)) for t in at])


def _around(u, v, corners: list[tuple[float, float]]):
    """A mask of one ring whose corners lie so far from a pixel."""
    places = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return F.array(F.flatten(F.transform(places, lambda p: F.array(u + p["x"], v + p["y"]))))


@query(f"""WITH d AS (SELECT f.frame_id, o.object_id, o.x - f.x AS vx, o.y - f.y AS vy, o.z - f.z AS vz FROM fx_drive_frames f JOIN fx_drive_objects o ON f.drive = o.drive AND sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) < 14)
SELECT frame_id, object_id, {", ".join(f"round(v{c} / sqrt(vx * vx + vy * vy + vz * vz), 5) + 0 AS d{c}" for c in "xyz")} FROM d""")
def mask_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects seen as tilted elliptic masks in turned panoramas, and the rays through the ellipses fitted to them: they point back at the objects."""
    frames, objects = view(spark, sf_dir, "fx_drive_frames"), view(spark, sf_dir, "fx_drive_objects")
    near = distance_pairs(objects.select(F.col("object_id").alias("id"), "x", "y"), frames.select(F.col("frame_id").alias("id"), "x", "y"), 14.0)
    rows = near.select(F.col("a").alias("object_id"), F.col("b").alias("frame_id")).join(frames, "frame_id").join(objects.select("object_id", *[F.col(c).alias(f"p{c}") for c in "xyz"]), "object_id")
    pose = tuple(F.col(c) for c in "xyz")
    u, v = camera.spherical_pixel(camera.to_camera(tuple(F.col(f"p{c}") for c in "xyz"), pose, *_turned()), 8000, 4000)
    pixels = keeper(spark)(rows.select("object_id", "frame_id", *"xyz", u.alias("u"), v.alias("v")))
    masks = keeper(spark)(pixels.select("object_id", "frame_id", *"xyz", _mask(F.col("u"), F.col("v"), 30.0, 12.0, 0.4).alias("segmentation")))
    found = rays.rays_of_masks(masks, rays.spherical(pose, _turned(), 8000, 4000))
    return found.select("frame_id", "object_id", *[(F.round(f"d{c}", 5) + 0).alias(f"d{c}") for c in "xyz"])


# The map projection

PLACES = "SELECT label_id, CAST(45.9 AS DOUBLE) + (label_id % 190) / 100.0::DOUBLE AS lat, 6 + (label_id % 440) / 100.0::DOUBLE AS lon FROM fx_labels"
PLANE = f"""sphere AS (SELECT label_id, 2 * (atan(exp({mapping.ALPHA!r}::DOUBLE * (ln(tan(pi() / 4 + radians(lat) / 2)) - {math.sqrt(mapping.BESSEL_E2) / 2!r}::DOUBLE * ln((1 + {math.sqrt(mapping.BESSEL_E2)!r}::DOUBLE * sin(radians(lat))) / (1 - {math.sqrt(mapping.BESSEL_E2)!r}::DOUBLE * sin(radians(lat))))) + {mapping.K!r}::DOUBLE)) - pi() / 4) AS b,
{mapping.ALPHA!r}::DOUBLE * (radians(lon) - {math.radians(mapping.CENTRE[1])!r}::DOUBLE) AS l FROM places),
turned AS (SELECT label_id, atan2(sin(l), {math.sin(mapping.B0)!r}::DOUBLE * tan(b) + {math.cos(mapping.B0)!r}::DOUBLE * cos(l)) AS l, asin({math.cos(mapping.B0)!r}::DOUBLE * sin(b) - {math.sin(mapping.B0)!r}::DOUBLE * cos(b) * cos(l)) AS b FROM sphere),
plane AS (SELECT label_id, {mapping.ORIGIN[0]} + {mapping.RADIUS!r}::DOUBLE * l AS east, {mapping.ORIGIN[1]} + {mapping.RADIUS!r}::DOUBLE / 2 * ln((1 + sin(b)) / (1 - sin(b))) AS north FROM turned)"""


@query(f"WITH places AS ({PLACES}), {PLANE} SELECT label_id, round(east, 4) AS east, round(north, 4) AS north FROM plane")
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the ellipsoid in the plane of the Swiss projection."""
    rows = view(spark, sf_dir, "fx_labels").select("label_id", mapping.to_plane(45.9 + F.col("label_id") % 190 / 100, 6 + F.col("label_id") % 440 / 100).alias("p"))
    return rows.select("label_id", F.round("p.east", 4).alias("east"), F.round("p.north", 4).alias("north"))


@query(f"SELECT label_id, round(lat, 8) AS lat, round(lon, 8) AS lon FROM ({PLACES})")
def map_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places, to the plane and back."""
    rows = map_projection(spark, sf_dir).select("label_id", mapping.from_plane(F.col("east"), F.col("north")).alias("g"))
    return rows.select("label_id", F.round("g.lat", 8).alias("lat"), F.round("g.lon", 8).alias("lon"))


@query()
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees by which grid north turns from the meridian at the cameras of drives, and their heading turned by it; tests hold it against places there and back."""
    rows = view(spark, sf_dir, "fx_drive_frames").select("frame_id", (2_500_000 + 20 * F.col("x")).alias("east"), (1_200_000 + F.col("y")).alias("north"), F.lit(500.0).alias("up"))
    rows = rows.withColumn("turn", mapping.meridian_convergence(F.col("east"), F.col("north"), F.col("up")))
    pose = camera.opk_matrix(F.lit(0.0), F.lit(0.0), F.radians(F.col("frame_id") % 90))
    kappa = camera.opk_of(mapping.turned_by_convergence(pose, F.col("turn")))[2]
    return rows.select("frame_id", F.round("turn", 6).alias("turn"), F.round(F.degrees(kappa), 6).alias("heading"))


# Polygons and names


def _tilted(rows: DataFrame) -> DataFrame:
    """Boxes of all images side by side on one map, as parallelograms of the same area: no image tells them apart any more."""
    x, y = F.col("x") + 20_000 * (F.col("image_id") % 50), F.col("y") + 20_000 * F.floor(F.col("image_id") / 50)
    corners = [(x, y), (x + F.col("w"), y), (x + F.col("w"), y + F.col("h")), (x, y + F.col("h"))]
    flat = F.array(*[c.cast("double") for u, v in corners for c in (2 * u + v, u + v)])
    return rows.withColumn("segmentation", F.array(flat)).drop("x", "y", "w", "h", "image_id")


def _tilted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets, labels = _tilted(view(spark, sf_dir, "fx_dets")), _tilted(view(spark, sf_dir, "fx_labels"))
    pairs = keeper(spark)(matching.polygon_pairs(dets, labels, 400.0))
    return matching.tagged(dets, labels, pairs=pairs)


@query(f"WITH {TAGS} SELECT dataset, tag, label_id, det_id FROM tags")
def polygon_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted outlines matched by their place alone, with the IoU of the outlines."""
    return _tilted_tags(spark, sf_dir).select("dataset", "tag", "label_id", "det_id")


@query(f'WITH {TAGS}, c AS (SELECT dataset, {COUNTS} FROM tags GROUP BY dataset) SELECT dataset, tp AS "TP", fp AS "FP", fn AS "FN", {RATIOS} FROM c')
def polygon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.metrics(_tilted_tags(spark, sf_dir), "dataset")


@query(f"{SWEEP} SELECT * FROM sweep")
def polygon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold sweep over outlines found by their place."""
    dets, labels = _tilted(view(spark, sf_dir, "fx_dets")), _tilted(view(spark, sf_dir, "fx_labels"))
    return matching.threshold_sweep(dets, labels, pairs=keeper(spark)(matching.polygon_pairs(dets, labels, 400.0)))


@query(f"WITH {PAIRS} SELECT det_id, label_id, round(iou, 4) AS iou FROM scored WHERE shared > 0")
def polygon_ious(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets, labels = (_tilted(view(spark, sf_dir, n)) for n in ("fx_dets", "fx_labels"))
    return matching.polygon_pairs(dets, labels, 400.0).select("det_id", "label_id", F.round("iou", 4).alias("iou"))


AREAS_SQL = "a AS (SELECT k, 200 * (k % 36) AS ax, 736 + 200 * (k // 36) AS ay FROM fx_objects)"


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas in the form of an L with a square hole."""
    x, y = 200.0 * (F.col("k") % 36), 736 + 200.0 * F.floor(F.col("k") / 36)
    place = lambda points: F.array(*[c for u, v in points for c in (x + u, y + v)])
    outer, hole = place([(0, 0), (150, 0), (150, 75), (75, 75), (75, 150), (0, 150)]), place([(20, 20), (50, 20), (50, 50), (20, 50)])
    return view(spark, sf_dir, "fx_objects").select("k", F.array(outer, hole).alias("segmentation"))


@query(f"""WITH {AREAS_SQL} SELECT DISTINCT label_id FROM fx_labels JOIN a ON x BETWEEN ax AND ax + 150 AND y BETWEEN ay AND ay + 150
WHERE NOT (x > ax + 75 AND y > ay + 75) AND NOT (x > ax + 20 AND x < ax + 50 AND y > ay + 20 AND y < ay + 50)""")
def points_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in concave areas with holes."""
    points = view(spark, sf_dir, "fx_labels").select("label_id", "x", "y")
    return areas.points_in_areas(points, _areas(spark, sf_dir), 60.0).select("label_id")


@query(f"""WITH {AREAS_SQL} SELECT DISTINCT det_id FROM fx_dets JOIN a ON x <= ax + 150 AND x + w >= ax AND y <= ay + 150 AND y + h >= ay
WHERE (y <= ay + 75 OR x <= ax + 75) AND NOT (x > ax + 20 AND x + w < ax + 50 AND y > ay + 20 AND y + h < ay + 50)""")
def outlines_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that share a point with such areas."""
    rows = view(spark, sf_dir, "fx_dets").select("det_id", F.array(F.transform(_flat(), lambda v: v.cast("double"))).alias("segmentation"))
    return areas.outlines_in_areas(rows, _areas(spark, sf_dir), 60.0, "det_id").select("det_id")


@query("SELECT label_id, CAST(w * h AS DOUBLE) AS area, dataset FROM fx_labels WHERE x <= 3000 AND x + w >= 2000 AND y + h > 1500")
def geopackage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines written as GeoPackage parts and read back where their box meets a window, by the index of each part."""
    geopackage.register(spark)
    ring = F.array(F.transform(_flat(), lambda v: v.cast("double")))
    path = f"{folder(spark)}/labels"
    view(spark, sf_dir, "fx_labels").select("label_id", "dataset", ring.alias("geometry")).write.format("gpkg").mode("append").save(path)
    rows = geopackage.projected(spark.read.format("gpkg").load(path).where("minx <= 3000 and maxx >= 2000 and maxy > 1500"))
    return rows.select("label_id", overlay.area("geometry").alias("area"), "dataset")


RIM = "SELECT label_id, i, x + w * cos(i * pi() / 6) AS x, y + h / 2.0::DOUBLE * sin(i * pi() / 6) AS y, 500 + (label_id % 5) * cos(i * pi() / 6) + CASE label_id % 3 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END * ((i * 7 + label_id) % 4) + CASE WHEN i = label_id % 12 AND label_id % 2 = 0 THEN 9 ELSE 0 END AS z FROM fx_labels, range(12) r(i)"


def _rims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve points around each label: tilted, some with noise, some with a point far too high."""
    i, a = F.col("i"), F.col("i") * (math.pi / 6)
    rows = view(spark, sf_dir, "fx_labels").select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    noise = F.when(F.col("label_id") % 3 == 0, 0.4).when(F.col("label_id") % 3 == 1, 0.02).otherwise(0.0) * ((i * 7 + F.col("label_id")) % 4)
    z = 500 + F.col("label_id") % 5 * F.cos(a) + noise + F.when((i == F.col("label_id") % 12) & (F.col("label_id") % 2 == 0), 9).otherwise(0)
    return rows.select("label_id", "i", (F.col("x") + F.col("w") * F.cos(a)).alias("x"), (F.col("y") + F.col("h") / 2 * F.sin(a)).alias("y"), z.alias("z"))


@query(f"""WITH p AS ({RIM}), m AS (SELECT label_id, avg(x) mx, avg(y) my, avg(z) mz, var_pop(x) a, covar_pop(x, y) d, covar_pop(x, z) e, var_pop(y) b, covar_pop(y, z) f, var_pop(z) c FROM p GROUP BY label_id),
q AS (SELECT *, (a + b + c) / 3 AS q FROM m), s AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS s FROM q),
t AS (SELECT *, q + 2 * s * cos(acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * s ** 3)))) / 3 + 2 * pi() / 3) AS l FROM s),
v AS (SELECT *, d * f - e * (b - l) AS nx, e * d - (a - l) * f AS ny, (a - l) * (b - l) - d * d AS nz FROM t), u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM v),
w AS (SELECT label_id, max(((x - mx) * nx + (y - my) * ny + (z - mz) * nz) / n) - min(((x - mx) * nx + (y - my) * ny + (z - mz) * nz) / n) AS spread FROM p JOIN u USING (label_id) GROUP BY label_id)
SELECT label_id, spread < 0.15 AS flat, round(spread, 5) AS spread FROM w""")
def plane_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rims of objects lie in a plane, by moments and a second pass."""
    return fits.flatness(_rims(spark, sf_dir), "label_id").select("label_id", "flat", F.round("spread", 5).alias("spread"))


@query(f"""WITH p AS ({RIM}), s AS (SELECT *, abs(z - avg(z) OVER w) > 2 * stddev_pop(z) OVER w AS outlier FROM p WINDOW w AS (PARTITION BY label_id)),
m AS (SELECT label_id, avg(x) mx, avg(y) my, avg(z) mz, var_pop(x) a, covar_pop(x, y) d, covar_pop(x, z) e, var_pop(y) b, covar_pop(y, z) f FROM s WHERE NOT outlier GROUP BY label_id),
k AS (SELECT *, (e * b - f * d) / (a * b - d * d) AS u, (f * a - e * d) / (a * b - d * d) AS v FROM m)
SELECT label_id, i, outlier, round(mz + u * (x - mx) + v * (y - my), 5) AS level FROM s JOIN k USING (label_id)""")
def levelled_rims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of rims on the plane fitted to those that are no outliers."""
    return fits.levelled(_rims(spark, sf_dir), "label_id").select("label_id", F.col("i").cast("long").alias("i"), "outlier", F.round("level", 5).alias("level"))


@query("SELECT label_id, CAST(x AS DOUBLE) AS cx, CAST(y AS DOUBLE) AS cy, round(greatest(w, h / 2.0::DOUBLE), 3) AS long, round(least(w, h / 2.0::DOUBLE), 3) AS short, round(65 / 2.0::DOUBLE * sin(2 * pi() / 65) * w * h / 2, 2) AS area FROM fx_labels")
def fitted_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses fitted to rims by their moments, and the area of 65 points along them."""
    found = fits.ellipses(_rims(spark, sf_dir), "label_id")
    area = overlay.area(F.array(fits.outline(*(F.col(c) for c in ("cx", "cy", "a", "b", "angle")))))
    return found.select("label_id", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"), F.round(F.greatest("a", "b"), 3).alias("long"), F.round(F.least("a", "b"), 3).alias("short"), F.round(area, 2).alias("area"))


@query("SELECT det_id, score, CAST(w * h AS DOUBLE) AS area FROM fx_dets WHERE x <= 4000 AND x + w >= 3000 AND y >= 1800")
def flatgeobuf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines written as FlatGeobuf parts in Hilbert order and read back where their box meets a window, by a walk through each part's tree."""
    flatgeobuf.register(spark)
    ring = F.array(F.transform(_flat(), lambda v: v.cast("double")))
    path = f"{folder(spark)}/dets"
    view(spark, sf_dir, "fx_dets").select("det_id", "score", ring.alias("geometry")).write.format("fgb").mode("append").save(path)
    rows = geopackage.projected(spark.read.format("fgb").load(path).where("minx <= 4000 and maxx >= 3000 and miny >= 1800"))
    return rows.select("det_id", "score", overlay.area("geometry").alias("area"))


def _cornered(kind: int) -> DataFrame:
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    rings = {
        "bow": F.array(F.array(x, y, x + w, y + h, x + w, y, x, y + h)),
        "spike": F.array(F.array(x, y, x + w, y, x + w, y + 3 * h, x + w, y, x + w, y + h, x + w, y + h, x, y + h)),
        "frame": F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h), F.array(x + 5, y + 5, x + w - 5, y + 5, x + w - 5, y + h - 5, x + 5, y + h - 5)),
        "pair": F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h), F.array(x + w / 2, y, x + 1.5 * w, y, x + 1.5 * w, y + h, x + w / 2, y + h)),
    }
    return list(rings.values())[kind]


@query("""SELECT label_id, CASE k WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS parts, CASE k WHEN 2 THEN 1 ELSE 0 END AS holes,
round(CASE k WHEN 0 THEN w * h / 2.0::DOUBLE WHEN 1 THEN w * h WHEN 2 THEN w * h - (w - 10) * (h - 10) ELSE w * h END, 2) AS area FROM (SELECT *, label_id % 4 AS k FROM fx_labels)""")
def repaired_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow-ties, spikes with repeated vertices, frames and overlapping parts, repaired to parts with holes."""
    kinds = [F.when(F.col("label_id") % 4 == k, _cornered(k)) for k in range(4)]
    rows = view(spark, sf_dir, "fx_labels").select("label_id", F.coalesce(*kinds).alias("segmentation"))
    rows = rows.select("label_id", overlay.repaired("segmentation").alias("parts"), overlay.area("segmentation").alias("area"))
    holes = F.aggregate(F.transform("parts", lambda p: F.size(p) - 1), F.lit(0), lambda a, n: a + n)
    return rows.select("label_id", F.size("parts").alias("parts"), holes.alias("holes"), F.round("area", 2).alias("area"))


@query("SELECT label_id, round(w * h + 2 * (w + h) * 3 + 64 * 0.5::DOUBLE * sin(pi() / 32) * 9, 2) AS grown, CAST((w - 6) * (h - 6) AS DOUBLE) AS shrunk, CASE WHEN least(w, h) > 80 THEN (w - 80.0::DOUBLE) * (h - 80) ELSE 0.0::DOUBLE END AS gone FROM fx_labels")
def buffered_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by 3 with round corners, shrunk by 3, and by 40, where small ones vanish."""
    rows = spread(view(spark, sf_dir, "fx_labels")).select("label_id", F.array(F.transform(_flat(), lambda v: v.cast("double"))).alias("s"))
    sizes = [F.round(overlay.area(overlay.buffered("s", F.lit(by))), 2).alias(c) for c, by in (("grown", 3.0), ("shrunk", -3.0), ("gone", -40.0))]
    return rows.select("label_id", *sizes)


@query("""WITH m AS (SELECT det_id // 4 AS b, min(det_id) AS id, count(*) AS n, max(w) AS w, max(h) AS h, round(median(score), 6) AS score FROM fx_dets GROUP BY 1)
SELECT id, n AS members, score, 1000.0::DOUBLE * (b % 7) + 3 * (id % 4) AS x, CAST(w + 3 * (n - 1) AS DOUBLE) AS w, CAST(h + 2 * (n - 1) AS DOUBLE) AS h, round(w * h + (n - 1) * (w * h - (w - 3) * (h - 2)) + 2 * (n - 1) * (1 - 8 * sin(pi() / 32)), 1) AS area FROM m""")
def polygon_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of tiles that overlap in steps, merged to one outline: grown by a pixel, united, shrunk by a pixel."""
    b, j = F.floor(F.col("det_id") / 4), F.col("det_id") % 4
    x, y = 1000.0 * (b % 7) + 3 * j, 1000.0 * (F.floor(b / 7) % 5) + 2 * j
    box = F.array(x - 468, y - 504, x - 468 + F.col("w"), y - 504, x - 468 + F.col("w"), y - 504 + F.col("h"), x - 468, y - 504 + F.col("h"))
    tiles = view(spark, sf_dir, "fx_dets").select("det_id", F.lit("one").alias("dataset"), F.floor(b / 35).alias("image_id"), (F.col("det_class") + 1).alias("category_id"), "score", F.array(box).alias("segmentation"), F.lit(468).alias("min_x"), F.lit(504).alias("min_y"))
    keep = keeper(spark)
    moved = keep(merging.outlines_to_panorama(tiles))
    merged = merging.merged_outlines(moved, merging.outline_groups(moved, keep), keep)
    return merged.select("id", "members", r6(F.col("score"), "score"), *[F.round(c, 2).alias(c) for c in "xwh"], F.round("area", 1).alias("area"))


@query("SELECT label_id, CASE WHEN label_id % 4 = 0 THEN 0 WHEN label_id % 4 = 1 THEN 2 ELSE 1 END AS parts, CASE WHEN label_id % 4 = 0 THEN 0.0::DOUBLE WHEN label_id % 4 = 1 THEN 2.0::DOUBLE * w * h ELSE CAST(w * h AS DOUBLE) END AS area, CASE WHEN label_id % 4 = 0 THEN 0 WHEN label_id % 4 = 1 THEN 16 ELSE 8 END AS numbers FROM fx_labels WHERE label_id % 4 <> 0")
def polygon_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations of no, one or two whole parts; those of none are dropped, others come back as one list."""
    part, far = _flat(), geometry.shift(_flat(), F.lit(10_000), F.lit(0))
    parts = F.when(F.col("label_id") % 4 == 0, F.array(F.slice(part, 1, 4))).when(F.col("label_id") % 4 == 1, F.array(part, far)).when(F.col("label_id") % 4 == 2, F.array(part, F.slice(part, 1, 2))).otherwise(F.array(part))
    rows = view(spark, sf_dir, "fx_labels").select("label_id", geometry.rings(parts).alias("rings")).where(F.size("rings") > 0)
    return rows.select("label_id", F.size("rings").alias("parts"), geometry.parts_area(F.col("rings")).alias("area"), F.size(F.get(geometry.segmentation(F.col("rings")), 0)).alias("numbers"))


@query("SELECT l.label_id, d.det_id FROM fx_labels l JOIN fx_dets d ON l.image_id = d.image_id AND d.x <= l.x + l.w AND l.x <= d.x + d.w AND d.y <= l.y + l.h AND l.y <= d.y + d.h")
def polygon_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and detections of an image whose outlines touch: boxes meet in the join, the sides of a batch of pairs are tested together."""
    outline = F.array(F.transform(_flat(), lambda v: v.cast("double"))).alias("segmentation")
    labels = view(spark, sf_dir, "fx_labels").select("image_id", "label_id", *"xywh", outline).alias("l")
    dets = view(spark, sf_dir, "fx_dets").select("image_id", "det_id", *"xywh", outline).alias("d")
    near = geometry.boxes_overlap(*({c: F.col(f"{t}.{c}") for c in "xywh"} for t in "ld"))
    met = labels.join(dets, (F.col("l.image_id") == F.col("d.image_id")) & near)
    return met.where(overlay.touch("l.segmentation", "d.segmentation")).select("label_id", "det_id")


@query("SELECT label_id, round(x + w / 2.0::DOUBLE - w * 0.55::DOUBLE, 6) AS x0, round(y + h / 2.0::DOUBLE + h * 0.55::DOUBLE, 6) AS y1, round(w * 1.1::DOUBLE, 6) AS w FROM fx_labels")
def polygon_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(spread(view(spark, sf_dir, "fx_labels")), {"b": geometry.bounds(geometry.scale(geometry.ring(_flat()), 1.1))})
    return rows.select("label_id", r6(F.col("b.x"), "x0"), r6(F.col("b.y") + F.col("b.h"), "y1"), r6(F.col("b.w"), "w"))


@query("SELECT det_id, [CAST(trunc(-x / 10.0::DOUBLE) AS INTEGER), CAST(trunc(y / 10.0::DOUBLE) AS INTEGER), CAST(w AS INTEGER), CAST(h AS INTEGER)] AS box FROM fx_dets")
def truncated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(-F.col("x") / 10, F.col("y") / 10, F.col("w").cast("double"), F.col("h").cast("double"))
    return view(spark, sf_dir, "fx_dets").select("det_id", geometry.truncated(box).alias("box"))


@query("SELECT label_id, w * h AS area FROM fx_labels WHERE w * h > greatest(4000, 8000) / 2")
def large_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_labels").select("label_id", (F.col("w") * F.col("h")).alias("area")).where(F.col("area") > F.greatest(F.lit(4000), F.lit(8000)) / 2)


@query("SELECT image_id, concat('pano_', image_id, '.jpg') AS once, ['a' || image_id, 'b'] AS listed, concat(aoi, '_pano_', image_id, '.png') AS shown FROM fx_images")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("image_id") % 2 == 0, F.col("file_name")).otherwise(F.regexp_replace("file_name", r"\.jpg$", ""))
    literal = F.concat(F.lit("['a"), F.col("image_id"), F.lit("', 'b']"))
    tif = F.regexp_replace("file_name", r"\.jpg$", ".tif")
    return view(spark, sf_dir, "fx_images").select("image_id", geometry.with_suffix(name, ".jpg").alias("once"), geometry.list_literal(literal).alias("listed"), geometry.shown_name(tif, F.col("aoi")).alias("shown"))


@query("SELECT id, cell_x FROM (SELECT CAST(CAST(50 * k AS BIGINT) + ix * 100 AS VARCHAR) || ', ' || CAST(iy * 100 AS VARCHAR) AS id, 50.0::DOUBLE * k + ix * 100.0::DOUBLE AS cell_x, iy * 100.0::DOUBLE AS cell_y FROM fx_objects, range(3) a(ix), range(2) b(iy)) WHERE cell_x BETWEEN 0 AND 1000 AND cell_y BETWEEN 0 AND 50")
def tested_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose lower left corner lies in a test shape."""
    extents = view(spark, sf_dir, "fx_objects").select((50.0 * F.col("k")).alias("minx"), F.lit(0.0).alias("miny"), (50.0 * F.col("k") + 250).alias("maxx"), F.lit(150.0).alias("maxy"))
    shape = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1000.0, 0.0), (1000.0, 50.0), (0.0, 50.0))])
    return tiling.extent_grid(extents, 100.0).where(geometry.inside(F.col("cell_x"), F.col("cell_y"), shape)).select("id", "cell_x")


@query("SELECT det_id, CAST(image_id AS INTEGER) AS image_id, CAST(w * h AS DOUBLE) AS area, x, y FROM fx_dets WHERE score >= 0.5")
def first_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from a score on, by the first ring of their segmentation alone."""
    parts = F.array(_flat(), geometry.shift(_flat(), F.lit(500), F.lit(0)))
    rows = view(spark, sf_dir, "fx_dets").where("score >= 0.5").select("det_id", F.col("image_id").cast("int").alias("image_id"), geometry.ring(F.get(parts, 0)).alias("ring"))
    return rows.select("det_id", "image_id", geometry.area(F.col("ring")).alias("area"), geometry.bounds(F.col("ring"))["x"].alias("x"), geometry.bounds(F.col("ring"))["y"].alias("y"))


@query("SELECT label_id, round(n / 2.0::DOUBLE * r * r * sin(2 * pi() / n), 4) AS area FROM (SELECT label_id, CASE WHEN label_id % 3 = 0 THEN 40 ELSE 64 END AS n, w / 8.0::DOUBLE AS r, w FROM fx_labels) WHERE n > 50 AND n / 2.0::DOUBLE * r * r * sin(2 * pi() / n) > 200")
def sane_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of over 50 vertices, over 200 square pixels and under 1000 pixels across."""
    labels = spread(view(spark, sf_dir, "fx_labels"))
    of = lambda n: geometry.point_buffer(F.col("x"), F.col("y"), F.col("w") / 8, n)
    rows = labels.select("label_id", F.when(F.col("label_id") % 3 == 0, of(40)).otherwise(of(64)).alias("ring"))
    rows = rows.select("label_id", "ring", geometry.area(F.col("ring")).alias("area"))
    return rows.where((F.size("ring") > 50) & (F.col("area") > 200) & (geometry.bounds(F.col("ring"))["w"] < 1000)).select("label_id", F.round("area", 4).alias("area"))


@query("SELECT label_id, label_id % 3 = 0 AS all_zero, CASE WHEN label_id % 3 = 0 THEN 0 ELSE label_id % 3 END AS first FROM fx_labels")
def elevation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines without any elevation are reported and left; others take the nearest one where it is missing."""
    z = F.array(F.lit(0).cast("bigint"), F.col("label_id") % 3, F.lit(0).cast("bigint"))
    rows = view(spark, sf_dir, "fx_labels").select("label_id", z.alias("z"))
    return rows.select("label_id", (~F.exists("z", lambda v: v != 0)).alias("all_zero"), F.get(geometry.nearest_nonzero(F.col("z")), 0).alias("first"))


@query("""SELECT image_id, 0 || ' ' || string_agg(line, ' ' ORDER BY k) AS line FROM (SELECT image_id, label_id, k, CAST(v AS VARCHAR) AS line FROM (SELECT image_id, label_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([x / 8000.0::DOUBLE, y / 4000.0::DOUBLE, (x + w) / 8000.0::DOUBLE, y / 4000.0::DOUBLE, (x + w) / 8000.0::DOUBLE, (y + h) / 4000.0::DOUBLE, x / 8000.0::DOUBLE, (y + h) / 4000.0::DOUBLE]) AS raw FROM fx_labels), LATERAL (SELECT round(raw, 6) AS v)) GROUP BY image_id, label_id""")
def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of whole shares of the image, written in a folder per image and read back."""
    from panolake.sources.coco import write_yolo

    labels = view(spark, sf_dir, "fx_labels").select("image_id", F.lit(0).alias("category_id"), F.array(_flat().cast("array<double>")).alias("segmentation"))
    write_yolo(labels, 8000, 4000, path := folder(spark))
    rows = spark.read.schema("value string, image_id bigint").text(path)
    return rows.select("image_id", F.col("value").alias("line"))


# Rotations, rigs, rays


@query(f"WITH {ANGLES}, m AS (SELECT *, {MATRIX} FROM a) SELECT frame_id, round(degrees(atan2(-m7, m8)), 6) AS omega, round(degrees(atan2(m6, sqrt(m7 * m7 + m8 * m8))), 6) AS phi, round(degrees(atan2(-m3, m0)), 6) AS kappa FROM m")
def rotation_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = camera.opk_degrees_of(camera.opk_matrix(*_angles()))
    return view(spark, sf_dir, "fx_frames").select("frame_id", *[r6(c, n) for c, n in zip(found, ("omega", "phi", "kappa"), strict=True)])


@query(f"WITH {ANGLES} SELECT frame_id, round(o, 6) AS omega, round(p, 6) AS phi, round(k, 6) AS kappa FROM a")
def euler_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = camera.opk_of_world_to_camera(camera.euler_matrix(*_angles()))
    return view(spark, sf_dir, "fx_frames").select("frame_id", *[(F.round(c, 6) + 0).alias(n) for c, n in zip(found, ("omega", "phi", "kappa"), strict=True)])


@query("SELECT frame_id, round((2 * x + 5) / CASE WHEN frame_id % 3 = 0 THEN 1 ELSE frame_id % 3 END, 6) AS x, round((z + 7) / CASE WHEN frame_id % 3 = 0 THEN 1 ELSE frame_id % 3 END, 6) AS y, round(-y / CASE WHEN frame_id % 3 = 0 THEN 1 ELSE frame_id % 3 END, 6) + 0 AS z FROM fx_frames")
def homogeneous_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.lit(float(v))
    rows = (n(2), n(0), n(0), n(5), n(0), n(0), n(1), n(7), n(0), n(-1), n(0), n(0), n(0), n(0), n(0), (F.col("frame_id") % 3).cast("double"))
    moved = camera.homogeneous(rows, tuple(F.col(c) for c in "xyz"))
    return view(spark, sf_dir, "fx_frames").select("frame_id", *[(F.round(c, 6) + 0).alias(a) for c, a in zip(moved, "xyz", strict=True)])


FACE_SQL = " ".join(f"WHEN {k} THEN [cos(radians({o})), sin(radians({o})), cos(radians({p})), sin(radians({p}))]" for k, (o, p) in enumerate(camera.FACE_ANGLES))
OFFSETS = {axis: "CASE sensor " + " ".join(f"WHEN {s[0]} THEN {float(s[i])}::DOUBLE" for s in camera.LB4) + " END" for i, axis in ((1, "dx"), (2, "dy"), (3, "dz"))}
SEEN = f"""{SCENE}, c AS (SELECT *, {FRAME} FROM d), g AS (SELECT *, degrees(atan2(cy, sqrt(cx * cx + cy * cy))) AS lat, degrees(atan2(cx, -cz)) AS lon, [-cz, cz, -cx, cx, cy, -cy] AS s FROM c),
n AS (SELECT *, CASE {SENSOR} ELSE -1 END AS sensor, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS face FROM g), f AS (SELECT *, CASE face {FACE_SQL} END AS t, cx - {OFFSETS['dx']} AS ux, cy - {OFFSETS['dy']} AS uy, cz - {OFFSETS['dz']} AS uz FROM n WHERE sensor >= 0),
w AS (SELECT *, t[3] * ux + t[2] * t[4] * uy - t[1] * t[4] * uz AS mx, t[1] * uy + t[2] * uz AS my, t[4] * ux - t[2] * t[3] * uy + t[1] * t[3] * uz AS mz FROM f)"""


@query(f"{SEEN} SELECT frame_id, sensor, face, round(mx, 6) + 0 AS mx, round(my, 6) + 0 AS my, round(mz, 6) + 0 AS mz, round(cx, 6) AS cx, round(1024 - 1024 * mx / mz, 3) AS u FROM w WHERE abs(mz) > 0.5")
def model_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the axes of their cube face, back in the camera's, and their pixel."""
    rows = _scene(spark, sf_dir).select("frame_id", *[c.alias(n) for c, n in zip(_in_frame(), ("cx", "cy", "cz"), strict=True)])
    frame = tuple(F.col(c) for c in ("cx", "cy", "cz"))
    rows = rows.select("*", camera.sensor_of(*camera.lat_lon(frame)).alias("sensor"), camera.face_of(frame).alias("face")).where("sensor >= 0")
    rows = rows.select("frame_id", "sensor", "face", *[c.alias(n) for c, n in zip(camera.frame_to_model(frame, F.col("sensor"), F.col("face")), ("mx", "my", "mz"), strict=True)]).where("abs(mz) > 0.5")
    model = tuple(F.col(c) for c in ("mx", "my", "mz"))
    back = camera.model_to_frame(model, F.col("sensor"), F.col("face"))
    return rows.select("frame_id", "sensor", "face", *[(F.round(c, 6) + 0).alias(c) for c in ("mx", "my", "mz")], r6(back[0], "cx"), F.round(camera.pinhole_pixel(model, 2048)[0], 3).alias("u"))


@query("SELECT det_id, round((x % 2048 - 1024) * 0.001::DOUBLE, 6) AS px, round(-(y % 2048 - 1024) * 0.001::DOUBLE, 6) + 0 AS py FROM fx_dets")
def image_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = camera.image_point(F.col("x") % 2048, F.col("y") % 2048, 2048)
    return view(spark, sf_dir, "fx_dets").select("det_id", (F.round(px, 6) + 0).alias("px"), (F.round(py, 6) + 0).alias("py"))


@query(f"WITH {ANGLES}, m AS (SELECT *, {MATRIX}, CAST(frame_id % 6 AS INTEGER) AS sensor FROM a), s AS (SELECT *, {OFFSETS['dx']} AS dx, {OFFSETS['dy']} AS dy, {OFFSETS['dz']} AS dz FROM m) SELECT frame_id, round(fx + m0 * dx + m1 * dy + m2 * dz, 6) AS x, round(fy + m3 * dx + m4 * dy + m5 * dz, 6) + 0 AS y, round(fz + m6 * dx + m7 * dy + m8 * dz, 6) AS z FROM s")
def sensor_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = camera.sensor_pose(F.col("frame_id") % 6, tuple(F.col(c) for c in "xyz"), _angles())
    return view(spark, sf_dir, "fx_frames").select("frame_id", *[(F.round(c, 6) + 0).alias(n) for c, n in zip(pose, "xyz", strict=True)])


TURNED = "WITH a AS (SELECT frame_id, radians(-(frame_id % 360)) AS yw, radians(frame_id % 5 - 2.0::DOUBLE) AS pt, radians(frame_id % 7 - 3.0::DOUBLE) AS rl, x, y, z FROM fx_frames), v AS (SELECT *, 2 * pi() / 8000 * ((frame_id * 37) % 8000 - 4000) AS az, 2 * pi() / 8000 * ((frame_id * 53) % 3000 + 500 - 2000) AS el FROM a), p AS (SELECT *, sin(az) * cos(el) AS e, sin(el) AS d, cos(az) * cos(el) AS n FROM v), q AS (SELECT *, e AS bx, n AS by_, -d AS bz FROM p), r1 AS (SELECT *, cos(rl) * bx + sin(rl) * bz AS x1, by_ AS y1, -sin(rl) * bx + cos(rl) * bz AS z1 FROM q), r2 AS (SELECT *, x1 AS x2, cos(pt) * y1 - sin(pt) * z1 AS y2, sin(pt) * y1 + cos(pt) * z1 AS z2 FROM r1), r3 AS (SELECT *, cos(yw) * x2 - sin(yw) * y2 AS dx, sin(yw) * x2 + cos(yw) * y2 AS dy, z2 AS dz FROM r2)"


def _turned() -> tuple:
    return (F.col("frame_id") % 360).cast("double"), F.col("frame_id") % 5 - F.lit(2.0), F.col("frame_id") % 7 - F.lit(3.0)


@query(f"{TURNED} SELECT frame_id, round(dx, 6) + 0 AS dx, round(dy, 6) + 0 AS dy, round(dz, 6) + 0 AS dz FROM r3")
def spherical_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays through pixels of panoramas that are turned, pitched and rolled."""
    _, ray = camera.spherical_ray(F.col("frame_id") * 37 % 8000, F.col("frame_id") * 53 % 3000 + 500, tuple(F.col(c) for c in "xyz"), _turned(), 8000, 4000)
    return view(spark, sf_dir, "fx_frames").select("frame_id", *[(F.round(c, 6) + 0).alias(n) for c, n in zip(ray, ("dx", "dy", "dz"), strict=True)])


@query(f"{TURNED} SELECT frame_id, (frame_id * 37) % 8000 AS u, (frame_id * 53) % 3000 + 500 AS v FROM r3")
def turned_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points along such rays, seen again at the pixels that they went through."""
    pose = tuple(F.col(c) for c in "xyz")
    _, ray = camera.spherical_ray(F.col("frame_id") * 37 % 8000, F.col("frame_id") * 53 % 3000 + 500, pose, _turned(), 8000, 4000)
    rows = view(spark, sf_dir, "fx_frames").select("*", *[(p + 12.5 * d).alias(f"p{n}") for p, d, n in zip(pose, ray, "xyz", strict=True)])
    u, v = camera.spherical_pixel(camera.to_camera(tuple(F.col(f"p{n}") for n in "xyz"), pose, *_turned()), 8000, 4000)
    return rows.select("frame_id", F.pmod(F.round(u).cast("bigint"), F.lit(8000)).alias("u"), F.round(v).cast("bigint").alias("v"))


CUBE = f"""WITH r AS (SELECT det_id, CAST(det_id % 6 AS INTEGER) AS face, 0.1::DOUBLE AS o, -0.2::DOUBLE AS p, 0.3::DOUBLE AS k, (x % 2048 - 1024) / n AS mx, -(y % 2048 - 1024) / n AS my, -1024 / n AS mz FROM (SELECT det_id, x, y, sqrt((x % 2048 - 1024.0::DOUBLE) ** 2 + (y % 2048 - 1024.0::DOUBLE) ** 2 + 1024.0::DOUBLE ** 2) AS n FROM fx_dets)),
t AS (SELECT *, CASE face {FACE_SQL} END AS t FROM r), f AS (SELECT *, t[3] * mx + t[4] * mz AS cx, t[2] * t[4] * mx + t[1] * my - t[2] * t[3] * mz AS cy, -t[1] * t[4] * mx + t[2] * my + t[1] * t[3] * mz AS cz FROM t),
g AS (SELECT *, degrees(atan2(cy, sqrt(cx * cx + cy * cy))) AS lat, degrees(atan2(cx, -cz)) AS lon FROM f), s AS (SELECT *, CASE {SENSOR} ELSE -1 END AS sensor FROM g), m AS (SELECT *, {MATRIX}, {OFFSETS['dx']} AS ux, {OFFSETS['dy']} AS uy, {OFFSETS['dz']} AS uz FROM s WHERE sensor >= 0)"""


@query(f"{CUBE} SELECT det_id, round(100 + m0 * ux + m1 * uy + m2 * uz, 5) AS ox, round(3 + m6 * ux + m7 * uy + m8 * uz, 5) AS oz, round(m0 * cx + m1 * cy + m2 * cz, 5) + 0 AS dx, round(m3 * cx + m4 * cy + m5 * cz, 5) + 0 AS dy, round(m6 * cx + m7 * cy + m8 * cz, 5) + 0 AS dz FROM m")
def cubemap_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays through pixels of cube faces, from the sensor that saw them."""
    rows = view(spark, sf_dir, "fx_dets").select("det_id", (F.col("det_id") % 6).alias("face"), (F.col("x") % 2048).alias("u"), (F.col("y") % 2048).alias("v"))
    pose, opk = (F.lit(100.0), F.lit(50.0), F.lit(3.0)), (F.lit(0.1), F.lit(-0.2), F.lit(0.3))
    rows = rows.select("det_id", camera.cubemap_ray(F.col("u"), F.col("v"), F.col("face"), pose, opk, 2048).alias("r")).where("r.sensor >= 0")
    columns = {"ox": "r.origin.x", "oz": "r.origin.z", "dx": "r.direction.x", "dy": "r.direction.y", "dz": "r.direction.z"}
    return rows.select("det_id", *[(F.round(c, 5) + 0).alias(n) for n, c in columns.items()])


@query(f"{CUBE}, e AS (SELECT det_id, m0 * cx + m1 * cy + m2 * cz AS ex, m3 * cx + m4 * cy + m5 * cz AS ey, m6 * cx + m7 * cy + m8 * cz AS ez FROM m WHERE det_id % 5 <> 0) SELECT det_id, round(ex / sqrt(ex * ex + ey * ey + ez * ez), 5) + 0 AS dx, round(ey / sqrt(ex * ex + ey * ey + ez * ez), 5) + 0 AS dy, round(ez / sqrt(ex * ex + ey * ey + ez * ez), 5) + 0 AS dz FROM e")
def cubemap_mask_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks on cube faces; a fifth of them are no ellipses and share too little with one."""
    rows = spread(view(spark, sf_dir, "fx_dets").select("det_id", (F.col("det_id") % 6).alias("face"), (F.col("x") % 2048).cast("double").alias("u"), (F.col("y") % 2048).cast("double").alias("v")))
    u, v = F.col("u"), F.col("v")
    star = _around(u, v, [((8, 30)[i % 2 == 0] * math.cos(i * math.pi / 10), (8, 30)[i % 2 == 0] * math.sin(i * math.pi / 10)) for i in range(20)])
    masks = settled(rows, {"segmentation": F.when(F.col("det_id") % 5 == 0, star).otherwise(_mask(u, v, 25.0, 14.0, 1.1))}).drop("u", "v")
    pose, opk = (F.lit(100.0), F.lit(50.0), F.lit(3.0)), (F.lit(0.1), F.lit(-0.2), F.lit(0.3))
    found = rays.rays_of_masks(masks, rays.cubemap(pose, opk, F.col("face"), 2048), 0.85, deal=False)
    return found.select("det_id", *[(F.round(f"d{c}", 5) + 0).alias(f"d{c}") for c in "xyz"])


@query("""WITH r AS (SELECT *, 900 + 40 * (frame_id % 4) AS area FROM fx_rays), p AS (SELECT a.ray_id AS ray_a, b.ray_id AS ray_b, a.ox AS ax, a.oy AS ay, a.oz AS az, b.ox AS bx, b.oy AS by_, b.oz AS bz, a.dx AS adx, a.dy AS ady, a.dz AS adz, b.dx AS bdx, b.dy AS bdy, b.dz AS bdz, a.area AS aa, b.area AS ba,
a.dx * b.dx + a.dy * b.dy + a.dz * b.dz AS cs, a.dx * (a.ox - b.ox) + a.dy * (a.oy - b.oy) + a.dz * (a.oz - b.oz) AS d, b.dx * (a.ox - b.ox) + b.dy * (a.oy - b.oy) + b.dz * (a.oz - b.oz) AS e FROM r a JOIN r b ON b.frame_id > a.frame_id AND b.frame_id <= a.frame_id + 8),
t AS (SELECT *, (cs * e - d) / (1 - cs * cs) AS t1, (e - cs * d) / (1 - cs * cs) AS t2 FROM p WHERE abs(1 - cs * cs) >= 1e-6),
q AS (SELECT *, t1 * sqrt(aa / (8000 * 4000 / (2 * pi() * pi()) * (abs(ady) / sqrt(1 - ady * ady)))) AS r1, t2 * sqrt(ba / (8000 * 4000 / (2 * pi() * pi()) * (abs(bdy) / sqrt(1 - bdy * bdy)))) AS r2,
 ax + t1 * adx AS px, ay + t1 * ady AS py, az + t1 * adz AS pz, bx + t2 * bdx AS qx, by_ + t2 * bdy AS qy, bz + t2 * bdz AS qz FROM t WHERE t1 BETWEEN 0 AND 20 AND t2 BETWEEN 0 AND 20)
SELECT ray_a, ray_b, round(greatest(t1, t2), 6) AS length FROM q WHERE abs(r1 - r2) <= 0.02 AND sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2) <= 0.2 AND (pz + qz) / 2 > least(az, bz) - 3.8 AND (pz + qz) / 2 < least(az, bz) - 2.0""")
def radius_controlled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = view(spark, sf_dir, "fx_rays").withColumn("area", 900 + 40 * (F.col("frame_id") % 4))
    return triangulation.ray_pairs(seen, radii_apart=0.02).select("ray_a", "ray_b", r6(F.col("length"), "length"))


@query(f"{RAYS}, g AS (SELECT *, frame_a // 10 AS k FROM good) SELECT CAST(round(median(x)) AS BIGINT) AS x, count(*) AS n, round(avg(length), 6) AS mean_length, max(frame_b) AS last_seen, CAST(0 AS BIGINT) AS missing, count(DISTINCT frame_a // 5) AS merged FROM g GROUP BY k")
def final_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within 30 m chain up; the scene's objects stand 25 m apart in pairs, moved 10 m away from the next pair."""
    keep = keeper(spark)
    pairs, won = _peeled(spark, sf_dir)
    members = keep(won.select("id", "cluster").distinct())
    found = keep(triangulation.candidates(pairs, members).withColumn("missing", F.col("last_seen") * 0))
    apart = found.withColumn("x", F.col("x") + 10.0 * F.floor(F.col("x") / 50))
    merged = triangulation.merged_candidates(apart, members, pairs, 30.0, keep)
    return merged.select(F.round("x").cast("bigint").alias("x"), "n", r6(F.col("mean_length"), "mean_length"), "last_seen", "missing", "merged")


@query(f"{RAYS} SELECT 'intersections' AS output, count(*) AS n FROM good UNION ALL SELECT 'candidates', count(DISTINCT frame_a // 5) FROM good UNION ALL SELECT 'rays', count(*) FROM fx_rays")
def three_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three tables that a run gives: intersections that are not false, candidates, rays."""
    pairs, won = _peeled(spark, sf_dir)
    members = won.select("id", "cluster").distinct()
    parts = {"intersections": pairs.join(members.select("id"), "id", "left_semi"), "candidates": triangulation.candidates(pairs, members), "rays": view(spark, sf_dir, "fx_rays")}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"""{DRIVE_PAIRS.replace('dist <= 0.2', 'dist <= 0.5')}, s AS (SELECT * FROM (VALUES ('spherical', 0.5::DOUBLE), ('cubemap', 0.2::DOUBLE)) v(model, gap)), p AS (SELECT model, ray_b, frame_a, row_number() OVER (PARTITION BY model, drive, ray_b, frame_a ORDER BY dist, ray_a) AS k FROM good JOIN s ON dist <= gap)
SELECT model, count(*) AS pairs, count(*) FILTER (k = 1) AS best FROM p GROUP BY model""")
def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays that meet under the parameters of either kind of panorama, and the best for each ray and earlier frame."""
    seen, out = view(spark, sf_dir, "fx_drive_rays"), None
    for model in triangulation.PARAMETERS:
        pairs = triangulation.ray_pairs(seen, group="drive", **triangulation.pairing(model))
        one = pairs.select(F.lit(model).alias("model"), F.row_number().over(Window.partitionBy("drive", "ray_b", "frame_a").orderBy("dist", "ray_a")).alias("k"))
        one = one.groupBy("model").agg(F.count("*").alias("pairs"), F.count_if(F.col("k") == 1).alias("best"))
        out = one if out is None else out.union(one)
    return out


@query()
def drive_candidates_cubemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the drives under the parameters of cube maps, which let candidates miss more frames."""
    frames = view(spark, sf_dir, "fx_drive_frames").select("drive", "frame", F.array("dataset").alias("datasets"))
    found = triangulation.triangulate(view(spark, sf_dir, "fx_drive_rays"), frames, keeper(spark), triangulation.limits_of("cubemap"), **triangulation.pairing("cubemap"))
    return found.candidates.select("drive", *[r6(F.col(c), c) for c in ("x", "y", "z")], "n", "last_seen", "missing", "merged")


@query(f"SELECT o.k AS id, count(*) AS n, round(min({FAR}), 6) AS least FROM fx_objects o JOIN fx_frames f ON {FAR} <= 15 GROUP BY o.k")
def nearest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, frames = (view(spark, sf_dir, n).select(F.col(k).alias("id"), "x", "y") for n, k in (("fx_objects", "k"), ("fx_frames", "frame_id")))
    return distance_pairs(objects, frames, 15.0, closed=True).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), r6(F.min("dist"), "least"))
