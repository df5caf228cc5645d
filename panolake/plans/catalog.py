"""All queries of the detection engine over the derived scenes, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.fixtures import view, with_views
from panolake.functions import camera, geometry
from panolake.operators import components, control, matching, merging, spatial, tiling, triangulation
from panolake.operators.ranges import keeper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(" ".join(sql.split()))
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


PAIRS = """pairs AS (SELECT d.det_id, l.label_id, d.dataset, d.image_id, d.score, l.label_class, d.det_class,
  (least(d.x + d.w, l.x + l.w) - greatest(d.x, l.x)) * (least(d.y + d.h, l.y + l.h) - greatest(d.y, l.y)) AS shared, d.w * d.h + l.w * l.h AS sides
  FROM fx_dets d JOIN fx_labels l ON d.image_id = l.image_id AND d.x <= l.x + l.w AND l.x <= d.x + d.w AND d.y <= l.y + l.h AND l.y <= d.y + d.h),
scored AS (SELECT *, CAST(shared AS DOUBLE) / (sides - shared) AS iou FROM pairs),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, label_id) AS k FROM scored) WHERE k = 1 AND iou >= 0.25)"""
TAGS = PAIRS + """, matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label_id ORDER BY iou DESC, det_id) AS kk FROM chosen) WHERE kk = 1 AND label_class = det_class + 1),
tags AS (SELECT d.dataset, CASE WHEN m.label_id IS NULL THEN 'FP' ELSE 'TP' END AS tag, m.label_id, d.det_id, d.score, round_even(m.iou * 1000, 0) / 1000 AS iou, d.x, d.y, m.label_class, d.det_class FROM fx_dets d LEFT JOIN matched m ON d.det_id = m.det_id
  UNION ALL SELECT l.dataset, 'FN', l.label_id, NULL, NULL, NULL, l.x, l.y, l.label_class, NULL FROM fx_labels l WHERE l.label_id NOT IN (SELECT label_id FROM matched))"""
RATIOS = """CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS f1"""
COUNTS = "count(*) FILTER (tag = 'TP') AS tp, count(*) FILTER (tag = 'FP') AS fp, count(*) FILTER (tag = 'FN') AS fn"


def tags_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tagged(view(spark, sf_dir, "fx_dets"), view(spark, sf_dir, "fx_labels"))


@query(f'WITH {TAGS}, c AS (SELECT {COUNTS} FROM tags) SELECT tp AS "TP", fp AS "FP", fn AS "FN", {RATIOS} FROM c')
def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.metrics(tags_of(spark, sf_dir))


@query(f"WITH {TAGS} SELECT dataset, tag, label_id, det_id, score, iou FROM tags")
def match_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags_of(spark, sf_dir).drop("label_class", "det_class")


@query(f'WITH {TAGS}, c AS (SELECT dataset, {COUNTS} FROM tags GROUP BY dataset) SELECT dataset, tp AS "TP", fp AS "FP", fn AS "FN", {RATIOS} FROM c')
def metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.metrics(tags_of(spark, sf_dir), "dataset")


SWEEP = f"""WITH {PAIRS}, grid AS (SELECT unnest(range(5, 96, 5)) AS t),
won AS (SELECT t, count(DISTINCT label_id) AS tp FROM grid JOIN chosen ON score >= t / 100.0::DOUBLE GROUP BY t),
above AS (SELECT t, count(*) AS dets FROM grid JOIN fx_dets ON score >= t / 100.0::DOUBLE GROUP BY t),
c AS (SELECT g.t, coalesce(w.tp, 0) AS tp, coalesce(a.dets, 0) - coalesce(w.tp, 0) AS fp, (SELECT count(*) FROM fx_labels) - coalesce(w.tp, 0) AS fn FROM grid g LEFT JOIN won w ON g.t = w.t LEFT JOIN above a ON g.t = a.t),
sweep AS (SELECT t / 100.0::DOUBLE AS threshold, tp AS "TP", fp AS "FP", fn AS "FN", {RATIOS} FROM c)"""


@query(f"{SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.threshold_sweep(view(spark, sf_dir, "fx_dets"), view(spark, sf_dir, "fx_labels"))


@query(f"{SWEEP} SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_threshold(threshold_sweep(spark, sf_dir))


@query(f"""WITH {TAGS}, c AS (SELECT dataset, {COUNTS} FROM tags GROUP BY dataset), r AS (SELECT *, {RATIOS}, sum(tp + fn) OVER () AS total, count(*) OVER () AS classes FROM c)
SELECT round(avg("precision"), 6) AS macro_p, round(avg(recall), 6) AS macro_r, round(sum("precision" * ((tp + fn)::DOUBLE / total) / classes), 6) AS weighted_p, round(sum(recall * ((tp + fn)::DOUBLE / total) / classes), 6) AS weighted_r,
round(sum(tp)::DOUBLE / sum(tp + fp), 6) AS micro_p, round(sum(tp)::DOUBLE / sum(tp + fn), 6) AS micro_r FROM r""")
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_class = matching.metrics(tags_of(spark, sf_dir), "dataset")
    averaged = matching.averages(by_class)
    return averaged.select(*[r6(F.col(c), c) for c in averaged.columns])


@query(f"""WITH {TAGS}, c AS (SELECT CASE WHEN tag = 'FP' THEN 'background' WHEN label_class = 1 THEN 'cover' ELSE 'grid' END AS true_class, CASE WHEN tag = 'FN' THEN 'background' WHEN det_class = 0 THEN 'cover' ELSE 'grid' END AS predicted FROM tags)
SELECT true_class, count(*) FILTER (predicted = 'cover') AS cover, count(*) FILTER (predicted = 'grid') AS "grid", count(*) FILTER (predicted = 'background') AS background FROM c GROUP BY true_class""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.confusion(tags_of(spark, sf_dir), ["cover", "grid"])


@query("SELECT image_id, concat('pano_', image_id, '_', 512, '_', 736, '.jpg') AS tile, concat('pano_', image_id) AS image, 512 AS x, 736 AS y FROM fx_images")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_images").withColumn("tile", geometry.tile_name(F.col("file_name"), F.lit(512), F.lit(736)))
    parsed = geometry.parse_tile_name(F.col("tile"))
    return rows.select("image_id", "tile", parsed["image"].alias("image"), parsed["x"].alias("x"), parsed["y"].alias("y"))


@query("SELECT frame_id, concat('102-', frame_id) AS frame, 'lb4' AS model, CAST(frame_id % 6 AS VARCHAR) AS face FROM fx_frames")
def parse_frame_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_frames").withColumn("name", F.concat(F.lit("102-lb4-"), F.col("frame_id") % 6, F.lit("-"), F.col("frame_id"), F.lit(".jpg")))
    parsed = geometry.parse_frame_name(F.col("name"))
    return rows.select("frame_id", *[parsed[c].alias(c) for c in ("frame", "model", "face")])


@query("SELECT det_id, greatest(o, 0) AS origin, CASE WHEN o < 0 THEN least(w + o, 512) WHEN o + w > 512 THEN 512 - o ELSE w END AS length FROM (SELECT det_id, x % 560 - 30 AS o, w FROM fx_dets)")
def bbox_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = geometry.clip_span(F.col("x") % 560 - 30, F.col("w"), 512)
    return view(spark, sf_dir, "fx_dets").select("det_id", cut["origin"].alias("origin"), cut["length"].alias("length"))


def _flat():
    return F.array("x", "y", F.col("x") + F.col("w"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), "x", F.col("y") + F.col("h"))


@query("SELECT label_id, x + 10 AS x0, y + 20 AS y0, x + w + 10 AS x1, y + h + 20 AS y2 FROM fx_labels")
def seg_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_labels").select("label_id", geometry.shift(_flat(), F.lit(10), F.lit(20)).alias("s"))
    return rows.select("label_id", F.col("s")[0].alias("x0"), F.col("s")[1].alias("y0"), F.col("s")[2].alias("x1"), F.col("s")[5].alias("y2"))


@query("SELECT label_id, CAST(w * h AS DOUBLE) AS area, x, y, w, h, round(x + w / 2.0::DOUBLE, 6) AS cx, round(y + h / 2.0::DOUBLE, 6) AS cy FROM fx_labels")
def polygon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_labels").select("label_id", geometry.ring(_flat()).alias("v"))
    rows = rows.select("label_id", geometry.area(F.col("v")).alias("area"), geometry.bounds(F.col("v")).alias("b"), geometry.centroid(F.col("v")).alias("c"))
    return rows.select("label_id", "area", "b.x", "b.y", "b.w", "b.h", r6(F.col("c.x"), "cx"), r6(F.col("c.y"), "cy"))


@query("SELECT label_id, CASE WHEN label_id % 3 = 0 THEN 5 + label_id % 4 ELSE label_id % 3 END AS first, 5 + label_id % 4 AS second, 7 AS last FROM fx_labels")
def nearest_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = geometry.nearest_nonzero(F.array(F.col("label_id") % 3, 5 + F.col("label_id") % 4, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(7).cast("long")))
    rows = view(spark, sf_dir, "fx_labels").select("label_id", filled.alias("f"))
    return rows.select("label_id", F.col("f")[0].alias("first"), F.col("f")[1].alias("second"), F.col("f")[3].cast("int").alias("last"))


GRID = """grid AS (SELECT image_id, aoi, height, c * 468 AS min_x, 736 + r * 504 AS min_y, concat('pano_', image_id, '_', c * 468, '_', 736 + r * 504, '.jpg') AS tile FROM fx_images, range(17) a(c), range(5) b(r))"""


@query(f"WITH {GRID} SELECT image_id, count(*) AS tiles, max(min_x) AS last_x, max(min_y) AS last_y FROM grid GROUP BY image_id")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(view(spark, sf_dir, "fx_images")).groupBy("image_id").agg(F.count("*").alias("tiles"), F.max("min_x").cast("long").alias("last_x"), F.max("min_y").cast("long").alias("last_y"))


@query("SELECT id, minx + ix * 100.0::DOUBLE AS cell_x, miny + iy * 100.0::DOUBLE AS cell_y FROM (SELECT CAST(CAST(50 * k AS BIGINT) + ix * 100 AS VARCHAR) || ', ' || CAST(iy * 100 AS VARCHAR) AS id, 50.0::DOUBLE * k AS minx, 0.0::DOUBLE AS miny, ix, iy FROM fx_objects, range(3) a(ix), range(2) b(iy))")
def grid_over_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = view(spark, sf_dir, "fx_objects").select((50.0 * F.col("k")).alias("minx"), F.lit(0.0).alias("miny"), (50.0 * F.col("k") + 250).alias("maxx"), F.lit(150.0).alias("maxy"))
    return tiling.extent_grid(extents, 100.0).select("id", "cell_x", "cell_y")


TILED = """tiled AS (SELECT label_id, x, y, w, h, c * 468 AS min_x, 736 + r * 504 AS min_y FROM fx_labels, range(17) a(c), range(5) b(r) WHERE x < c * 468 + 512 AND x + w > c * 468 AND y < 736 + r * 504 + 512 AND y + h > 736 + r * 504)"""
CLIPPED = """SELECT label_id, min_x, min_y, greatest(x - min_x, 0) AS tile_x, greatest(y - min_y, 0) AS tile_y,
CASE WHEN x < min_x THEN least(w + x - min_x, 512) WHEN x - min_x + w > 512 THEN 512 - (x - min_x) ELSE w END AS tile_w,
CASE WHEN y < min_y THEN least(h + y - min_y, 512) WHEN y - min_y + h > 512 THEN 512 - (y - min_y) ELSE h END AS tile_h FROM tiled"""


@query(f"WITH {TILED} {CLIPPED}")
def tile_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiling.tiles_of_boxes(view(spark, sf_dir, "fx_labels"))
    return rows.select("label_id", F.col("min_x").cast("long").alias("min_x"), F.col("min_y").cast("long").alias("min_y"), "tile_x", "tile_y", "tile_w", "tile_h")


@query(f"WITH {TILED}, c AS ({CLIPPED}) SELECT label_id, min_x, min_y, CAST(least(tile_x + CAST(round_even(tile_w * 1.1::DOUBLE, 0) AS BIGINT), 512) AS BIGINT) AS black_x, CAST(least(tile_y + CAST(round_even(tile_h * 1.1::DOUBLE, 0) AS BIGINT), 512) AS BIGINT) AS black_y FROM c")
def rejected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tile_annotations(spark, sf_dir)
    return rows.select("label_id", "min_x", "min_y", tiling.blackened(F.col("tile_x"), F.col("tile_w")).cast("long").alias("black_x"), tiling.blackened(F.col("tile_y"), F.col("tile_h")).cast("long").alias("black_y"))


@query(f"WITH {GRID} SELECT image_id, count(*) AS n FROM grid WHERE min_y >= height * 0.5 GROUP BY image_id")
def low_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.low_tiles(tiling.tiles(view(spark, sf_dir, "fx_images"))).groupBy("image_id").agg(F.count("*").alias("n"))


@query(f"""WITH {GRID}, {TILED}, full_tiles AS (SELECT DISTINCT CAST(label_id // 20 AS BIGINT) AS image_id, min_x, min_y FROM tiled), marked AS (SELECT g.*, f.image_id IS NOT NULL AS full_tile FROM grid g LEFT JOIN full_tiles f ON g.image_id = f.image_id AND g.min_x = f.min_x AND g.min_y = f.min_y),
need AS (SELECT aoi, CAST(ceil(count(*) * 0.33::DOUBLE / (1 - 0.33::DOUBLE)) AS BIGINT) AS n FROM marked WHERE full_tile GROUP BY aoi),
ranked AS (SELECT m.aoi, m.tile, m.min_y, n, row_number() OVER (PARTITION BY m.aoi ORDER BY (m.min_y >= 2000) DESC, md5(concat('42|', m.tile)), m.tile) AS k FROM marked m JOIN need ON m.aoi = need.aoi WHERE NOT full_tile)
SELECT aoi, tile FROM ranked WHERE k <= n""")
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every image becomes 85 tiles, so images of few and small files are dealt out first.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    images, keys = view(spark, sf_dir, "fx_images").repartition(n), ["image_id", "min_x", "min_y"]
    taken = keeper(spark)(tiling.tiles_of_boxes(view(spark, sf_dir, "fx_labels")).select(*keys).distinct())
    side = F.broadcast(taken) if taken.count() <= 500_000 else taken  # the grid is not shuffled for a few tiles
    empty = tiling.tiles(images).select("aoi", "tile", *keys).join(side, keys, "left_anti")
    positives = taken.join(images.select("image_id", "aoi"), "image_id")
    chosen = tiling.sample_negatives(empty, positives, ["aoi"], 0.33, F.col("min_y") >= 2000)
    return chosen.select("aoi", "tile")


@query("""WITH r AS (SELECT image_id, aoi, row_number() OVER (PARTITION BY aoi ORDER BY md5(concat('42|', image_id)), image_id) AS k, count(*) OVER (PARTITION BY aoi) AS n FROM fx_images), t AS (SELECT *, round_even(n * 0.7::DOUBLE, 0) AS trn FROM r)
SELECT image_id, aoi, CASE WHEN k <= trn THEN 'trn' WHEN k <= trn + round_even((n - trn) * 0.5, 0) THEN 'val' ELSE 'tst' END AS dataset FROM t""")
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.split(view(spark, sf_dir, "fx_images"), "image_id", "aoi").select("image_id", "aoi", "dataset")


@query("""WITH m AS (SELECT aoi, max(image_id) + 1 AS n FROM fx_images GROUP BY aoi), o AS (SELECT aoi, coalesce(sum(n) OVER (ORDER BY aoi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM m)
SELECT i.image_id, i.aoi, CAST(i.image_id + o.shift AS BIGINT) AS new_id FROM fx_images i JOIN o ON i.aoi = o.aoi""")
def offset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.shifted_ids(view(spark, sf_dir, "fx_images"), "aoi", "image_id").select("image_id", "aoi", "new_id")


@query("SELECT l.label_id, l.image_id, i.file_name, concat(i.aoi, '/', i.file_name) AS basename_source FROM fx_labels l LEFT JOIN fx_images i ON l.image_id = i.image_id AND i.aoi = CASE l.image_id % 2 WHEN 0 THEN 'NE' ELSE 'SZH' END")
def id_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "fx_labels").withColumn("aoi", F.when(F.col("image_id") % 2 == 0, "NE").otherwise("SZH"))
    rows = labels.join(view(spark, sf_dir, "fx_images").select("image_id", "aoi", "file_name"), ["aoi", "image_id"], "left")
    return rows.select("label_id", "image_id", "file_name", F.concat("aoi", F.lit("/"), "file_name").alias("basename_source"))


@query("SELECT det_id, image_id FROM fx_dets WHERE image_id NOT IN (SELECT image_id FROM fx_labels)")
def orphan_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_dets").select("det_id", "image_id").join(view(spark, sf_dir, "fx_labels"), "image_id", "left_anti")


@query("""WITH known AS (SELECT file_name FROM fx_images WHERE image_id % 7 <> 0), missing AS (SELECT file_name FROM fx_images WHERE file_name NOT IN (SELECT file_name FROM known))
SELECT file_name, CAST(row_number() OVER (ORDER BY file_name) + (SELECT max(image_id) FROM fx_images WHERE image_id % 7 <> 0) AS BIGINT) AS new_id FROM missing""")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panolake.sources.coco import with_missing_images

    images = view(spark, sf_dir, "fx_images")
    return with_missing_images(images.where("image_id % 7 <> 0"), images.select("file_name"))


@query("SELECT d.det_id, f.frame_id, f.x, f.t FROM fx_frames f RIGHT JOIN fx_dets d ON f.frame_id = d.image_id")
def traj_right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, dets = view(spark, sf_dir, "fx_frames"), view(spark, sf_dir, "fx_dets").select("det_id", "image_id")
    return frames.join(dets, frames.frame_id == dets.image_id, "right").select("det_id", "frame_id", "x", "t")


LOG = "SELECT image_id % 24 AS trial, (det_id % 97) / 100.0::DOUBLE AS p, (det_id % 89) / 100.0::DOUBLE AS r, (det_id % 83) / 100.0::DOUBLE AS m FROM fx_dets"


@query(f"""WITH log AS ({LOG}), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM log) SELECT trial, max(p) AS "precision", round(max(f1), 6) AS f1, max(m) AS map50 FROM f GROUP BY trial""")
def trial_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_dets").select((F.col("image_id") % 24).alias("trial"), (F.col("det_id") % 97 / 100).alias("precision"), (F.col("det_id") % 89 / 100).alias("recall"), (F.col("det_id") % 83 / 100).alias("map50"))
    return control.best_trials(log).withColumn("f1", F.round("f1", 6))


@query(f"""WITH {TAGS}, t AS (SELECT det_id, score, CASE WHEN score >= 0.3 THEN tag END AS tag FROM tags WHERE det_id IS NOT NULL), low AS (SELECT min(score) AS s FROM t WHERE tag IS NOT NULL) SELECT det_id, score, coalesce(tag, 'oth') AS tag FROM t, low WHERE score >= s""")
def review_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tags_of(spark, sf_dir).where("det_id is not null").select("det_id", "score", F.when(F.col("score") >= 0.3, F.col("tag")).alias("tag"))
    return control.review(rows)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_status WHERE action IN ('click', 'purchase')) SELECT ann_id, true AS validated, action = 'purchase' AS removed FROM k WHERE n = 1""")
def validation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest_status(view(spark, sf_dir, "fx_status"), "click", "purchase")


def _angles():
    return F.col("frame_id") % 7 * 0.1, F.col("frame_id") % 11 * 0.1 - 0.5, F.col("frame_id") % 13 * 0.2


ANGLES = "a AS (SELECT frame_id, frame_id % 7 * 0.1::DOUBLE AS o, frame_id % 11 * 0.1::DOUBLE - 0.5::DOUBLE AS p, frame_id % 13 * 0.2::DOUBLE AS k, x AS fx, y AS fy, z AS fz FROM fx_frames)"
MATRIX = "cos(p) * cos(k) AS m0, -cos(p) * sin(k) AS m1, sin(p) AS m2, cos(o) * sin(k) + sin(o) * sin(p) * cos(k) AS m3, cos(o) * cos(k) - sin(o) * sin(p) * sin(k) AS m4, -sin(o) * cos(p) AS m5, sin(o) * sin(k) - cos(o) * sin(p) * cos(k) AS m6, sin(o) * cos(k) + cos(o) * sin(p) * sin(k) AS m7, cos(o) * cos(p) AS m8"


@query(f"WITH {ANGLES}, m AS (SELECT *, {MATRIX} FROM a) SELECT frame_id, {', '.join(f'round(m{i}, 6) AS m{i}' for i in range(9))} FROM m")
def opk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_frames").select("frame_id", *[r6(c, f"m{i}") for i, c in enumerate(camera.opk_matrix(*_angles()))])


@query(f"WITH {ANGLES} SELECT frame_id, round(o, 6) AS omega, round(p, 6) AS phi, round(k, 6) AS kappa FROM a")
def opk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "fx_frames").select("frame_id", *[c.alias(f"m{i}") for i, c in enumerate(camera.opk_matrix(*_angles()))])
    found = camera.opk_of(tuple(F.col(f"m{i}") for i in range(9)))
    turned = F.pmod(found[2], F.lit(2 * math.pi))
    return frames.select("frame_id", r6(found[0], "omega"), r6(found[1], "phi"), r6(F.when(turned > 2 * math.pi - 1e-9, 0.0).otherwise(turned), "kappa"))


SCENE = f"WITH {ANGLES}, m AS (SELECT *, {MATRIX} FROM a), d AS (SELECT m.*, ob.k AS object_id, ob.x - fx AS vx, ob.y - fy AS vy, ob.z - fz AS vz FROM m JOIN fx_objects ob ON m.frame_id // 5 = ob.k)"
FRAME = "m0 * vx + m3 * vy + m6 * vz AS cx, m1 * vx + m4 * vy + m7 * vz AS cy, m2 * vx + m5 * vy + m8 * vz AS cz"


def _scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, objects = view(spark, sf_dir, "fx_frames"), view(spark, sf_dir, "fx_objects")
    o = objects.select("k", *[F.col(c).alias(f"o{c}") for c in "xyz"])
    return frames.join(o, F.floor(F.col("frame_id") / 5) == F.col("k"))


def _in_frame():
    return camera.world_to_frame(tuple(F.col(f"o{c}") for c in "xyz"), tuple(F.col(c) for c in "xyz"), _angles())


@query(f"{SCENE}, c AS (SELECT *, {FRAME} FROM d) SELECT frame_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM c")
def world_to_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, sf_dir).select("frame_id", *[r6(c, n) for c, n in zip(_in_frame(), ("cx", "cy", "cz"), strict=True)])


PIXEL = "4000 + 8000 / (2 * pi()) * atan2(vx, vy) AS u, 2000 + 8000 / (2 * pi()) * atan2(-vz, sqrt(vx * vx + vy * vy)) AS v"


def _pixel(rows: DataFrame) -> DataFrame:
    level = (F.lit(0.0),) * 3
    seen = camera.to_camera(tuple(F.col(f"o{c}") for c in "xyz"), tuple(F.col(c) for c in "xyz"), *level)
    u, v = camera.spherical_pixel(seen, 8000, 4000)
    return rows.select("*", u.alias("u"), v.alias("v"), camera.length(seen).alias("far"))


@query(f"{SCENE}, p AS (SELECT *, {PIXEL} FROM d) SELECT frame_id, round(u, 4) AS u, round(v, 4) AS v FROM p")
def spherical_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel(_scene(spark, sf_dir)).select("frame_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query(f"{SCENE} SELECT frame_id, round(vx + fx, 6) AS x, round(vy + fy, 6) AS y, round(vz + fz, 6) + 0 AS z FROM d")
def spherical_unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixel(_scene(spark, sf_dir))
    back = camera.to_local(camera.spherical_point(F.col("u"), F.col("v"), F.col("far"), 8000, 4000), tuple(F.col(c) for c in "xyz"), *(F.lit(0.0),) * 3)
    return rows.select("frame_id", *[(F.round(c, 6) + 0).alias(n) for c, n in zip(back, "xyz", strict=True)])


@query(f"{SCENE}, c AS (SELECT *, {FRAME} FROM d), f AS (SELECT *, [-cz, cz, -cx, cx, cy, -cy] AS s FROM c) SELECT frame_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS face FROM f")
def cubemap_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, sf_dir).select("frame_id", camera.face_of(_in_frame()).alias("face"))


SENSOR = " ".join(f"WHEN ((lon - {lo % 360}) % 360 + 360) % 360 <= {(hi - lo % 360) % 360} AND lat >= {a} AND lat <= {b} THEN {pos}" for pos, *_, a, b, lo, hi in camera.LB4)


@query(f"{SCENE}, c AS (SELECT *, {FRAME} FROM d), g AS (SELECT frame_id, degrees(atan2(cy, sqrt(cx * cx + cy * cy))) AS lat, degrees(atan2(cx, -cz)) AS lon FROM c) SELECT frame_id, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE {SENSOR} ELSE -1 END AS sensor FROM g")
def sensor_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = camera.lat_lon(_in_frame())
    rows = _scene(spark, sf_dir).select("frame_id", lat.alias("lat"), lon.alias("lon"))
    return rows.select("frame_id", r6(F.col("lat"), "lat"), r6(F.col("lon"), "lon"), camera.sensor_of(F.col("lat"), F.col("lon")).alias("sensor"))


@query(f"{SCENE}, c AS (SELECT *, {FRAME} FROM d) SELECT frame_id, round(1024 - 1024 * cx / cz, 4) AS u, round(1024 + 1024 * cy / cz, 4) AS v FROM c WHERE abs(cz) > 0.5")
def cubemap_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scene(spark, sf_dir).select("frame_id", *[c.alias(n) for c, n in zip(_in_frame(), ("cx", "cy", "cz"), strict=True)]).where("abs(cz) > 0.5")
    u, v = camera.pinhole_pixel((F.col("cx"), F.col("cy"), F.col("cz")), 2048)
    return rows.select("frame_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("SELECT det_id, round((x % 2048 - 1024) / n, 6) AS dx, round(-(y % 2048 - 1024) / n, 6) AS dy, round(-1024 / n, 6) AS dz FROM (SELECT det_id, x, y, sqrt((x % 2048 - 1024.0::DOUBLE) ** 2 + (y % 2048 - 1024.0::DOUBLE) ** 2 + 1024.0::DOUBLE ** 2) AS n FROM fx_dets)")
def pixel_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    ray = camera.pinhole_ray(F.col("x") % 2048, F.col("y") % 2048, 2048)
    return view(spark, sf_dir, "fx_dets").select("det_id", *[r6(c, n) for c, n in zip(ray, ("dx", "dy", "dz"), strict=True)])


@query("SELECT det_id, round(4 * sqrt(w * h / (8000 * 4000 / (2 * pi() * pi()) * (abs(vy) / sqrt(1 - vy * vy)))), 6) AS radius FROM (SELECT *, (1 + det_id % 5) / sqrt(1.0::DOUBLE + (1 + det_id % 5) ** 2 + 9) AS vy FROM fx_dets)")
def radius_from_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    ray = (F.lit(1.0), (1 + F.col("det_id") % 5).cast("double"), F.lit(3.0))
    return view(spark, sf_dir, "fx_dets").select("det_id", r6(camera.radius_of_area(F.col("w") * F.col("h"), ray, F.lit(4.0), 8000, 4000), "radius"))


OVERLAPS = "SELECT l.dataset, l.image_id, l.det_id AS a, r.det_id AS b FROM fx_dets l JOIN fx_dets r ON l.image_id = r.image_id AND l.det_id <= r.det_id AND l.x <= r.x + r.w AND r.x <= l.x + l.w AND l.y <= r.y + r.h AND r.y <= l.y + l.h"
COMPONENTS = f"WITH RECURSIVE near AS ({OVERLAPS}), sym AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT a, a AS b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a), groups AS (SELECT a AS det_id, min(b) AS root FROM reach GROUP BY a)"


@query(OVERLAPS)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlap_pairs(view(spark, sf_dir, "fx_dets"))


@query(f"{COMPONENTS} SELECT det_id, root FROM groups")
def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.overlap_groups(view(spark, sf_dir, "fx_dets"), keeper(spark))


@query(f"{COMPONENTS} SELECT root AS id, min(image_id) AS image_id, min(dataset) AS dataset, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members, round(median(score), 6) AS score FROM fx_dets JOIN groups USING (det_id) GROUP BY root")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = view(spark, sf_dir, "fx_dets")
    return merging.merged_boxes(dets, merging.overlap_groups(dets, keeper(spark))).withColumn("score", F.round("score", 6))


def _points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return view(spark, sf_dir, name).select(F.col(key).alias("id"), "x", "y")


FAR = "sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y))"


@query(f"SELECT o.k AS id, count(*) AS n FROM fx_objects o JOIN fx_frames f ON {FAR} <= 15 GROUP BY o.k HAVING count(*) >= 3")
def distance_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.seen_often(_points(spark, sf_dir, "fx_objects", "k"), _points(spark, sf_dir, "fx_frames", "frame_id"))


@query(f"SELECT o.k AS a, f.frame_id AS b, round({FAR}, 6) AS dist FROM fx_objects o JOIN fx_frames f ON {FAR} < 20")
def nearby_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.distance_pairs(_points(spark, sf_dir, "fx_objects", "k"), _points(spark, sf_dir, "fx_frames", "frame_id"), 20.0).withColumn("dist", F.round("dist", 6))


def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _points(spark, sf_dir, "fx_objects", "k")
    found = truth.select("id", (F.col("x") + 0.1 * (F.col("id") % 5)).alias("x"), "y")
    return matching.greedy_one_to_one(spatial.distance_pairs(truth, found, 2.0), keeper(spark))


@query("SELECT k AS a, k AS b, round(0.1::DOUBLE * (k % 5), 6) AS dist FROM fx_objects")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query("WITH m AS (SELECT 0.1::DOUBLE * (k % 5) AS dist FROM fx_objects) SELECT round(avg(dist), 6) AS mean, round(stddev_pop(dist), 6) AS std, round(min(dist), 6) AS least, round(max(dist), 6) AS most, round(median(dist), 6) AS median, count(*) AS n FROM m")
def match_dist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = control.match_statistics(_greedy(spark, sf_dir))
    return stats.select(*[F.col(c) if c == "n" else r6(F.col(c), c) for c in stats.columns])


PROBLEM = f"WITH {TAGS}, p AS (SELECT tag, x, y FROM tags WHERE tag <> 'TP')"


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets, labels = view(spark, sf_dir, "fx_dets"), view(spark, sf_dir, "fx_labels")
    tags = matching.tagged(dets, labels)
    of_dets = tags.where("tag = 'FP'").select("tag", "det_id").join(dets, "det_id").select("tag", "x", "y")
    return of_dets.unionByName(tags.where("tag = 'FN'").select("tag", "label_id").join(labels, "label_id").select("tag", "x", "y"))


@query(f"""{PROBLEM}, c AS (SELECT tag, unnest(list_distinct([x // 100, (x + 99) // 100 - 1])) AS ix, x, y FROM p), cc AS (SELECT tag, ix, unnest(list_distinct([y // 100, (y + 99) // 100 - 1])) AS iy FROM c)
SELECT concat(ix * 100, ', ', iy * 100) AS id, tag, count(*) AS n FROM cc WHERE ix >= 0 AND iy >= 0 GROUP BY 1, 2""")
def heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.heat_map(_problems(spark, sf_dir))


@query(f"WITH {TAGS} SELECT CASE tag WHEN 'TP' THEN 'confirmed' WHEN 'FP' THEN 'new detection' ELSE 'missing' END AS status, label_id AS cadaster_id, det_id, dataset FROM tags")
def cadastre_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.exported(tags_of(spark, sf_dir)).select("status", "cadaster_id", "det_id", "dataset")


RAYS = """WITH r AS (SELECT a.ray_id AS ray_a, b.ray_id AS ray_b, a.frame_id AS frame_a, b.frame_id AS frame_b, a.ox AS ax, a.oy AS ay, a.oz AS az, b.ox AS bx, b.oy AS by_, b.oz AS bz, a.dx AS adx, a.dy AS ady, a.dz AS adz, b.dx AS bdx, b.dy AS bdy, b.dz AS bdz,
a.dx * b.dx + a.dy * b.dy + a.dz * b.dz AS cs, a.dx * (a.ox - b.ox) + a.dy * (a.oy - b.oy) + a.dz * (a.oz - b.oz) AS d, b.dx * (a.ox - b.ox) + b.dy * (a.oy - b.oy) + b.dz * (a.oz - b.oz) AS e FROM fx_rays a JOIN fx_rays b ON b.frame_id > a.frame_id AND b.frame_id <= a.frame_id + 8),
t AS (SELECT *, (cs * e - d) / (1 - cs * cs) AS t1, (e - cs * d) / (1 - cs * cs) AS t2 FROM r WHERE abs(1 - cs * cs) >= 1e-6),
q AS (SELECT *, ax + t1 * adx AS px, ay + t1 * ady AS py, az + t1 * adz AS pz, bx + t2 * bdx AS qx, by_ + t2 * bdy AS qy, bz + t2 * bdz AS qz FROM t WHERE t1 BETWEEN 0 AND 20 AND t2 BETWEEN 0 AND 20),
met AS (SELECT ray_a, ray_b, frame_a, frame_b, (px + qx) / 2 AS x, (py + qy) / 2 AS y, (pz + qz) / 2 AS z, sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2) AS dist, greatest(t1, t2) AS length, least(az, bz) AS cz FROM q),
good AS (SELECT * FROM met WHERE dist <= 0.2 AND z > cz - 3.8 AND z < cz - 2.0)"""
SHOWN = "ray_a, ray_b, frame_a, frame_b, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) + 0 AS z, round(dist, 6) AS dist, round(length, 6) AS length"


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.select("ray_a", "ray_b", "frame_a", "frame_b", *[(F.round(c, 6) + 0).alias(c) for c in ("x", "y", "z", "dist", "length")])


@query(f"{RAYS} SELECT {SHOWN} FROM good")
def ray_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(triangulation.ray_pairs(view(spark, sf_dir, "fx_rays")))


@query(f"{RAYS}, k AS (SELECT *, row_number() OVER (PARTITION BY ray_b, frame_a ORDER BY dist, ray_a) AS n FROM good) SELECT {SHOWN} FROM k WHERE n = 1")
def best_pair_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(triangulation.best_per_frame(triangulation.ray_pairs(view(spark, sf_dir, "fx_rays"))))


DRIVE_PAIRS = RAYS.replace("fx_rays a JOIN fx_rays b ON b.frame_id > a.frame_id AND b.frame_id <= a.frame_id + 8", "fx_drive_rays a JOIN fx_drive_rays b ON a.drive = b.drive AND b.frame_id > a.frame_id").replace("SELECT a.ray_id AS ray_a", "SELECT a.drive, a.ray_id AS ray_a").replace("SELECT ray_a, ray_b, frame_a", "SELECT drive, ray_a, ray_b, frame_a")


@query(f"{DRIVE_PAIRS} SELECT drive, {SHOWN} FROM good")
def drive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays that meet on drives that come back along the same road: found by place, not by how near their frames are."""
    pairs = triangulation.ray_pairs(view(spark, sf_dir, "fx_drive_rays"), group="drive")
    return pairs.select("drive", *_shown(pairs).columns[:4], *[(F.round(c, 6) + 0).alias(c) for c in ("x", "y", "z", "dist", "length")])


def _triangulated(spark: SparkSession, sf_dir: str) -> triangulation.Triangulated:
    frames = view(spark, sf_dir, "fx_drive_frames").select("drive", "frame", F.array("dataset").alias("datasets"))
    return triangulation.triangulate(view(spark, sf_dir, "fx_drive_rays"), frames, keeper(spark))


@query()
def drive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of drives with neighbouring objects and revisits; the walk is held against a plain one in the tests."""
    found = _triangulated(spark, sf_dir).candidates
    return found.select("drive", *[r6(F.col(c), c) for c in ("x", "y", "z", "mean_length", "mean_dist")], "n", "last_seen", "missing", "merged", F.array_join("datasets", ",").alias("datasets"))


@query()
def drive_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings that the walk kept."""
    return _triangulated(spark, sf_dir).intersections.select("drive", "ray_a", "ray_b", "frame", *[r6(F.col(c), c) for c in ("x", "y", "z", "dist", "length")])


@query()
def drive_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rays, and whether they are still active at the end of their drive."""
    return _triangulated(spark, sf_dir).rays.select("drive", "ray_id", "frame_id", "active")


@query("""WITH RECURSIVE near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fx_points a JOIN fx_points b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.004::DOUBLE), reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a) SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a""")
def dbscan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangulation.clusters(_points(spark, sf_dir, "fx_points", "vec_id"), 0.004, keeper(spark))


@query("WITH o AS (SELECT frame_id // 500 AS trajectory, frame_id, frame_id % 500 AS k FROM fx_frames) SELECT trajectory, frame_id, CAST(CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE k END AS BIGINT) AS place FROM o")
def frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drives of 500 frames in which neighbours come in swapped order of time: the anchor before is passed, so one frame stands behind."""
    frames = view(spark, sf_dir, "fx_frames").withColumn("trajectory", F.floor(F.col("frame_id") / 500)).withColumn("t", F.col("frame_id").bitwiseXOR(F.lit(1)))
    return triangulation.frame_order(frames)


def _peeled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keep = keeper(spark)
    pairs = keep(triangulation.best_per_frame(triangulation.ray_pairs(view(spark, sf_dir, "fx_rays"))).withColumn("id", F.col("ray_a") * (1 << 32) + F.col("ray_b")))
    return pairs, triangulation.peel(pairs, 0.5, keep)


@query(f"{RAYS}, c AS (SELECT frame_a // 5 AS object_id, ray_a, ray_b FROM good), s AS (SELECT object_id, count(*) AS n FROM c GROUP BY object_id) SELECT c.ray_a, c.ray_b, n FROM c JOIN s USING (object_id)")
def peel_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, won = _peeled(spark, sf_dir)
    ids = won.select("id", "cluster").distinct()
    sizes = ids.groupBy("cluster").agg(F.count("*").alias("n"))
    return ids.join(sizes, "cluster").select(F.shiftright("id", 32).alias("ray_a"), F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).alias("ray_b"), "n")


@query(f"{RAYS} SELECT CAST(round(median(x)) AS BIGINT) AS x, CAST(round(median(y)) AS BIGINT) AS y, CAST(round(median(z)) AS BIGINT) AS z, count(*) AS n, round(avg(length), 6) AS mean_length, max(frame_b) AS last_seen FROM good GROUP BY frame_a // 5")
def candidates_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, won = _peeled(spark, sf_dir)
    found = triangulation.good(triangulation.candidates(pairs, won.select("id", "cluster").distinct()))
    return found.select(*[F.round(c).cast("long").alias(c) for c in "xyz"], "n", r6(F.col("mean_length"), "mean_length"), "last_seen")


@query("SELECT a AS node, min(b) AS root FROM (SELECT label_id AS a, label_id // 10 * 10 AS b FROM fx_labels) GROUP BY a")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "fx_labels")
    chain = labels.select(F.col("label_id").alias("a"), F.greatest(F.col("label_id") - F.when(F.col("label_id") % 10 == 0, 0).otherwise(1), F.lit(0)).alias("b"))
    return components.connected_components(chain, keeper(spark))


@query("SELECT label_id, CASE WHEN hi - lo > 4000 THEN 0 ELSE lo END AS left_u, least(CASE WHEN hi - lo > 4000 THEN 100 ELSE hi END, 7999) AS right_u FROM (SELECT label_id, CASE WHEN label_id % 4 = 0 THEN 50 ELSE x END AS lo, CASE WHEN label_id % 4 = 0 THEN 7950 ELSE x + w END AS hi FROM fx_labels)")
def wrap_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    seam = F.col("label_id") % 4 == 0
    us = F.when(seam, F.array(F.lit(50).cast("long"), F.lit(100).cast("long"), F.lit(7950).cast("long"))).otherwise(F.array(F.col("x"), F.col("x") + 1, F.col("x") + F.col("w")))
    rows = view(spark, sf_dir, "fx_labels").select("label_id", geometry.wrap_around(us, F.lit(8000)).alias("u"))
    return rows.select("label_id", F.array_min("u").cast("long").alias("left_u"), F.array_max("u").cast("long").alias("right_u"))


@query("SELECT dataset, det_id FROM (SELECT dataset, det_id, row_number() OVER (PARTITION BY dataset ORDER BY md5(concat('42|', det_id)), det_id) AS k FROM fx_dets) WHERE k <= 50")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.capped(view(spark, sf_dir, "fx_dets").select("dataset", "det_id"), "dataset", 50, tiling.order_key("det_id"), "det_id")


@query("SELECT DISTINCT image_id, 'left' AS side FROM fx_dets WHERE image_id NOT IN (SELECT image_id FROM fx_labels) UNION ALL SELECT DISTINCT image_id, 'right' FROM fx_labels WHERE image_id NOT IN (SELECT image_id FROM fx_dets)")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.key_differences(view(spark, sf_dir, "fx_dets"), view(spark, sf_dir, "fx_labels"), "image_id")


@query("SELECT concat('pano_', i.image_id, '.jpg') AS file_name, i.image_id, CAST(i.image_id % 3 AS BIGINT) AS n FROM fx_images i")
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "fx_images")
    return control.looked_up(images.select("file_name", (F.col("image_id") % 3).alias("n")), images, "file_name").select("file_name", "image_id", "n")


@query("WITH m AS (SELECT image_id, median(CAST(CASE WHEN h % 4 <> 0 THEN h END AS DOUBLE)) AS med FROM fx_labels GROUP BY image_id) SELECT label_id, CASE WHEN h % 4 <> 0 THEN CAST(h AS DOUBLE) ELSE med END AS z FROM fx_labels JOIN m USING (image_id)")
def elevation_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_labels").select("label_id", "image_id", F.when(F.col("h") % 4 != 0, F.col("h").cast("double")).otherwise(0.0).alias("z"))
    return control.filled(rows, "image_id", "z").select("label_id", "z")


@query("""WITH near AS (SELECT o.k AS object_id, f.frame_id, o.x - f.x AS vx, o.y - f.y AS vy, o.z - f.z AS vz FROM fx_objects o JOIN fx_frames f ON sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) < 20),
c AS (SELECT *, i * pi() / 4 AS a FROM near, range(8) r(i)), p AS (SELECT object_id, frame_id, 4000 + 8000 / (2 * pi()) * atan2(vx + 0.35 * cos(a), vy + 0.35 * sin(a)) AS u, 2000 + 8000 / (2 * pi()) * atan2(-vz, sqrt((vx + 0.35 * cos(a)) ** 2 + (vy + 0.35 * sin(a)) ** 2)) AS v FROM c)
SELECT object_id, frame_id, round(min(u), 3) AS x, round(min(v), 3) AS y, round(max(u) - min(u), 3) AS w, round(max(v) - min(v), 3) AS h FROM p GROUP BY object_id, frame_id HAVING max(u) - min(u) < 1000""")
def projected_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth disks seen from all cameras within 20 m, as boxes in their panoramas."""
    objects, frames = view(spark, sf_dir, "fx_objects"), view(spark, sf_dir, "fx_frames")
    near = spatial.distance_pairs(_points(spark, sf_dir, "fx_objects", "k"), _points(spark, sf_dir, "fx_frames", "frame_id"), 20.0)
    o = objects.select(F.col("k").alias("a"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    rows = near.join(o, "a").join(frames.withColumnRenamed("frame_id", "b"), "b")
    rows = rows.withColumn("corner", F.explode(geometry.point_buffer(F.col("ox"), F.col("oy"), 0.35, 8)))
    seen = camera.to_camera((F.col("corner.x"), F.col("corner.y"), F.col("oz")), tuple(F.col(c) for c in "xyz"), *(F.lit(0.0),) * 3)
    u, v = camera.spherical_pixel(seen, 8000, 4000)
    shape = rows.select(F.col("a").alias("object_id"), F.col("b").alias("frame_id"), u.alias("u"), v.alias("v")).groupBy("object_id", "frame_id").agg(F.min("u").alias("x"), F.min("v").alias("y"), (F.max("u") - F.min("u")).alias("w"), (F.max("v") - F.min("v")).alias("h"))
    return shape.where("w < 1000").select("object_id", "frame_id", *[F.round(c, 3).alias(c) for c in "xywh"])
