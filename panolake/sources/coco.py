"""COCO documents, detection lists, trajectories: read into tables, written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.operators import ranges

IMAGE = "id bigint, file_name string, width int, height int"
ANNOTATION = "id bigint, object_id bigint, image_id bigint, category_id int, segmentation array<array<double>>, area double, bbox array<double>, iscrowd int, score double"
CATEGORY = "id int, name string, supercategory string"
DOCUMENT = f"images array<struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>>, annotations array<struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>>, categories array<struct<{CATEGORY.replace(' ', ':').replace(',:', ',')}>>"
DETECTION = "det_id bigint, image_id bigint, file_name string, bbox array<double>, area double, score double, det_class int, segmentation array<array<double>>"


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images (renamed image_id), annotations, categories, and the orphans among the annotations."""
    document = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    part = lambda name: document.select(F.inline(name))
    images = part("images").withColumnRenamed("id", "image_id")
    annotations = part("annotations")
    return {"images": images, "annotations": annotations.join(images, "image_id", "left_semi"), "categories": part("categories"), "orphans": annotations.join(images, "image_id", "left_anti")}


def with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations as a list; images without any stay."""
    lists = annotations.groupBy("image_id").agg(F.collect_list(F.struct(*[c for c in annotations.columns if c != "image_id"])).alias("annotations"))
    return images.join(lists, "image_id", "left")


def read_many(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Images of several areas with an ``aoi`` column."""
    parts = [read_coco(spark, path)["images"].withColumn("aoi", F.lit(aoi)) for aoi, path in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_detections(spark: SparkSession, paths: dict[str, str], least: float = 0.0) -> DataFrame:
    """Detection lists of several datasets, with a ``dataset`` column and a score threshold."""
    out = None
    for dataset, path in paths.items():
        rows = spark.read.schema(DETECTION).json(path, multiLine=True).where(F.col("score") >= least).withColumn("dataset", F.lit(dataset))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory files: items of cameras whose name begins with lb, with the side length of their faces."""
    item = "dataSourceId:string,gpsWeekSeconds:double,imagePath:array<string>,x:double,y:double,z:double,rx:double,ry:double,rz:double"
    rows = spark.read.schema(f"items array<struct<{item}>>").json(path, multiLine=True).select(F.inline("items"))
    return rows.where(F.col("dataSourceId").startswith("lb")).withColumn("size", F.when(F.col("dataSourceId") == "lb4", 2048).otherwise(4016))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """One document; a COCO file is one JSON object, so its parts meet in one row."""
    listed = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    one = listed(images, "images").join(listed(annotations, "annotations")).join(listed(categories, "categories"))
    one.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def share(value: Column) -> Column:
    """A share to six decimals, never in powers of ten (1.25E-4), which label files do not hold."""
    v = F.round(value, 6)
    return F.when((v != 0) & (F.abs(v) < 0.001), F.rtrim(v.cast("decimal(8, 6)").cast("string"), F.lit("0"))).otherwise(v.cast("string"))


def write_yolo(annotations: DataFrame, width: int, height: int, path: str) -> None:
    """Label lines: the class, then each vertex as shares of the image, one folder per image."""
    points = F.transform(F.get("segmentation", 0), lambda v, i: share(v / F.when(i % 2 == 0, width).otherwise(height)))
    rows = annotations.select("image_id", F.concat_ws(" ", F.col("category_id").cast("string"), F.array_join(points, " ")).alias("value"))
    rows.write.mode("overwrite").partitionBy("image_id").text(path)


def with_missing_images(known: DataFrame, listed: DataFrame) -> DataFrame:
    """file_name, new_id of listed images that are not known, numbered on from the largest id."""
    most = known.agg(F.coalesce(F.max("image_id"), F.lit(-1)).alias("most"))
    missing = listed.select("file_name").distinct().join(known.select("file_name"), "file_name", "left_anti")
    return ranges.places(missing, "file_name").join(F.broadcast(most)).select("file_name", (F.col("most") + 1 + F.col("place")).alias("new_id"))
