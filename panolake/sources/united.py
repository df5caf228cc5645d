"""COCO documents of several areas or datasets read as one table each, and written in parts by all tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.operators import tiling
from panolake.sources import coco, tables

#: Fields of a tagged detection.
TAGGED = "dataset string, tag string, label_id bigint, label_class int, category string, det_id bigint, score double, det_class int, det_category string, area double, IOU double, segmentation array<array<double>>, bbox array<double>, image_id bigint"
_IMAGES = f"images array<struct<{coco.IMAGE.replace(', ', ',').replace(' ', ':')}>>"
_TAGGED = f"annotations array<struct<{TAGGED.replace(', ', ',').replace(' ', ':')}>>"
#: Annotations of a written document, about; an image's own are never parted.
EACH = 50_000


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def read_areas(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """images, annotations, orphans and ids of the areas' documents under image ids that are unique over all areas.

    Areas keep the order of ``paths``; each one's ids start after the largest ids of those before. ``original_id``
    is the id within the document, ``ids`` (aoi, image_id, original_id) the table that leads from one to the other.
    Annotations whose image is not in their own area's document are orphans, also where another area has its id.
    """
    documents = {aoi: coco.read_coco(spark, path) for aoi, path in paths.items()}

    def every(name: str) -> DataFrame:
        return union(d[name].withColumns({"aoi": F.lit(aoi), "place": F.lit(k)}) for k, (aoi, d) in enumerate(documents.items()))

    images = tiling.shifted_ids(every("images"), "place", "image_id").withColumnRenamed("image_id", "original_id").withColumnRenamed("new_id", "image_id")
    ids = images.select("aoi", "image_id", "original_id")
    annotations = every("annotations").drop("place").withColumnRenamed("image_id", "original_id").join(ids, ["aoi", "original_id"])
    return {"images": images.drop("place", "offset"), "annotations": annotations, "orphans": every("orphans").drop("place"), "ids": ids}


def read_tagged(spark: SparkSession, paths: dict[str, str], image_paths: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of tagged files, in the order of ``paths``.

    A file is a document, whose own images count, or a bare list of annotations, whose images are those of all
    ``image_paths``. Of images that share a file_name the first stays: by file, then by place in the document; in a
    folder of several documents, which are parts of one, the least id. Annotations without a dataset take their file's.
    """
    found, annotations = [], []
    for k, (dataset, path) in enumerate(paths.items()):
        rows = spark.read.schema(f"{_IMAGES}, {_TAGGED}, {TAGGED}").json(path, multiLine=True)
        bare = rows.where("annotations IS NULL AND images IS NULL").drop("images", "annotations")
        own = union([rows.select(F.inline("annotations")), bare])
        annotations.append(own.withColumn("dataset", F.coalesce("dataset", F.lit(dataset))))
        sources = [rows] if bare.isEmpty() else [spark.read.schema(_IMAGES).json(p, multiLine=True) for p in image_paths]
        for j, source in enumerate(sources):
            listed = source.select(F.posexplode("images").alias("at", "image"))
            # A place counts within one document; parts of a folder hold images by their ids.
            at = F.col("at") if source.limit(2).count() < 2 else F.lit(0)
            found.append(listed.select(F.lit(k).alias("file"), F.lit(j).alias("source"), at.alias("at"), "image.*"))
    images = tables.first_wins(union(found), ["file_name"], *(F.col(c) for c in ("file", "source", "at", "id")))
    return images.select("id", "file_name", "width", "height"), union(annotations)


def write_coco_parts(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, each: int = EACH) -> None:
    """A folder of documents, each whole in itself: some of the images (id, ...), their annotations and all categories.

    Images are dealt by their ids, to as many documents as hold about ``each`` annotations and images; the documents
    are made and written by all tasks, and ``read_coco`` of the folder gives all rows back. Annotations of unknown
    images are written too, so that no row is lost.
    """
    parts = (annotations.count() + images.count()) // each + 1

    def listed(rows: DataFrame, key: str, name: str) -> DataFrame:
        part: Column = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(-1))), F.lit(parts))
        return rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))

    names = F.broadcast(categories.agg(F.collect_list(F.struct(*categories.columns)).alias("categories")))  # one row, as many items as classes
    pictures = listed(images, "id", "images").withColumn("images", F.array_sort("images", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
    whole = pictures.join(listed(annotations, "image_id", "annotations"), "part", "full").join(names)
    value = F.to_json(F.struct(*[F.coalesce(c, F.array()).alias(c) for c in ("images", "annotations")], "categories"))
    whole.select(value.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_list_parts(rows: DataFrame, path: str, each: int = EACH) -> None:
    """A folder of JSON lists of about ``each`` rows, made and written by all tasks; an empty table is one empty list.

    Rows are dealt by their values, so that a task that runs again deals them alike; repeated rows share a list.
    """
    parts = rows.count() // each + 1
    lists = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("list"))
    if rows.isEmpty():
        lists = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("list"))
    lists.select(F.to_json("list").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
