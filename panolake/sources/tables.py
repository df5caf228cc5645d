"""Files beside COCO documents: CSV and TSV, record lists in JSON, vector features, trial logs, image folders, status maps."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.sources.coco import DETECTION

#: Features as GeoJSON has them; outlines are one flat list of coordinates here.
FEATURE = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties map<string,string>"
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def write_csv(rows: DataFrame, path: str, *order: str, sep: str = ",", single: bool = False) -> None:
    """Parts written by all tasks, in the order of columns from part to part if given; ``single`` for reports of few rows, as one file."""
    if order:
        rows = (rows.coalesce(1) if single else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    elif single:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_records(rows: DataFrame, path: str, as_array: bool = False) -> None:
    """One JSON object per line; ``as_array`` gives one document with a list, for readers that take nothing else."""
    if as_array:
        rows = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1)
        rows.write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").json(path)


def read_detections_any(spark: SparkSession, path: str) -> DataFrame:
    """Detections of a document that is a list or has one under ``annotations``; ``id`` and ``category_id`` are renamed."""
    fields = [x.strip().split(" ", 1) for x in DETECTION.split(", ")]
    item = ",".join(f"{n}:{k}" for n, k in [*fields, ("id", "bigint"), ("category_id", "int")])
    rows = spark.read.schema(f"{DETECTION}, id bigint, category_id int, annotations array<struct<{item}>>").json(path, multiLine=True)
    inner = rows.where("annotations is not null").select(F.inline("annotations"))
    every = rows.where("annotations is null").drop("annotations").unionByName(inner)
    return every.withColumn("det_id", F.coalesce("det_id", "id")).withColumn("det_class", F.coalesce("det_class", "category_id")).drop("id", "category_id")


def with_image_ids(dets: DataFrame, tiles: DataFrame) -> DataFrame:
    """Detections without ``image_id`` take that of the tile of their name; those of no tile go."""
    missing = dets.where("image_id is null").drop("image_id").join(tiles.select("file_name", "image_id"), "file_name")
    return dets.where("image_id is not null").join(tiles.select("image_id"), "image_id", "left_semi").unionByName(missing)


def write_features(rows: DataFrame, ring: str, path: str) -> None:
    """Features of one outline each (a flat list of coordinates), one per line, all other columns as properties."""
    points = F.transform(F.sequence(F.lit(0), F.size(ring) - 2, F.lit(2)), lambda i: F.array(F.get(ring, i), F.get(ring, i + 1)))
    others = [c for c in rows.columns if c != ring]
    properties = F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    rows.select(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties")).write.mode("overwrite").json(path)


def read_features(spark: SparkSession, path: str, projected: bool = True) -> DataFrame:
    """geometry (the outer outline as a flat list), properties; features without one go where the file has no projection."""
    rows = spark.read.schema(FEATURE).json(path)
    rows = rows.select(F.flatten(F.get("geometry.coordinates", 0)).alias("geometry"), "properties")
    return rows if projected else rows.where("geometry is not null")


def trial_logs(spark: SparkSession, root: str) -> DataFrame:
    """Progress rows of all trials under a folder: files progress.csv in train_yolo_*/train_yolo_*, with the trial's folder."""
    schema = "epoch int, precision double, recall double, map50 double"
    rows = spark.read.schema(schema).csv(f"{root}/train_yolo_*/train_yolo_*/progress.csv", header=True)
    return rows.withColumn("trial", F.regexp_extract(F.input_file_name(), r"/(train_yolo_[^/]*)/progress\.csv", 1))


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG file; None for what cannot be read."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return None


def listed_images(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, width, height of the images in a folder; other files and those that cannot be read are left out."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [image_size(x.as_py() or b"") for x in batch.column("content")]
            kept = pa.array([i for i, s in enumerate(found) if s], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file_name").take(kept), *(pa.array([s[k] for s in found if s], pa.int32()) for k in range(2))], ["file_name", "width", "height"])

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder).select(name.alias("file_name"), "content")
    known = F.lower(F.element_at(F.split("file_name", r"\."), -1)).isin(*IMAGE_ENDINGS)
    return files.where(known).mapInArrow(sizes, "file_name string, width int, height int")


def write_status(status: DataFrame, path: str) -> None:
    """ann_id, validated, removed as the cache that a review begins with; the one before is replaced."""
    status.select("ann_id", "validated", "removed").write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ann_id bigint, validated boolean, removed boolean").json(path)


def with_category_names(rows: DataFrame) -> DataFrame:
    """``category`` and ``supercategory`` in capitals; a table with neither is refused."""
    names = {c.lower(): c for c in rows.columns if c.lower() in ("category", "supercategory")}
    if not names:
        raise ValueError("the table has neither category nor supercategory")
    for low, name in names.items():
        rows = rows.withColumnRenamed(name, low.upper())
    return rows


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows that share ``keys`` the first in order."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("one")).select(*keys, "one.*")


def every_nth(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows 0, n, 2n ... in order; numbered in ranges, so that no task holds all rows."""
    from panolake.operators import ranges

    return ranges.places(rows, *order).where(F.col("place") % n == 0).drop("place")
