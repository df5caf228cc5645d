"""GeoPackage layers: written, read, pruned by box, and the rule for layers without a projection."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from panolake.functions import geometry
from panolake.sources import geopackage


def box(x, y, w, h):
    return [[float(c) for c in (x, y, x + w, y, x + w, y + h, x, y + h)]]


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    geopackage.register(spark)
    rows = [(i, f"n{i}" if i % 3 else None, i / 7, i % 2 == 0, box(10 * i, 5 * i, 4, 2) + (box(10 * i + 1, 5 * i + 0.5, 1, 1) if i % 5 == 0 else [])) for i in range(300)] + [(300, "no place", 0.5, None, None)]
    frame = spark.createDataFrame(rows, "id long, name string, score double, good boolean, geometry array<array<double>>")
    folder = str(tmp_path_factory.mktemp("layers") / "dets")
    frame.repartition(3, "id").write.format("gpkg").option("srs", 2056).option("layer", "dets").mode("append").save(folder)
    return rows, folder


def test_written_rows_come_back(spark, layer):
    rows, folder = layer
    got = spark.read.format("gpkg").option("rows", 40).load(folder)
    assert got.rdd.getNumPartitions() >= 6
    assert sorted((r["id"], r["name"], r["score"], r["good"], r["geometry"]) for r in got.collect()) == rows
    assert {(r["srs"], r["projected"], r["kind"]) for r in got.where("id < 300").collect()} == {(2056, True, "Polygon")}
    assert spark.read.format("gpkg").load(f"{folder}").where("minx is null").count() == 1


def test_boxes_are_pruned_in_the_index(spark, layer, monkeypatch):
    rows, folder = layer
    reader = geopackage.Reader(folder, None, 1000)
    limits = [geopackage.GreaterThanOrEqual(("maxx",), 1000.0), geopackage.LessThan(("minx",), 1100.0), geopackage.LessThan(("score",), 1.0)]
    assert list(reader.pushFilters(limits)) == limits
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[1] for r in read) == list(range(100, 111))
    got = spark.read.format("gpkg").load(folder).where("maxx >= 1000 and minx < 1100 and maxy >= 520")
    assert sorted(r["id"] for r in got.collect()) == list(range(104, 110))


def test_layers_without_a_projection(spark, tmp_path):
    geopackage.register(spark)
    frame = spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, None)], "id long, geometry array<array<double>>")
    for name, text in (("geo", 'GEOGCS["WGS 84"]'), ("flat", 'PROJCS["LV95"]')):
        frame.coalesce(1).write.format("gpkg").option("srs", 4326 if name == "geo" else 21781).option("definition", text).mode("append").save(str(tmp_path / name))
    read = lambda name: sorted((r["id"], r["srs"]) for r in geopackage.projected(spark.read.format("gpkg").load(str(tmp_path / name))).collect())
    assert read("geo") == [(1, 2056)] and read("flat") == [(1, 21781), (2, 21781)]


def test_kinds_and_orders_of_binaries(spark):
    point = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    high = struct.pack("<BIddd", 1, 1001, 1.0, 2.0, 9.0)
    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 3, 4)
    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    many = struct.pack("<BII", 1, 6, 2) + polygon + polygon
    named = struct.pack("<BII", 1, 1 | 0x20000000, 2056) + struct.pack("<dd", 5, 6)
    empty = struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))
    tri = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    expected = [[[1.0, 2.0]], [[1.0, 2.0]], [[0.0, 0.0, 3.0, 4.0]], [tri], [tri, tri], [[5.0, 6.0]], [], None]
    frame = spark.createDataFrame([(i, bytearray(b) if b else None) for i, b in enumerate((point, high, line, polygon, many, named, empty, None))], "i int, b binary")
    got = [r["rings"] for r in frame.select("i", geopackage.rings_of_binary("b").alias("rings")).orderBy("i").collect()]
    assert got == expected
    again = spark.createDataFrame([(tri,)], "r array<double>").select(geopackage.rings_of_binary(geometry.well_known_binary(geometry.ring(F.col("r")))).alias("r")).first()
    assert again["r"] == [tri]


def test_files_hold_what_the_format_asks_for(layer):
    _, folder = layer
    db = sqlite3.connect(geopackage._files(folder)[0])
    assert db.execute("PRAGMA application_id").fetchone() == (0x47504B47,)
    assert db.execute("SELECT table_name, data_type, srs_id FROM gpkg_contents").fetchall() == [("dets", "features", 2056)]
    assert db.execute("SELECT geom FROM dets WHERE geom IS NOT NULL").fetchone()[0][:2] == b"GP"
