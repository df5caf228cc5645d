"""FlatGeobuf files: written, read, pruned by their tree."""

import io
import struct

import numpy as np
import pytest

from panolake.sources import flatgeobuf, geopackage


def box(x, y, w, h):
    return [[float(c) for c in (x, y, x + w, y, x + w, y + h, x, y + h)]]


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    flatgeobuf.register(spark)
    rng = np.random.default_rng(1)
    rows = [(i, f"n{i}" if i % 3 else None, i / 7, i % 2 == 0, box(*map(float, rng.random(2) * 1000), 4, 2)) for i in range(700)]
    rows[3] = rows[3][:4] + (box(50, 50, 20, 20) + box(55, 55, 5, 5),)
    rows.append((700, "no place", 0.5, None, None))
    frame = spark.createDataFrame(rows, "id long, name string, score double, good boolean, geometry array<array<double>>")
    folder = str(tmp_path_factory.mktemp("layers") / "dets")
    frame.repartition(2, "id").write.format("fgb").option("srs", 2056).mode("append").save(folder)
    return rows, folder


def test_written_rows_come_back(spark, layer):
    rows, folder = layer
    got = spark.read.format("fgb").option("rows", 100).load(folder)
    assert got.rdd.getNumPartitions() >= 6
    assert sorted((r["id"], r["name"], r["score"], r["good"], r["geometry"]) for r in got.collect()) == rows
    assert {(r["srs"], r["projected"], r["kind"]) for r in got.where("id < 700").collect()} == {(2056, True, "Polygon")}


def test_boxes_prune_the_tree(spark, layer):
    rows, folder = layer
    rng = np.random.default_rng(2)
    for _ in range(12):
        x0, y0 = (rng.random(2) * 900).tolist()
        limits = [("minx", "<=", x0 + 100), ("maxx", ">=", x0), ("miny", "<", y0 + 100), ("maxy", ">", y0)]
        text = " and ".join(f"{c} {s} {v!r}" for c, s, v in limits)
        expected = sorted(r[0] for r in rows if r[4] and x0 <= max(r[4][0][::2]) and min(r[4][0][::2]) <= x0 + 100 and y0 < max(r[4][0][1::2]) and min(r[4][0][1::2]) < y0 + 100)
        assert sorted(r["id"] for r in spark.read.format("fgb").load(folder).where(text).collect()) == expected
        reader = flatgeobuf.Reader(folder, 1000)
        kinds = {"<=": geopackage.LessThanOrEqual, ">=": geopackage.GreaterThanOrEqual, "<": geopackage.LessThan, ">": geopackage.GreaterThan}
        assert len(list(reader.pushFilters([kinds[s]((c,), v) for c, s, v in limits]))) == 4
        read = [r[1] for p in reader.partitions() for r in reader.read(p)]
        assert set(expected) <= set(read) and len(read) <= len(expected) + 4
    odd = spark.read.format("fgb").load(folder).where("minx >= 500 and maxx < 600 and miny > 990")
    assert sorted(r["id"] for r in odd.collect()) == sorted(r[0] for r in rows if r[4] and min(r[4][0][::2]) >= 500 and max(r[4][0][::2]) < 600 and min(r[4][0][1::2]) > 990)


class Counting(io.BytesIO):
    bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.bytes += len(got)
        return got


def test_few_bytes_of_the_tree_are_read(layer):
    _, folder = layer
    file = Counting(open(flatgeobuf._files(folder)[0], "rb").read())
    head = flatgeobuf.Head.of(file)
    before = file.bytes
    some = flatgeobuf.matches(file, head, [(0, "<=", 110.0), (2, ">=", 100.0), (1, "<=", 110.0), (3, ">=", 100.0)])
    assert file.bytes - before < (head.features - head.tree) / 3 and len(some) < head.count / 10
    assert len(flatgeobuf.matches(file, head, [])) == head.count


def test_tables_follow_the_encoding():
    raw = flatgeobuf.table_bytes({0: b"name", 2: ("B", 7), 3: np.array([1.5, 2.5]), 4: [{0: b"a"}, {0: b"bc", 1: ("d", 0.5)}], 5: ("q", -3), 6: {1: ("i", 9)}})
    t = flatgeobuf.Table.root(raw)
    assert (t.text(0), t.number(2, "B"), t.number(5, "q"), t.number(1, "i", 42), t.number(99, "i", 1)) == ("name", 7, -3, 42, 1)
    assert t.vector(3, "<f8").tolist() == [1.5, 2.5] and [x.text(0) for x in t.tables(4)] == ["a", "bc"]
    assert t.tables(4)[1].number(1, "d") == 0.5 and t.table(6).number(1, "i") == 9 and t.table(1) is None
    # With the size before it each double stands on a multiple of eight.
    assert (t._place(5) + 4) % 8 == 0 and (t._target(3) + 4 + 4) % 8 == 0
    assert struct.unpack_from("<I", raw)[0] == t.at


def test_the_curve_visits_each_cell_and_moves_by_one():
    x, y = (c.reshape(-1) for c in np.meshgrid(np.arange(16), np.arange(16)))
    at = flatgeobuf.hilbert(x, y, 4)
    assert sorted(at.tolist()) == list(range(256))
    order = np.argsort(at)
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()


def test_an_empty_part_and_no_projection(spark, tmp_path):
    flatgeobuf.register(spark)
    frame = spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, None)], "id long, geometry array<array<double>>")
    frame.where("id < 0").coalesce(1).write.format("fgb").mode("append").save(str(tmp_path / "none"))
    frame.coalesce(1).write.format("fgb").option("srs", 4326).option("definition", 'GEOGCS["WGS 84"]').mode("append").save(str(tmp_path / "geo"))
    rows = spark.read.format("fgb").load(str(tmp_path / "geo"))
    assert sorted((r["id"], r["srs"]) for r in geopackage.projected(rows).collect()) == [(1, 2056)]
    assert spark.read.format("fgb").load(str(tmp_path / "none")).count() == 0 if flatgeobuf._files(str(tmp_path / "none")) else True
