"""GeoPackage layers as a Spark data source: row ranges as partitions, boxes pruned by the file's own spatial index.

    geopackage.register(spark)
    spark.read.format("gpkg").load(path).where("minx <= 10 and maxx >= 0")
    rows.write.format("gpkg").option("srs", 2056).mode("append").save(folder)

A path is one file or a folder of parts that all executors can open, as SQLite files are opened in place. Rows have fid, the
columns of the layer, geometry (rings, lines or points as flat lists of x and y), kind, srs, projected, and the box minx, miny,
maxx, maxy. Comparisons of the box columns with numbers go to the index; Spark tests them again on what comes back, as an
index rounds outward. Empty and null geometries have a null box and no index entry, and are left out where a box is asked for.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, StructType

#: Names and numbers of the formats.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
APPLICATION, VERSION = 0x47504B47, 10300
TYPES = {"BOOLEAN": "boolean", "TINYINT": "int", "SMALLINT": "int", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "BLOB": "binary"}
BOX = ("minx", "miny", "maxx", "maxy")
TAIL = "geometry array<array<double>>, kind string, srs int, projected boolean, minx double, miny double, maxx double, maxy double"


def decode(raw: bytes, at: int = 0) -> tuple[str, list[np.ndarray], int]:
    """Kind, point lists (as many rows of x and y) and end of a well-known binary; further coordinates are dropped."""
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", raw, at + 1)
    wide = 2 + bool(code & 0x80000000 or code // 1000 % 10 in (1, 3)) + bool(code & 0x40000000 or code // 1000 % 10 in (2, 3))
    at += 5 + 4 * bool(code & 0x20000000)
    kind = (code & 0x0FFFFFFF) % 1000

    def points(n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, f"{order}f8", n * wide, at).reshape(n, wide)[:, :2].astype(float)
        at += n * wide * 8
        return found

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", raw, at - 4)[0]

    if kind == 1:
        lists = [points(1)]
        lists = [] if np.isnan(lists[0]).all() else lists
    elif kind == 2:
        lists = [points(number())]
    elif kind == 3:
        lists = [points(number()) for _ in range(number())]
        # The closing point of a ring is the first one again.
        lists = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in lists]
    elif kind in KINDS:
        lists = []
        for _ in range(number()):
            _, part, at = decode(raw, at)
            lists += part
    else:
        raise ValueError(f"geometry of kind {kind}")
    return KINDS[kind], lists, at


def encode(kind: str, rings: list[list[float]]) -> bytes:
    """A point, line or polygon as little-endian well-known binary; rings are closed."""
    lists = [np.array(r, "<f8").reshape(-1, 2) for r in rings]
    if kind == "Point":
        return struct.pack("<BI", 1, 1) + lists[0][0].tobytes()
    if kind == "LineString":
        return struct.pack("<BII", 1, 2, len(lists[0])) + lists[0].tobytes()
    closed = [np.concatenate([r, r[:1]]) for r in lists]
    return struct.pack("<BII", 1, 3, len(closed)) + b"".join(struct.pack("<I", len(r)) + r.tobytes() for r in closed)


@arrow_udf(ArrayType(ArrayType(DoubleType())))
def rings_of_binary(raw: pa.Array) -> pa.Array:
    """The point lists of well-known binaries; null for null."""
    return pa.array([None if b is None else [r.reshape(-1).tolist() for r in decode(b)[1]] for b in raw.to_pylist()], pa.list_(pa.list_(pa.float64())))


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"SQLite opens files in place; not a mounted path: {path}")
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".gpkg")) if os.path.isdir(path) else [path]


def _open(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)


@dataclass
class Layer:
    table: str
    shape: str
    key: str
    srs: int
    projected: bool
    columns: list[tuple[str, str]]
    indexed: bool

    @staticmethod
    def of(file: str, name: str | None) -> Layer:
        with _open(file) as db:
            rows = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
            table, shape, srs = next(r for r in rows if name in (None, r[0]))
            (definition,) = db.execute("SELECT definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs,)).fetchone() or ("",)
            every = db.execute(f'PRAGMA table_info("{table}")').fetchall()
            key = next((c[1] for c in every if c[5]), "rowid")
            columns = [(c[1], TYPES.get(c[2].upper().split("(")[0], "string")) for c in every if c[1] not in (shape, key)]
            indexed = db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (f"rtree_{table}_{shape}",)).fetchone()[0] > 0
        return Layer(table, shape, key, srs, definition.upper().startswith(("PROJ", "BOUNDCRS[SOURCECRS[PROJ")), columns, indexed)


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    last: int


@dataclass
class Reader(DataSourceReader):
    path: str
    layer: str | None
    rows: int
    limits: list[tuple[str, str, float]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {GreaterThan: ">=", GreaterThanOrEqual: ">=", LessThan: "<=", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in BOX and isinstance(f.value, (int, float)):
                self.limits.append((f.attribute[0], signs[type(f)], float(f.value)))
            yield f

    def partitions(self) -> list[Rows]:
        out = []
        for file in _files(self.path):
            layer = Layer.of(file, self.layer)
            with _open(file) as db:
                low, high = db.execute(f'SELECT min("{layer.key}"), max("{layer.key}") FROM "{layer.table}"').fetchone()
            if low is not None:
                out += [Rows(file, k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: Rows) -> Iterator[tuple]:
        layer = Layer.of(partition.file, self.layer)
        names = ", ".join(f't."{c}"' for c in (layer.key, *(c for c, _ in layer.columns), layer.shape))
        text, values = f'FROM "{layer.table}" t', [partition.first, partition.last]
        limits = self.limits if layer.indexed else []
        if limits:
            text += f' JOIN "rtree_{layer.table}_{layer.shape}" b ON b.id = t."{layer.key}"'
        text += f' WHERE t."{layer.key}" BETWEEN ? AND ?' + "".join(f" AND b.{c} {sign} ?" for c, sign, _ in limits)
        logical = [k for k, (_, kind) in enumerate(layer.columns) if kind == "boolean"]
        with _open(partition.file) as db:
            for key, *others, blob in db.execute(f"SELECT {names} {text}", values + [v for _, _, v in limits]):
                for k in logical:
                    others[k] = None if others[k] is None else bool(others[k])
                yield (key, *others, *_shape(blob), layer.srs, layer.projected, *_box(blob))


def _shape(blob: bytes | None) -> tuple[list[list[float]] | None, str | None]:
    if blob is None:
        return None, None
    kind, lists, _ = decode(blob, 8 + ENVELOPES[blob[3] >> 1 & 7])
    return [r.reshape(-1).tolist() for r in lists], kind


def _box(blob: bytes | None) -> tuple[float | None, ...]:
    lists = decode(blob, 8 + ENVELOPES[blob[3] >> 1 & 7])[1] if blob is not None else []
    if not sum(map(len, lists)):
        return (None,) * 4
    every = np.concatenate(lists)
    return (*map(float, every.min(0)), *map(float, every.max(0)))


@dataclass
class Written(WriterCommitMessage):
    part: str


class Writer(DataSourceWriter):
    """A file for each task in the folder; parts get their names when all are whole."""

    def __init__(self, folder: str, schema: StructType, table: str, srs: int, definition: str):
        self.folder, self.table, self.srs, self.definition = folder.removeprefix("file://").removeprefix("file:"), table, srs, definition
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN", "binary": "BLOB"}
        skipped = {"geometry", "kind", "srs", "projected", "fid", *BOX}
        self.names = [f.name for f in schema]
        self.columns = [(f.name, kinds.get(f.dataType.simpleString(), "TEXT")) for f in schema if f.name not in skipped]

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gpkg"
        with sqlite3.connect(f"{self.folder}/.{part}") as db:
            self._tables(db)
            fields = ", ".join(f'"{c}"' for c, _ in self.columns)
            marks = ", ".join("?" * (2 + len(self.columns)))
            for n, row in enumerate(rows, 1):
                values = dict(zip(self.names, row, strict=True))
                rings = values["geometry"]
                blob = None if rings is None else struct.pack("<2sBBi", b"GP", 0, 1, self.srs) + encode(values.get("kind") or "Polygon", rings)
                db.execute(f'INSERT INTO "{self.table}" (fid, geom{", " * bool(fields)}{fields}) VALUES ({marks})', (n, blob, *(values[c] for c, _ in self.columns)))
                x0, y0, x1, y1 = _box(blob)
                if x0 is not None:
                    db.execute(f'INSERT INTO "rtree_{self.table}_geom" VALUES (?, ?, ?, ?, ?)', (n, x0, x1, y0, y1))
        return Written(part)

    def _tables(self, db: sqlite3.Connection) -> None:
        db.executescript(
            f"""PRAGMA application_id = {APPLICATION}; PRAGMA user_version = {VERSION};
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
            CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
            CREATE TABLE "{self.table}" (fid INTEGER PRIMARY KEY, geom GEOMETRY{"".join(f', "{c}" {k}' for c, k in self.columns)});
            CREATE VIRTUAL TABLE "rtree_{self.table}_geom" USING rtree(id, minx, maxx, miny, maxy);"""
        )
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", (f"EPSG:{self.srs}", self.srs, self.srs, self.definition))
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (self.table, self.table, self.srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (self.table, self.srs))
        db.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (self.table,))

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                os.rename(f"{self.folder}/.{m.part}", f"{self.folder}/{m.part}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(f"{self.folder}/.{m.part}"):
                os.remove(f"{self.folder}/.{m.part}")


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        layer = Layer.of(_files(self.options["path"])[0], self.options.get("layer"))
        return ", ".join(["fid bigint", *(f"`{c}` {k}" for c, k in layer.columns), TAIL])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("layer"), int(self.options.get("rows", 50_000)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        srs = int(self.options.get("srs", 2056))
        return Writer(self.options["path"], schema, self.options.get("layer", "features"), srs, self.options.get("definition", f'PROJCS["EPSG:{srs}"]'))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(GeoPackage)


def projected(rows: DataFrame, srs: int = 2056) -> DataFrame:
    """Layers without a projection: rows without geometry go, the others are taken to be in ``srs``."""
    known = rows.where(F.col("projected") | F.col("geometry").isNotNull())
    return known.withColumn("srs", F.when(F.col("projected"), F.col("srs")).otherwise(F.lit(srs))).drop("projected")
