"""FlatGeobuf files as a Spark data source: the packed Hilbert R-tree of a file says which features meet a box.

    flatgeobuf.register(spark)
    spark.read.format("fgb").load(path).where("minx <= 10 and maxx >= 0")
    rows.write.format("fgb").option("srs", 2056).mode("append").save(folder)

Rows are those of the ``gpkg`` source (fid is a feature's place in its file). Comparisons of the box columns with numbers prune: the
tree is walked from its root, and only leaves that may hold a match are read, neighbours in one go. Files without a tree are
read whole. A writer puts a file per task into the folder, its features in Hilbert order; features wait in a temporary file of the
task, in memory are their boxes alone.
"""

from __future__ import annotations

import math
import os
import struct
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from typing import Any, BinaryIO

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from panolake.sources.geopackage import BOX, KINDS, TAIL

#: Fixed values of the format: its first bytes, the bytes of a node, and the types of columns.
MAGIC = bytes([0x66, 0x67, 0x62, 3, 0x66, 0x67, 0x62, 0])
NODE = np.dtype([("box", "<f8", 4), ("at", "<u8")])
TYPES = {0: ("b", "int"), 1: ("B", "int"), 2: ("?", "boolean"), 3: ("h", "int"), 4: ("H", "int"), 5: ("i", "int"), 6: ("I", "bigint"), 7: ("q", "bigint"), 8: ("Q", "bigint"), 9: ("f", "double"), 10: ("d", "double"), 11: ("s", "string"), 12: ("s", "string"), 13: ("s", "string"), 14: ("y", "binary")}
WRITTEN = {"boolean": 2, "int": 5, "smallint": 5, "bigint": 7, "float": 10, "double": 10, "binary": 14}
#: How its header names and numbers geometries and the slots that are used here.
NAME, ENVELOPE, KIND, COLUMNS, COUNT, FAN, CRS = 0, 1, 2, 7, 8, 9, 10

#: Features of a file that a task writes; their boxes and places are held until it is whole.
EACH = 250_000


class Table:
    """A table of the FlatBuffers encoding: fields by slot."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at
        self.slots = at - struct.unpack_from("<i", raw, at)[0]
        self.size = struct.unpack_from("<H", raw, self.slots)[0]

    @staticmethod
    def root(raw: bytes) -> Table:
        return Table(raw, struct.unpack_from("<I", raw, 0)[0])

    def _place(self, slot: int) -> int:
        at = 4 + 2 * slot
        off = struct.unpack_from("<H", self.raw, self.slots + at)[0] if at < self.size else 0
        return self.at + off if off else 0

    def number(self, slot: int, kind: str, default: Any = 0) -> Any:
        at = self._place(slot)
        return struct.unpack_from(f"<{kind}", self.raw, at)[0] if at else default

    def _target(self, slot: int) -> int:
        at = self._place(slot)
        return at + struct.unpack_from("<I", self.raw, at)[0] if at else 0

    def vector(self, slot: int, kind: str) -> np.ndarray:
        at = self._target(slot)
        return np.frombuffer(self.raw, kind, struct.unpack_from("<I", self.raw, at)[0], at + 4) if at else np.zeros(0, kind)

    def text(self, slot: int) -> str:
        return self.vector(slot, "u1").tobytes().decode()

    def table(self, slot: int) -> Table | None:
        at = self._target(slot)
        return Table(self.raw, at) if at else None

    def tables(self, slot: int) -> list[Table]:
        at = self._target(slot)
        return [Table(self.raw, at + 4 + 4 * i + o) for i, o in enumerate(self.vector(slot, "<u4").tolist())] if at else []


def table_bytes(root: dict[int, Any]) -> bytes:
    """A table from its fields: (format, number), bytes (a text), arrays, tables as dicts, and lists of these. Everything referred to comes later."""
    out = bytearray(4)
    waiting: list[tuple[int, Any]] = [(0, root)]

    def aligned(size: int, ahead: int = 0) -> None:
        while (len(out) + ahead) % size:
            out.append(0)

    while waiting:
        back, value = waiting.pop(0)
        if isinstance(value, dict):
            slots, inline, refs = [0] * (max(value, default=-1) + 1), bytearray(4), []
            for slot, v in sorted(value.items(), key=lambda kv: -struct.calcsize(f"<{kv[1][0]}") if isinstance(kv[1], tuple) else -4):
                width = struct.calcsize(f"<{v[0]}") if isinstance(v, tuple) else 4
                while (len(inline) + 4) % width:
                    inline.append(0)
                slots[slot] = len(inline)
                if not isinstance(v, tuple):
                    refs.append((len(inline), v))
                inline += struct.pack(f"<{v[0]}", v[1]) if isinstance(v, tuple) else bytes(4)
            head = struct.pack("<HH", 4 + 2 * len(slots), len(inline)) + struct.pack(f"<{len(slots)}H", *slots)
            # Numbers of eight bytes stand where the place, with the size before it, is a multiple of eight.
            aligned(8, len(head))
            first = len(out)
            out += head
            at = len(out)
            struct.pack_into("<i", inline, 0, at - first)
            out += inline
            waiting += [(at + place, v) for place, v in refs]
        else:
            aligned(8 if isinstance(value, np.ndarray) and value.itemsize == 8 else 4)
            at = len(out)
            out += struct.pack("<I", len(value))
            if isinstance(value, list):
                out += bytes(4 * len(value))
                waiting += [(at + 4 + 4 * i, v) for i, v in enumerate(value)]
            else:
                out += value + b"\0" if isinstance(value, bytes) else value.tobytes()
        struct.pack_into("<I", out, back, at - back)
    return bytes(out)


def levels(count: int, fan: int) -> list[tuple[int, int]]:
    """First and last place of the nodes of each level of a tree, the leaves first; the root is node 0."""
    sizes = [count]
    while sizes[-1] > 1 or len(sizes) == 1:
        sizes.append(-(-sizes[-1] // fan))
    ends = np.cumsum(sizes[::-1])[::-1].tolist()
    return [(e - n, e) for e, n in zip(ends, sizes, strict=True)]


def packed_tree(boxes: np.ndarray, at: np.ndarray, fan: int = 16) -> np.ndarray:
    """The nodes of a tree over sorted boxes: leaves point to bytes, other nodes to their first child."""
    bounds = levels(len(boxes), fan)
    nodes = np.zeros(bounds[0][1], NODE)
    nodes["box"][bounds[0][0] :], nodes["at"][bounds[0][0] :] = boxes, at
    for (low, high), (first, last) in zip(bounds, bounds[1:], strict=False):
        starts = np.arange(low, high, fan)
        cuts = starts - low
        own = nodes["box"][low:high]
        nodes["box"][first:last] = np.concatenate([np.minimum.reduceat(own[:, :2], cuts), np.maximum.reduceat(own[:, 2:], cuts)], axis=1)
        nodes["at"][first:last] = starts
    return nodes


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """Place along a Hilbert curve of points on a grid of 2^bits cells a side."""
    x, y, out = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        s = 1 << b
        right, up = (x & s) > 0, (y & s) > 0
        out += s * s * ((3 * right) ^ up)
        flip = ~up & right
        x, y = np.where(flip, s - 1 - (x & (s - 1)), x & (s - 1)), np.where(flip, s - 1 - (y & (s - 1)), y & (s - 1))
        x, y = np.where(up, x, y), np.where(up, y, x)
    return out


@dataclass
class Head:
    columns: list[tuple[str, int]]
    count: int
    fan: int
    kind: int
    srs: int
    projected: bool
    #: Where the tree and the features begin.
    tree: int
    features: int

    @staticmethod
    def of(file: BinaryIO) -> Head:
        if file.read(8)[:3] != MAGIC[:3]:
            raise ValueError("not a FlatGeobuf file")
        (size,) = struct.unpack("<I", file.read(4))
        t = Table.root(file.read(size))
        count, fan, crs = t.number(COUNT, "Q"), t.number(FAN, "H", 16), t.table(CRS)
        nodes = levels(count, fan)[0][1] if count and fan else 0
        wkt, code = (crs.text(4), crs.number(1, "i")) if crs else ("", 0)
        flat = wkt.upper().startswith(("PROJ", "BOUNDCRS[SOURCECRS[PROJ")) if wkt else code not in (0, 4326, 4258, 4979)
        return Head([(c.text(0), c.number(1, "B")) for c in t.tables(COLUMNS)], count, fan, t.number(KIND, "B"), code, flat, 12 + size, 12 + size + nodes * NODE.itemsize)


def matches(file: BinaryIO, head: Head, limits: list[tuple[int, str, float]]) -> np.ndarray:
    """(feature, its place) of all leaves that meet the limits (column of the box, sign, number), by a walk from the root."""
    bounds = levels(head.count, head.fan)

    def read(first: int, n: int) -> np.ndarray:
        file.seek(head.tree + first * NODE.itemsize)
        return np.frombuffer(file.read(n * NODE.itemsize), NODE)

    found, ranges = [], [(0, 1, len(bounds) - 1)]
    while ranges:
        first, n, level = ranges.pop()
        nodes, may = read(first, n), np.ones(n, bool)
        for column, sign, number in limits:
            # The greatest lower edge in a node is below its upper edge, and the least upper edge above its lower one.
            outer = (column + 2) % 4 if level and (sign == ">=") == (column < 2) else column
            may &= nodes["box"][:, outer] >= number if sign == ">=" else nodes["box"][:, outer] <= number
        if level == 0:
            found += [(first + i - bounds[0][0], int(nodes["at"][i])) for i in np.flatnonzero(may).tolist()]
            continue
        for child in nodes["at"][may].tolist():
            ranges.append((child, min(head.fan, bounds[level - 1][1] - child), level - 1))
    return np.array(sorted(found), np.int64).reshape(-1, 2)


def _shape(g: Table, kind: int) -> tuple[list[np.ndarray], str]:
    kind = g.number(6, "B") or kind
    if g.tables(7):
        return [p for part in g.tables(7) for p in _shape(part, {4: 1, 5: 2, 6: 3}.get(kind, 0))[0]], KINDS.get(kind, "GeometryCollection")
    xy = g.vector(1, "<f8").reshape(-1, 2)
    ends = g.vector(0, "<u4").astype(np.int64)
    lists = np.split(xy, ends[:-1]) if len(ends) > 1 else [xy] if len(xy) else []
    if kind == 3:
        lists = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in lists]
    return lists, KINDS.get(kind, "GeometryCollection")


def _values(raw: bytes, columns: list[tuple[str, int]]) -> list:
    out, at = [None] * len(columns), 0
    while at < len(raw):
        (k,) = struct.unpack_from("<H", raw, at)
        code, at = TYPES[columns[k][1]][0], at + 2
        if code in "sy":
            (n,) = struct.unpack_from("<I", raw, at)
            out[k], at = raw[at + 4 : at + 4 + n], at + 4 + n
            out[k] = out[k].decode() if code == "s" else out[k]
        else:
            out[k], at = struct.unpack_from(f"<{code}", raw, at)[0], at + struct.calcsize(f"<{code}")
    return out


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".fgb")) if os.path.isdir(path) else [path]


@dataclass
class Leaves(InputPartition):
    """Features of a file: their numbers and places; the whole file from its first feature on where it has no tree."""

    file: str
    numbers: list[int] | None
    places: list[int]


@dataclass
class Reader(DataSourceReader):
    path: str
    rows: int
    limits: list[tuple[int, str, float]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {GreaterThan: ">=", GreaterThanOrEqual: ">=", LessThan: "<=", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in BOX and isinstance(f.value, (int, float)):
                self.limits.append((BOX.index(f.attribute[0]), signs[type(f)], float(f.value)))
            yield f

    def partitions(self) -> list[Leaves]:
        out = []
        for name in _files(self.path):
            with open(name, "rb") as file:
                head = Head.of(file)
                if not head.count or not head.fan:
                    out.append(Leaves(name, None, []))
                    continue
                leaves = matches(file, head, self.limits)
            out += [Leaves(name, *leaves[k : k + self.rows].T.tolist()) for k in range(0, len(leaves), self.rows)]
        return out

    def read(self, partition: Leaves) -> Iterator[tuple]:
        with open(partition.file, "rb") as file:
            head = Head.of(file)
            file.seek(head.features)
            numbers, at = partition.numbers, 0
            for k in range(len(numbers)) if numbers is not None else iter(int, 1):
                if numbers is not None and partition.places[k] != at:
                    at = partition.places[k]
                    file.seek(head.features + at)
                if len(size := file.read(4)) < 4:
                    return
                (n,) = struct.unpack("<I", size)
                feature = Table.root(file.read(n))
                yield self._row(feature, head, numbers[k] if numbers is not None else at)
                at += 4 + n

    @staticmethod
    def _row(feature: Table, head: Head, number: int) -> tuple:
        g = feature.table(0)
        lists, kind = _shape(g, head.kind) if g else (None, None)
        every = np.concatenate(lists) if lists else np.zeros((0, 2))
        box = (*map(float, every.min(0)), *map(float, every.max(0))) if len(every) else (None,) * 4
        own = [(c.text(0), c.number(1, "B")) for c in feature.tables(2)] or head.columns
        values = dict(zip((c for c, _ in own), _values(feature.vector(1, "u1").tobytes(), own), strict=True))
        rings = None if lists is None else [r.reshape(-1).tolist() for r in lists]
        return (number, *(values.get(c) for c, _ in head.columns), rings, kind, head.srs, head.projected, *box)


@dataclass
class Written(WriterCommitMessage):
    parts: list[str]


class Writer(DataSourceWriter):
    """Files of at most ``each`` features by each task in the folder; parts get their names when all are whole."""

    def __init__(self, folder: str, schema: StructType, srs: int, definition: str, each: int = EACH):
        self.each = each
        self.folder, self.srs, self.definition = folder.removeprefix("file://").removeprefix("file:"), srs, definition
        skipped = {"geometry", "kind", "srs", "projected", "fid", *BOX}
        self.names = [f.name for f in schema]
        self.columns = [(f.name, WRITTEN.get(f.dataType.simpleString(), 11)) for f in schema if f.name not in skipped]

    def _feature(self, values: dict) -> tuple[bytes, tuple[float, ...]]:
        properties = bytearray()
        for k, (name, kind) in enumerate(self.columns):
            v, code = values[name], TYPES[kind][0]
            if v is None:
                continue
            raw = str(v).encode() if code == "s" else bytes(v) if code == "y" else struct.pack(f"<{code}", v)
            properties += struct.pack("<H", k) + (struct.pack("<I", len(raw)) if code in "sy" else b"") + raw
        feature: dict[int, Any] = {1: np.frombuffer(bytes(properties), "u1")}
        box = (math.inf, math.inf, -math.inf, -math.inf)
        if values["geometry"]:
            kind = {v: k for k, v in KINDS.items()}[values.get("kind") or "Polygon"]
            lists = [np.array(r, "<f8").reshape(-1, 2) for r in values["geometry"]]
            lists = [np.concatenate([r, r[:1]]) for r in lists] if kind == 3 else lists
            every = np.concatenate(lists)
            box = (*every.min(0).tolist(), *every.max(0).tolist())
            feature[0] = {1: every.reshape(-1), 6: ("B", kind)} | ({0: np.cumsum([len(r) for r in lists]).astype("<u4")} if len(lists) > 1 else {})
        return table_bytes(feature), box

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        rows, parts = iter(rows), []
        first = list(islice(rows, 1))
        while first or not parts:
            parts.append(self._file(chain(first, islice(rows, self.each - 1))))
            first = list(islice(rows, 1))
        return Written(parts)

    def _file(self, rows: Iterator) -> str:
        """One file of these rows, whose boxes and places are held in memory."""
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.fgb"
        boxes, places, sizes, at = array("d"), array("q"), array("q"), 0
        with tempfile.TemporaryFile() as waiting:
            for row in rows:
                raw, box = self._feature(dict(zip(self.names, row, strict=True)))
                waiting.write(struct.pack("<I", len(raw)) + raw)
                boxes.extend(box)
                places.append(at)
                sizes.append(4 + len(raw))
                at += sizes[-1]
            box, size = np.array(boxes).reshape(-1, 4), np.array(sizes)
            low, high = (box[:, :2].min(0), box[:, 2:].max(0)) if len(box) else (np.zeros(2), np.zeros(2))
            with np.errstate(invalid="ignore", divide="ignore"):
                grid = np.nan_to_num(((box[:, :2] + box[:, 2:]) / 2 - low) / (high - low) * 65535, nan=0.0, posinf=0, neginf=0)
            order = np.argsort(hilbert(grid[:, 0], grid[:, 1]), kind="stable") if len(box) else np.zeros(0, np.int64)
            header = {
                NAME: b"features", KIND: ("B", 0), COUNT: ("Q", len(box)), FAN: ("H", 16 if len(box) else 0),
                COLUMNS: [{0: c.encode(), 1: ("B", k)} for c, k in self.columns], CRS: {0: b"EPSG", 1: ("i", self.srs), 4: self.definition.encode()},
            }
            if len(box) and np.isfinite([*low, *high]).all():
                header[ENVELOPE] = np.array([*low, *high], "<f8")
            head = table_bytes(header)
            with open(f"{self.folder}/.{part}", "wb") as file:
                file.write(MAGIC + struct.pack("<I", len(head)) + head)
                if len(box):
                    file.write(packed_tree(box[order], np.cumsum(size[order]) - size[order]).tobytes())
                for k in order.tolist():
                    waiting.seek(places[k])
                    file.write(waiting.read(sizes[k]))
        return part

    def commit(self, messages: list[Written | None]) -> None:
        for part in (p for m in messages if m for p in m.parts):
            os.rename(f"{self.folder}/.{part}", f"{self.folder}/{part}")

    def abort(self, messages: list[Written | None]) -> None:
        for part in (p for m in messages if m for p in m.parts):
            if os.path.exists(f"{self.folder}/.{part}"):
                os.remove(f"{self.folder}/.{part}")


class FlatGeobuf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fgb"

    def schema(self) -> str:
        with open(_files(self.options["path"])[0], "rb") as file:
            columns = Head.of(file).columns
        return ", ".join(["fid bigint", *(f"`{c}` {TYPES[k][1]}" for c, k in columns), TAIL])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rows", 50_000)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        srs = int(self.options.get("srs", 2056))
        return Writer(self.options["path"], schema, srs, self.options.get("definition", f'PROJCS["EPSG:{srs}"]'), int(self.options.get("each", EACH)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FlatGeobuf)
