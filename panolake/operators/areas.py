"""Areas of interest as polygons with holes: points and outlines in them, by cells of a grid.

An area gives a row for each cell that it touches. Cells that lie inside pass everything; the others carry the area's
sides that touch them, and whether one point of the cell lies inside: a point of the cell does so too if the way
between the two crosses an even number of sides. So no test looks at more than what an area does in one cell, and areas
are joined by equality of cells. Edges belong to an area; rings follow the even-odd rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolake.functions.geometry import inside, ring, segmentation_box
from panolake.functions.overlay import Rings, _spread, rings_of
from panolake.operators.ranges import keeper, settled, spread
from panolake.operators.spatial import box_pairs

#: Where in a cell its test point lies; no round number, so that no side ends level with it.
WITHIN = (0.41421356237, 0.73205080757)
_CELLS = pa.schema([("cx", pa.int64()), ("cy", pa.int64()), ("whole", pa.bool_()), ("odd", pa.bool_()), ("sides", pa.list_(pa.float64()))])


def area_cells(areas: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, whole, odd, sides) of every cell that an area (``segmentation``) touches."""

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for sides in _sides_of(rings_of(batch.column("segmentation"))):
                waiting += _cells_of(*sides, cell)
                if sum(b.num_rows for b in waiting) >= 5000 or len(waiting) >= 500:
                    yield pa.concat_batches(waiting)
                    waiting = []
        if waiting:
            yield pa.concat_batches(waiting)

    rows = areas.select(F.col("segmentation").cast("array<array<double>>").alias("segmentation"))
    return spread(rows).mapInArrow(decompose, "cx long, cy long, whole boolean, odd boolean, sides array<double>")


def _sides_of(rings: Rings) -> Iterator[tuple[np.ndarray, ...]]:
    """The sides (x1, y1, x2, y2) of each row; rings come row by row, so each row's lie together."""
    if not len(rings.row):
        return
    ends = np.cumsum(rings.size)
    after = np.arange(1, len(rings.x) + 1)
    after[ends - 1] = ends - rings.size
    every = rings.x, rings.y, rings.x[after], rings.y[after]
    last = np.flatnonzero(np.append(rings.row[1:] != rings.row[:-1], True))
    for low, high in pairwise([0, *ends[last].tolist()]):
        yield tuple(c[low:high] for c in every)


def _cells_of(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, cell: float, at_once: int = 5000) -> Iterator[pa.RecordBatch]:
    low, high = np.floor(np.minimum(y1, y2) / cell).astype(np.int64), np.floor(np.maximum(y1, y2) / cell).astype(np.int64)
    # A side on the border of two rows or columns touches both.
    low -= np.minimum(y1, y2) == low * cell
    side, cy = np.repeat(np.arange(len(x1)), high - low + 1), _spread(low, high - low + 1)
    dx, dy = x2 - x1, y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        t1, t2 = ((cy * cell - y1[side]) / dy[side], ((cy + 1) * cell - y1[side]) / dy[side])
    level = dy[side] == 0
    t1, t2 = np.where(level, 0, np.clip(np.minimum(t1, t2), 0, 1)), np.where(level, 1, np.clip(np.maximum(t1, t2), 0, 1))
    a, b = x1[side] + t1 * dx[side], x1[side] + t2 * dx[side]
    left, right = np.floor(np.minimum(a, b) / cell - 1e-9).astype(np.int64), np.floor(np.maximum(a, b) / cell + 1e-9).astype(np.int64)
    counts = right - left + 1
    side, cy, cx = np.repeat(side, counts), np.repeat(cy, counts), _spread(left, counts)
    order = np.lexsort((cx, cy))
    side, cy, cx = side[order], cy[order], cx[order]
    first = np.flatnonzero(np.concatenate([[True], (cy[1:] != cy[:-1]) | (cx[1:] != cx[:-1])])) if len(side) else np.zeros(0, int)
    last = np.concatenate([first[1:], [len(side)]])
    out: dict[str, list] = {c: [] for c in _CELLS.names}

    def add(cx: int, cy: int, whole: bool, odd: bool, sides: list[float]) -> None:
        for c, v in zip(out, (cx, cy, whole, odd, sides), strict=True):
            out[c].append(v)

    at = 0
    for line in np.unique(cy).tolist():
        level = (line + WITHIN[1]) * cell
        crossed = (y1 > level) != (y2 > level)
        xs = np.sort(x1[crossed] + (level - y1[crossed]) * (dx[crossed] / dy[crossed]))
        touched = []
        while at < len(first) and cy[first[at]] == line:
            here = int(cx[first[at]])
            touched.append(here)
            s = side[first[at] : last[at]]
            odd = bool(np.searchsorted(xs, (here + WITHIN[0]) * cell) % 2)
            add(here, line, False, odd, np.stack([x1[s], y1[s], x2[s], y2[s]], axis=1).reshape(-1).tolist())
            at += 1
        between = np.setdiff1d(np.arange(touched[0], touched[-1] + 1), touched)
        odd = np.searchsorted(xs, (between + WITHIN[0]) * cell) % 2 == 1
        for here in between[odd].tolist():
            add(here, line, True, True, [])
        if len(out["cx"]) >= at_once:
            yield pa.RecordBatch.from_pydict(out, schema=_CELLS)
            out = {c: [] for c in _CELLS.names}
    if out["cx"]:
        yield pa.RecordBatch.from_pydict(out, schema=_CELLS)


def _sides(flat: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(flat) - 4, F.lit(4))
    return F.when(F.size(flat) > 0, F.transform(at, lambda i: F.struct(*[F.get(flat, i + k).alias(c) for k, c in enumerate(("ax", "ay", "bx", "by"))]))).otherwise(F.array())


def _turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _holds(x: Column, y: Column, cell: float) -> Column:
    """A point of a cell lies in the area that gave the cell's row."""
    qx, qy = (F.col("cx") + WITHIN[0]) * cell, (F.col("cy") + WITHIN[1]) * cell
    over = lambda s: ((_turn(x, y, qx, qy, s["ax"], s["ay"]) > 0) != (_turn(x, y, qx, qy, s["bx"], s["by"]) > 0)) & ((_turn(s["ax"], s["ay"], s["bx"], s["by"], x, y) > 0) != (_turn(s["ax"], s["ay"], s["bx"], s["by"], qx, qy) > 0))
    on = lambda s: (_turn(s["ax"], s["ay"], s["bx"], s["by"], x, y) == 0) & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
    sides = _sides(F.col("sides"))
    crossings = F.size(F.filter(sides, over)) % 2 == 1
    return F.col("whole") | F.exists(sides, on) | (crossings != F.col("odd"))


def points_in_areas(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Points (x, y, and more) that lie in one or more areas or on their edge; an equality join on the cell."""
    return _points_in_cells(points, area_cells(areas, cell), cell)


def _points_in_cells(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    dealt = points.withColumns({"px": F.floor(F.col("x") / cell), "py": F.floor(F.col("y") / cell)})
    held = (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & _holds(F.col("x"), F.col("y"), cell)
    return dealt.join(cells.hint("merge"), held, "left_semi").drop("px", "py")


def outlines_in_areas(rows: DataFrame, areas: DataFrame, cell: float, key: str) -> DataFrame:
    """Rows whose outline (``segmentation``) shares a point with an area: a vertex lies in one, a side meets one's side, or an area lies within."""
    cells = keeper(rows.sparkSession)(area_cells(areas, cell))
    ends = F.transform("segmentation", lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 2, F.lit(2)), lambda i: F.struct(F.get(r, i).alias("x"), F.get(r, i + 1).alias("y"), F.get(r, (i + 2) % F.size(r)).alias("ex"), F.get(r, (i + 3) % F.size(r)).alias("ey"))))
    rows = settled(spread(rows), {"segmentation": F.col("segmentation")})
    sides = rows.select(F.col(key).alias("key"), F.explode(F.flatten(ends)).alias("s")).select("key", "s.*")
    by_vertex = _points_in_cells(sides.select("key", "x", "y"), cells, cell).select("key")
    spans = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    dealt = sides.withColumn("px", spans("x", "ex")).withColumn("py", spans("y", "ey"))
    own = lambda s: (F.col("x"), F.col("y"), F.col("ex"), F.col("ey"), s["ax"], s["ay"], s["bx"], s["by"])
    crossed = F.exists(_sides(F.col("sides")), lambda s: _cross(*own(s)))
    by_side = dealt.join(cells.hint("merge"), (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & crossed, "left_semi").select("key")
    flat = F.explode("segmentation").alias("outer")
    first = areas.select(flat).select(F.get("outer", 0).cast("double").alias("x"), F.get("outer", 1).cast("double").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    boxes = rows.select(F.col(key).alias("key"), "segmentation", segmentation_box("segmentation").alias("b")).where("b is not null").select("key", "segmentation", "b.*")
    around = box_pairs(first, boxes, cell).where(F.exists("r_segmentation", lambda r: inside(F.col("l_x"), F.col("l_y"), ring(r)))).select(F.col("r_key").alias("key"))
    found = by_vertex.union(by_side).union(around).distinct()
    return rows.join(found, rows[key] == found["key"], "left_semi")


def _cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Two sides cross or touch."""
    one, two = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    three, four = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    within = (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    return within & (F.signum(one) * F.signum(two) <= 0) & (F.signum(three) * F.signum(four) <= 0)
