"""Planes and ellipses through the points of each key, from moments: no task holds a key's points.

Moments are built-in aggregates that combine before the shuffle; what they give is solved in closed form, and what is asked
of single points, as their distance from the plane, is a second pass over the points joined to one row per key: a merge
join, for keys are as many as objects, and a broadcast chosen by the size of a file would bring them all to the driver.
Defined results: points with a null key or coordinate take no part in a fit; keys of under three points, or whose points lie
on one line or in one place, are not flat and have no normal; their fitted height is that of the plane that slopes least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolake.functions.fitting import ellipse_of_moments

AXES = "xyz"


def _sound(points: DataFrame, key: str, axes: str = AXES) -> DataFrame:
    return points.dropna(subset=[key, *axes])


def moments(points: DataFrame, key: str) -> DataFrame:
    """key, n, means mx, my, mz and central second moments sxx .. szz of each key."""
    second = [(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(f"s{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    return _sound(points, key).groupBy(key).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES], *second)


def normals(found: DataFrame) -> DataFrame:
    """Adds nx, ny, nz to moments: the direction of least spread, by the closed form of a symmetric matrix's eigenvalues."""
    xx, xy, xz, yy, yz, zz = (F.col(f"s{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
    rows = found.withColumn("mean", (xx + yy + zz) / 3)
    a, b, c = (d - F.col("mean") for d in (xx, yy, zz))
    rows = rows.withColumn("size", F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * F.pow("size", F.lit(3.0)))))) / 3
    rows = rows.withColumn("turn", F.when(F.col("size") > 0, turn).otherwise(0.0))
    rows = rows.withColumns({"most": F.col("mean") + 2 * F.col("size") * F.cos("turn"), "least": F.col("mean") + 2 * F.col("size") * F.cos(F.col("turn") + 2 * math.pi / 3)})
    rows = rows.withColumn("middle", 3 * F.col("mean") - F.col("most") - F.col("least"))
    low = F.col("least")
    r0, r1, r2 = (xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    # Of the three products of rows the longest is the most exact.
    choices = [F.struct(length(v).alias("long"), *[x.alias(f"n{c}") for x, c in zip(v, AXES, strict=True)]) for v in (cross(r0, r1), cross(r0, r2), cross(r1, r2))]
    rows = rows.withColumn("best", F.greatest(*choices))
    flat = (F.col("n") >= 3) & (F.col("middle") > 1e-12 * F.col("most")) & (F.col("best.long") > 0)
    unit = {f"n{c}": F.when(flat, F.col(f"best.n{c}") / F.col("best.long")) for c in AXES}
    return rows.withColumns(unit).drop("mean", "size", "turn", "most", "middle", "least", "best")


def flatness(points: DataFrame, key: str, epsilon: float = 0.15) -> DataFrame:
    """key, n, flat, spread: how far apart points lie across their plane, and whether that is below ``epsilon``."""
    planes = normals(moments(points, key)).select(key, "n", *[f"{m}{c}" for m in "mn" for c in AXES])
    across = sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"n{c}") for c in "yz"), (F.col("x") - F.col("mx")) * F.col("nx"))
    rows = _sound(points, key).select(key, *AXES).join(planes.hint("merge"), key).select(key, "n", across.alias("d"))
    spread = (F.max("d") - F.min("d")).alias("spread")
    return rows.groupBy(key).agg(F.first("n").alias("n"), spread).select(key, "n", F.coalesce(F.col("spread") < epsilon, F.lit(False)).alias("flat"), "spread")


def _slopes(n: str, s: str) -> tuple[Column, Column, Column]:
    """a, b, c of z = ax + by + c from the moments named n, s; the least slopes where points lie on a line."""
    col = lambda name: F.col(f"{s}{name}")
    det = col("xx") * col("yy") - col("xy") * col("xy")
    spread = col("xx") + col("yy")
    line = det <= 1e-12 * spread * spread
    share = lambda top: F.when(spread > 0, top / spread).otherwise(0.0)
    a = F.when(line, share(col("xz"))).otherwise((col("xz") * col("yy") - col("yz") * col("xy")) / det)
    b = F.when(line, share(col("yz"))).otherwise((col("yz") * col("xx") - col("xz") * col("xy")) / det)
    return a, b, F.col(f"{n}z") - a * F.col(f"{n}x") - b * F.col(f"{n}y")


def levelled(points: DataFrame, key: str, sigmas: float = 2.0) -> DataFrame:
    """Points with ``outlier`` (a height beyond ``sigmas`` deviations) and ``level``, their height on the plane fitted to the others.

    Where under three points are left, all of them count.
    """
    sound = _sound(points, key)
    z = sound.groupBy(key).agg(F.avg("z").alias("zm"), F.stddev_pop("z").alias("zs"))
    marked = sound.join(z.hint("merge"), key).withColumn("outlier", F.abs(F.col("z") - F.col("zm")) > sigmas * F.col("zs")).drop("zm", "zs")
    own = lambda c, kept: F.when(~F.col("outlier"), F.col(c)) if kept else F.col(c)
    aggregates = []
    for p, kept in (("k", True), ("e", False)):
        aggregates += [F.avg(own(c, kept)).alias(f"{p}m{c}") for c in AXES]
        aggregates += [(F.var_pop(own(a, kept)) if a == b else F.covar_pop(own(a, kept), own(b, kept))).alias(f"{p}s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz")]
    found = marked.groupBy(key).agg(F.count_if(~F.col("outlier")).alias("left"), *aggregates)
    few = F.col("left") < 3
    slopes = {c: F.when(few, e).otherwise(k) for c, k, e in zip("abc", _slopes("km", "ks"), _slopes("em", "es"), strict=True)}
    planes = found.select(F.col(key), *[v.alias(f"plane_{c}") for c, v in slopes.items()])
    rows = marked.join(planes.hint("merge"), key)
    level = F.col("plane_a") * F.col("x") + F.col("plane_b") * F.col("y") + F.col("plane_c")
    return rows.withColumn("level", level).drop("plane_a", "plane_b", "plane_c")


POWERS = [(i, j) for i in range(5) for j in range(5) if i + j <= 4]


def ellipses(points: DataFrame, key: str) -> DataFrame:
    """key, cx, cy, a, b, angle of the direct least-squares ellipse of each key of five points and more; null where none fits."""
    sound = _sound(points, key, "xy")
    frame = sound.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("size"))
    frame = frame.where("n >= 5 and size > 0")
    u, v = ((F.col(c) - F.col(f"m{c}")) / F.col("size") for c in "xy")
    power = lambda c, k: F.lit(1.0) if k == 0 else c if k == 1 else c * power(c, k - 1)
    sums = [F.sum(power(u, i) * power(v, j)).alias(f"p{i}{j}") for i, j in POWERS]
    rows = sound.join(frame.hint("merge"), key).groupBy(key, "mx", "my", "size").agg(*sums)
    kind = rows.schema[key].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = {(i, j): batch.column(f"p{i}{j}").to_numpy() for i, j in POWERS}
            mean, size = np.stack([batch.column("mx").to_numpy(), batch.column("my").to_numpy()], 1), batch.column("size").to_numpy()
            found = [ellipse_of_moments({k: float(v[r]) for k, v in p.items()}, mean[r], float(size[r])) or (None,) * 5 for r in range(batch.num_rows)]
            columns = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.float64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "cx", "cy", "a", "b", "angle"])

    return rows.mapInArrow(solve, f"{key} {kind}, cx double, cy double, a double, b double, angle double")


def outline(cx: Column, cy: Column, a: Column, b: Column, angle: Column, points: int = 65) -> Column:
    """So many points along an ellipse as a flat list of coordinates, the first at the end of its axis ``a``."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (2 * math.pi / points))
    return F.flatten(F.transform(at, lambda t: F.array(cx + a * F.cos(t) * F.cos(angle) - b * F.sin(t) * F.sin(angle), cy + a * F.cos(t) * F.sin(angle) + b * F.sin(t) * F.cos(angle))))
