"""From masks to rays: the centre of a mask's ellipse, seen through any projection.

A projection is a function of columns: it takes those of the pixel and gives origin and direction, or one struct of both that is
worked out once, so that another camera needs another function and nothing else. ``spherical`` and ``cubemap`` are the two in use.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from panolake.functions import camera, overlay
from panolake.functions.fitting import ellipses_of_moments
from panolake.functions.geometry import centroid, ring
from panolake.operators import ranges
from panolake.operators.fits import POWERS

Vector = tuple[Column, Column, Column]
Projection = Callable[[Column, Column], tuple[Vector, Vector] | Column]

ELLIPSE = StructType([StructField(c, DoubleType()) for c in ("cx", "cy", "a", "b", "angle")])
#: Points of the outline that a mask's ellipse is compared by.
POINTS = 99
#: Shares so near to the least one, and masks of so short half axes, are left to the overlay, which cuts coordinates to its grid.
NEAR, SHORT = 1e-4, 0.25


def _first(r: overlay.Rings, rows: int) -> tuple[overlay.Rings, np.ndarray]:
    """The first ring of each row, and which of them are alone."""
    first = np.concatenate([[True], r.row[1:] != r.row[:-1]]) if len(r.row) else np.zeros(0, bool)
    return overlay._some(r, first), np.bincount(r.row, minlength=rows)[r.row[first]] == 1


def _fitted(r: overlay.Rings) -> np.ndarray:
    """cx, cy, a, b, angle of the direct least-squares ellipse through each ring, its closing point counted again."""
    starts, rings = np.cumsum(r.size) - r.size, np.arange(len(r.size))
    x, y, row = (np.concatenate([c, d]) for c, d in ((r.x, r.x[starts]), (r.y, r.y[starts]), (np.repeat(rings, r.size), rings)))
    n = np.bincount(row, minlength=len(rings))
    mx, my = (np.bincount(row, c, len(rings)) / np.maximum(n, 1) for c in (x, y))
    wide = np.zeros(len(rings))
    np.maximum.at(wide, row, np.maximum(np.abs(x - mx[row]), np.abs(y - my[row])))
    wide[wide == 0] = 1.0
    u, v = (x - mx[row]) / wide[row], (y - my[row]) / wide[row]
    powers = [[np.ones(len(c)), c, c * c, c * c * c, c * c * c * c] for c in (u, v)]
    found = ellipses_of_moments({(i, j): np.bincount(row, powers[0][i] * powers[1][j], len(rings)) for i, j in POWERS}, np.stack([mx, my], 1), wide)
    found[n < 5] = np.nan
    return found


def _structs(found: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    out = np.full((rows, 5), np.nan)
    out[row] = found
    none = np.isnan(out).any(axis=1)
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], fields=[pa.field(f.name, pa.float64()) for f in ELLIPSE], mask=pa.array(none))


@arrow_udf(ELLIPSE)
def mask_ellipse(segmentations: pa.Array) -> pa.Array:
    """The direct least-squares ellipse through the first ring of a mask, its closing point counted again; null where none fits."""
    r, _ = _first(overlay.rings_of(segmentations), len(segmentations))
    return _structs(_fitted(r), r.row, len(segmentations))


@arrow_udf(ELLIPSE)
@overlay._in_slices
def shared_ellipse(segmentations: pa.Array, least: pa.Array) -> pa.Array:
    """``mask_ellipse`` where a mask and its ellipse share at least ``least`` (intersection over union), null elsewhere.

    Bounds settle most masks (``_bounds``), the overlay those that they leave open.
    """
    every = overlay.rings_of(segmentations)
    r, alone = _first(every, len(segmentations))
    found, least = _fitted(r), least.to_numpy(zero_copy_only=False)[r.row]
    fits = ~np.isnan(found).any(axis=1)
    low, high = _bounds(r, found)
    sure = alone & fits & (found[:, 2:4].min(axis=1) >= SHORT) if len(found) else fits
    kept = sure & (low >= least + NEAR)
    open_ = np.flatnonzero(fits & ~kept & ~(sure & (high < least - NEAR)))
    if len(open_):
        at = np.arange(POINTS) * (2 * math.pi / POINTS)
        cx, cy, a, b, angle = (c[:, None] for c in found[open_].T)
        x, y = cx + a * np.cos(at) * np.cos(angle) - b * np.sin(at) * np.sin(angle), cy + a * np.cos(at) * np.sin(angle) + b * np.sin(at) * np.cos(angle)
        outlines = overlay.Rings(np.arange(len(open_)), np.full(len(open_), POINTS), x.reshape(-1), y.reshape(-1))
        masks = overlay.rings_of(segmentations.take(pa.array(r.row[open_])))
        kept[open_] = overlay.shares(outlines, masks, len(open_)) >= least[open_]
    return _structs(np.where(kept[:, None], found, np.nan), r.row, len(segmentations))


def _bounds(r: overlay.Rings, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what the intersection over union of each ring and its ellipse's outline lies; 0 and 1 for a ring that does not go around the centre once, ever onward.

    Where the ellipse is the unit circle, the ring holds the circle that its sides stay out of and lies in that of its farthest
    vertex, and so does the outline; the lesser area over the greater is the most.
    """
    if not len(r.size):
        return np.zeros(0), np.ones(0)
    ring, after, starts = np.repeat(np.arange(len(r.size)), r.size), overlay._after(r), np.cumsum(r.size) - r.size
    cx, cy, a, b, angle = found.T
    c, s = np.cos(angle)[ring], np.sin(angle)[ring]
    dx, dy = r.x - cx[ring], r.y - cy[ring]
    with np.errstate(all="ignore"):
        p, q = (dx * c + dy * s) / a[ring], (dy * c - dx * s) / b[ring]
        px, qx = p[after], q[after]
        cross = p * qx - px * q
        area = np.add.reduceat(cross, starts) / 2
        way = np.sign(area)
        onward = np.minimum.reduceat(cross * way[ring], starts) > 0
        once = np.add.reduceat((q < 0) & (qx >= 0), starts) == 1
        ux, uy = px - p, qx - q
        t = np.clip(-(p * ux + q * uy) / (ux * ux + uy * uy), 0.0, 1.0)
        inner = np.sqrt(np.minimum.reduceat((p + t * ux) ** 2 + (q + t * uy) ** 2, starts))
        outer = np.sqrt(np.maximum.reduceat(p * p + q * q, starts))
        own = POINTS / 2 * math.sin(2 * math.pi / POINTS)
        low = (np.minimum(inner, math.cos(math.pi / POINTS)) / np.maximum(outer, 1.0)) ** 2
        high = np.minimum(area * way, own) / np.maximum(area * way, own)
    plain = onward & once & np.isfinite(low) & np.isfinite(high)
    return np.where(plain, low, 0.0), np.where(plain, high, 1.0)


def spherical(pose: Vector, turned: Vector, width: int, height: int) -> Projection:
    """Panoramas: camera at ``pose``, yaw, pitch and roll in degrees."""
    return lambda u, v: camera.spherical_ray(u, v, pose, turned, width, height)


def cubemap(pose: Vector, opk: Vector, face: Column, size: int) -> Projection:
    """Faces of a cube map of one rig, seen by the sensor that the pixel belongs to."""

    return lambda u, v: camera._let(camera.cubemap_ray(u, v, face, pose, opk, size), lambda r: F.when(r["sensor"] >= 0, r))


def rays_of_masks(masks: DataFrame, project: Projection, least_iou: float | None = None, deal: bool = True) -> DataFrame:
    """The columns of ``masks`` with ox, oy, oz and the unit direction dx, dy, dz of each mask's centre.

    The centre is that of the fitted ellipse. With ``least_iou`` masks without a fit, or that share less with their ellipse
    (intersection over union), go; without it the centroid stands in where no ellipse fits. Masks without a centre, and those that no sensor sees, go.
    Masks are dealt to all tasks; ``deal`` is off where they already are, as long rows are dear to move.
    """
    e = lambda c: F.col(f"ellipse.{c}")
    ellipse = mask_ellipse("segmentation") if least_iou is None else shared_ellipse("segmentation", F.lit(float(least_iou)))
    rows = ranges.settled((ranges.spread(masks) if deal else masks).withColumn("ellipse", ellipse), {"ellipse": F.col("ellipse")})
    if least_iou is not None:
        rows = rows.where("ellipse is not null")
    else:
        rows = ranges.settled(rows, {"middle": centroid(ring(F.get("segmentation", 0)))})
    u, v = (e("cx"), e("cy")) if least_iou is not None else (F.coalesce(e("cx"), F.col("middle.x")), F.coalesce(e("cy"), F.col("middle.y")))
    rows = ranges.settled(rows, {"pixel_u": u, "pixel_v": v}).where("pixel_u is not null and pixel_v is not null")
    seen = project(F.col("pixel_u"), F.col("pixel_v"))
    if isinstance(seen, Column):
        rows = ranges.settled(rows, {"seen": seen})
        seen = tuple(tuple(F.col(f"seen.{side}.{c}") for c in "xyz") for side in ("origin", "direction"))
    origin, way = seen
    rows = ranges.settled(rows, {f"{p}{c}": x for p, vector in (("o", origin), ("d", way)) for c, x in zip("xyz", vector, strict=True)})
    rows = rows.withColumn("long", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return rows.withColumns({f"d{c}": F.col(f"d{c}") / F.col("long") for c in "xyz"}).where("long > 0").drop("ellipse", "middle", "pixel_u", "pixel_v", "seen", "long")
