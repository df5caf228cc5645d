"""Fits and general polygon work as Arrow functions over numpy: ellipses, planes, intersections, unions' areas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<struct<x:double,y:double>>"


def ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre, half axes and angle by direct least squares under the ellipse constraint; None if it fails."""
    if len(points) < 5:
        return None
    mean = points.mean(0)
    size = float(np.abs(points - mean).max()) or 1.0
    x, y = ((points - mean) / size).T
    return ellipse_of_moments({(i, j): float((x**i * y**j).sum()) for i in range(5) for j in range(5) if i + j <= 4}, mean, size)


def ellipse_of_moments(sums: dict[tuple[int, int], float], mean: np.ndarray, size: float) -> tuple[float, float, float, float, float] | None:
    """The same from the sums of x^i y^j (up to the fourth degree) of points moved by ``mean`` and divided by ``size``."""
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
    scatter = np.array([[sums[a + c, b + d] for c, d in terms] for a, b in terms])
    try:
        to_linear = -np.linalg.solve(scatter[3:, 3:], scatter[3:, :3])
        reduced = scatter[:3, :3] + scatter[:3, 3:] @ to_linear
        values, vectors = np.linalg.eig(np.array([reduced[2] / 2, -reduced[1], reduced[0] / 2]))
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors)
    fits = 4 * vectors[0] * vectors[2] - vectors[1] ** 2
    if not (fits > 0).any():
        return None
    a, b, c = vectors[:, int(np.argmax(fits))]
    d, e, f = to_linear @ np.array([a, b, c])
    below = b * b - 4 * a * c
    cx, cy = (2 * c * d - b * e) / below, (2 * a * e - b * d) / below
    rest = a * cx * cx + b * cx * cy + c * cy * cy - f
    with np.errstate(divide="ignore", invalid="ignore"):
        shape = np.array([[a, b / 2], [b / 2, c]]) / rest
    if not np.isfinite(shape).all():
        return None
    spread, turn = np.linalg.eigh(shape)
    if (spread <= 0).any():
        return None
    half = 1 / np.sqrt(spread) * size
    return float(cx * size + mean[0]), float(cy * size + mean[1]), float(half[0]), float(half[1]), float(np.arctan2(turn[1, 0], turn[0, 0]))


def _each(f, width: int, *stacks: np.ndarray) -> np.ndarray:
    """``f`` of stacks of matrices; not a number for those that it fails on."""
    try:
        return f(*stacks)
    except np.linalg.LinAlgError:
        if len(stacks[0]) == 1:
            return np.full((1, 3, width), np.nan)
        half = len(stacks[0]) // 2
        return np.concatenate([_each(f, width, *(s[part] for s in stacks)) for part in (slice(half), slice(half, None))])


def ellipses_of_moments(sums: dict[tuple[int, int], np.ndarray], mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``ellipse_of_moments`` of many at once, a row each; not a number where none fits."""
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
    scatter = np.stack([np.stack([sums[a + c, b + d] for c, d in terms], -1) for a, b in terms], -2)
    out = np.full((len(size), 5), np.nan)
    rows = np.flatnonzero(np.isfinite(scatter).all(axis=(1, 2)))
    scatter = scatter[rows]
    with np.errstate(all="ignore"):
        to_linear = -_each(np.linalg.solve, 3, scatter[:, 3:, 3:], scatter[:, 3:, :3])
        reduced = scatter[:, :3, :3] + scatter[:, :3, 3:] @ to_linear
        solved = np.isfinite(reduced).all(axis=(1, 2))
        rows, to_linear, reduced = rows[solved], to_linear[solved], reduced[solved]
        vectors = np.real(_each(lambda m: np.linalg.eig(m)[1], 3, np.stack([reduced[:, 2] / 2, -reduced[:, 1], reduced[:, 0] / 2], 1)))
        fits = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2
        some = (fits > 0).any(axis=1)
        rows, to_linear, vectors, fits = rows[some], to_linear[some], vectors[some], fits[some]
        best = np.take_along_axis(vectors, np.argmax(fits, axis=1)[:, None, None], 2)[:, :, 0]
        (a, b, c), (d, e, f) = best.T, (to_linear @ best[:, :, None])[:, :, 0].T
        below = b * b - 4 * a * c
        cx, cy = (2 * c * d - b * e) / below, (2 * a * e - b * d) / below
        rest = a * cx * cx + b * cx * cy + c * cy * cy - f
        shape = np.stack([np.stack([a, b / 2], 1), np.stack([b / 2, c], 1)], 1) / rest[:, None, None]
        sound = np.isfinite(shape).all(axis=(1, 2))
        rows, cx, cy, (spread, turn) = rows[sound], cx[sound], cy[sound], np.linalg.eigh(shape[sound])
        round_ = (spread > 0).all(axis=1)
        rows, cx, cy, spread, turn = rows[round_], cx[round_], cy[round_], spread[round_], turn[round_]
        half = 1 / np.sqrt(spread) * size[rows, None]
        out[rows] = np.stack([cx * size[rows] + mean[rows, 0], cy * size[rows] + mean[rows, 1], half[:, 0], half[:, 1], np.arctan2(turn[:, 1, 0], turn[:, 0, 0])], 1)
    return out


def plane(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit normal through the centroid, and the largest distance of a point from the plane."""
    centred = points - points.mean(0)
    normal = np.linalg.svd(centred, full_matrices=False)[2][-1]
    return normal, float(np.abs(centred @ normal).max())


def without_outliers(z: np.ndarray, sigmas: float = 2.0) -> np.ndarray:
    return np.abs(z - z.mean()) <= sigmas * z.std()


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one, edge by edge."""
    def cross(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    if shoelace(window) < 0:
        window = window[::-1]
    out = [tuple(p) for p in subject]
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1], strict=True):
            sp, sq = cross(a, b, p), cross(a, b, q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return np.array(out).reshape(-1, 2)


def shoelace(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def slab_areas(rings: list[np.ndarray]) -> tuple[float, float]:
    """Areas of the union and of the common part of simple polygons: exact sums over slabs between all
    vertices and crossings, in which every edge is a straight border."""
    edges = [np.concatenate([r, np.roll(r, -1, 0)], 1) for r in rings]
    every = np.concatenate(edges)
    cuts = set(every[:, 0])
    for i, (x1, y1, x2, y2) in enumerate(every):
        for x3, y3, x4, y4 in every[i + 1 :]:
            below = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
            if below:
                t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / below
                u = ((x1 - x3) * (y1 - y2) - (y1 - y3) * (x1 - x2)) / below
                if 0 <= t <= 1 and 0 <= u <= 1:
                    cuts.add(x1 + t * (x2 - x1))
    xs = sorted(cuts)
    union = common = 0.0
    for a, b in zip(xs[:-1], xs[1:], strict=True):
        middle, marks = (a + b) / 2, []
        for ring in edges:
            ys = sorted(y1 + (middle - x1) * (y2 - y1) / (x2 - x1) for x1, y1, x2, y2 in ring if min(x1, x2) < middle < max(x1, x2))
            marks += [(y, 1 if k % 2 == 0 else -1) for k, y in enumerate(ys)]
        depth, last = 0, 0.0
        for y, step in sorted(marks):
            if depth:
                union += (y - last) * (b - a)
            if depth == len(edges):
                common += (y - last) * (b - a)
            depth, last = depth + step, y
    return union, common


def _array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "a", "b", "angle")]))
def fit_ellipse(rings: pd.Series) -> pd.DataFrame:
    found = [ellipse(_array(r)) or (None,) * 5 for r in rings]
    return pd.DataFrame(found, columns=["cx", "cy", "a", "b", "angle"], dtype=float)


@F.pandas_udf(T.DoubleType())
def polygon_iou(left: pd.Series, right: pd.Series) -> pd.Series:
    """Intersection over union of two simple polygons; 0 for an empty union."""
    def one(p, q):
        union, common = slab_areas([_array(p), _array(q)])
        return common / union if union else 0.0

    return pd.Series([one(p, q) for p, q in zip(left, right, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def union_area(groups: pd.Series) -> pd.Series:
    """Area that a list of simple polygons covers."""
    return pd.Series([slab_areas([_array(r) for r in rings])[0] if len(rings) else 0.0 for rings in groups], dtype=float)


@F.pandas_udf(T.BooleanType())
def is_flat(points: pd.Series) -> pd.Series:
    """Points (x, y, z) that lie within 0.15 of their plane."""
    return pd.Series([len(p) >= 3 and plane(np.array([(q["x"], q["y"], q["z"]) for q in p]))[1] < 0.15 for p in points])
