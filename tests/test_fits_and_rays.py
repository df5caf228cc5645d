"""Planes and ellipses from moments, and rays through masks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panolake.functions import camera
from panolake.operators import fits, rays

POINT = "key string, x double, y double, z double"


def cloud(rng, normal, n, noise):
    basis = np.linalg.svd(np.array([normal]))[2][1:]
    return np.array([2.6e6, 1.2e6, 500.0]) + rng.normal(size=(n, 2)) @ basis * 3 + rng.normal(size=(n, 3)) * noise


def test_flatness_of_clouds_lines_and_few_points(spark):
    rng = np.random.default_rng(1)
    clouds = {f"c{i}": cloud(rng, rng.normal(size=3), int(rng.integers(3, 60)), noise) for i, noise in enumerate([0.0, 0.01, 0.02, 0.05, 0.3, 1.0] * 5)}
    rows = [(k, *map(float, p)) for k, c in clouds.items() for p in c]
    rows += [("line", float(i), 2.0 * i, 3.0 * i) for i in range(9)] + [("two", 0.0, 0.0, 0.0), ("two", 1.0, 0.0, 0.0)] + [("same", 1.0, 2.0, 3.0)] * 5
    rows += [(None, 0.0, 0.0, 0.0), ("c0", None, 0.0, 0.0), ("c0", 0.0, 0.0, None)]
    got = {r["key"]: r for r in fits.flatness(spark.createDataFrame(rows, POINT).withColumn("nx", F.lit(1)), "key").collect()}
    for k, c in clouds.items():
        centred = c - c.mean(0)
        d = centred @ np.linalg.svd(centred, full_matrices=False)[2][-1]
        assert got[k]["spread"] == pytest.approx(np.ptp(d), abs=2e-4) and got[k]["flat"] == (np.ptp(d) < 0.15) and got[k]["n"] == len(c)
    assert all(not got[k]["flat"] and got[k]["spread"] is None for k in ("line", "two", "same"))
    assert set(got) == {*clouds, "line", "two", "same"}


def test_heights_on_the_plane_without_outliers(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for k in range(12):
        xy, n = rng.random((20, 2)) * 5, 20
        z = 3 + 0.2 * xy[:, 0] - 0.1 * xy[:, 1] + rng.normal(size=n) * 0.01
        z[: k % 3] += 8
        keep = np.abs(z - z.mean()) <= 2 * z.std()
        fit = np.linalg.lstsq(np.c_[xy[keep], np.ones(keep.sum())], z[keep], rcond=None)[0]
        for p, h, inside in zip(xy, z, keep):
            rows.append((str(k), float(p[0]), float(p[1]), float(h)))
            expected[rows[-1]] = (not inside, float(fit @ [*p, 1]))
    rows += [("up", 0.0, 0.0, 1.0), ("up", 0.0, 0.0, 3.0), ("slope", 0.0, 0.0, 0.0), ("slope", 1.0, 0.0, 2.0), ("slope", 2.0, 0.0, 4.0)]
    got = {(r["key"], r["x"], r["y"], r["z"]): (r["outlier"], r["level"]) for r in fits.levelled(spark.createDataFrame(rows, POINT), "key").collect()}
    for k, (outlier, level) in expected.items():
        assert got[k][0] == outlier and got[k][1] == pytest.approx(level, abs=1e-9)
    assert got["up", 0.0, 0.0, 1.0][1] == 2 and [got["slope", x, 0.0, 2 * x][1] for x in (0.0, 1.0, 2.0)] == pytest.approx([0, 2, 4])


def test_ellipses_from_moments(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for k in range(20):
        cx, cy, a, b, turn = 2.6e6 + rng.random() * 100, 1.2e6, 5 + rng.random() * 5, 1 + rng.random() * 3, rng.random() * np.pi
        t = rng.random(30) * 2 * np.pi
        rows += [(str(k), float(cx + a * np.cos(s) * np.cos(turn) - b * np.sin(s) * np.sin(turn)), float(cy + a * np.cos(s) * np.sin(turn) + b * np.sin(s) * np.cos(turn)), 0.0) for s in t]
        expected[str(k)] = (cx, cy, a, b)
    rows += [("few", float(i), i * i / 2, 0.0) for i in range(4)] + [("dot", 1.0, 1.0, 0.0)] * 9 + [("line", float(i), float(i), 0.0) for i in range(9)]
    got = {r["key"]: r for r in fits.ellipses(spark.createDataFrame(rows, POINT), "key").collect()}
    for k, (cx, cy, a, b) in expected.items():
        r = got[k]
        assert (r["cx"], r["cy"]) == pytest.approx((cx, cy), abs=1e-3) and sorted((r["a"], r["b"])) == pytest.approx(sorted((a, b)), abs=1e-3)
    assert "few" not in got and "dot" not in got and ("line" not in got or got["line"]["cx"] is None)


def ellipse(cx, cy, a, b, n=40):
    t = np.arange(n) * 2 * np.pi / n
    return [np.stack([cx + a * np.cos(t), cy + b * np.sin(t)], 1).reshape(-1).tolist()]


def test_rays_of_masks(spark):
    masks = [(1, ellipse(5000, 2300, 40, 20)), (2, [[10.0, 10.0, 30.0, 10.0, 30.0, 30.0]]), (3, None), (4, [[1.0, 1.0, 2.0, 2.0, 3.0, 3.0]]), (5, ellipse(100, 100, 9, 9) + ellipse(900, 900, 5, 5))]
    frame = spark.createDataFrame(masks, "id int, segmentation array<array<double>>").repartition(2).withColumns({"u": F.lit("own"), "x": F.lit(1.0)})
    zero = (F.lit(0.0),) * 3
    project = rays.spherical((F.col("x"), F.lit(2.0), F.lit(3.0)), zero, 8000, 4000)
    got = {r["id"]: r for r in rays.rays_of_masks(frame, project).collect()}
    assert set(got) == {1, 2, 5} and {r["u"] for r in got.values()} == {"own"}
    for k, (u, v) in {1: (5000, 2300), 2: (70 / 3, 50 / 3), 5: (100, 100)}.items():
        _, way = camera.spherical_ray(F.lit(float(u)), F.lit(float(v)), (F.lit(1.0), F.lit(2.0), F.lit(3.0)), zero, 8000, 4000)
        expected = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(way)]).first()
        assert [got[k][f"d{c}"] for c in "xyz"] == pytest.approx(list(expected), abs=1e-6)
        assert [got[k][f"o{c}"] for c in "xyz"] == [1.0, 2.0, 3.0]
    assert {r["id"] for r in rays.rays_of_masks(frame, project, 0.85).collect()} == {1}
    # Any function of columns is a projection.
    straight = rays.rays_of_masks(frame, lambda u, v: ((u, v, F.lit(9.0)), (F.lit(0.0), F.lit(0.0), F.lit(-2.0))))
    assert {r["id"]: (round(r["ox"], 3), r["dz"]) for r in straight.collect()}[1] == (5000.0, -1.0)
