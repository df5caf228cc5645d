"""Points and outlines in polygonal areas against plain tests."""

import numpy as np
import pytest

from panolake.operators import areas


def star(rng, n, cx, cy, size):
    at = np.sort(rng.random(n)) * 2 * np.pi
    r = size * (0.2 + 0.8 * rng.random(n))
    return np.stack([cx + r * np.cos(at), cy + r * np.sin(at)], 1).reshape(-1).tolist()


def odd(x, y, seg):
    found = False
    for ring in seg:
        r = np.array(ring).reshape(-1, 2)
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, 0)):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                found = not found
    return found


@pytest.mark.parametrize("cell", [3.0, 20.0, 500.0])
def test_points_in_stars_with_holes(spark, cell):
    rng = np.random.default_rng(int(cell))
    shapes = [[star(rng, 30, *(rng.random(2) * 200 - 100), 60), star(rng, 9, *(rng.random(2) * 200 - 100), 30)] for _ in range(6)] + [[]]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((1500, 2)) * 300 - 150)]
    of = spark.createDataFrame([(s,) for s in shapes] + [(None,)], "segmentation array<array<double>>")
    found = areas.points_in_areas(spark.createDataFrame(points, "id int, x double, y double"), of, cell)
    assert sorted(r["id"] for r in found.collect()) == [i for i, x, y in points if any(odd(x, y, s) for s in shapes)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_edges_belong_to_an_area(spark):
    of = spark.createDataFrame([([[0.0, 0.0, 20.0, 0.0, 20.0, 20.0, 0.0, 20.0], [5.0, 5.0, 15.0, 5.0, 15.0, 15.0, 5.0, 15.0]],)], "segmentation array<array<double>>")
    inside = [(0, 0), (20, 20), (10, 0), (20, 10), (5, 10), (15, 15), (10, 5), (2, 2), (5, 20)]
    outside = [(20.001, 10), (10, 10), (5.001, 5.001), (-1, 0), (10, -0.001)]
    points = spark.createDataFrame([(float(x), float(y)) for x, y in inside + outside], "x double, y double")
    for cell in (1.0, 5.0, 10.0, 7.0):
        assert {(r["x"], r["y"]) for r in areas.points_in_areas(points, of, cell).collect()} == set(inside)


def test_outlines_that_cross_hold_or_lie_in_an_area(spark):
    box = lambda x, y, w, h: [[float(c) for c in (x, y, x + w, y, x + w, y + h, x, y + h)]]
    of = spark.createDataFrame([(box(0, 0, 20, 20) + box(5, 5, 10, 10),)], "segmentation array<array<double>>")
    rows = {1: box(1, 1, 2, 2), 2: box(-50, -50, 200, 200), 3: box(7, 7, 2, 2), 4: box(-5, 8, 60, 2), 5: box(30, 30, 5, 5), 6: box(20, 0, 5, 5), 7: box(4, 4, 12, 12), 8: None}
    frame = spark.createDataFrame(list(rows.items()), "id int, segmentation array<array<double>>")
    for cell in (2.0, 8.0, 100.0):
        assert sorted(r["id"] for r in areas.outlines_in_areas(frame, of, cell, "id").collect()) == [1, 2, 4, 6, 7]
