"""Overlay against inclusion-exclusion, pixels and closed forms."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panolake.functions import overlay as o


def rows(*segmentations):
    return pa.array(segmentations, pa.list_(pa.list_(pa.float64())))


def square(x, y, w, h=None):
    h = h or w
    return [float(c) for c in (x, y, x + w, y, x + w, y + h, x, y + h)]


def area(array):
    return o.areas(o.even_odd(o.rings_of(array).edges()), len(array))


def common(a, b):
    return o.areas(o.covered(o._joined(*o._both(a, b)), 2), len(a))


def union(a, b):
    return o.areas(o.covered(o._joined(*o._both(a, b)), 1), len(a))


def star(rng, n, cx=0.0, cy=0.0, size=10.0):
    at = np.sort(rng.random(n)) * 2 * np.pi
    r = size * (0.3 + 0.7 * rng.random(n))
    return np.stack([cx + r * np.cos(at), cy + r * np.sin(at)], 1).reshape(-1).tolist()


def inside(points, seg):
    """Even-odd test of points against all rings."""
    odd = np.zeros(len(points), bool)
    for ring in seg:
        r = np.array(ring).reshape(-1, 2)
        q = np.roll(r, -1, 0)
        for (ax, ay), (bx, by) in zip(r, q):
            if ay != by:
                odd ^= ((ay > points[:, 1]) != (by > points[:, 1])) & (points[:, 0] < ax + (points[:, 1] - ay) * (bx - ax) / (by - ay))
    return odd


def test_boxes_bow_ties_spikes_and_repeats():
    cases = {
        "box": ([square(0, 0, 2, 3)], 6.0, 1),
        "bow-tie": ([[0, 0, 2, 2, 2, 0, 0, 2]], 2.0, 2),
        "spike": ([[0, 0, 4, 0, 4, 9, 4, 0, 4, 4, 0, 4]], 16.0, 1),
        "repeated vertices": ([[0, 0, 0, 0, 2, 0, 2, 2, 2, 2, 0, 2, 0, 0]], 4.0, 1),
        "two parts": ([square(0, 0, 1), square(5, 5, 2)], 5.0, 2),
        "a hole": ([square(0, 0, 4), square(1, 1, 2)], 12.0, 1),
        "a hole that touches": ([square(0, 0, 4), [0, 0, 2, 1, 1, 2]], 14.5, 1),
        "overlapping parts": ([square(0, 0, 2), square(1, 0, 2)], 4.0, 2),
        "figure of eight twice": ([[0, 0, 2, 2, 2, 0, 0, 2], square(10, 0, 1)], 3.0, 3),
        "a line": ([[0, 0, 5, 5, 3, 3]], 0.0, 0),
        "two points": ([[0, 0, 5, 5]], 0.0, 0),
        "odd number": ([[0, 0, 2, 0, 2, 2, 7]], 2.0, 1),
        "none": ([], 0.0, 0),
    }
    array = rows(*(c[0] for c in cases.values()), None)
    found = o._parts(o.outlines(o.even_odd(o.rings_of(array).edges())), len(array)).to_pylist()
    for (name, (_, size, n)), got, parts in zip(cases.items(), area(array), found):
        assert got == pytest.approx(size), name
        assert len(parts) == n, (name, parts)
    assert [len(p) for p in found[5]] == [2] and found[-1] == []


def test_union_and_intersection_of_boxes():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 8, (300, 4)) for _ in range(2))
    a[:, 2:] += 1
    b[:, 2:] += 1
    left, right = (rows(*([square(*map(float, r))] for r in m)) for m in (a, b))
    w = np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    shared = np.maximum(w, 0) * np.maximum(h, 0)
    assert common(left, right) == pytest.approx(shared)
    assert union(left, right) == pytest.approx(a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - shared)


def test_stars_satisfy_inclusion_exclusion_and_agree_with_points():
    rng = np.random.default_rng(2)
    left, right = [[star(rng, 25)] for _ in range(60)], [[star(rng, 18, 3, 2), star(rng, 9, 25, 0, 4)] for _ in range(60)]
    a, b = rows(*left), rows(*right)
    assert union(a, b) + common(a, b) == pytest.approx(area(a) + area(b), rel=1e-6)
    points = rng.random((40_000, 2)) * (45, 30) - (12, 14)
    for k in range(5):
        share = (inside(points, left[k]) & inside(points, right[k])).mean() * 45 * 30
        assert common(a, b)[k] == pytest.approx(share, abs=6)


def test_crossing_rings_are_even_odd():
    rng = np.random.default_rng(3)
    wild = [[(rng.random(24) * 10).tolist()] for _ in range(40)]
    array = rows(*wild)
    rings = o.outlines(o.even_odd(o.rings_of(array).edges()))
    assert o._signed(rings).sum() == pytest.approx(area(array).sum())
    points = rng.random((20_000, 2)) * 10
    again = o._lists(rings, len(array)).to_pylist()
    for k in range(40):
        assert (inside(points, wild[k]) == inside(points, again[k])).mean() > 0.9999


def test_buffers_of_convex_rings_follow_the_closed_form():
    rng = np.random.default_rng(4)
    polygons = []
    for _ in range(50):
        at = np.sort(rng.random(9)) * 2 * np.pi
        polygons.append(np.stack([100 + 20 * np.cos(at), 50 + 12 * np.sin(at)], 1))
    array = rows(*([p.reshape(-1).tolist()] for p in polygons))
    around = np.array([np.linalg.norm(p - np.roll(p, -1, 0), axis=1).sum() for p in polygons])
    for r in (1.0, 3.5):
        grown = o.buffered_rings(o.rings_of(array), np.full(50, r))
        found = np.bincount(grown.row, o._signed(grown), 50)
        assert found == pytest.approx(area(array) + around * r + np.pi * r * r, rel=2e-3)
        back = o.buffered_rings(grown, np.full(50, -r))
        assert np.bincount(back.row, o._signed(back), 50) == pytest.approx(area(array), rel=2e-3)


def test_shrinking_splits_and_empties():
    dumbbell = [0, 0, 10, 0, 10, 4, 20, 4, 20, 0, 30, 0, 30, 10, 20, 10, 20, 6, 10, 6, 10, 10, 0, 10]
    frame = [square(0, 0, 20), square(5, 5, 10)]
    array = rows([dumbbell], [square(0, 0, 1.5)], frame, [square(0, 0, 10)])
    found = o.buffered_rings(o.rings_of(array), np.array([-1.5, -1.0, -1.0, -3.0]))
    parts = o._parts(found, 4).to_pylist()
    assert [len(p) for p in parts] == [2, 0, 1, 1] and len(parts[2][0]) == 2
    sizes = np.bincount(found.row, o._signed(found), 4)
    assert sizes[0] == pytest.approx(98, rel=1e-2) and sizes[3] == pytest.approx(16)
    assert sizes[2] == pytest.approx(18 * 18 - (12 * 12 - (4 - np.pi)), rel=1e-3)
    grown = o.buffered_rings(o.rings_of(rows([dumbbell])), np.array([3.0]))
    points = np.random.default_rng(5).random((20_000, 2)) * (40, 20) - 5
    ring = np.array(dumbbell).reshape(-1, 2)
    sides = np.stack([ring, np.roll(ring, -1, 0)], 1)
    d = np.min([_distance(points, *s) for s in sides], axis=0)
    near = inside(points, [dumbbell]) | (d <= 3.0)
    assert (inside(points, o._lists(grown, 1).to_pylist()[0]) == near).mean() > 0.998


def _distance(points, a, b):
    t = np.clip(((points - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
    return np.linalg.norm(points - a - t[:, None] * (b - a), axis=1)


def test_areas_that_touch():
    rng = np.random.default_rng(6)
    cases = [
        ([square(0, 0, 2)], [square(2, 2, 2)], True), ([square(0, 0, 2)], [square(2, 0.5, 1)], True), ([square(0, 0, 9)], [square(3, 3, 1)], True),
        ([square(3, 3, 1)], [square(0, 0, 9)], True), ([square(0, 0, 9), square(2, 2, 5)], [square(3, 3, 1)], False), ([square(0, 0, 2)], [square(2.001, 0, 2)], False),
        ([square(0, 0, 1), square(8, 8, 1)], [square(8.2, 8.2, 0.1)], True), ([], [square(0, 0, 1)], False), (None, [square(0, 0, 1)], False), ([square(0, 0, 4, 1)], [square(1, -2, 1, 6)], True),
    ]
    left, right = ([c[k] for c in cases] for k in (0, 1))
    assert o.touching(o.rings_of(rows(*left)), o.rings_of(rows(*right)), len(cases)).tolist() == [c[2] for c in cases]
    left, right = [[star(rng, 12)] for _ in range(200)], [[star(rng, 12, *(rng.random(2) * 24 - 12))] for _ in range(200)]
    a, b = rows(*left), rows(*right)
    assert (o.touching(o.rings_of(a), o.rings_of(b), 200) == (common(a, b) > 1e-6)).all()


def test_far_from_the_origin():
    a, b = rows([square(2_600_000.25, 1_200_000.5, 3)]), rows([square(2_600_001.25, 1_200_001.5, 3)])
    assert common(a, b) == pytest.approx([4.0]) and union(a, b) == pytest.approx([14.0])


def test_columns(spark):
    data = [(1, [square(0, 0, 2.0)], [square(1, 1, 2.0)]), (2, [square(0, 0, 2.0)], None), (3, None, None), (4, [square(0, 0, 2.0)], [square(9, 9, 1.0)])]
    frame = spark.createDataFrame(data, "id int, a array<array<double>>, b array<array<double>>").repartition(2)
    got = {r["id"]: r for r in frame.select("id", o.iou("a", "b").alias("iou"), o.shared_area("a", "b").alias("shared"), o.area("a").alias("area"), o.repaired("a").alias("parts"), o.buffered("a", F.lit(1.0)).alias("grown"), o.united(F.array("a", "b")).alias("all")).collect()}
    assert got[1]["iou"] == pytest.approx(1 / 7) and got[1]["shared"] == pytest.approx(1)
    assert [got[k]["iou"] for k in (2, 3, 4)] == [0, 0, 0] and [got[k]["area"] for k in (1, 3)] == [4, 0]
    assert len(got[1]["parts"]) == 1 and got[3]["parts"] == [] and len(got[4]["all"]) == 2 and len(got[1]["all"][0]) == 16
    assert len(got[1]["grown"][0]) == 2 * 4 * 17
