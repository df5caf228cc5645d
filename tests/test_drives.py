"""The walk over drives against a plain one, batch against stream, and the peeling of clusters that fall apart."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panolake.fixtures import view
from panolake.operators import drive, triangulation
from panolake.plans.catalog import keeper
from panolake.streaming import drives

SF = "/root/testdata/sf0.001"


def meet(p, q, radius=20.0, gap=0.2):
    """Midpoint, gap and length of two rays (origin, direction), by least squares along both."""
    (o, d), (e, f) = p, q
    if abs(1 - (d @ f) ** 2) < 1e-6:
        return None
    t = np.linalg.lstsq(np.array([d, -f]).T, e - o, rcond=None)[0]
    if min(t) < 0 or max(t) > radius:
        return None
    a, b = o + t[0] * d, e + t[1] * f
    low = min(o[2], e[2])
    z = (a[2] + b[2]) / 2
    if np.linalg.norm(a - b) > gap or not low - 3.8 < z < low - 2.0:
        return None
    return (a + b) / 2, float(np.linalg.norm(a - b)), float(max(t))


def parts_of(points, ids, eps):
    left, out = list(ids), []
    while left:
        part = [left.pop(0)]
        for i in part:
            more = [j for j in left if np.linalg.norm(points[i] - points[j]) <= eps]
            left = [j for j in left if j not in more]
            part += more
        out.append(frozenset(part))
    return out


def plain_walk(rays, frames, limits):
    """Every step in full, over lists: rays are (id, frame, origin, direction)."""
    met, live, idle, shown, false = {}, set(), set(), [], set()
    for frame in frames:
        mine = sorted((r for r in rays if r[1] == frame), key=lambda r: r[0])
        for r in mine:
            best = {}
            for q in sorted((q for q in rays if q[1] < frame), key=lambda q: q[0]):
                if q[0] not in idle and (m := meet(q[2:], r[2:])) and (q[1] not in best or m[1] < best[q[1]][1][1]):
                    best[q[1]] = (q[0], m)
            for at in sorted(best):
                met[len(met)] = (best[at][0], r[0], *best[at][1])
                live.add(len(met) - 1)
        left, taken = set(live), []
        while left:
            part = min(parts_of({i: met[i][2] for i in left}, sorted(left), limits.cluster), key=lambda c: (-len(c), min(c)))
            used = {r for i in part for r in met[i][:2]}
            gone = {i for i in left if set(met[i][:2]) & used}
            false |= gone - part
            live -= gone - part
            left -= gone
            taken.append(part)
        changed = set()
        for part in taken:
            centre = np.median([met[i][2] for i in part], axis=0)
            for k, c in enumerate(shown):
                if not c["open"]:
                    continue
                if c["members"] == part:
                    break
                if np.linalg.norm(c["centre"] - centre) < limits.update:
                    c["members"] = c["members"] | part
                    live |= c["members"]
                    idle -= {r for i in c["members"] for r in met[i][:2]}
                    c["centre"], c["seen"], c["missing"] = np.median([met[i][2] for i in c["members"]], axis=0), frame, 0
                    changed.add(k)
                    break
            else:
                shown.append({"members": part, "centre": centre, "seen": frame, "missing": 0, "open": True})
                changed.add(len(shown) - 1)
        for k, c in enumerate(shown):
            if c["open"] and k not in changed:
                c["missing"] += 1
                if c["missing"] > limits.missing:
                    c["open"] = False
                    idle |= {r for i in c["members"] for r in met[i][:2]}
                    live -= c["members"]
    return met, shown, false, idle


def as_rays(rows):
    return [(r["ray_id"], r["frame_id"], np.array([r["ox"], r["oy"], r["oz"]]), np.array([r["dx"], r["dy"], r["dz"]])) for r in rows]


def candidate_row(c, met):
    return (tuple(np.round(c["centre"], 6) + 0.0), frozenset(met[i][:2] for i in c["members"]), c["seen"], c["missing"], c["open"])


def found_rows(rows):
    return {(tuple(round(r[c], 6) + 0.0 for c in "xyz"), frozenset((m["ray_a"], m["ray_b"]) for m in r["members"]), r["last_seen"], r["missing"], r["active"]) for r in rows}


@pytest.fixture(scope="module")
def scene(spark):
    rays = view(spark, SF, "fx_drive_rays").where("drive = 0").cache()
    frames = view(spark, SF, "fx_drive_frames").where("drive = 0").selectExpr("drive", "frame", "array(dataset) as datasets").cache()
    return rays, frames, sorted(r["frame"] for r in frames.collect())


@pytest.mark.parametrize("limits", [drive.Limits(), drive.Limits(0.8, 2.5, 20), drive.Limits(0.1, 0.4, 0)])
def test_the_walk_equals_a_plain_one(spark, scene, limits):
    rays, frames, order = scene
    walk = drive.walked(frames, triangulation.ray_pairs(rays, group="drive"), limits).cache()
    met, shown, false, idle = plain_walk(as_rays(rays.collect()), order, limits)
    rows = walk.collect()
    of = {k: [r for r in rows if r["kind"] == k] for k in ("intersection", "false", "candidate", "idle")}
    assert {(r["ray_a"], r["ray_b"]) for r in of["intersection"]} == {m[:2] for m in met.values()}
    assert {(r["ray_a"], r["ray_b"]) for r in of["false"]} == {met[i][:2] for i in false}
    assert found_rows(of["candidate"]) == {candidate_row(c, met) for c in shown} and len(of["candidate"]) == len(shown)
    assert {r["ray_a"] for r in of["idle"]} == idle
    assert len(false) > 5 and any(not c["open"] for c in shown)


def test_the_stream_equals_the_batch(spark, scene, tmp_path):
    rays, frames, _ = scene
    rows = drive.ticks(frames, triangulation.ray_pairs(rays, group="drive")).cache()
    expected = drive.walked(frames, triangulation.ray_pairs(rays, group="drive")).collect()
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got, folder = [], str(tmp_path / "rows")
    try:
        for low, high in ((0, 40), (40, 41), (41, 300)):
            rows.where(F.col("frame").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
            stream = drives.walked(spark.readStream.schema(rows.schema).parquet(folder))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: got.append(df.collect()))
            query.trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = [b for b in got if b]
    every = [r for b in got for r in b]
    pairs = lambda rows, kind: {(r["ray_a"], r["ray_b"]) for r in rows if r["kind"] == kind}
    assert pairs(every, "intersection") == pairs(expected, "intersection") and pairs(every, "false") == pairs(expected, "false")
    closed = [r for r in every if r["kind"] == "candidate" and not r["active"]]
    still = [r for r in got[-1] if r["kind"] == "candidate" and r["active"]]
    assert found_rows(closed + still) == found_rows(r for r in expected if r["kind"] == "candidate")


def test_clusters_that_lose_a_meeting_fall_apart(spark):
    at = {1: (0.0, 1, 2), 2: (0.4, 3, 4), 3: (0.8, 5, 6), **{10 + k: (5.0 + 0.1 * k, 4, 20 + k) for k in range(5)}}
    rows = spark.createDataFrame([(i, a, b, x, 0.0, 0.0) for i, (x, a, b) in at.items()], "id long, ray_a long, ray_b long, x double, y double, z double")
    won = triangulation.peel(rows, 0.5, keeper(spark)).select("id", "cluster").distinct().collect()
    assert {r["id"]: r["cluster"] for r in won} == {1: 1, 3: 3, **{10 + k: 10 for k in range(5)}}
    taken, false = drive.peeled({i: drive.Meeting(a, b, x, 0.0, 0.0, 0.0, 1.0) for i, (x, a, b) in at.items()}, 0.5)
    assert taken == [{10, 11, 12, 13, 14}, {1}, {3}] and false == [2]


def test_peeling_in_rounds_equals_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(60)), 100 + int(rng.integers(60)), *map(float, rng.random(3) * (6, 2, 2))) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, ray_a long, ray_b long, x double, y double, z double")
    won = triangulation.peel(frame, 0.5, keeper(spark)).select("id", "cluster").distinct().collect()
    parts = {}
    for r in won:
        parts.setdefault(r["cluster"], set()).add(r["id"])
    taken, _ = drive.peeled({i: drive.Meeting(a, b, x, y, z, 0.0, 1.0) for i, a, b, x, y, z in rows}, 0.5)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, taken))


def test_rays_meet_where_a_place_is_passed_again(spark):
    rays = view(spark, SF, "fx_drive_rays").where("drive = 0")
    rows = as_rays(rays.collect())
    expected = {(p[0], q[0]) if p[1] < q[1] else (q[0], p[0]) for p, q in combinations(rows, 2) if p[1] != q[1] and meet(p[2:], q[2:])}
    pairs = triangulation.ray_pairs(rays, group="drive")
    assert {(r["ray_a"], r["ray_b"]) for r in pairs.collect()} == expected
    assert max(r["frame_b"] - r["frame_a"] for r in pairs.collect()) > 20
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()


def test_an_under_and_an_overpass_stay_apart(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.1, 0.0, 6.0), (3, 0.2, 0.0, 0.1)], "id long, x double, y double, z double")
    assert {r["id"]: r["cluster"] for r in triangulation.clusters(points, 0.5, keeper(spark)).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_drive_without_pairs(spark):
    frames = spark.createDataFrame([(1, 0, None), (1, 1, ["a"]), (2, 0, ["a"])], "drive long, frame long, datasets array<string>")
    rays = spark.createDataFrame([], "drive long, frame_id long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert drive.walked(frames, triangulation.ray_pairs(rays, group="drive")).collect() == []
    assert isinstance(drive._frame([]), pd.DataFrame)
