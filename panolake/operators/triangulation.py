"""Rays of many frames meet: pair search, best pair per frame, clusters by peeling, candidates."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panolake.functions.camera import radius_of_area
from panolake.operators import drive
from panolake.operators.components import connected_components
from panolake.operators.ranges import settled, spread
from panolake.operators.spatial import distance_pairs


def ray_pairs(rays: DataFrame, radius: float = 20.0, gap: float = 0.2, height: tuple[float, float] | None = (-3.8, -2.0), radii_apart: float | None = None, group: str | None = None) -> DataFrame:
    """(ray_a, ray_b, frame_a, frame_b, x, y, z, dist, length): closest approaches of rays of an earlier and a later frame.

    Rays no longer than ``radius`` meet only where their cameras stand within twice that, so rays meet by cells
    of that size, whenever a place is passed again: an equality join, never a nested loop. Nearly parallel rays,
    points behind a camera or beyond ``radius``, gaps above ``gap`` and heights outside the window below the lower
    camera are rejected; with ``radii_apart`` also pairs whose disks, worked out from the mask ``area`` of either
    ray, differ by more in radius. With ``group`` only rays that agree in this column meet, and it is put out.
    """
    cells, keys = [F.floor(F.col(o) / (2 * radius)).alias(c) for o, c in (("ox", "cx"), ("oy", "cy"))], [group] if group else []
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    own = [*(f"{v}{c}" for v in "od" for c in "xyz"), "ray_id", "frame_id", *(["area"] if radii_apart is not None else [])]
    sides = {s: rays.select(*keys, *cells, *[F.col(c).alias(f"{s}_{c}") for c in own]) for s in "ab"}
    a = sides["a"].withColumn("ex", around).withColumn("ey", around)
    a = a.withColumns({"cx": F.col("cx") + F.col("ex"), "cy": F.col("cy") + F.col("ey")}).drop("ex", "ey")
    on = [*keys, "cx", "cy"]
    across, along = (F.col(f"a_{c}") - F.col(f"b_{c}") for c in ("ox", "oy"))
    near = across * across + along * along <= (2 * radius) ** 2
    # Rays make many pairs, so a join of few bytes is dealt to all tasks; columns are settled, as the filters below name them again and again.
    met = spread(a, *on).join(spread(sides["b"], *on), on).where((F.col("a_frame_id") < F.col("b_frame_id")) & near)
    d1, d2, o1, o2 = ([F.col(f"{s}_{v}{c}") for c in "xyz"] for v in "do" for s in "ab")
    met = settled(met, {"cos": sum((p * q for p, q in zip(d1[1:], d2[1:], strict=True)), d1[0] * d2[0])}).where(F.abs(1 - F.col("cos") * F.col("cos")) >= 1e-6)
    w = [p - q for p, q in zip(o1, o2, strict=True)]
    d, e = (sum((x * y for x, y in zip(v[1:], w[1:], strict=True)), v[0] * w[0]) for v in (d1, d2))
    below = F.nullif(1 - F.col("cos") * F.col("cos"), F.lit(0.0))
    met = settled(met, {"t1": (F.col("cos") * e - d) / below, "t2": (e - F.col("cos") * d) / below})
    met = met.where(F.col("t1").between(0, radius) & F.col("t2").between(0, radius))
    if radii_apart is not None:
        one, two = (radius_of_area(F.col(f"{s}_area"), tuple(d), F.col(t), 8000, 4000) for s, d, t in (("a", d1, "t1"), ("b", d2, "t2")))
        met = met.where(F.abs(one - two) <= radii_apart)
    met = settled(met, {f"{s}_{c}": p + F.col(t) * u for s, t, o, v in (("p", "t1", o1, d1), ("q", "t2", o2, d2)) for c, p, u in zip("xyz", o, v, strict=True)})
    ends = [(F.col(f"p_{c}"), F.col(f"q_{c}")) for c in "xyz"]
    far = F.sqrt(sum(((p - q) * (p - q) for p, q in ends[1:]), (ends[0][0] - ends[0][1]) * (ends[0][0] - ends[0][1])))
    out = met.where(far <= gap)
    z, camera_z = (ends[2][0] + ends[2][1]) / 2, F.least(o1[2], o2[2])
    if height:
        out = out.where((z > camera_z + height[0]) & (z < camera_z + height[1]))
    return out.select(
        *keys, F.col("a_ray_id").alias("ray_a"), F.col("b_ray_id").alias("ray_b"), F.col("a_frame_id").alias("frame_a"), F.col("b_frame_id").alias("frame_b"),
        *[((p + q) / 2).alias(c) for (p, q), c in zip(ends, "xyz", strict=True)], far.alias("dist"), F.greatest("t1", "t2").alias("length"),
    )


def best_per_frame(pairs: DataFrame) -> DataFrame:
    """For each new ray and each earlier frame the pair of the least gap, ties to the smaller ray."""
    rank = Window.partitionBy("ray_b", "frame_a").orderBy("dist", "ray_a")
    return pairs.withColumn("k", F.row_number().over(rank)).where("k = 1").drop("k")


def clusters(points: DataFrame, eps: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, cluster): components of points (id, x, y, and z if there) at most ``eps`` apart; every point is in one."""
    pairs = distance_pairs(points, points, eps, closed=True).where("a <= b").select("a", "b")
    return connected_components(pairs, keep).select(F.col("node").alias("id"), F.col("root").alias("cluster"))


def peel(meetings: DataFrame, eps: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, ray, cluster) of meetings (id, ray_a, ray_b, x, y, z) in the clusters that win their rays: the largest first, ties to the lower number.

    A round keeps every cluster that beats all clusters it shares a ray with and drops the meetings of other
    clusters on its rays; clusters that lose one so fall into clusters anew. Others only shrink meanwhile, so
    this equals taking the largest again and again. The largest of all wins in each round, so rounds go on until none is left.
    """
    meetings = meetings.select("id", "ray_a", "ray_b", *"xyz")
    points = meetings.select("id", *"xyz")
    on_rays = meetings.select("id", F.explode(F.array("ray_a", "ray_b")).alias("ray"))
    left, won = keep(clusters(points, eps, keep).join(on_rays, "id")), None
    while True:
        sizes = left.groupBy("cluster").agg(F.count_distinct("id").alias("n"))
        on_ray = left.join(sizes, "cluster").withColumn("k", F.dense_rank().over(Window.partitionBy("ray").orderBy(F.desc("n"), "cluster")))
        winners = keep(on_ray.groupBy("cluster").agg(F.max("k").alias("worst")).where("worst = 1").select("cluster"))
        now = keep(left.join(winners, "cluster", "left_semi"))
        won = now if won is None else won.unionByName(now)
        lost = left.join(winners, "cluster", "left_anti")
        hurt = keep(lost.join(now.select("ray").distinct(), "ray", "left_semi").select("id", "cluster").distinct())
        lost = keep(lost.join(hurt.select("id"), "id", "left_anti"))
        if lost.isEmpty():
            return won
        broken = lost.join(hurt.select("cluster").distinct(), "cluster", "left_semi").select("id", "ray")
        anew = clusters(points.join(broken.select("id").distinct(), "id", "left_semi"), eps, keep)
        left = keep(lost.join(hurt.select("cluster").distinct(), "cluster", "left_anti").select("id", "cluster", "ray").union(anew.join(broken, "id").select("id", "cluster", "ray")))


def candidates(intersections: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per cluster: median centre, mean length and gap, number of intersections, last frame seen."""
    rows = intersections.join(labels, "id")
    return rows.groupBy("cluster").agg(
        *[F.percentile(c, 0.5).alias(c) for c in "xyz"], F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.avg("dist").alias("mean_dist"), F.max("frame_b").alias("last_seen")
    )


def good(found: DataFrame, length: float = 15.0, gap: float = 0.2, least: int = 2) -> DataFrame:
    return found.where((F.col("mean_length") <= length) & (F.col("mean_dist") <= gap) & (F.col("n") >= least))


def frame_order(frames: DataFrame, radius: float = 10.0, group: str = "trajectory") -> DataFrame:
    """(trajectory, frame_id, place): frames by time; each anchor and the unused frames within ``radius`` of it
    follow sorted along the way from the anchor before it, so that some may stand before it; the first anchor
    stands alone. Each place depends on those before: one drive's frames, a row each, are a group."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "frame_id"]).drop_duplicates("frame_id").reset_index(drop=True)
        xyz = rows[["x", "y", "z"]].to_numpy(float)
        cells: dict[tuple[int, int], list[int]] = {}
        for i, (x, y, _) in enumerate(xyz):
            cells.setdefault((int(x // radius), int(y // radius)), []).append(i)
        used, order, last = [False] * len(rows), [], -1
        for i in range(len(rows)):
            if used[i]:
                continue
            near = [i]
            if last >= 0:
                way = xyz[i] - xyz[last]
                size = float((way @ way) ** 0.5)
                way = way / size if size >= 1e-6 else np.array([1.0, 0.0, 0.0])
                cx, cy = int(xyz[i][0] // radius), int(xyz[i][1] // radius)
                near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx + a, cy + b), ()) if not used[j] and ((xyz[j] - xyz[i]) ** 2).sum() <= radius * radius]
                near.sort(key=lambda j: (float(xyz[j] @ way), j))
            for j in near:
                used[j] = True
            order += near
            last = i
        out = rows.loc[order, [group, "frame_id"]]
        return out.assign(place=range(len(out)))

    kind = frames.schema[group].dataType.simpleString()
    return frames.groupBy(group).applyInPandas(walk, f"{group} {kind}, frame_id long, place long")


def merged_candidates(found: DataFrame, members: DataFrame, intersections: DataFrame, within: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates (cluster, x, y, z, last_seen, missing, datasets) whose centres chain up within a distance in space, as one each.

    The set union of their intersections (``members``: cluster, id) gives centre, means and number anew; the
    last frame seen is the greatest, the number of missed frames the least, the datasets are all of theirs.
    """
    roots = clusters(found.select(F.col("cluster").alias("id"), *"xyz"), within, keep).select(F.col("id").alias("cluster"), F.col("cluster").alias("root"))
    roots = keep(roots)
    own = members.join(roots, "cluster").select("root", "id").distinct().join(intersections, "id")
    points = own.groupBy("root").agg(*[F.percentile(c, 0.5).alias(c) for c in "xyz"], F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.avg("dist").alias("mean_dist"))
    every = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("datasets")))).alias("datasets")] if "datasets" in found.columns else []
    seen = found.join(roots, "cluster").groupBy("root").agg(F.max("last_seen").alias("last_seen"), F.min("missing").alias("missing"), F.count("*").alias("merged"), *every)
    return points.join(seen, "root").withColumnRenamed("root", "cluster")


class Triangulated(NamedTuple):
    """What a run over drives gives."""

    #: cluster, drive, x, y, z, n, mean_length, mean_dist, last_seen, missing, merged, datasets
    candidates: DataFrame
    #: drive, id, ray_a, ray_b, frame, x, y, z, dist, length of every meeting that no larger cluster made false
    intersections: DataFrame
    #: the columns of the rays, and whether a ray is still active at the end of its drive
    rays: DataFrame


def triangulate(rays: DataFrame, frames: DataFrame, keep: Callable[[DataFrame], DataFrame], limits: drive.Limits = drive.Limits(), **pairing) -> Triangulated:
    """Candidates of ``rays`` (drive, frame_id, ray_id, ox..dz) over ``frames`` (drive, frame, datasets): pairs by place, the walk of each drive, the last merge."""
    pairs = ray_pairs(rays, group="drive", **pairing)
    walk = keep(drive.walked(frames, pairs, limits))
    key = F.struct("drive", "ray_a", "ray_b").alias("id")
    false = walk.where("kind = 'false'").select("drive", "ray_a", "ray_b").distinct()
    every = walk.where("kind = 'intersection'").select("drive", key, "ray_a", "ray_b", "frame", *"xyz", "dist", "length")
    found = walk.where("kind = 'candidate'").select(F.struct("drive", "candidate").alias("cluster"), *"xyz", "last_seen", "missing", "datasets", "members", "drive")
    members = found.select("cluster", "drive", F.explode("members").alias("m")).select("cluster", "drive", F.col("m.ray_a").alias("ray_a"), F.col("m.ray_b").alias("ray_b"))
    members = members.select("cluster", key)
    merged = keep(merged_candidates(found.drop("members", "drive"), members, every, limits.update, keep).withColumn("drive", F.col("cluster.drive")))
    idle = walk.where("kind = 'idle'").select("drive", F.col("ray_a").alias("ray_id")).withColumn("idle", F.lit(True))
    shown = rays.join(idle, ["drive", "ray_id"], "left").withColumn("active", F.col("idle").isNull()).drop("idle")
    return Triangulated(merged, every.join(false, ["drive", "ray_a", "ray_b"], "left_anti"), shown)


#: Thresholds in use for the two kinds of panoramas: gap of rays, size of clusters, distance of an update, frames missed, length of a ray.
PARAMETERS = {"spherical": (0.5, 1.0, 1.0, 5, 20.0), "cubemap": (0.2, 0.5, 1.0, 20, 20.0)}


def pairing(model: str) -> dict[str, float]:
    """What ``ray_pairs`` takes for a kind of panoramas."""
    gap, _, _, _, radius = PARAMETERS[model]
    return {"gap": gap, "radius": radius}


def limits_of(model: str) -> drive.Limits:
    """The limits of the walk for a kind of panoramas."""
    _, cluster, update, missing, _ = PARAMETERS[model]
    return drive.Limits(cluster, update, missing)
