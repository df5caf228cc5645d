"""Candidates of a drive: a walk over its frames that keeps rays, intersections and candidates as state.

Spark finds which rays meet (``triangulation.ray_pairs``); the walk decides, frame by frame and drive by drive,
which of these meetings count. In each frame

* every new ray keeps its closest meeting with each earlier frame, among rays that are not idle;
* live intersections fall into clusters; the largest is taken, what else lies on its rays is false and goes,
  and what is left falls into clusters anew, until none is left;
* a cluster joins the first open candidate whose centre is near and whose intersections are others: the
  candidate holds both sets, all of them and their rays are live again. Otherwise it opens a candidate,
  unless one holds the same intersections;
* a candidate that gained nothing misses a frame; beyond the limit it closes, its rays are idle, its intersections no
  longer live.

Ties: the smaller ray of equal distances, the cluster with the earliest intersection of equal sizes, candidates in
the order in which they opened. ``walked`` runs drives in parallel over sorted partitions and holds one drive's
open state at a time; ``DriveProcessor`` holds the same state in a stream.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Limits(NamedTuple):
    """Size of clusters, distance of an update, frames that a candidate may miss."""

    cluster: float = 0.5
    update: float = 1.0
    missing: int = 5


class Meeting(NamedTuple):
    ray_a: int
    ray_b: int
    x: float
    y: float
    z: float
    dist: float
    length: float


@dataclass
class Candidate:
    members: set[int]
    centre: tuple[float, float, float]
    mean_length: float
    mean_dist: float
    last_seen: int
    missing: int = 0
    datasets: set[str] = field(default_factory=set)


@dataclass
class Drive:
    """The state of one walk; meetings stay as long as they are live or an open candidate holds them."""

    limits: Limits = Limits()
    meetings: dict[int, Meeting] = field(default_factory=dict)
    live: set[int] = field(default_factory=set)
    idle: set[int] = field(default_factory=set)
    open: dict[int, Candidate] = field(default_factory=dict)
    met: int = 0
    opened: int = 0
    #: The clusters of ``live`` as long as it stays as it is.
    steady: list[set[int]] | None = None
    #: Each meeting's neighbours and each cluster's centre and means, worked out once; made anew where they are missing.
    near: dict[int, set[int]] = field(default_factory=dict)
    middles: dict[frozenset[int], tuple] = field(default_factory=dict)

    def step(self, frame: int, pairs: list[tuple], datasets: set[str]) -> tuple[list[int], list[int], dict[int, Candidate]]:
        """Takes a frame's pairs (ray_b, frame_a, dist, ray_a, x, y, z, length), sorted; gives new and false meetings and closed candidates."""
        new = self._meet(pairs)
        clusters, false = self._clusters()
        known = {key: cluster for cluster in clusters for key in [frozenset(cluster)]}
        self.middles = {key: self.middles.get(key) or self._middle(cluster) for key, cluster in known.items()}
        changed = {c for key, cluster in known.items() if (c := self._place(frame, cluster, datasets, self.middles[key])) is not None}
        closed = self._age(changed)
        return new, false, closed

    def forget(self) -> None:
        """Drops meetings that nothing holds any more."""
        held = self.live.union(*(c.members for c in self.open.values()))
        for i in self.meetings.keys() - held:
            del self.meetings[i]
            for j in self.near.pop(i, ()):
                if j != i:
                    self.near[j].discard(i)

    def _meet(self, pairs: list[tuple]) -> list[int]:
        new, last = [], None
        for ray_b, frame_a, dist, ray_a, x, y, z, length in pairs:
            if (ray_b, frame_a) == last or ray_a in self.idle:
                continue
            last = (ray_b, frame_a)
            self.meetings[self.met] = Meeting(ray_a, ray_b, x, y, z, dist, length)
            new.append(self.met)
            self.met += 1
        if new:
            self.live.update(new)
            self.steady = None
        return new

    def _clusters(self) -> tuple[list[set[int]], list[int]]:
        if self.steady is None:
            _meet_neighbours(self.near, self.meetings, self.limits.cluster)
            taken, false = peeled({i: self.meetings[i] for i in self.live}, self.limits.cluster, self.near)
            self.live.difference_update(false)
            self.steady = taken
            return taken, false
        return self.steady, []

    def _middle(self, members: set[int]) -> tuple[tuple[float, float, float], float, float]:
        """Median centre, mean length and mean gap."""
        rows = np.array([self.meetings[i][2:] for i in sorted(members)])
        at, n = np.sort(rows[:, :3], axis=0), len(rows)
        return tuple(((at[(n - 1) // 2] + at[n // 2]) / 2).tolist()), float(rows[:, 4].mean()), float(rows[:, 3].mean())

    def _place(self, frame: int, cluster: set[int], datasets: set[str], middle: tuple) -> int | None:
        """The candidate that this cluster opens or adds to, None if one holds the same."""
        for number, old in self.open.items():
            if old.members == cluster:
                return None
            if math.dist(middle[0], old.centre) < self.limits.update:
                both = old.members | cluster
                if not both <= self.live:
                    self.live |= both
                    self.steady = None
                self.idle.difference_update(r for i in both for r in self.meetings[i][:2])
                self.open[number] = Candidate(both, *self._middle(both), frame, 0, old.datasets)
                return number
        self.open[self.opened] = Candidate(set(cluster), *middle, frame, 0, set(datasets))
        self.opened += 1
        return self.opened - 1

    def _age(self, changed: set[int]) -> dict[int, Candidate]:
        closed = {}
        for number in [n for n in self.open if n not in changed]:
            old = self.open[number]
            old.missing += 1
            if old.missing > self.limits.missing:
                self.idle.update(r for i in old.members for r in self.meetings[i][:2])
                if old.members & self.live:
                    self.live -= old.members
                    self.steady = None
                closed[number] = self.open.pop(number)
        return closed


def _meet_neighbours(near: dict[int, set[int]], meetings: dict[int, Meeting], eps: float, at_once: int = 512) -> None:
    """Adds to ``near`` the meetings that are not in it: who is within ``eps`` of whom, themselves included."""
    new = [i for i in meetings if i not in near]
    if not new:
        return
    ids = list(meetings)
    at = np.array([meetings[i][2:5] for i in ids]).reshape(-1, 3)
    own = np.array([meetings[i][2:5] for i in new]).reshape(-1, 3)
    near.update((i, set()) for i in new)
    for k in range(0, len(new), at_once):
        close = ((own[k : k + at_once, None] - at[None]) ** 2).sum(2) <= eps * eps
        for i, j in zip(*(v.tolist() for v in np.nonzero(close)), strict=True):
            near[new[i + k]].add(ids[j])
            near[ids[j]].add(new[i + k])


def _parts(ids: set[int], near: dict[int, set[int]]) -> list[set[int]]:
    """Connected parts of ``ids``."""
    left, parts = set(ids), []
    for first in sorted(ids):
        if first not in left:
            continue
        part, todo = set(), {first}
        while todo:
            left -= todo
            part |= todo
            todo = set().union(*(near[i] for i in todo)) & left
        parts.append(part)
    return parts


def peeled(meetings: dict[int, Meeting], eps: float, near: dict[int, set[int]] | None = None) -> tuple[list[set[int]], list[int]]:
    """Clusters taken one by one, the largest first, and the meetings on their rays that are in no cluster taken.

    After each one taken, clusters that lost a meeting fall apart into those that are left. ``near`` holds the neighbours of
    these meetings, and may name others, where a walk has worked them out before.
    """
    on_ray = defaultdict(set)
    if near is None:
        _meet_neighbours(near := {}, meetings, eps)
    for i, m in meetings.items():
        on_ray[m.ray_a].add(i)
        on_ray[m.ray_b].add(i)
    left, taken, false = set(meetings), [], []
    queue = [(-len(p), min(p), p) for p in _parts(left, near)]
    heapq.heapify(queue)
    while queue:
        _, _, part = heapq.heappop(queue)
        if not part <= left:
            for p in _parts(part & left, near):
                heapq.heappush(queue, (-len(p), min(p), p))
            continue
        taken.append(part)
        gone = set().union(*(on_ray[r] for i in part for r in meetings[i][:2])) & left
        false += sorted(gone - part)
        left -= gone
    return taken, false


#: What a walk puts out. kind: intersection (x, y, z, dist, length of a meeting), false (a meeting that is none), idle (a ray, in ray_a, that
#: ended idle), candidate (centre, means, number and keys of its intersections), clock (frames of the drive, in n).
WALKED = (
    "drive long, kind string, candidate long, ray_a long, ray_b long, frame long, x double, y double, z double, dist double, length double, "
    "n long, last_seen long, missing long, active boolean, datasets array<string>, members array<struct<ray_a: long, ray_b: long>>"
)
_NAMES = [c.strip().split()[0] for c in WALKED.split("members")[0].split(",") if c.strip()] + ["members"]
_ORDER = ["drive", "frame", "ray_b", "frame_a", "dist", "ray_a", "x", "y", "z", "length", "datasets"]


def _rows(drive: int, frame: int, state: Drive, new: list[int], false: list[int], closed: dict[int, Candidate], active: bool = False) -> list[dict]:
    out = [{"kind": "intersection", **state.meetings[i]._asdict()} for i in new]
    out += [{"kind": "false", "ray_a": state.meetings[i].ray_a, "ray_b": state.meetings[i].ray_b} for i in false]
    for number, c in closed.items():
        members = [{"ray_a": state.meetings[i].ray_a, "ray_b": state.meetings[i].ray_b} for i in sorted(c.members)]
        place = dict(zip("xyz", map(float, c.centre), strict=True))
        out.append({"kind": "candidate", "candidate": number, **place, "dist": c.mean_dist, "length": c.mean_length, "n": len(members), "last_seen": c.last_seen, "missing": c.missing, "active": active, "datasets": sorted(c.datasets), "members": members})
    return [r | {"drive": drive, "frame": frame} for r in out]


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object if c in ("kind", "datasets", "members") else None) for c in _NAMES})
    whole = ["candidate", "ray_a", "ray_b", "n", "last_seen", "missing"]
    return out.astype(dict.fromkeys(whole, "Int64") | {"active": "boolean"})


def ticks(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each frame (drive, frame, datasets) and one for each pair (drive, frame of its later ray ``frame_b``), as the walk takes them."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in zip(_ORDER[2:10], ("long", "long", "double", "long", *["double"] * 4), strict=True)]
    marks = frames.select("drive", "frame", *empty, F.col("datasets").cast("array<string>").alias("datasets"))
    met = pairs.select("drive", F.col("frame_b").alias("frame"), *_ORDER[2:10], F.lit(None).cast("array<string>").alias("datasets"))
    return marks.union(met)


def _by_frame(rows: pd.DataFrame) -> Iterator[tuple[tuple[int, int], list[tuple], set[str]]]:
    """(drive, frame), sorted pairs and datasets of each frame in sorted rows."""
    rows = rows.dropna(subset=["drive", "frame"])
    keys = rows[["drive", "frame"]].to_numpy("int64")
    new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    has = rows["ray_b"].notna().to_numpy()
    of = rows[has]
    pairs = list(zip(*(of[c].astype("int64" if c in ("ray_b", "frame_a", "ray_a") else "float64").tolist() for c in _ORDER[2:10]), strict=True))
    before, named = [0, *np.cumsum(has).tolist()], rows["datasets"].tolist()
    for low, high in pairwise([0, *new.tolist(), len(rows)] if len(rows) else []):
        yield tuple(keys[low].tolist()), sorted(pairs[before[low] : before[high]]), {d for s in named[low:high] if s is not None for d in s}


def walked(frames: DataFrame, pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The walk of every drive (columns: ``WALKED``): ``frames`` (drive, frame, datasets), ``pairs`` as ``triangulation.ray_pairs`` gives them with drive.

    A frame's pairs are the ones of its rays with earlier frames; frames without any still count as missed.
    """
    rows = ticks(frames, pairs)
    dealt = rows.repartition("drive").sortWithinPartitions(*_ORDER[:6])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drive, state, waiting = None, Drive(limits), None

        def closing() -> list[dict]:
            out = _rows(drive, None, state, [], [], state.open, True)
            return out + [{"drive": drive, "kind": "idle", "ray_a": r} for r in sorted(state.idle)]

        def take(part: pd.DataFrame) -> list[dict]:
            nonlocal drive, state
            out = []
            for (own, frame), met, datasets in _by_frame(part):
                if own != drive:
                    out += closing() if drive is not None else []
                    drive, state = own, Drive(limits)
                out += _rows(own, frame, state, *state.step(frame, met, datasets))
                state.forget()
            return out

        for batch in batches:
            if batch.empty:
                continue
            batch = batch if waiting is None else pd.concat([waiting, batch])
            last = (batch["drive"] == batch["drive"].iloc[-1]) & (batch["frame"] == batch["frame"].iloc[-1])
            waiting = batch[last]
            yield _frame(take(batch[~last]))
        if waiting is not None:
            yield _frame(take(waiting) + closing())

    return dealt.mapInPandas(walk, WALKED)
