"""Candidates of a drive as its frames arrive: a fold over ordered intersections with ageing by frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CANDIDATE = "trajectory long, candidate long, x double, y double, z double, n long, last_seen long, active boolean"


@dataclass
class Candidates:
    """Open candidates of one trajectory; a candidate that no frame has met for ``missing`` frames closes."""

    near: float = 1.0
    missing: int = 5
    seen: dict[int, list[tuple[float, float, float]]] = field(default_factory=dict)
    last: dict[int, int] = field(default_factory=dict)
    next_id: int = 0

    def add(self, frame: int, points: np.ndarray) -> set[int]:
        """Points of a frame join the nearest open candidate within ``near`` of its median, or open one."""
        changed = set()
        for p in points:
            centres = {i: np.median(self.seen[i], axis=0) for i in self.last}
            best = min(centres, key=lambda i: (float(np.linalg.norm(centres[i] - p)), i), default=None)
            if best is None or np.linalg.norm(centres[best] - p) >= self.near:
                best, self.next_id = self.next_id, self.next_id + 1
                self.seen[best] = []
            self.seen[best].append(tuple(map(float, p)))
            self.last[best] = frame
            changed.add(best)
        for i in [i for i, f in self.last.items() if frame - f > self.missing]:
            changed.add(i)
        return changed

    def close(self, frame: int) -> None:
        for i in [i for i, f in self.last.items() if frame - f > self.missing]:
            del self.last[i], self.seen[i]


def track(intersections: DataFrame, near: float = 1.0, missing: int = 5) -> DataFrame:
    """trajectory, candidate, median centre, number of intersections, last frame, whether it is still open.

    ``intersections`` streams (trajectory, frame_id, x, y, z) in frame order. The state holds open candidates
    only, so it is bounded by what one stretch of road shows.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Candidates(near, missing)
        if state.exists:
            ids, last, lengths, flat, held.next_id = state.get
            at = 0
            for i, f, n in zip(ids, last, lengths, strict=True):
                held.seen[i] = [tuple(flat[3 * k : 3 * k + 3]) for k in range(at, at + n)]
                held.last[i], at = f, at + n
        out = []
        rows = pd.concat(list(parts)).sort_values("frame_id", kind="stable")
        for frame, part in rows.groupby("frame_id", sort=True):
            for i in sorted(held.add(int(frame), part[["x", "y", "z"]].to_numpy())):
                x, y, z = np.median(held.seen[i], axis=0)
                out.append((key[0], i, x, y, z, len(held.seen[i]), held.last[i], frame - held.last[i] <= missing))
            held.close(int(frame))
        ids = sorted(held.last)
        state.update(([*ids], [held.last[i] for i in ids], [len(held.seen[i]) for i in ids], [v for i in ids for p in held.seen[i] for v in p], held.next_id))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    kept = "ids array<long>, last array<long>, lengths array<long>, points array<double>, next_id long"
    return intersections.groupBy("trajectory").applyInPandasWithState(fold, CANDIDATE, kept, "update", GroupStateTimeout.NoTimeout)
