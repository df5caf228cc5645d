"""The walk over a drive's frames as a stream: keyed state in map and value states, the steps of ``operators.drive``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panolake.operators.drive import WALKED, Candidate, Drive, Limits, Meeting, _by_frame, _frame, _rows


class DriveProcessor(StatefulProcessor):
    """Holds a drive's live meetings, idle rays and open candidates between batches."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meetings = handle.getMapState("meetings", "id long", "ray_a long, ray_b long, x double, y double, z double, dist double, length double, live boolean")
        self.idle = handle.getMapState("idle", "ray long", "since long")
        found = "members array<long>, x double, y double, z double, mean_length double, mean_dist double, last_seen long, missing long, datasets array<string>"
        self.open = handle.getMapState("open", "candidate long", found)
        self.clock = handle.getValueState("clock", "met long, opened long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._read()
        state, out = self._read(), []
        batch = pd.concat(list(rows)).sort_values("frame", kind="stable")
        frame = None
        for (_, frame), pairs, datasets in _by_frame(batch):
            out += _rows(key[0], frame, state, *state.step(frame, pairs, datasets))
            state.forget()
        out += _rows(key[0], frame, state, [], [], state.open, True)
        self._write(before, state, int(frame))
        yield _frame(out)

    def _read(self) -> Drive:
        state = Drive(self.limits)
        if not self.clock.exists():
            return state
        state.met, state.opened = self.clock.get()
        for (i,), (*fields, live) in self.meetings.iterator():
            state.meetings[i] = Meeting(*fields)
            if live:
                state.live.add(i)
        state.idle = {ray for (ray,), _ in self.idle.iterator()}
        found = {n: v for (n,), v in self.open.iterator()}
        for n in sorted(found):
            members, x, y, z, length, dist, last_seen, missing, datasets = found[n]
            state.open[n] = Candidate(set(members), (x, y, z), length, dist, last_seen, missing, set(datasets))
        return state

    def _write(self, before: Drive, state: Drive, frame: int) -> None:
        """Writes what changed."""
        for i in before.meetings.keys() - state.meetings.keys():
            self.meetings.removeKey((i,))
        for i, m in state.meetings.items():
            if i not in before.meetings or (i in before.live) != (i in state.live):
                self.meetings.updateValue((i,), (*m, i in state.live))
        for ray in before.idle - state.idle:
            self.idle.removeKey((ray,))
        for ray in state.idle - before.idle:
            self.idle.updateValue((ray,), (frame,))
        for n in before.open.keys() - state.open.keys():
            self.open.removeKey((n,))
        for n, c in state.open.items():
            self.open.updateValue((n,), (sorted(c.members), *c.centre, c.mean_length, c.mean_dist, int(c.last_seen), int(c.missing), sorted(c.datasets)))
        self.clock.update((state.met, state.opened))

    def close(self) -> None:
        pass


def walked(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The walk of streaming ``operators.drive.ticks``: frames come whole and in order; open candidates are put out after each batch.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return rows.groupBy("drive").transformWithStateInPandas(DriveProcessor(limits), outputStructType=WALKED, outputMode="Update", timeMode="None")
