"""Review decisions and detections as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATUS = "ann_id long, validated boolean, removed boolean"


def latest_status(events: DataFrame, keep: str, remove: str) -> DataFrame:
    """Keyed upsert: the state of an annotation is its last decision by (ts, event_id); later batches win only
    with later events. Emits a row whenever an annotation's status is decided anew."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for rows in parts:
            for r in rows.itertuples(index=False):
                mark = (r.micros, r.event_id, r.action == remove)
                if best is None or mark[:2] > tuple(best)[:2]:
                    best = mark
        state.update(best)
        yield pd.DataFrame({"ann_id": [key[0]], "validated": [True], "removed": [bool(best[2])]})

    decided = events.where(F.col("action").isin(keep, remove)).select("ann_id", "event_id", "action", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return decided.groupBy("ann_id").applyInPandasWithState(update, STATUS, "micros long, event_id long, removed boolean", "update", GroupStateTimeout.NoTimeout)


def detections_per_window(detections: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Detections and mean score per dataset and event-time window; rows later than ``late`` are dropped."""
    return detections.withWatermark("ts", late).groupBy(F.window("ts", window), "dataset").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
