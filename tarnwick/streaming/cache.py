"""Streaming forms of the keyed state: a read-through cache and a seen flag, both with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwick.operators.state import TTL


def _flags(refresh: bool, ttl: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        until = state.get[0] if state.exists else float("-inf")
        hits = []
        for t in rows["t"]:
            hits.append(t < until)
            if refresh or t >= until:
                until = t + ttl
        state.update((until,))
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(hit=hits)[["event_id", "key", "t", "hit"]]

    return run


def flags(events: DataFrame, key: str = "key", ttl: int = TTL, refresh: bool = False, late: str = "1 hour") -> DataFrame:
    """(event_id, key, t, hit) of a stream (event_id, key, ts timestamp); state of a key ends with its time to live."""
    stream = events.withWatermark("ts", late).select(F.col("event_id").cast("long"), F.col(key).cast("string").alias("key"), (F.unix_micros("ts") / 1_000_000).alias("t"), "ts")
    return stream.groupBy("key").applyInPandasWithState(_flags(refresh, ttl), "event_id long, key string, t double, hit boolean", "until double", "append", GroupStateTimeout.EventTimeTimeout)
