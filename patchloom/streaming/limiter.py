"""A sliding-window rate limiter by identity: hits that it rejects don't count against the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "identity string, hit_id long, ts timestamp, allowed boolean"


def admit(times: list[float], now: float, window: float, most: int) -> bool:
    """Whether a hit is let through; times holds those let through, oldest first, and is changed in place."""
    while times and times[0] <= now - window:
        times.pop(0)
    if len(times) >= most:
        return False
    times.append(now)
    return True


def limited(hits: DataFrame, most: int = 30, window: float = 60.0) -> DataFrame:
    """identity, hit_id, ts to the same with ``allowed``. The state is at most ``most`` times an identity, and it goes
    once the watermark is a window past the last of them. Hits of a batch are taken in order of ts, then hit_id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        batch = pd.concat(frames).sort_values(["ts", "hit_id"])
        allowed = [admit(times, t.timestamp(), window, most) for t in batch["ts"]]
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(int((times[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield batch.assign(identity=key[0], allowed=allowed)[["identity", "hit_id", "ts", "allowed"]]

    late = f"{int(window)} seconds"
    return hits.withWatermark("ts", late).groupBy("identity").applyInPandasWithState(step, SCHEMA, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
