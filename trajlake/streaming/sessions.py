"""Sessions with an idle timeout: in batch by gaps, in a stream by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MINUTES = 30


def sessions(events: DataFrame, key: str, ts: str, order: str, minutes: int = IDLE_MINUTES) -> DataFrame:
    """``events`` with ``session_idx``: a gap strictly longer than ``minutes`` starts the next session of a key."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {minutes} MINUTES")
    return events.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session_idx", F.sum("_new").over(w)).drop("_new")


def stream_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", minutes: int = IDLE_MINUTES, late: str = "10 minutes") -> DataFrame:
    """(key, started, ended, n) of each session of a stream, once its idle time has passed in event time."""
    width = minutes * 60_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            a, b, n = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "started": [pd.Timestamp(a, unit="ms")], "ended": [pd.Timestamp(b, unit="ms")], "n": [n]})
            return
        held, out = state.get if state.exists else None, []
        times = sorted(int(t.value // 1_000_000) for f in frames for t in f[ts])
        for t in times:
            if held and t - held[1] > width:
                out.append(held)
                held = None
            held = (t, t, 1) if held is None else (min(held[0], t), max(held[1], t), held[2] + 1)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] + width + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "started": [pd.Timestamp(x[0], unit="ms") for x in out], "ended": [pd.Timestamp(x[1], unit="ms") for x in out], "n": [x[2] for x in out]})

    kind = dict(events.dtypes)[key]
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        step, f"key {kind}, started timestamp, ended timestamp, n long", "started long, ended long, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
