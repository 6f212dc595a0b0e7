"""Live variants on Structured Streaming: trust with state per trip, and sessions closed by silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailweave.operators.trust import Monitor

STATE = "state string, rejected int, accepted int, last double"


def trust(stream: DataFrame, late: str = "10 seconds", gap: float = 5.0, idle: int = 3600) -> DataFrame:
    """State after each fix (trip_id, ts, t, accepted); fixes older than the last of their trip are marked late and change nothing.

    A trip that is silent for ``idle`` seconds of event time is told to be LOST, ``gap`` seconds after its last fix, and its
    state is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[3]
            state.remove()
            yield pd.DataFrame([(key[0], last + gap, False, "LOST", False)], columns=["trip_id", "t", "accepted", "state", "late"])
            return
        monitor = Monitor(gap=gap)
        if state.exists:
            monitor.state, monitor.rejected, monitor.accepted, monitor.last = state.get
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, ok in zip(rows["t"], rows["accepted"], strict=True):
            late_row = monitor.last is not None and t < monitor.last
            if not late_row:
                monitor.silent(t)
                monitor.update(t, bool(ok))
            out.append((key[0], float(t), bool(ok), monitor.state, late_row))
        state.update((monitor.state, monitor.rejected, monitor.accepted, monitor.last))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle * 1000)
        yield pd.DataFrame(out, columns=["trip_id", "t", "accepted", "state", "late"])

    return stream.withWatermark("ts", late).groupBy("trip_id").applyInPandasWithState(run, "trip_id long, t double, accepted boolean, state string, late boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(stream: DataFrame, gap: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Sessions per trip, each given out once silence has closed it."""
    s = stream.withWatermark("ts", late).groupBy("trip_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("fixes"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return s.select("trip_id", "start", "end", "fixes")
