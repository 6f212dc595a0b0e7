"""Live motion: bins, fixes that wait for their motion, quiet and sliding windows, on Structured Streaming.

Each takes streams with an event time ``ts`` and gives a stream; rows that come later than the watermark are dropped, and
state is dropped with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bins(stream: DataFrame, width: str = "100 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Motion samples (trip_id, ts, a, w), each time of a trip once, averaged in bins; a bin comes out once it is closed."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trip_id", "ts"])
    return once.groupBy("trip_id", F.window("ts", width).alias("bin")).agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("w").alias("w")).select("trip_id", F.col("bin.start").alias("start"), "n", "a", "w")


def aligned(fixes: DataFrame, motion: DataFrame, before: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """Each fix (trip_id, ts, ...) with the motion rows (trip_id, mts, a) of the time before it: a fix waits in state until
    the watermark of the motion has passed it."""
    f, m = fixes.withWatermark("ts", late), motion.withWatermark("mts", late)
    near = (F.col("f.trip_id") == F.col("m.trip_id")) & (F.col("mts") <= F.col("ts")) & (F.col("mts") > F.col("ts") - F.expr(f"interval {before}"))
    return f.alias("f").join(m.alias("m"), near).select("f.trip_id", "ts", "mts", "a")


def rates(stream: DataFrame, width: str, late: str = "2 seconds") -> DataFrame:
    """What one consumer is shown: the last weight of each trip per tick of its own width."""
    return stream.withWatermark("ts", late).groupBy("trip_id", F.window("ts", width).alias("tick")).agg(F.count("*").alias("n"), F.max_by("w", "ts").alias("w")).select("trip_id", F.col("tick.end").alias("at"), "n", "w")


def sliding(stream: DataFrame, width: str = "60 seconds", every: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """The parking window: slow fixes of the last minute, told again every few seconds."""
    slow = F.count_if(F.col("speed") <= 3.0)
    return stream.withWatermark("ts", late).groupBy("trip_id", F.window("ts", width, every).alias("w")).agg(F.count("*").alias("n"), slow.alias("slow"), F.max("ts").alias("last")).select("trip_id", F.col("w.end").alias("at"), "n", "slow")


def quiet(stream: DataFrame, hold: float = 1.0, least: float = 0.25, idle: str = "60 seconds", late: str = "2 seconds") -> DataFrame:
    """Samples (trip_id, ts, t, a) with ``quiet``: true once the trip has been still for ``hold`` seconds, never before.

    State is the start of the still run and the last time; a trip that is silent for ``idle`` is forgotten.
    """
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, last = state.get if state.exists else (None, None)
        out, newest = [], None
        for batch in [pd.concat(list(batches)).sort_values("t")]:
            for t, a, ts in zip(batch["t"], batch["a"], batch["ts"], strict=True):
                if last is not None and t <= last:
                    continue  # out of order or repeated
                start = None if abs(a) >= least else t if start is None else start
                last, newest = t, ts
                out.append((key[0], float(t), start is not None and t - start >= hold))
        if newest is not None:
            state.update((start, last))
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + seconds)
        yield pd.DataFrame(out, columns=["trip_id", "t", "quiet"])

    return stream.withWatermark("ts", late).groupBy("trip_id").applyInPandasWithState(run, "trip_id long, t double, quiet boolean", "start double, last double", "append", GroupStateTimeout.EventTimeTimeout)
