"""Faults put into tracks of fixes: (kind, start, end, east, north), with east and north a rate for drifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def during(fault: tuple) -> Column:
    return (F.col("t") >= fault[1]) & (F.col("t") < fault[2])


def covered(df: DataFrame, faults: list[tuple]) -> DataFrame:
    """A row for each fix and fault that covers it, with the fault's kind."""
    kinds = F.filter(F.array(*[F.when(during(f), f[0]) for f in faults]), lambda k: k.isNotNull())
    return df.withColumn("kind", F.explode(kinds))


def injected(df: DataFrame, faults: list[tuple]) -> DataFrame:
    """Fixes with all offsets and drifts added and dropped fixes gone; what was touched is marked synthetic."""
    east, north, touched, gone = F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(False)
    for f in faults:
        if f[0] == "dropout":
            gone |= during(f)
            continue
        scale = F.col("t") - f[1] if f[0] == "drift" else F.lit(1.0)
        east, north, touched = east + F.when(during(f), f[3] * scale).otherwise(0.0), north + F.when(during(f), f[4] * scale).otherwise(0.0), touched | during(f)
    return df.where(~gone).withColumns({"east": F.col("east") + east, "north": F.col("north") + north, "synthetic": F.col("synthetic") | touched})


def false_recovery(df: DataFrame, start: float, count: int, sigma: float = 250.0) -> DataFrame:
    """The first ``count`` fixes from ``start`` on, as false ones of shrinking sigma."""
    w = Window.partitionBy("trip_id").orderBy("t", "seq")
    d = df.where(F.col("t") >= start).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
    return d.withColumn("acc", sigma / (1 + F.col("rank"))).withColumn("synthetic", F.lit(True))


def composite(start: float, offset: float, dropout: float, east: float, north: float) -> list[tuple]:
    """An offset, then a dropout; a false recovery is to follow at the end of the latter."""
    return [("offset", start, start + offset, east, north), ("dropout", start + offset, start + offset + dropout, 0.0, 0.0)]
