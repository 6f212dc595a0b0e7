"""As-of, nearest and interpolating joins on time, by one union and one sort per key; no range join.

Ties of time stand in the order of ``seq`` where there is one. A reference row at the same time as a query row counts as
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacked(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both tables as one, with the last and the next right row of each row as structs ``prev`` and ``next``."""
    row = F.struct(F.col("t"), *values)
    a = left.withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None))
    b = right.select(*keys, "t", F.lit(0).alias("__side"), row.alias("__r"))
    both = a.drop("__r").unionByName(b, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy("t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("prev", F.last("__r", ignorenulls=True).over(back)).withColumn("next", F.last("__r", ignorenulls=True).over(ahead))
    return both.where("__side = 1").drop("__side", "__r")


def backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], within: float | None = None) -> DataFrame:
    """Each left row with the last right row at or before its time, not older than ``within``."""
    d = stacked(left, right, keys, values)
    fresh = F.lit(True) if within is None else F.col("t") - F.col("prev.t") <= within
    return d.select(*left.columns, *[F.when(fresh, F.col(f"prev.{v}")).alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], within: float) -> DataFrame:
    """Each left row with the right row nearest in time, the earlier of two as near."""
    d = stacked(left, right, keys, values)
    a, b = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
    pick = F.when(b.isNull() | (a <= b), F.col("prev")).otherwise(F.col("next"))
    near = F.least(F.coalesce(a, b), F.coalesce(b, a)) <= within
    return d.withColumn("__p", F.when(near, pick)).select(*left.columns, *[F.col(f"__p.{v}").alias(v) for v in values])


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], max_gap: float | None = 2.0, clamp: bool = False) -> DataFrame:
    """Each left row with right values on the straight line between its neighbours.

    Outside the right table's span there is no value, or with ``clamp`` that of the end; across a gap of more than
    ``max_gap`` there is none unless the time is hit exactly.
    """
    d = stacked(left, right, keys, values)
    span = F.col("next.t") - F.col("prev.t")

    def at(v: str):
        line = F.col(f"prev.{v}") + (F.col(f"next.{v}") - F.col(f"prev.{v}")) * (F.col("t") - F.col("prev.t")) / span
        hit = F.when(F.col("prev.t") == F.col("t"), F.col(f"prev.{v}")).when(F.col("next.t") == F.col("t"), F.col(f"next.{v}"))
        line = F.when(F.lit(max_gap is None) | (span <= (max_gap or 0)), line)
        ends = F.coalesce(F.col(f"prev.{v}"), F.col(f"next.{v}")) if clamp else F.lit(None).cast("double")
        return F.coalesce(hit, F.when(span.isNull(), ends).otherwise(line)).alias(v)

    return d.select(*left.columns, *[at(v) for v in values])
