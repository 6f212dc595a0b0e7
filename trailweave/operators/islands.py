"""Gaps and islands: sessions, runs of equal states, outages, stops and turns.

All work per key in order of time, in one sort; a key (a trip) is one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.geo import haversine_m


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, keys: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """``df`` with the number, from 0, of the island that each row is in; ``breaks`` is true where a new one starts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__b", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("__b").over(upto(w))).drop("__b")


def by_gap(df: DataFrame, keys: list[str], t: str, order: list, gap: float, name: str = "island") -> DataFrame:
    """Islands parted by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumn("__l", F.lag(t).over(w))
    return numbered(before, keys, order, F.coalesce(F.col(t) - F.col("__l") > gap, F.lit(False)), name).drop("__l")


def by_change(df: DataFrame, keys: list[str], order: list, value: Column, name: str = "island") -> DataFrame:
    """Islands of equal values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return numbered(df.withColumn("__v", F.lag(value).over(w)), keys, order, ~value.eqNullSafe(F.col("__v")), name).drop("__v")


def sessions(df: DataFrame, gap: float = 60.0, least: float = 60.0, top_speed: float = 60.0) -> DataFrame:
    """Sessions of each trip: start, end, fixes, moving time, way and implausible jumps; numbered without the short ones."""
    order = ["t", "seq"]
    w = Window.partitionBy("trip_id", "island").orderBy(*order)
    d = by_gap(df, ["trip_id"], "t", order, gap)
    for c in ("t", "lat", "lon", "speed"):
        d = d.withColumn(f"__{c}", F.lag(c).over(w))
    step = haversine_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    d = d.withColumn("__dt", F.col("t") - F.col("__t")).withColumn("__step", step)
    s = d.groupBy("trip_id", "island").agg(
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.count("*").alias("fixes"),
        F.coalesce(F.sum(F.when(F.col("__speed") > 1.0, F.col("__dt"))), F.lit(0.0)).alias("moving_s"),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("distance_m"),
        F.count_if(F.col("__step") > top_speed * F.greatest(F.col("__dt"), F.lit(0.05))).alias("jumps"),
    )
    s = s.where(F.col("t1") - F.col("t0") >= least)
    return s.withColumn("session", F.row_number().over(Window.partitionBy("trip_id").orderBy("t0")) - 1).drop("island")


def intervals(df: DataFrame, state: str = "state") -> DataFrame:
    """Runs of equal states: state, start, end, rows."""
    d = by_change(df, ["trip_id"], ["seq"], F.col(state))
    return d.groupBy("trip_id", "island").agg(F.first(state).alias("state"), F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("rows")).drop("island")


def outages(df: DataFrame, least: float = 1.0, after: float = 0.5) -> DataFrame:
    """Times without trust, closed by the next trusted row or the end of the trip, in seconds from the trip's start."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    d = df.withColumn("out", F.col("state") != "TRUSTED").withColumn("next", F.lead("t").over(w))
    d = d.withColumn("t0", F.min("t").over(Window.partitionBy("trip_id"))).withColumn("t_end", F.max("t").over(Window.partitionBy("trip_id")))
    d = by_change(d, ["trip_id"], ["seq"], F.col("out")).where("out")
    o = d.groupBy("trip_id", "island").agg((F.min("t") - F.first("t0")).alias("start_s"), (F.coalesce(F.max_by("next", "seq"), F.first("t_end")) - F.first("t0")).alias("end_s"), F.max_by("state", "seq").alias("state"))
    return o.where((F.round("end_s", 2) - F.round("start_s", 2) > least) & (F.round("start_s", 2) > after)).drop("island")


def motion_start(df: DataFrame, speed: float = 1.5, hold: float = 3.0) -> DataFrame:
    """Per trip, the start of the first run of fixes at ``speed`` or more that lasts ``hold``."""
    d = by_change(df.withColumn("moving", F.col("speed") >= speed), ["trip_id"], ["t", "seq"], F.col("moving")).where("moving")
    runs = d.groupBy("trip_id", "island").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where(F.col("t1") - F.col("t0") >= hold)
    return runs.groupBy("trip_id").agg(F.min("t0").alias("t"))


def stops(df: DataFrame, quiet: Column, need: int, dt: float) -> DataFrame:
    """Rows with ``stationary``: in a run of at least ``need`` quiet rows, and how long it has lasted."""
    d = by_change(df.withColumn("quiet", quiet), ["trip_id"], ["n"], F.col("quiet"))
    run = Window.partitionBy("trip_id", "island")
    d = d.withColumn("stationary", F.col("quiet") & (F.count("*").over(run) >= need))
    return d.withColumn("stopped_s", F.when(F.col("stationary"), F.row_number().over(run.orderBy("n")) * dt).otherwise(0.0)).drop("island")


def turns(df: DataFrame, dt: float, bias: float = 0.0, least_rate: float = 0.06, least_delta: float = 0.4363323129985824, max_gap: float = 1.0) -> DataFrame:
    """Turns: yaw above ``least_rate``, carried across idle runs of up to ``max_gap`` and the idle rows that end them.

    A turn goes from its first active row to the row at which it has been idle for one step more than the gap allows,
    or to the end of the trip.
    """
    steps = max(1, round(max_gap / dt))
    w = Window.partitionBy("trip_id").orderBy("n")
    d = df.withColumn("rate", F.col("yaw") - bias).withColumn("active", F.abs("rate") > least_rate)
    d = d.withColumn("last", F.max(F.when(F.col("active"), F.col("n"))).over(upto(w)))
    d = d.withColumn("inside", F.col("last").isNotNull() & (F.col("n") - F.col("last") <= steps + 1))
    d = d.withColumn("before", F.lag("last").over(w))
    starts = F.col("active") & (F.col("before").isNull() | (F.col("n") - F.col("before") > steps + 1))
    d = numbered(d, ["trip_id"], ["n"], starts).where("inside")
    out = d.groupBy("trip_id", "island").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), (F.sum("rate") * dt).alias("delta"), F.max(F.struct(F.abs("rate").alias("a"), (-F.col("n")).alias("m"), "t", "rate")).alias("p"))
    return out.where(F.abs("delta") >= least_delta).select("trip_id", "t_start", "t_end", F.col("p.t").alias("t_peak"), "delta", F.col("p.rate").alias("peak_rate"))
