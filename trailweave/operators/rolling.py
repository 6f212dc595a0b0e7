"""Rolling windows and resampling over samples (trip_id, n, t, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centred(half: int):
    return Window.partitionBy("trip_id").orderBy("n").rowsBetween(-half, half)


def rolling_std(value: str, half: int) -> Column:
    """Centred population deviation; the window shrinks at the ends.

    The rows of a window are folded in order by Welford's rule, the mean first, as SQL engines do, so a deviation that
    stands at a threshold falls on the same side.
    """

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + 1.0
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    rows = F.collect_list(F.col(value).cast("double")).over(centred(half))
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(rows, none, add, lambda s: F.sqrt(s["m2"] / F.nullif(s["n"], F.lit(0.0))))


def rolling_mean(value: str, half: int) -> Column:
    return F.avg(value).over(centred(half))


def boxcar(value: str, width: int) -> Column:
    """Centred sum over the full width: beyond the ends there are zeros."""
    return F.sum(value).over(Window.partitionBy("trip_id").orderBy("n").rowsBetween(-(width - 1) // 2, width // 2)) / width


def trailing(aggregate: str, seconds: float, t: str = "t") -> Column:
    """An aggregate, in SQL, over the last ``seconds`` up to each row."""
    return F.expr(f"{aggregate} over (partition by trip_id order by {t} range between {seconds}D preceding and current row)")


def hampel(df: DataFrame, value: str, half: int, z: float, floor: float) -> DataFrame:
    """``df`` with spikes replaced by the median of their window, the end values standing in beyond the ends."""
    w = Window.partitionBy("trip_id").orderBy("n")
    all_ = Window.partitionBy("trip_id")
    d = df.withColumn("__w", F.collect_list(value).over(centred(half)))
    d = d.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(all_))
    d = d.withColumn("__a", F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("__z", F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    padded = F.concat(F.array_repeat("__a", F.greatest(F.lit(0), half + 1 - F.col("__i")).cast("int")), F.col("__w"), F.array_repeat("__z", F.greatest(F.lit(0), F.col("__i") + half - F.col("__n")).cast("int")))
    middle = lambda a: F.get(F.array_sort(a), half)
    d = d.withColumn("__p", padded).withColumn("__m", middle(F.col("__p")))
    d = d.withColumn("__d", middle(F.transform("__p", lambda x: F.abs(x - F.col("__m")))))
    limit = z * F.greatest(1.4826 * F.col("__d"), F.lit(floor))
    return d.withColumn("clean", F.when(F.abs(F.col(value) - F.col("__m")) > limit, F.col("__m")).otherwise(F.col(value))).drop("__w", "__i", "__n", "__a", "__z", "__p", "__m", "__d")


def resampled(df: DataFrame, step: int) -> DataFrame:
    """Bins of ``step`` samples' time (in ticks ``n``), left-closed, also where they are empty: median, peak, count."""
    span = df.groupBy("trip_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    grid = span.select("trip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(hi - lo) div {step}"))).alias("bin"))
    d = df.join(span, "trip_id").withColumn("bin", F.expr(f"(n - lo) div {step}"))
    bins = d.groupBy("trip_id", "bin").agg(F.expr("percentile(a_long, 0.5)").alias("a"), F.max(F.abs("yaw")).alias("peak"), F.count("*").alias("samples"))
    return grid.join(bins, ["trip_id", "bin"], "left").select("trip_id", "bin", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("peak", F.lit(0.0)).alias("peak"), F.coalesce("samples", F.lit(0)).alias("samples"))


def thinned(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row."""
    w = Window.partitionBy("trip_id").orderBy("n")
    return df.withColumn("__r", F.row_number().over(w) - 1).where(F.col("__r") % step == 0).drop("__r")
