"""Scores of a run against its reference: branches, recovery, survival, distance, authority.

Everything is a grouped aggregate or a window over one trip; what a whole table is reduced to is combined from partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by_change


def branch_accuracy(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Per trip, the share of ticks whose likeliest branch holds the reference, and of those where one of three does:
    branches (trip_id, keys, branch, p, hit)."""
    order = Window.partitionBy("trip_id", *keys).orderBy(F.col("p").desc(), "branch")
    ticks = branches.withColumn("rank", F.row_number().over(order)).groupBy("trip_id", *keys)
    ticks = ticks.agg(F.max((F.col("hit") & (F.col("rank") == 1)).cast("int")).alias("top1"), F.max((F.col("hit") & (F.col("rank") <= 3)).cast("int")).alias("top3"), F.count("*").alias("n"))
    return ticks.groupBy("trip_id").agg(F.avg("top1").alias("top1"), F.avg("top3").alias("top3"), F.count("*").alias("ticks"), F.avg("n").alias("mean_branches"), F.max("n").alias("max_branches"))


def recoveries(history: DataFrame) -> DataFrame:
    """trip_id, t, seconds: for each return to TRUSTED after a LOST, from the first accepted fix after the LOST on.

    A run begins with each LOST; its first accepted fix starts the clock and its first TRUSTED from then on stops it. A
    TRUSTED before any fix was accepted ends nothing.
    """
    upto = Window.partitionBy("trip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col("state") == "LOST"
    rows = history.withColumn("run", F.sum(lost.cast("int")).over(upto)).where((F.col("run") > 0) & ~lost)
    within = Window.partitionBy("trip_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.min(F.when(F.col("accepted"), F.col("t"))).over(within))
    back = rows.where(F.col("start").isNotNull() & (F.col("state") == "TRUSTED"))
    back = back.groupBy("trip_id", "run").agg(F.min_by(F.struct("t", "start"), "seq").alias("b"))
    return back.select("trip_id", F.col("b.t").alias("t"), (F.col("b.t") - F.col("b.start")).alias("seconds"))


def survival(frames: DataFrame, near: float = 25.0) -> DataFrame:
    """Per trip: frames (trip_id, ranked edges ``top``, truth, error, covered) scored by whether the truth is still held."""
    held = lambda k: F.avg(F.array_contains(F.slice("top", 1, k), F.col("truth")).cast("double"))
    return frames.groupBy("trip_id").agg(
        F.count("*").alias("ticks"), F.avg(F.array_contains("top", F.col("truth")).cast("double")).alias("alive"), *[held(k).alias(f"top{k}") for k in (1, 3, 5)],
        F.avg((F.col("error") <= near).cast("double")).alias("near"), F.avg("error").alias("mean"), F.expr("percentile(error, 0.5)").alias("median"), F.expr("percentile(error, 0.95)").alias("p95"), F.max("error").alias("worst"), F.avg(F.col("covered").cast("double")).alias("coverage"),
    )


def deaths(frames: DataFrame, window: float = 10.0) -> DataFrame:
    """Per trip: when the true edge is first lost, when for good, and how many frames it was held in the seconds before."""
    w = Window.partitionBy("trip_id")
    rows = frames.withColumn("alive", F.array_contains("top", F.col("truth")))
    rows = rows.withColumn("last_alive", F.max(F.when(F.col("alive"), F.col("t"))).over(w)).withColumn("first", F.min(F.when(~F.col("alive"), F.col("t"))).over(w))
    gone = F.min(F.when(F.col("last_alive").isNull() | (F.col("t") > F.col("last_alive")), F.col("t")))
    before = F.count_if(F.col("alive") & (F.col("t") < F.col("first")) & (F.col("t") >= F.col("first") - window))
    return rows.groupBy("trip_id").agg(F.first("first").alias("first_loss"), gone.alias("permanent_loss"), F.when(F.first("first").isNotNull(), before).alias("held_before"))


def calibration(trace: DataFrame) -> DataFrame:
    """Per trip: trace (trip_id, seq, t, way, sigma, true_speed, dt) of distances against the sum of true speeds."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = trace.withColumn("sum", F.sum(F.col("true_speed") * F.col("dt")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("truth", F.col("sum") - F.first("sum").over(whole) + F.first("way").over(whole)).withColumn("error", F.col("way") - F.col("truth")).withColumn("z", F.abs(F.try_divide(F.col("error"), F.col("sigma"))))
    last = lambda x: F.max_by(x, "seq")
    share = lambda k: F.avg(F.coalesce(F.col("z") <= k, F.lit(False)).cast("double"))
    ratio = F.when(F.abs(last("truth")) > 1, last("way") / last("truth"))
    return rows.groupBy("trip_id").agg(ratio.alias("ratio"), F.avg(F.abs("error")).alias("mean"), F.expr("percentile(abs(error), 0.5)").alias("median"), F.max(F.abs("error")).alias("worst"), share(1.0).alias("within1"), share(2.0).alias("within2"), F.expr("percentile(z, 0.5)").alias("median_z"))


def authority(updates: DataFrame) -> DataFrame:
    """Per source of measurements: updates (trip_id, seq, kind, residual, gain) with error figures and the longest run of one kind."""
    runs = by_change(updates, ["trip_id"], [F.col("seq")], F.col("kind"), "run").groupBy("trip_id", "run", "kind").agg(F.count("*").alias("n"))
    longest = runs.groupBy("kind").agg(F.max("n").alias("longest"))
    sums = updates.groupBy("kind").agg(F.count("*").alias("n"), F.avg("residual").alias("bias"), F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(F.pow("residual", 2))).alias("rmse"), F.avg("gain").alias("gain"), F.sum(F.col("gain") * F.col("residual")).alias("moved"))
    return sums.join(longest, "kind")


def attribution(updates: DataFrame, bin_: Column) -> DataFrame:
    """Per trip and interval: what each kind of update moved the estimate, and what of the whole change none explains:
    updates (trip_id, seq, kind, moved, value)."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = updates.withColumn("bin", bin_).withColumn("step", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))
    return rows.groupBy("trip_id", "bin").agg(F.sum("step").alias("change"), F.sum(F.when(F.col("kind") == "gps", F.col("moved")).otherwise(0.0)).alias("by_gps"), F.sum(F.when(F.col("kind") != "gps", F.col("moved")).otherwise(0.0)).alias("by_others"), (F.sum("step") - F.sum("moved")).alias("unexplained"))


def run_errors(rows: DataFrame, bands: tuple[float, ...], long: tuple[float, ...]) -> DataFrame:
    """Errors of two odometers along each trip: rows (trip_id, seq, t, true, route, pos), all ways so far.

    Medians, the 95th percentile and the largest error of both, the largest lead and lag of ``pos``, its shares below each of
    ``bands`` and beyond the last two of ``long``, the longest run above each of ``long`` in seconds (rows times the middle step), and
    the share of rows at which ``pos`` is the closer.
    """
    col = F.col
    d = rows.withColumn("er", F.abs(col("route") - col("true"))).withColumn("ep", F.abs(col("pos") - col("true"))).withColumn("sp", col("pos") - col("true"))
    w = Window.partitionBy("trip_id").orderBy("seq")
    d = d.withColumn("dt", col("t") - F.lag("t").over(w))
    share = lambda x: F.avg(x.cast("double"))
    named = lambda x: str(int(x))
    out = [F.median("er").alias("med_route"), F.median("ep").alias("med_pos"), F.percentile("er", 0.95).alias("p95_route"), F.percentile("ep", 0.95).alias("p95_pos"), F.max("er").alias("max_route"), F.max("ep").alias("max_pos"), F.max("sp").alias("lead"), F.min("sp").alias("lag")]
    out += [share(col("ep") < b).alias(f"below_{named(b)}") for b in bands] + [share(col("ep") >= b).alias(f"from_{named(b)}") for b in long] + [share(col("ep") < col("er")).alias("closer"), F.median("dt").alias("step")]
    result = d.groupBy("trip_id").agg(*out)
    for b in long:
        over = col("ep") > b
        g = d.withColumn("over", over).withColumn("run", F.sum((~over).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        longest = g.where("over").groupBy("trip_id", "run").agg(F.count("*").alias("n")).groupBy("trip_id").agg(F.max("n").alias("n"))
        result = result.join(longest, "trip_id", "left").withColumn(f"run_{named(b)}", F.coalesce(col("n") * col("step"), F.lit(0.0))).drop("n")
    return result.drop("step")
