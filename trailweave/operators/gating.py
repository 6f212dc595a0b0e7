"""Gates over fixes, intervals and routes: every reason is kept, none stops the next test.

A gate that compares a fix with the last good one takes it from a window over the trip, so one trip is one task; all else
is a column expression or a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import gates
from trailweave.functions.angles import course_to_heading, wrap_angle


def reasons(*tests: tuple[str, Column]) -> Column:
    """The names of the tests that hold, in order, joined by commas; empty if none does."""
    return F.array_join(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda r: r.isNotNull()), ",")


def last_good(df: DataFrame, good: Column, columns: list[str], order: str = "seq") -> DataFrame:
    """``df`` with ``last_*``: the columns of the trip's last row before this one that is good; null if there is none."""
    w = Window.partitionBy("trip_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(good, F.struct(*columns)), ignorenulls=True).over(w)
    out = df.withColumn("__last", last)
    return out.select(*df.columns, *[F.col("__last")[name].alias(f"last_{name}") for name in columns])


def gated(df: DataFrame, good: Column, simulated: Column, max_speed_error: float = 8.0, min_speed: float = 3.0, max_course_error: float = 60.0, threshold: float = 9.21) -> DataFrame:
    """Fixes (east, north, t, speed, course, acc) with ``why``: what the six gates say against the last good fix, whose
    speed and course predict where this one should be."""
    rows = last_good(df, good & ~simulated, ["t", "east", "north", "speed", "course", "acc"])
    dt = F.col("t") - F.col("last_t")
    # headings stay unwrapped, the turn between them is wrapped once, so that a turn of just the limit falls as in SQL
    psi = F.radians(90.0 - F.col("last_course"))
    far = F.hypot(F.col("east") - F.col("last_east"), F.col("north") - F.col("last_north"))
    rx = F.col("east") - F.col("last_east") - F.col("last_speed") * dt * F.cos(psi)
    ry = F.col("north") - F.col("last_north") - F.col("last_speed") * dt * F.sin(psi)
    s = F.pow(gates.measurement_sigma(F.col("acc")), 2) + F.pow(gates.measurement_sigma(F.col("last_acc")) + 2.0 * dt, 2)
    turned = F.abs(F.degrees(wrap_angle(F.radians(90.0 - F.col("course")) - psi)))
    fast = (F.col("speed") >= min_speed) & (F.col("last_speed") >= min_speed)
    return rows.withColumn(
        "why",
        reasons(
            ("invalid_fix", ~good),
            ("simulated_by_software", simulated),
            ("physical_gate", far > gates.reach(dt, F.col("last_speed"))),
            ("mahalanobis_gate", F.col("last_t").isNotNull() & (gates.mahalanobis(rx, ry, s, F.lit(0.0), s) > threshold)),
            ("speed_mismatch", F.abs(F.col("speed") - F.col("last_speed")) > max_speed_error),
            ("course_mismatch", fast & (turned > max_course_error)),
        ),
    )


def fix_to_fix(df: DataFrame, good: Column, lost_gap: float = 5.0, speed_slack: float = 6.0, min_step: float = 4.0, min_speed: float = 3.0, max_course_error: float = 55.0) -> DataFrame:
    """Fixes with ``why``: whether speed and course that the fix reports fit the step from the last good one. After a longer
    gap than ``lost_gap`` a step says nothing, and noise of the two places counts by the second between them."""
    rows = last_good(df, good, ["t", "east", "north", "acc"])
    dt = F.col("t") - F.col("last_t")
    dx, dy = F.col("east") - F.col("last_east"), F.col("north") - F.col("last_north")
    step, noise = F.hypot(dx, dy), F.hypot(gates.measurement_sigma(F.col("acc")), gates.measurement_sigma(F.col("last_acc")))
    told = (dt > 0) & (dt <= lost_gap)
    pace = F.try_divide(step, dt)
    off = F.abs(F.degrees(wrap_angle(course_to_heading(F.col("course")) - F.atan2(dy, dx))))
    return rows.withColumn(
        "why",
        reasons(
            ("out_of_order", dt <= 0),
            ("speed_inconsistent_with_previous_fix", told & (F.abs(F.col("speed") - pace) > speed_slack + F.try_divide(2 * noise, dt))),
            ("course_inconsistent_with_previous_fix", told & (step >= F.greatest(F.lit(min_step), 2 * noise)) & (pace >= min_speed) & (off > max_course_error)),
        ),
    )


def shocks(df: DataFrame, shock: Column, hold: float = 1.0, recovery: float = 5.0, gain: float = 0.5) -> DataFrame:
    """Steps (trip_id, n, t) with ``shaken``, for ``hold`` seconds from each shock on, and the trust in yaw for
    ``recovery`` seconds after that."""
    w = Window.partitionBy("trip_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    until = F.max(F.when(shock, F.col("t") + hold)).over(w)
    rows = df.withColumn("shaken", F.coalesce(F.col("t") <= until, F.lit(False)))
    return rows.withColumn("yaw_trust", F.when(~F.col("shaken") & (F.col("t") <= until + recovery), gain).otherwise(1.0))


def terminal_cluster(df: DataFrame, window: float = 30.0, low_speed: float = 3.0, least: int = 3, radius: float = 35.0) -> DataFrame:
    """trip_id, n, east, north: where slow fixes of a trip's last seconds lie, weighted by accuracy; trips without enough go."""
    end = F.max("t").over(Window.partitionBy("trip_id"))
    tail = df.withColumn("end", end).where((F.col("t") >= F.col("end") - window) & (F.col("speed") <= low_speed))
    middle = tail.groupBy("trip_id").agg(F.expr("percentile(east, 0.5)").alias("me"), F.expr("percentile(north, 0.5)").alias("mn"), F.count("*").alias("all"))
    kept = tail.join(middle.where(F.col("all") >= least), "trip_id").where(F.hypot(F.col("east") - F.col("me"), F.col("north") - F.col("mn")) <= radius)
    w = 1 / F.pow(F.greatest(F.col("acc"), F.lit(5.0)), 2)
    mean = lambda x: F.sum(w * F.col(x)) / F.sum(w)
    return kept.groupBy("trip_id").agg(F.count("*").alias("n"), mean("east").alias("east"), mean("north").alias("north")).where(F.col("n") >= least)


def corroborated(routes: DataFrame, keys: list[str], least_mass: float = 0.02, least_routes: int = 2, spread: float = 0.06, floor: float = 12.0, majority: float = 0.5, effective: float = 1.5) -> DataFrame:
    """The drift that several routes agree on: routes (keys, route, w, y), one row per hypothesis.

    Hypotheses on one route count once, by their mass. For each route's drift the routes within a tolerance of it are
    summed by a range frame over the sorted drifts; the heaviest such cluster wins, the least drift among equals.
    """
    w = F.col("w")
    each = routes.where(w > 0).groupBy(*keys, "route").agg(F.sum(w).alias("w"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y")).where(w >= least_mass)
    # the tolerance goes by the seed, so a range frame can't hold it: the routes of one moment are few and go into one array
    few = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "w"))).alias("all"))
    seeds = few.withColumn("seed", F.explode("all"))
    tolerance = F.greatest(spread * F.greatest(F.abs("seed.y"), F.lit(1.0)), F.lit(floor))
    seeds = seeds.withColumn("near", F.filter("all", lambda r: F.abs(r["y"] - F.col("seed.y")) <= tolerance))
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, r: a + f(r))
    seeds = seeds.withColumn("mass", total("near", lambda r: r["w"]))
    best = seeds.groupBy(*keys).agg(F.max_by(F.struct("near", "mass", F.size("all").alias("routes")), F.struct(F.round("mass", 9), -F.col("seed.y"))).alias("b")).select(*keys, "b.*")
    best = best.withColumn("drift", total("near", lambda r: r["w"] * r["y"]) / F.col("mass"))
    best = best.withColumn("effective", F.col("mass") * F.col("mass") / total("near", lambda r: r["w"] * r["w"]))
    why = F.when(F.col("routes") < least_routes, "too few routes").when(F.col("mass") < majority, "too little mass").when(F.size("near") < least_routes, "a single route").when(F.col("effective") < effective, "too few effective routes")
    return best.select(*keys, "routes", F.size("near").alias("agreeing"), "mass", "drift", "effective", why.alias("why"))


def agreed_length(lengths: DataFrame, keys: list[str], spread: float = 0.06, floor: float = 12.0, majority: float = 0.5, shortest: float = 40.0, longest: float = 3000.0) -> DataFrame:
    """Whether the routes over an interval agree with the heaviest of them: lengths (keys, route, w, length)."""
    first = lengths.groupBy(*keys).agg(F.max_by("length", F.struct("w", -F.col("route"))).alias("centre"), F.count("*").alias("routes"))
    near = F.abs(F.col("length") - F.col("centre")) <= F.greatest(spread * F.greatest(F.abs("centre"), F.lit(1.0)), F.lit(floor))
    sums = lengths.join(first, keys).groupBy(*keys).agg(F.first("routes").alias("routes"), F.sum(F.when(near, F.col("w"))).alias("mass"), F.count_if(near).alias("agreeing"), (F.sum(F.when(near, F.col("w") * F.col("length"))) / F.sum(F.when(near, F.col("w")))).alias("mean"))
    why = F.when(F.col("routes") < 2, "only one hypothesis").when(F.col("mass") < majority, "route mass").when(~F.col("mean").between(shortest, longest), "length")
    return sums.select(*keys, "routes", "agreeing", "mass", F.col("mean").alias("length"), why.alias("why"))


def interval_reason(length: Column, duration: Column, drift: Column, a_ok: Column, b_ok: Column, unsure: Column, forks: Column, rolled_back: Column, single: Column) -> Column:
    """The first rule that an interval between two turns breaks; null if it keeps all."""
    return (
        F.when(~length.between(40.0, 20000.0), "length")
        .when(duration > 1800.0, "duration")
        .when(F.abs(drift) > 120.0, "drift")
        .when(~a_ok, "endpoint A")
        .when(~b_ok, "endpoint B")
        .when(unsure > 0, "low-confidence junction inside")
        .when(forks > 0, "unresolved fork upstream")
        .when(rolled_back, "rollback inside")
        .when(~single, "not a single chain")
    )


def divergence(no_truth: Column, first: Column, candidate: Column, gap: Column, error: Column, in_tolerance: Column) -> Column:
    """Why a decision at a junction left the true route: a decision table over what was known at that moment."""
    late = F.coalesce((gap > 8.0) & (F.abs(error) > 40.0), F.lit(False))
    lag = F.coalesce(F.abs(error) > 60.0, F.lit(False))
    return (
        F.when(no_truth & first, "seed")
        .when(no_truth, "diverged earlier")
        .when(~candidate & (late | lag | ~in_tolerance), "junction timing mismatch")
        .when(~candidate, "successor not generated")
        .when(late, "temporal misalignment")
        .otherwise("out-scored on the turn angle")
    )
