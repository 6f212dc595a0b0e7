"""Motion along a trip: attitude, smoothing, windows and the recursions that no window expresses.

One trip is one task throughout. Only a step that depends on what the step before decided (thinning, leaky sums, the
filter) is a kernel over the rows of a trip; the rest are window functions and arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_trip():
    return Window.partitionBy("trip_id").orderBy("n")


def thinned(df: DataFrame, spacing: float) -> DataFrame:
    """The rows (trip_id, seq, t) that are at least ``spacing`` seconds after the last row kept."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "seq"])
        kept, last = [], -np.inf
        for t in group["t"]:
            kept.append(t - last >= spacing)
            last = t if kept[-1] else last
        return group[kept]

    return df.select("trip_id", "seq", "t").groupBy("trip_id").applyInPandas(run, df.select("trip_id", "seq", "t").schema)


def leaky(df: DataFrame, value: str, tau: float) -> DataFrame:
    """Rows (trip_id, n, t) with ``leaky``: the sum of value * dt that decays with ``tau``; steps are clipped to it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        dt = np.clip(np.diff(group["t"], prepend=group["t"].iloc[0]), 0.0, tau)
        out, carry = np.empty(len(group)), 0.0
        for i, (x, d) in enumerate(zip(group[value], dt, strict=True)):
            carry = carry * np.exp(-d / tau) + x * d
            out[i] = carry
        return pd.DataFrame({"trip_id": group["trip_id"], "n": group["n"], "leaky": out})

    return df.select("trip_id", "n", "t", value).groupBy("trip_id").applyInPandas(run, "trip_id long, n long, leaky double")


def gradient(x: Column, t: Column) -> Column:
    """Derivative by central differences for uneven steps, one-sided at the ends; null for a single row."""
    w = by_trip()
    before, after = t - F.lag(t).over(w), F.lead(t).over(w) - t
    down, up = F.lag(x).over(w), F.lead(x).over(w)
    middle = (before * before * up + (after * after - before * before) * x - after * after * down) / (before * after * (before + after))
    return F.coalesce(middle, (up - x) / after, (x - down) / before)


def angular_velocity(df: DataFrame) -> DataFrame:
    """Rows (trip_id, n, t, q of w, x, y, z) with wx, wy, wz: the body rates of the attitudes, 2 * conj(q) * dq/dt.

    q and -q are one attitude, so signs are made continuous first: each turn of sign flips all that follows.
    """
    size = F.sqrt(sum(F.pow(F.col("q")[i], 2) for i in range(4)))
    rows = df.withColumn("q", F.transform("q", lambda v: v / size))
    last = F.lag("q").over(by_trip())
    turn = sum(F.col("q")[i] * last[i] for i in range(4)) < 0
    rows = rows.withColumn("turn", F.coalesce(turn, F.lit(False)).cast("int"))
    odd = F.sum("turn").over(by_trip().rowsBetween(Window.unboundedPreceding, 0)) % 2
    rows = rows.withColumn("s", 1 - 2 * odd).select("trip_id", "n", "t", *[(F.col("q")[i] * F.col("s")).alias(k) for i, k in enumerate("abcd")])
    a, b, c, d = F.col("a"), -F.col("b"), -F.col("c"), -F.col("d")
    rows = rows.select("*", *[gradient(F.col(k), F.col("t")).alias(f"d{k}") for k in "abcd"])
    da, db, dc, dd = (F.coalesce(f"d{k}", F.lit(0.0)) for k in "abcd")
    out = {"wx": a * db + b * da + c * dd - d * dc, "wy": a * dc - b * dd + c * da + d * db, "wz": a * dd + b * dc - c * db + d * da}
    return rows.select("trip_id", "n", *[(2 * v).alias(k) for k, v in out.items()])


def padded_mean(value: str, half: int) -> Column:
    """Mean of 2 * half + 1 rows about each, the first and last value standing in for rows beyond the ends."""
    w = by_trip()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    left, right = F.greatest(F.lit(0), half - i), F.greatest(F.lit(0), half - (n - 1 - i))
    inside = F.sum(value).over(w.rowsBetween(-half, half))
    return (inside + left * F.first(value).over(whole) + right * F.last(value).over(whole)) / (2 * half + 1)


def gaussian(df: DataFrame, value: str, sigma: float) -> DataFrame:
    """trip_id, n, smooth: weighted by a normal curve cut at three sigma, the row mirrored at its ends without its end point."""
    half = max(1, int(round(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel = F.array(*[F.lit(float(x)) for x in weights / weights.sum()])
    rows = df.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("v")))).alias("a"))
    size = F.size("a")

    def at(i: Column) -> Column:
        turned = F.pmod(i, F.greatest(F.lit(1), 2 * (size - 1)))
        return F.get(F.col("a"), F.least(turned, 2 * (size - 1) - turned))["v"]

    smooth = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * half)), F.lit(0.0), lambda acc, j: acc + F.get(kernel, j) * at(i + j - half))
    out = rows.withColumn("out", F.transform("a", lambda e, i: F.struct(e["n"].alias("n"), smooth(i).alias("smooth"))))
    return out.select("trip_id", F.explode("out").alias("o")).select("trip_id", "o.n", "o.smooth")


def redistributed(df: DataFrame, moving: float = 2.0) -> DataFrame:
    """trip_id, seq, way, speed: jumps of the distance at anchors spread back over the moving time before them.

    Rows are (trip_id, seq, t, way, speed, jump), ``jump`` null but at anchors. A jump is shared by the moving rows since
    the anchor before, by their time steps; it has no effect from its anchor on, where the estimate already holds it.
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = df.withColumn("dt", F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("t") - F.lag("t").over(w)))).withColumn("dt", F.coalesce("dt", F.lead("dt").over(w)))
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("jump").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumn("at_anchor", F.col("jump").isNotNull())
    ahead = F.first("jump", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    part = Window.partitionBy("trip_id", "part").orderBy("seq")
    busy = (F.col("speed") > moving) & ~F.col("at_anchor")
    rows = rows.withColumn("ahead", ahead).withColumn("busy", F.when(busy, F.col("dt")).otherwise(0.0))
    total = F.sum("busy").over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("share", F.coalesce(F.try_divide(F.col("ahead") * F.col("busy"), total), F.lit(0.0)))
    run = F.sum("share").over(part.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("trip_id", "seq", (F.col("way") + run).alias("way"), (F.col("speed") + F.coalesce(F.try_divide("share", "dt"), F.lit(0.0))).alias("speed"))


def dead_reckoned(df: DataFrame, accel_sigma: float = 0.8, yaw_sigma: float = 0.03, speed_sigma: float = 1.0) -> DataFrame:
    """trip_id, seq, east, north, speed, heading, sigma: an extended Kalman filter over the state (e, n, v, psi, ba, bw).

    Rows (trip_id, seq, dt, a, w, east, north, acc, speed) in order of ``seq``; a null position is predicted only. The mean
    moves by the middle heading of the step, the covariance by the derivatives of that step; positions correct by their
    accuracy and speeds by ``speed_sigma``. The covariance is kept symmetric by the Joseph form.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        x, p, out = None, np.diag([25.0, 25.0, 25.0, 1.0, 0.04, 0.0004]), []
        for r in group.itertuples(index=False):
            if x is None:
                x = np.array([np.nan_to_num(r.east), np.nan_to_num(r.north), np.nan_to_num(r.speed), 0.0, 0.0, 0.0])
            dt, a, w = r.dt, r.a - x[4], r.w - x[5]
            middle, step = x[3] + 0.5 * w * dt, max(0.0, x[2] * dt + 0.5 * a * dt * dt)
            c, s = np.cos(middle), np.sin(middle)
            f = np.eye(6)
            f[0, 2:] = dt * c, -step * s, -0.5 * dt * dt * c, 0.5 * dt * step * s
            f[1, 2:] = dt * s, step * c, -0.5 * dt * dt * s, -0.5 * dt * step * c
            f[2, 4], f[3, 5] = -dt, -dt
            x = np.array([x[0] + step * c, x[1] + step * s, max(0.0, x[2] + a * dt), x[3] + w * dt, x[4], x[5]])
            g = np.array([[0.5 * dt * dt * c, 0], [0.5 * dt * dt * s, 0], [dt, 0], [0, dt], [0, 0], [0, 0]])
            p = f @ p @ f.T + g @ np.diag([accel_sigma**2, yaw_sigma**2]) @ g.T + np.diag([0, 0, 0, 0, 1e-4, 1e-6]) * dt
            for h, z, sd in ((0, r.east, r.acc), (1, r.north, r.acc), (2, r.speed, speed_sigma)):
                if z == z and z is not None:
                    k = p[:, h] / (p[h, h] + sd * sd)
                    x = x + k * (z - x[h])
                    j = np.eye(6)
                    j[:, h] -= k
                    p = j @ p @ j.T + np.outer(k, k) * sd * sd
            x[3] = np.arctan2(np.sin(x[3]), np.cos(x[3]))
            out.append((r.trip_id, r.seq, *x[:4], float(np.sqrt(np.linalg.eigvalsh(p[:2, :2])[1]))))
        return pd.DataFrame(out, columns=["trip_id", "seq", "east", "north", "speed", "heading", "sigma"])

    rows = df.select("trip_id", "seq", "dt", "a", "w", "east", "north", "acc", "speed")
    return rows.groupBy("trip_id").applyInPandas(run, "trip_id long, seq long, east double, north double, speed double, heading double, sigma double")


def nudged(heading: Column, target: Column, gain: float) -> Column:
    """The heading moved a share of the way to the target, the short way round."""
    turn = target - heading
    return heading + gain * F.atan2(F.sin(turn), F.cos(turn))
