"""Streets as polylines: vertices (edge, u, v, i, x, y, highway) in order of ``i``, their pieces, profiles and lookups.

Everything is keyed by edge: one street's vertices and samples are one partition's, and lookups are equi joins on edge, or
on edge and sample number, so a graph is as parallel as it has streets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.angles import wrap_angle

#: Curvature below this is noise of the arithmetic.
NOISE = 1e-9


def steps(x: Column, step: Column) -> Column:
    """How many whole steps reach ``x``; a billionth of rounding error doesn't make one more."""
    return F.ceil(F.round(x / step, 6)).cast("long")


def pieces(vertices: DataFrame) -> DataFrame:
    """edge, piece (from 0), x0, y0, x1, y1, len, a and b (way at its ends), bearing, last; pieces without length are left out."""
    w = Window.partitionBy("edge").orderBy("i")
    d = vertices.select("edge", "i", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = d.withColumn("len", F.sqrt(dx * dx + dy * dy)).where("len > 1e-9").withColumn("bearing", F.atan2(dy, dx))
    d = d.withColumn("piece", F.row_number().over(w) - 1).withColumn("b", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("a", F.coalesce(F.lag("b").over(w), F.lit(0.0))).withColumn("last", F.lead("i").over(w).isNull())
    return d.select("edge", "piece", "x0", "y0", "x1", "y1", "len", "a", "b", "bearing", "last")


def table(vertices: DataFrame, shortest: float = 0.001) -> DataFrame:
    """One row per street that is longer than ``shortest``: edge, pieces, length, bearings of its first and last piece, box."""
    box = [f(a).alias(f"{n}{a[0]}") for n, f, cols in (("lo", F.min, ("x", "y")), ("hi", F.max, ("x", "y"))) for a in cols]
    ends = vertices.groupBy("edge").agg(*box)
    p = pieces(vertices).groupBy("edge").agg(F.count("*").alias("pieces"), F.max("b").alias("length"), F.min_by("bearing", "piece").alias("first"), F.max_by("bearing", "piece").alias("final"))
    return p.where(F.col("length") > shortest).join(ends, "edge")


def at(vertices: DataFrame, places: DataFrame) -> DataFrame:
    """Points and bearings of places (edge, s) on their streets; s is kept on the street, a vertex belongs to the piece after it."""
    p = pieces(vertices)
    s = F.greatest(F.lit(0.0), F.col("s"))
    d = places.join(p, "edge").where((s >= F.col("a")) & ((s < F.col("b")) | F.col("last")))
    share = F.least(F.lit(1.0), (s - F.col("a")) / F.col("len"))
    return d.select(*places.columns, (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("y"), "bearing")


def smoothed(samples: DataFrame, value: str, half: int, sigma: float) -> DataFrame:
    """``samples`` (edge, k, n, ...) with ``smooth``: a normal curve of ``2 * half + 1`` samples over ``value``.

    Beyond an end the row goes on turned about its end point, as far as it has samples, and then level. The rows beyond
    are made first, so that each sample is one weighted sum of its neighbours in the window.
    """
    weights = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-half, half + 1)]
    total, v, k, n = sum(weights), F.col(value), F.col("k"), F.col("n")
    whole = Window.partitionBy("edge").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = samples.withColumn("__first", F.first(value).over(whole)).withColumn("__last", F.last(value).over(whole))
    spot = lambda place, x: F.struct(place.cast("long").alias("p"), x.alias("x"))
    left, right, far = 2 * F.col("__first") - v, 2 * F.col("__last") - v, n - 1
    none = F.array().cast("array<struct<p:bigint,x:double>>")
    # a row of fewer than half samples is level beyond what it has, at the value of its far end turned about
    level = lambda here, lo, hi, x: F.when(here & (far < half), F.transform(F.sequence(lo, hi), lambda p: spot(p, x))).otherwise(none)
    entries = F.concat(
        F.array(spot(k, v)),
        F.when((k >= 1) & (k <= half), F.array(spot(-k, left))).otherwise(none),
        F.when((far - k >= 1) & (far - k <= half), F.array(spot(2 * far - k, right))).otherwise(none),
        level(k == far, F.lit(-half).cast("long"), -far - 1, left),
        level(k == 0, 2 * far + 1, far + half, right),
    )
    w = Window.partitionBy("edge").orderBy("p")
    rows = d.select(*samples.columns, F.explode(entries).alias("e")).select(*samples.columns, "e.p", "e.x")
    parts = [F.lag("x", half - i).over(w) * (g / total) if i < half else F.lead("x", i - half).over(w) * (g / total) if i > half else F.col("x") * (g / total) for i, g in enumerate(weights)]
    return rows.withColumn("smooth", sum(parts[1:], parts[0])).where(F.col("p") == F.col("k")).drop("p", "x")


def slope(value: str, step: Column) -> Column:
    """Derivative along the samples of a street: central, one-sided at its ends."""
    w = Window.partitionBy("edge").orderBy("k")
    up, down, x = F.lead(value).over(w), F.lag(value).over(w), F.col(value)
    return F.coalesce((up - down) / (2 * step), (up - x) / step, (x - down) / step)


def profile(vertices: DataFrame, spacing: float = 2.0, smooth: float = 10.0, floor: float = 0.002, scale: float = 0.6) -> DataFrame:
    """edge, k, n, step, s, heading (unwrapped), kappa, grad, sigma on an even grid of each street.

    The heading is that of the piece that a sample lies on, unwrapped piece by piece and smoothed; kappa is its derivative,
    grad that of kappa; sigma grows with how far the smoothed heading departs from the polyline's. Streets of two samples
    are straight. Curvature below ``NOISE`` is zero, and so is a departure.
    """
    p = pieces(vertices)
    whole = Window.partitionBy("edge").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy("edge").orderBy("piece")
    p = p.withColumn("length", F.max("b").over(whole)).withColumn("n", F.greatest(F.lit(2).cast("long"), steps(F.col("length"), F.lit(spacing)) + 1))
    p = p.withColumn("step", F.col("length") / (F.col("n") - 1))
    turn = F.coalesce(wrap_angle(F.col("bearing") - F.lag("bearing").over(order)), F.col("bearing"))
    p = p.withColumn("turn", turn).withColumn("raw", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lo = steps(F.col("a"), F.col("step"))
    hi = F.when(F.col("last"), F.col("n") - 1).otherwise(steps(F.col("b"), F.col("step")) - 1)
    samples = p.withColumn("lo", lo).withColumn("hi", hi).where("hi >= lo").select("edge", "n", "step", "raw", F.explode(F.sequence("lo", "hi")).alias("k"))
    sigma = max(smooth / spacing, 0.5)
    half = max(1, math.ceil(3 * sigma))
    straight, step = F.col("n") <= 2, F.col("step")
    d = smoothed(samples, "raw", half, sigma).withColumn("heading", F.when(straight, F.col("raw")).otherwise(F.col("smooth"))).drop("smooth")
    d = d.withColumn("rest", F.abs(F.col("raw") - F.col("heading")))
    d = smoothed(d, "rest", half, sigma).withColumn("rough", F.when(straight, F.col("rest")).otherwise(F.col("smooth")))
    d = d.withColumn("kappa", F.when(straight, 0.0).otherwise(slope("heading", step)))
    d = d.withColumn("grad", F.when(straight, 0.0).otherwise(slope("kappa", step)))
    quiet = lambda x: F.when(F.abs(x) < NOISE, 0.0).otherwise(F.col(x)).alias(x)
    rough = F.when(F.col("rough") < NOISE, 0.0).otherwise(F.col("rough"))
    return d.select("edge", "k", "n", "step", (F.col("k") * step).alias("s"), "heading", quiet("kappa"), quiet("grad"), (floor + scale * rough / max(smooth, 1e-6)).alias("sigma"))


def looked_up(profiles: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (edge, s) with heading (wrapped), kappa, grad and sigma of the nearest sample: an equi join on edge and number."""
    sizes = profiles.where("k = 0").select("edge", "n", "step")
    s = F.greatest(F.lit(0.0), F.least(F.col("s"), F.col("step") * (F.col("n") - 1)))
    k = F.least(F.col("n") - 1, F.rint(F.round(s / F.col("step"), 6)).cast("long"))
    near = places.join(sizes, "edge").withColumn("k", k)
    return near.join(profiles.select("edge", "k", "heading", "kappa", "grad", "sigma"), ["edge", "k"]).select(*places.columns, wrap_angle(F.col("heading")).alias("heading"), "kappa", "grad", "sigma")


def cells(vertices: DataFrame, size: float = 250.0) -> DataFrame:
    """row, col, edge: the grid cells, counted from the least corner, that hold a vertex or the middle of a piece of a street."""
    low = vertices.agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    w = Window.partitionBy("edge").orderBy("i")
    middle = vertices.select("edge", ((F.col("x") + F.lead("x").over(w)) / 2).alias("x"), ((F.col("y") + F.lead("y").over(w)) / 2).alias("y")).where("x is not null")
    spots = vertices.select("edge", "x", "y").unionByName(middle).join(F.broadcast(low))  # one row
    return spots.select(F.floor((F.col("y") - F.col("ly")) / size).alias("row"), F.floor((F.col("x") - F.col("lx")) / size).alias("col"), "edge").distinct()
