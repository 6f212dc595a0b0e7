"""Honest scores of models: leave-one-group-out ridge, ridge on intervals, rank tests and a bootstrap, each by aggregates.

A ridge needs only sums of products, so the model that has not seen a group is that of all sums less the group's: one pass
over the rows whatever the number of folds. Only those sums, a few numbers for each group, go through numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def names(features: list[str], target: str) -> list[str]:
    terms = [*features, target]
    return ["n", *[f"s_{a}" for a in terms], *[f"p_{a}_{b}" for i, a in enumerate(terms) for b in terms[i:]]]


def moments(df: DataFrame, keys: list[str], features: list[str], target: str, weight: Column | None = None) -> DataFrame:
    """Sums (weighted) of the features and the target, and of their products, by ``keys``."""
    w, terms = F.lit(1.0) if weight is None else weight, [*features, target]
    sums = [F.sum(w).alias("n"), *[F.sum(w * C(a)).alias(f"s_{a}") for a in terms], *[F.sum(w * C(a) * C(b)).alias(f"p_{a}_{b}") for i, a in enumerate(terms) for b in terms[i:]]]
    return df.groupBy(*keys).agg(*sums)


def ridge_of(row, features: list[str], target: str, penalty: float, floor: float | None) -> tuple[float, list[float]]:
    """Intercept and coefficients of a ridge from sums. Features are standardised, a spread below ``floor`` counts as it; with
    ``floor`` None they are taken as they are."""
    terms, k = [*features, target], len(features)
    mean = np.array([getattr(row, f"s_{a}") for a in terms]) / row.n
    product = lambda i, j: getattr(row, f"p_{terms[min(i, j)]}_{terms[max(i, j)]}") / row.n - mean[i] * mean[j]
    cov = np.array([[product(i, j) for j in range(k + 1)] for i in range(k)])
    sd = np.sqrt(np.maximum(np.diag(cov[:, :k]), 0.0))
    sd = np.ones(k) if floor is None else np.where(sd > 1e-9, sd, 1.0) if floor == 0 else np.maximum(sd, floor)
    beta = np.linalg.solve(row.n * cov[:, :k] / np.outer(sd, sd) + penalty * np.eye(k), row.n * cov[:, k] / sd) / sd
    return float(mean[k] - beta @ mean[:k]), beta.tolist()


def solved(sums: DataFrame, keys: list[str], features: list[str], target: str, penalty: float, floor: float | None = 0.0) -> DataFrame:
    """``keys``, intercept, beta of each row of sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [ridge_of(r, features, target, penalty, floor) for r in batch.itertuples()]
            yield batch[keys].assign(intercept=[x for x, _ in found], beta=[b for _, b in found])

    schema = ", ".join(f"{k} {t}" for k, t in sums.select(*keys).dtypes)
    return sums.select(*keys, *names(features, target)).mapInPandas(run, f"{schema}, intercept double, beta array<double>")


def predicted(features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [C("intercept"), *[C("beta")[i] * C(f) for i, f in enumerate(features)]])


def left_out(df: DataFrame, group: str, features: list[str], target: str, penalty: float = 1.0, pool: Column | None = None, least: int = 20) -> DataFrame:
    """``df`` with ``predicted`` by a model that has not seen the row's group; groups with fewer than ``least`` other rows are left out.

    ``pool`` says which rows may be learnt from.
    """
    own = moments(df if pool is None else df.where(pool), [group], features, target)
    total = own.agg(*[F.sum(c).alias(f"all_{c}") for c in names(features, target)])
    rest = df.select(group).distinct().join(own, group, "left").join(F.broadcast(total))  # one row
    rest = rest.select(group, *[(C(f"all_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in names(features, target)]).where(C("n") >= least)
    return df.join(solved(rest, [group], features, target, penalty), group).withColumn("predicted", predicted(features)).drop("intercept", "beta")


def scores(truth: Column, guess: Column) -> list[Column]:
    e = guess - truth
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count("*"))).alias("r2")]


def stages(df: DataFrame, group: str, sets: dict[str, list[str]], target: str, shares: dict[str, Column], penalty: float = 1.0) -> DataFrame:
    """Ablation and learning curve: the held-out scores for each named set of features and each share of the groups learnt from."""
    parts = []
    for stage, features in sets.items():
        for share, pool in shares.items():
            out = left_out(df, group, features, target, penalty, pool)
            parts.append(out.agg(*scores(C(target), C("predicted"))).select(F.lit(stage).alias("stage"), F.lit(share).alias("share"), "*"))
    return reduce(DataFrame.unionByName, parts)


def interval_ridge(windows: DataFrame, intervals: DataFrame, features: list[str], penalty: float = 3.0, least: int = 30) -> DataFrame:
    """A speed model of each trip from distances alone: trip_id, intervals, reason, intercept, beta, sigma, in_sample.

    Windows (trip_id, t, features) are averaged over the intervals (trip_id, start, end, distance) that hold them, at least
    three in each; the mean is regressed on distance over time, weighted by duration over its median, 1/4 to 4. ``sigma``, 1.5
    to 12, is the error on the last three tenths of the intervals by a model of the first; the coefficients are of all. A trip
    of fewer than ``least`` intervals is refused with a reason.
    """
    good = intervals.where((C("end") > C("start")) & (C("distance") >= 0))
    inside = windows.join(good, "trip_id").where((C("t") > C("start")) & (C("t") <= C("end")))
    rows = inside.groupBy("trip_id", "start", "end", "distance").agg(F.count("*").alias("held"), *[F.avg(f).alias(f) for f in features]).where("held >= 3")
    rows = rows.withColumn("duration", C("end") - C("start")).withColumn("speed", C("distance") / C("duration"))
    trip, order = Window.partitionBy("trip_id"), Window.partitionBy("trip_id").orderBy("start")
    rows = rows.withColumn("many", F.count("*").over(trip)).withColumn("at", F.row_number().over(order))
    split = F.least(F.greatest(F.lit(least // 2), F.floor(C("many") * 0.7)), C("many") - 5)
    rows = rows.withColumn("train", C("at") <= split)
    weight = lambda d: d.withColumn("w", F.greatest(F.lit(0.25), F.least(F.lit(4.0), C("duration") / F.greatest(C("median"), F.lit(1e-6)))))
    middle = lambda d: weight(d.join(d.groupBy("trip_id").agg(F.median("duration").alias("median")), "trip_id"))
    enough = rows.where(C("many") >= least)
    first = solved(moments(middle(enough.where("train")), ["trip_id"], features, "speed", C("w")), ["trip_id"], features, "speed", penalty, 0.2)
    e = F.pow(predicted(features) - C("speed"), 2)
    tried = enough.join(first, "trip_id").groupBy("trip_id").agg(F.sqrt(F.avg(F.when(~C("train"), e))).alias("held_out"), F.sqrt(F.avg(F.when(C("train"), e))).alias("in_sample"))
    final = solved(moments(middle(enough), ["trip_id"], features, "speed", C("w")), ["trip_id"], features, "speed", penalty, 0.2)
    out = windows.select("trip_id").distinct().join(rows.groupBy("trip_id").agg(F.count("*").alias("intervals")), "trip_id", "left").join(final, "trip_id", "left").join(tried, "trip_id", "left")
    n = F.coalesce("intervals", F.lit(0))
    reason = F.when(n < least, F.concat(F.lit("too few intervals: "), n.cast("string"))).otherwise("ok")
    return out.select("trip_id", n.alias("intervals"), reason.alias("reason"), "intercept", "beta", F.greatest(F.lit(1.5), F.least(F.lit(12.0), C("held_out"))).alias("sigma"), "in_sample")


def speed_models(df: DataFrame, order: str, features: list[str], target: str = "speed", penalty: float = 1.0, least: int = 60, moving: int = 30, share: float = 0.7) -> DataFrame:
    """A model of each trip, scored on its own last rows: trip_id, n, reason, intercept, beta, sigma, corr, in_sample, gap.

    Rows with a null or NaN are left out. A trip of fewer than ``least`` rows, or ``moving`` faster than 2 m/s, is refused, and so
    is one whose prediction is constant on the rows held out, the last 1 - ``share`` in ``order``. Sigma, 1.5 to 12, is the
    error there of a model of the rows before; the coefficients are of all rows.
    """
    whole, trip = reduce(lambda a, b: a & b, [C(x).isNotNull() & ~F.isnan(x) for x in (*features, target)]), Window.partitionBy("trip_id")
    rows = df.where(whole).withColumn("many", F.count("*").over(trip)).withColumn("fast", F.count_if(C(target) > 2.0).over(trip)).withColumn("at", F.row_number().over(trip.orderBy(order)))
    split = F.least(F.greatest(F.lit(least // 2), F.floor(C("many") * share)), C("many") - 5)
    enough = rows.where((C("many") >= least) & (C("fast") >= moving)).withColumn("train", C("at") <= split)
    first = solved(moments(enough.where("train"), ["trip_id"], features, target), ["trip_id"], features, target, penalty, None)
    tried = enough.join(first, "trip_id").withColumn("guess", predicted(features))
    held, e = F.when(~C("train"), C("guess")), F.pow(C("guess") - C(target), 2)
    tried = tried.groupBy("trip_id").agg(F.stddev_pop(held).alias("spread"), F.sqrt(F.avg(F.when(~C("train"), e))).alias("held_out"), F.corr(held, target).alias("corr"), F.sqrt(F.avg(F.when(C("train"), e))).alias("in_sample"))
    final = solved(moments(enough, ["trip_id"], features, target), ["trip_id"], features, target, penalty, None)
    seen = rows.groupBy("trip_id").agg(F.count("*").alias("n"), F.max("fast").alias("fast"))
    out = df.select("trip_id").distinct().join(seen, "trip_id", "left").join(tried, "trip_id", "left").join(final, "trip_id", "left")
    n, fast = F.coalesce("n", F.lit(0)), F.coalesce("fast", F.lit(0))
    reason = F.when((n < least) | (fast < moving), F.concat(F.lit("too few rows: "), n.cast("string"), F.lit(", moving "), fast.cast("string"))).when(C("spread") < 1e-9, "constant prediction").otherwise("ok")
    ok = lambda x: F.when(C("reason") == "ok", x)
    sigma, gap = F.greatest(F.lit(1.5), F.least(F.lit(12.0), C("held_out"))), C("held_out") / F.greatest(C("in_sample"), F.lit(1e-6))
    corr = F.when(C("corr").isNull() | F.isnan("corr"), 0.0).otherwise(C("corr"))
    return out.select("*", n.alias("rows"), reason.alias("reason")).select("trip_id", C("rows").alias("n"), "reason", ok(C("intercept")).alias("intercept"), ok(C("beta")).alias("beta"), ok(sigma).alias("sigma"), ok(corr).alias("corr"), ok(C("in_sample")).alias("in_sample"), ok(gap).alias("gap"))


def two_sided(z: Column) -> Column:
    """Chance of a normal value at least as far out, by a polynomial good to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z / 2)


def rank_test(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """Mann-Whitney of the rows where ``first`` holds against the others, by ``keys``: n1, n2, u, z, p.

    Ranks are averages over ties; z is corrected for ties and continuity; null where one side is empty or all values tie.
    """
    by = df.withColumn("one", first).groupBy(*keys, value).agg(F.count("*").alias("t"), F.count_if("one").alias("a"))
    order = Window.partitionBy(*keys).orderBy(value)
    by = by.withColumn("rank", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)) - (C("t") - 1) / 2.0)
    d = by.groupBy(*keys).agg(F.sum("a").alias("n1"), (F.sum("t") - F.sum("a")).alias("n2"), F.sum(C("a") * C("rank")).alias("r"), F.sum(C("t") * C("t") * C("t") - C("t")).alias("ties"))
    n, both = C("n1") + C("n2"), (C("n1") * C("n2")).cast("double")
    u, var = C("r") - C("n1") * (C("n1") + 1) / 2.0, both / 12 * (n + 1 - F.try_divide(C("ties"), n * (n - 1)))
    z = F.greatest(F.lit(0.0), F.abs(u - both / 2) - 0.5) / F.sqrt(F.nullif(F.greatest(F.lit(0.0), var), F.lit(0.0)))
    return d.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"), two_sided(z).alias("p"))


def poisson(u: Column) -> Column:
    """A Poisson number of mean one, by a number spread evenly over [0, 1)."""
    below = [sum(np.exp(-1) / float(np.prod(range(1, j + 1))) for j in range(i + 1)) for i in range(7)]
    return reduce(lambda a, b: a + b, [(u >= float(x)).cast("int") for x in below])


def bootstrap_medians(df: DataFrame, keys: list[str], row: Column, value: str, side: Column, replicates: int = 200) -> DataFrame:
    """Difference of the medians of both sides with its 95 % range over Poisson replicates: ``keys``, diff, low, high, used.

    A row counts in a replicate as often as a hash of both says, so all replicates are one pass and reruns agree. A median is
    the least value with half of the weight at or below it; replicates in which a side is empty are not used.
    """
    d = df.select(*keys, C(value).alias("x"), side.alias("side"), row.cast("string").alias("__row"))
    # numbers come out of the explosion, so each hash is taken once; replicate 0 takes each row once
    spread = lambda rep: F.conv(F.substring(F.md5(F.concat("__row", F.lit(":"), rep.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    drawn = F.transform(F.sequence(F.lit(0), F.lit(replicates)), lambda rep: F.struct(rep.alias("rep"), F.when(rep > 0, spread(rep)).alias("u")))
    # a small table is still much work, so its rows are dealt out to all tasks
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartition(tasks, "__row").select(*keys, "side", "x", F.inline(drawn))
    d = d.withColumn("w", F.when(C("rep") == 0, 1).otherwise(poisson(C("u")))).where("w > 0")
    d = d.groupBy(*keys, "side", "rep", "x").agg(F.sum("w").alias("w"))
    part = Window.partitionBy(*keys, "side", "rep")
    d = d.withColumn("upto", F.sum("w").over(part.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(part))
    m = d.where(2 * C("upto") >= C("all")).groupBy(*keys, "side", "rep").agg(F.min("x").alias("m"))
    gap = m.groupBy(*keys, "rep").agg(F.max(F.when(C("side"), C("m"))).alias("one"), F.max(F.when(~C("side"), C("m"))).alias("two")).withColumn("diff", C("one") - C("two")).where("diff is not null")
    out = F.when(C("rep") > 0, C("diff"))
    return gap.groupBy(*keys).agg(F.max(F.when(C("rep") == 0, C("diff"))).alias("diff"), F.percentile(out, 0.025).alias("low"), F.percentile(out, 0.975).alias("high"), F.count_if(C("rep") > 0).alias("used"))
