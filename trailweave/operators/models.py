"""Models fitted by aggregates, and searches over parameter grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_fit(df: DataFrame, knots: list[float]) -> DataFrame:
    """For each knot, the least-squares line of y on max(0, x - knot): knot, slope, sse."""
    d = df.withColumn("knot", F.explode(F.array(*map(F.lit, knots)))).withColumn("h", F.greatest(F.lit(0.0), F.col("x") - F.col("knot")))
    return d.groupBy("knot").agg(F.expr("regr_slope(y, h)").alias("slope"), F.expr("regr_syy(y, h) - pow(regr_sxy(y, h), 2) / regr_sxx(y, h)").alias("sse"))


def lookup(df: DataFrame, x: str, curve: list[tuple[float, float]]) -> DataFrame:
    """y of each row on a curve of straight pieces, level beyond its ends."""
    y, c = F.lit(curve[-1][1]), F.col(x)
    for (x0, y0), (x1, y1) in reversed(list(zip(curve, curve[1:], strict=False))):
        y = F.when(c <= x1, y0 + (y1 - y0) * (c - x0) / (x1 - x0)).otherwise(y)
    return df.withColumn("y", F.when(c < curve[0][0], curve[0][1]).otherwise(y))


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> DataFrame:
    """Ridge regression of the standardized features: one row a coefficient. Only the sums of products leave the cluster."""
    terms = [*features, target]
    sums = [F.sum(F.col(a)).alias(f"s_{a}") for a in terms] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(terms) for b in terms[i:]]
    r = df.agg(F.count("*").alias("n"), *sums).first()
    n = max(r["n"], 1)
    mean = np.array([(r[f"s_{a}"] or 0.0) / n for a in terms])
    product = lambda i, j: (r[f"p_{terms[min(i, j)]}_{terms[max(i, j)]}"] or 0.0) / n - mean[i] * mean[j]
    cov = np.array([[product(i, j) for j in range(len(terms))] for i in range(len(terms))])
    k = len(features)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 1e-12))
    beta = np.linalg.solve(cov[:k, :k] / np.outer(sd, sd) + penalty / n * np.eye(k), cov[:k, k] / sd) / sd
    rows = [("intercept", float(mean[k] - beta @ mean[:k])), *[(f, float(b)) for f, b in zip(features, beta, strict=True)]]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def clock_offset(samples: DataFrame, lags: list[int]) -> DataFrame:
    """Per trip, the lag at which yaw and acceleration go together best: trip_id, lag, corr."""
    a = samples.select("trip_id", "n", "yaw").withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("m", F.col("n") + F.col("lag"))
    b = samples.select("trip_id", F.col("n").alias("m"), "a_long")
    r = a.join(b, ["trip_id", "m"]).groupBy("trip_id", "lag").agg(F.corr("yaw", "a_long").alias("corr")).where("corr is not null and not isnan(corr)")
    best = Window.partitionBy("trip_id").orderBy(F.round("corr", 9).desc(), "lag")
    return r.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def places(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """For each query (every id divisible by ``every``), the ``k`` most similar other vectors by cosine.

    A stated set of queries against all rows: the queries are broadcast if there are few, each row keeps its best.
    """
    norm = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    q = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), norm(F.col("embedding")).alias("nq"))
    if q.count() <= 100_000:
        q = F.broadcast(q)
    v = vectors.select("vec_id", "embedding", norm(F.col("embedding")).alias("nv"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    d = v.join(q, F.col("vec_id") != F.col("query")).select("query", "vec_id", (dot / (F.col("nq") * F.col("nv"))).alias("sim"))
    rank = Window.partitionBy("query").orderBy(F.col("sim").desc(), "vec_id")
    return d.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def refined_offset(samples: DataFrame, span: int, coarse: int, fine: int = 1, least: float = 0.0, sure: float = 0.35) -> DataFrame:
    """The lag of each trip, searched in steps of ``coarse`` samples up to ``span`` and then in steps of ``fine`` about the best:
    trip_id, lag, corr, note (``weak`` below ``sure``). Trips in which no coarse lag is above ``least`` are left out."""
    rough = clock_offset(samples, list(range(-span, span + 1, coarse))).where(F.col("corr") > least)
    near = F.sequence(F.col("lag") - coarse, F.col("lag") + coarse, F.lit(fine))
    a = samples.select("trip_id", "n", "yaw").join(rough.select("trip_id", F.explode(near).alias("lag")), "trip_id").withColumn("m", F.col("n") + F.col("lag"))
    b = samples.select("trip_id", F.col("n").alias("m"), "a_long")
    r = a.join(b, ["trip_id", "m"]).groupBy("trip_id", "lag").agg(F.corr("yaw", "a_long").alias("corr")).where("corr is not null and not isnan(corr)")
    best = r.groupBy("trip_id").agg(F.max(F.struct(F.round("corr", 9).alias("c"), (-F.col("lag")).alias("l"), "corr", "lag")).alias("b"))
    return best.select("trip_id", "b.lag", "b.corr", F.when(F.col("b.corr") < sure, "weak").otherwise("ok").alias("note"))
