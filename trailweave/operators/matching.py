"""Map matching of a trip, attitude from gravity and gyro, and monotone curves.

The candidates of each fix and the ways between edges are tables that Spark joins; what is left for a kernel is the walk
over one trip's few candidates per fix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(hits: DataFrame, fixes: DataFrame) -> DataFrame:
    """trip_id, seq, t, step, edges and their offsets and places, one row per fix: hits (point, edge, s, offset), fixes
    (trip_id, seq, t, point, step: metres from the fix before)."""
    each = hits.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("edge", "s", "offset"))).alias("c"))
    return fixes.join(each, "point").select("trip_id", "seq", "t", "step", F.transform("c", lambda x: x["edge"]).alias("edges"), F.transform("c", lambda x: x["s"]).alias("s"), F.transform("c", lambda x: x["offset"]).alias("offsets"))


def matched(rows: DataFrame, ways: DataFrame, sigma: float = 15.0, beta: float = 40.0) -> DataFrame:
    """trip_id, seq, edge: the likeliest sequence of candidate edges (Viterbi).

    A candidate is as likely as a normal error of its offset, a step between two as an exponential of how far the way along
    the roads is from the straight step; ways (start, edge, way) that are not there are impossible. Where no step is
    possible the walk begins anew. ``ways`` is joined to each trip by the edges that it can use, so a task holds no more.
    """
    used = rows.select("trip_id", F.explode("edges").alias("start")).distinct()
    near = ways.join(used, "start").select(F.col("trip_id").alias("trip"), "start", "edge", "way")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("trip_id", "seq", "edge")})
        left = left.sort_values("seq")
        way = {(a, b): w for a, b, w in zip(right["start"], right["edge"], right["way"], strict=True)}
        best, back, out = None, [], {}

        def close() -> None:  # write the walk so far, from its best end
            if best is not None:
                k = int(np.argmax(best))
                for seq, edges, origin in reversed(back):
                    out[seq] = edges[k]
                    k = origin[k]

        before = None
        for r in left.itertuples(index=False):
            emission = -0.5 * (np.asarray(r.offsets) / sigma) ** 2
            if before is not None:
                road = np.array([[(s1 - s0 if e0 == e1 and s1 >= s0 else way.get((e0, e1), np.inf) - s0 + s1) for e1, s1 in zip(r.edges, r.s, strict=True)] for e0, s0 in zip(*before, strict=True)])
                score = best[:, None] - np.abs(road - r.step) / beta
                if np.isfinite(score.max(axis=0)).any():
                    origin = score.argmax(axis=0)
                    best = score.max(axis=0) + emission
                    back.append((r.seq, r.edges, origin))
                    before = (r.edges, r.s)
                    continue
                close()
            best, back, before = emission, [(r.seq, r.edges, np.zeros(len(r.edges), int))], (r.edges, r.s)
        close()
        return pd.DataFrame({"trip_id": [left["trip_id"].iloc[0]] * len(out), "seq": list(out), "edge": list(out.values())})

    return rows.groupBy("trip_id").cogroup(near.groupBy("trip")).applyInPandas(run, "trip_id long, seq long, edge long")


def mahony(df: DataFrame, gain: float = 0.5, leak: float = 0.02) -> DataFrame:
    """trip_id, n, q: attitudes (w, x, y, z) from rates and specific force (trip_id, n, dt, gx, gy, gz, ax, ay, az).

    The rates are corrected towards the measured direction of gravity, in proportion and, slowly, for their bias, and then
    integrated; a row without force is integrated alone.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        q, bias, out = np.array([1.0, 0.0, 0.0, 0.0]), np.zeros(3), []
        for r in group.itertuples(index=False):
            rate, force = np.array([r.gx, r.gy, r.gz]), np.array([r.ax, r.ay, r.az])
            size = np.linalg.norm(force)
            if size > 1e-9:
                w, x, y, z = q
                up = np.array([2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z])
                error = np.cross(force / size, up)
                bias = bias + leak * error * r.dt
                rate = rate + gain * error + bias
            turn = np.linalg.norm(rate) * r.dt
            axis = rate * (r.dt / 2 if turn < 1e-12 else np.sin(turn / 2) / np.linalg.norm(rate))
            a, (b, c, d) = np.cos(turn / 2), axis
            w, x, y, z = q
            q = np.array([w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a])
            q = q / np.linalg.norm(q)
            out.append((r.trip_id, r.n, q))
        return pd.DataFrame(out, columns=["trip_id", "n", "q"])

    rows = df.select("trip_id", "n", "dt", "gx", "gy", "gz", "ax", "ay", "az")
    return rows.groupBy("trip_id").applyInPandas(run, "trip_id long, n long, q array<double>")


def monotone(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y: the rising curve that fits best by squares (pooled neighbours), at its corners, by Spark's own regression."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[x], outputCol="features").transform(df.select(F.col(x).cast("double"), F.col(y).cast("double").alias("label")))
    model = IsotonicRegression().fit(rows)
    return df.sparkSession.createDataFrame(list(zip(map(float, model.boundaries), map(float, model.predictions), strict=True)), "x double, y double")
