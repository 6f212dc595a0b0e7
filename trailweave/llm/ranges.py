"""Sampled splitters: cut a keyed table into ranges of bounded weight without sorting it in one place.

Rows are drawn with a chance in proportion to their weight, by a hash of the key, so reruns draw the same rows; quantiles
of the draw are the range boundaries. Ranges that turn out overfull are sampled again at a higher rate and subdivided,
until a draw finds no new boundary: what is overfull then is all but filled by one key.
The draw is bounded by ``OVERSAMPLE * max_ranges`` keys, the only thing that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_array

OVERSAMPLE = 16
NO_ID = -(2**63)


def key_of(hi: Column, lo: Column) -> Column:
    """A composite key as a struct that compares field by field; nulls come first."""
    return F.struct(F.coalesce(hi.cast("long"), F.lit(NO_ID)).alias("a"), F.coalesce(lo.cast("long"), F.lit(NO_ID)).alias("b"))


def draw(rows: DataFrame, total: int, n: int) -> list[tuple[int, int, int]]:
    """About ``n`` keys (a, b, weight they stand for), in order; each row's chance is n * weight / total, at most 1."""
    step = max(1, total // max(1, n))
    chance = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(2**40)) / F.lit(float(2**40))
    drawn = rows.where(chance < F.col("weight") / F.lit(float(step))).select("key", F.greatest(F.col("weight"), F.lit(step)).alias("w"))
    return sorted((r["key"]["a"], r["key"]["b"], r["w"]) for r in drawn.collect())


def quantiles(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int]]:
    total, acc, out = sum(w for *_, w in sample), 0, []
    for a, b, w in sample:
        acc += w
        if acc * parts >= (len(out) + 1) * total and len(out) < parts - 1:
            out.append((a, b))
            while acc * parts >= (len(out) + 1) * total and len(out) < parts - 1:
                out.append((a, b))
    return sorted(set(out))


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are below the row's key: coarse steps first, then the splitters of one step."""
    if not splitters:
        return F.lit(0)
    width = math.isqrt(len(splitters)) + 1
    kind = "struct<a:bigint,b:bigint>"
    as_rows = lambda rows: literal_array([{"a": a, "b": b} for a, b in rows], kind)
    below = lambda array: F.size(F.filter(array, lambda s: s < F.col("key")))
    coarse = below(as_rows(splitters[width - 1 :: width])) if len(splitters) >= width else F.lit(0)
    return (coarse * width + below(F.slice(as_rows(splitters), coarse * width + 1, F.lit(width)))).cast("int")


def with_ranges(rows: DataFrame, parts: int, slack: float = 2.0, cuts: int = 1, least: float = 0.0) -> tuple[DataFrame, list[dict], list[tuple[int, int]]]:
    """``rows`` (key, weight, ...) with ``range``; per range its number, rows and weight in order; and the splitters.

    With ``cuts``, ranges that hold the border of one of so many equal shares are subdivided until they weigh ``least``.
    """
    total = rows.agg(F.sum("weight")).first()[0] or 0
    splitters = quantiles(draw(rows, total, OVERSAMPLE * parts), parts)
    while True:  # each round adds a boundary or is the last, and ranges are numbered by the boundaries returned
        out = rows.withColumn("range", range_of(splitters))
        found = out.groupBy("range").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")).orderBy("range").collect()
        full, more, ahead = [], 0, 0
        for r in found:
            shares = lambda w: w * cuts // total if total else 0
            overfull, border = r["weight"] * parts > slack * total, r["weight"] > least and shares(ahead) < shares(ahead + r["weight"])
            if r["rows"] > 1 and (overfull or border and cuts > 1):
                full.append(r)
                more += max(math.ceil(r["weight"] * parts / total), math.ceil(2 * r["weight"] / least) if border and cuts > 1 and least else 0)
            ahead += r["weight"]
        if not full:
            break
        within = out.where(F.col("range").isin([r["range"] for r in full]))
        sample = draw(within, sum(r["weight"] for r in full), 4 * OVERSAMPLE * more)
        finer = sorted(set(splitters) | set(quantiles(sample, 2 * more)))
        if finer == splitters:
            break
        splitters = finer
    return out, [r.asDict() for r in found], splitters
