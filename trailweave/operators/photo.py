"""Street signs against the names of the road graph.

Names are alike by their words: equal ones count one, others their ratio of common runs of letters where that is 0.8 or
more. Two words of such a ratio share a pair of letters, or are of two and three letters with the same first and last
one, so words meet by an equi-join on those and every pair of names that can be alike is found.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import signs

ALIKE = 0.8


def similarity(a: str, b: str) -> float:
    """Words in common, likened ones by their ratio, over the words of the name that has more."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    ratio = lambda v: max((SequenceMatcher(None, v, w).ratio() for w in y - x), default=0.0)
    near = [r for r in map(ratio, x - y) if r >= ALIKE]
    return (len(x & y) + sum(near)) / max(len(x), len(y))


def name_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run(a, b)


def handles(words: Column) -> Column:
    """What two words that are alike have in common: a pair of letters, or the ends of a short word, or all of it."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    ends = lambda w: F.when(F.length(w) <= 3, F.array(F.concat(F.substring(w, 1, 1), F.lit("~"), F.right(w, F.lit(1))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(pairs(w), ends(w)))))


def matched(names: DataFrame, roads: DataFrame, least: float = 0.6) -> DataFrame:
    """name, road, score: the pairs of distinct names (name) and road names (road) that are alike enough."""
    left = names.select("name").distinct().select("name", F.explode(handles(F.split("name", " "))).alias("h"))
    right = roads.select("road").distinct().select("road", F.explode(handles(F.split("road", " "))).alias("h"))
    pairs = left.join(right, "h").select("name", "road").distinct()
    return pairs.withColumn("score", name_similarity(F.col("name"), F.col("road"))).where(F.col("score") >= least)


def parsed(lines: DataFrame, keys: list[str], least_confidence: float = 0.3) -> DataFrame:
    """Per sign: the street names, house numbers and zones of its lines (line, confidence, text), each once, in the order of
    the lines; the lines themselves and their mean confidence."""
    rows = lines.where((F.col("confidence") >= least_confidence) & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    zone, house = signs.parking_zone(F.col("text")), signs.house_number(F.col("text"))
    rows = rows.select(*keys, F.struct("line", signs.street_names(F.col("text")).alias("streets"), house.alias("house"), zone.alias("zone"), "text").alias("x"), "confidence")
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"), F.avg("confidence").alias("confidence"))
    once = lambda f: F.array_distinct(F.filter(F.transform("x", f), lambda v: v.isNotNull()))
    return g.select(*keys, F.array_distinct(F.flatten(F.transform("x", lambda v: v["streets"]))).alias("streets"), once(lambda v: v["house"]).alias("houses"), once(lambda v: v["zone"]).alias("zones"), F.transform("x", lambda v: v["text"]).alias("lines"), "confidence")


def localized(matches: DataFrame, places: DataFrame, regions: DataFrame, keys: list[str], radius: float, best: int = 5) -> DataFrame:
    """The places (road, edge, x, y) of matched streets (keys, road, score), weighed by the regions (x, y, r, p) about them.

    A region counts if it lies within ``radius`` and its own radius of the place; regions are entered under the grid cells
    that they reach, so only near ones are compared. The ``best`` by score times weight are kept; those of no weight go.
    """
    cell = 500.0
    reach = lambda at: F.sequence(F.floor((F.col(at) - F.col("r") - radius) / cell), F.floor((F.col(at) + F.col("r") + radius) / cell))
    near = regions.withColumn("cx", F.explode(reach("x"))).withColumn("cy", F.explode(reach("y"))).select("cx", "cy", F.col("x").alias("rx"), F.col("y").alias("ry"), "r", "p")
    at = places.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(near, ["cx", "cy"])
    prior = at.where(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")) <= radius + F.col("r")).groupBy("road", "edge").agg(F.sum("p").alias("prior"))
    rows = matches.join(prior.where("prior > 0"), "road").groupBy(*keys, "edge", "prior").agg(F.max("score").alias("match"))
    rows = rows.withColumn("score", F.col("match") * F.col("prior"))
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "edge")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
