"""Algebra of weighted particles and hypotheses (trip_id, i, edge, s, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(df: DataFrame) -> DataFrame:
    """Weights that sum to one; what is no weight counts nothing, and if nothing is left all are equal."""
    trip = Window.partitionBy("trip_id")
    d = df.withColumn("w", F.when(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0), 0.0).otherwise(F.col("w")))
    d = d.withColumn("__s", F.sum("w").over(trip)).withColumn("__n", F.count("*").over(trip))
    return d.withColumn("w", F.when(F.col("__s") > 0, F.col("w") / F.col("__s")).otherwise(1.0 / F.col("__n"))).drop("__s", "__n")


def effective_size(w: Column) -> Column:
    return 1.0 / F.sum(w * w)


def circular(angle: Column, w: Column) -> tuple[Column, Column]:
    """Weighted mean angle and resultant length."""
    x, y = F.sum(w * F.cos(angle)), F.sum(w * F.sin(angle))
    return F.atan2(y, x), F.hypot(x, y) / F.sum(w)


def densest(df: DataFrame, gamma: float) -> DataFrame:
    """The fewest particles, heaviest first, whose weights reach ``gamma`` of all."""
    heavy = Window.partitionBy("trip_id").orderBy(F.col("w").desc(), "i")
    d = df.withColumn("__before", F.coalesce(F.sum("w").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return d.where(F.col("__before") < gamma * F.lit(1.0)).drop("__before")


def resampled(df: DataFrame, u: float) -> DataFrame:
    """Systematic resampling: particle i takes the pointers (u + j) / n that fall in its share of the weights."""
    line = Window.partitionBy("trip_id").orderBy("i")
    d = df.withColumn("__n", F.count("*").over(Window.partitionBy("trip_id")))
    d = d.withColumn("__hi", F.sum("w").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__lo", F.coalesce(F.sum("w").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    upto = lambda x: F.greatest(F.lit(0), F.least(F.col("__n"), F.ceil(x * F.col("__n") - u)))
    return d.withColumn("copies", (upto(F.col("__hi")) - upto(F.col("__lo"))).cast("long")).drop("__n", "__hi", "__lo")


def merged(df: DataFrame, cell: float = 8.0) -> DataFrame:
    """Hypotheses in the same cell of an edge as one: the best score and the log of the summed weights."""
    d = df.withColumn("cell", F.floor(F.col("s") / cell)).withColumn("score", F.log("w"))
    w = Window.partitionBy("trip_id", "edge", "cell")
    d = d.withColumn("__m", F.max("score").over(w))
    return d.groupBy("trip_id", "edge", "cell").agg(F.max("score").alias("best"), (F.first("__m") + F.log(F.sum(F.exp(F.col("score") - F.col("__m"))))).alias("mass"), F.count("*").alias("n"))


def reduced(df: DataFrame, keep: int = 64, margin: float = 30.0) -> DataFrame:
    """The best modes within a margin of the best, with weights that sum to one again."""
    trip = Window.partitionBy("trip_id")
    d = df.withColumn("score", F.log("w")).withColumn("rank", F.row_number().over(trip.orderBy(F.col("score").desc(), "i")))
    d = d.withColumn("__m", F.max("score").over(trip)).where((F.col("rank") <= keep) & (F.col("score") >= F.col("__m") - margin))
    return d.withColumn("p", F.exp(F.col("score") - F.col("__m"))).withColumn("p", F.col("p") / F.sum("p").over(trip)).drop("__m")


def decided(df: DataFrame, selected: float = 0.98, margin: float = 0.2) -> DataFrame:
    """Zones (trip_id, zone, p) ranked, and the decision: confident, ambiguous or outside."""
    rank = Window.partitionBy("trip_id").orderBy(F.col("p").desc(), "zone")
    d = df.withColumn("rank", F.row_number().over(rank)).withColumn("second", F.coalesce(F.lead("p").over(rank), F.lit(0.0))).where("rank = 1")
    sure = (F.col("p") >= selected) & (F.col("p") - F.col("second") >= margin)
    return d.select("trip_id", "zone", "p", F.when(F.col("p") <= 0, "outside").when(sure, "confident").otherwise("ambiguous").alias("status"))
