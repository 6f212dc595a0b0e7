"""Connected components of a table of links, by alternating large-star and small-star steps.

Both steps need only the least neighbour of each node, a partial aggregate, joined back to the links. That table has one
row per node, so where a node with a third of all links makes its part of the join overfull, adaptive execution splits
the links of that part and repeats the one row. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, staged


def star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u, v with u > v) after one step, again with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:  # each higher neighbour goes to the least of u's neighbourhood
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # all lower neighbours, and u, go to the least of them
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def is_forest_of_stars(links: DataFrame) -> bool:
    """Whether no node has two lower neighbours and no lower neighbour has one of its own."""
    twice = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty() and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of the component) for every node of a link but the roots themselves."""
    links = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct(), "links")
    while not is_forest_of_stars(links):
        before, links = links, staged(star(star(links, True), False), "links")
        forget(before)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
