"""GeoJSON as lines of features: tracks, points and polygons, written as text and read back as one row per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT, LINE, MANY = "array<double>", "array<array<double>>", "array<array<array<double>>>"


def feature(kind: Column, coordinates: Column, properties: list[Column]) -> Column:
    """One feature as a line; coordinates are JSON text already."""
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))


def tracks(df: DataFrame, breaks: str) -> DataFrame:
    """trip_id, value: a line per trip through its rows (seq, lat, lon), in several parts where rows are marked as breaks;
    those rows, and parts of a single point, are in no part."""
    upto = Window.partitionBy("trip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("part", F.sum(F.col(breaks).cast("int")).over(upto)).where(~F.col(breaks))
    parts = rows.groupBy("trip_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p")).where(F.size("p") >= 2)
    parts = parts.withColumn("p", F.transform("p", lambda x: F.array(x["lon"], x["lat"])))
    lines = parts.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]).alias("lines"))
    single = F.size("lines") == 1
    kind = F.when(single, "LineString").otherwise("MultiLineString")
    return lines.select("trip_id", feature(kind, F.when(single, F.to_json(F.col("lines")[0])).otherwise(F.to_json("lines")), [F.col("trip_id")]).alias("value"))


def points(df: DataFrame, properties: list[str]) -> DataFrame:
    """trip_id, value: a point per row."""
    return df.select("trip_id", feature(F.lit("Point"), F.to_json(F.array("lon", "lat")), [F.col("trip_id"), *map(F.col, properties)]).alias("value"))


def polygons(df: DataFrame, properties: list[str]) -> DataFrame:
    """trip_id, value: a polygon per row, from its ``rings``."""
    return df.select("trip_id", feature(F.lit("Polygon"), F.to_json("rings"), [F.col("trip_id"), *map(F.col, properties)]).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """trip_id, kind, properties, part, place, lon, lat: one row per point of each feature."""
    raw = spark.read.text(path)
    at = lambda p: F.get_json_object("value", p)
    rows = raw.select(at("$.properties.trip_id").cast("long").alias("trip_id"), at("$.geometry.type").alias("kind"), at("$.properties").alias("properties"), at("$.geometry.coordinates").alias("c"))
    one = F.from_json("c", POINT)
    parts = F.when(F.col("kind") == "Point", F.array(F.array(one))).when(F.col("kind") == "LineString", F.array(F.from_json("c", LINE))).otherwise(F.from_json("c", MANY))
    rows = rows.select("trip_id", "kind", "properties", F.posexplode(parts).alias("part", "line"))
    return rows.select("trip_id", "kind", "properties", "part", F.posexplode("line").alias("place", "p")).select("trip_id", "kind", "properties", "part", "place", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def areas(read_back: DataFrame, keys: list) -> DataFrame:
    """The keys and the area of each polygon, by the sum of the cross products of neighbouring points."""
    rows = read_back.select(*keys, "part", "place", "lon", "lat")
    names = [n for n in rows.columns if n not in ("part", "place", "lon", "lat")]
    w = Window.partitionBy(*names, "part").orderBy("place")
    cross = F.lag("lon").over(w) * F.col("lat") - F.col("lon") * F.lag("lat").over(w)
    return rows.withColumn("cross", cross).groupBy(*names).agg((F.abs(F.sum("cross")) / 2).alias("area"))
