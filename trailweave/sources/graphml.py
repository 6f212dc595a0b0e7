"""Road graphs in GraphML, written and read by Spark's own XML source.

A graph is a folder of parts that, one after the other, are one document: elements never cross a part, so each is read
where it lies. Only the list of attribute names, the header of the document, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.lineage import written

#: Attributes of this writer, by what they belong to; their place in the list is their id.
ATTRIBUTES = (("graph", "turn_restrictions_json"), ("node", "y"), ("node", "x"), ("edge", "osmid"), ("edge", "highway"), ("edge", "geometry"))
ELEMENT = "data array<struct<_VALUE: string, _key: string>>"
RULE = "array<struct<kind: string, from: bigint, via: array<bigint>, to: bigint>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def datum(belongs: str, name: str, value: Column) -> Column:
    """A data element, nothing where the value is null."""
    at = ATTRIBUTES.index((belongs, name))
    return F.coalesce(F.concat(F.lit(f'<data key="d{at}">'), escaped(value.cast("string")), F.lit("</data>")), F.lit(""))


def write(vertices: DataFrame, rules: DataFrame) -> str:
    """Write streets (edge, u, v, i, x, y, highway) and turn rules (kind, from, via, to) as GraphML; returns the place.

    Nodes are the ends of the streets; a street of two vertices has no geometry of its own.
    """
    spark = vertices.sparkSession
    spot = F.struct("i", "x", "y")
    e = vertices.groupBy("edge", "u", "v").agg(F.array_sort(F.collect_list(spot)).alias("p"), F.any_value("highway").alias("highway"))
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.element_at("p", 1).alias("p")), F.struct(F.col("v").alias("n"), F.element_at("p", -1).alias("p")))).alias("e"))
    nodes = ends.groupBy(F.col("e.n").alias("n")).agg(F.min("e.p.x").alias("x"), F.min("e.p.y").alias("y"))
    node = F.concat(F.lit('<node id="'), F.col("n").cast("string"), F.lit('">'), datum("node", "y", F.col("y")), datum("node", "x", F.col("x")), F.lit("</node>"))
    shape = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("p", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ", "), F.lit(")"))
    street = F.concat(
        F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" id="0">'),
        datum("edge", "osmid", F.col("edge")), datum("edge", "highway", F.col("highway")), datum("edge", "geometry", F.when(F.size("p") > 2, shape)), F.lit("</edge>"),
    )
    keys = "".join(f'<key id="d{i}" for="{b}" attr.name="{n}" attr.type="string" />' for i, (b, n) in enumerate(ATTRIBUTES))
    head = f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    said = rules.agg(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "from", "via", "to")))).alias("json"))  # one value by the format
    parts = [
        spark.createDataFrame([(0, head), (4, "</graph></graphml>")], "o int, value string"),
        nodes.select(F.lit(1).alias("o"), node.alias("value")), e.select(F.lit(2).alias("o"), street.alias("value")), said.select(F.lit(3).alias("o"), datum("graph", "turn_restrictions_json", F.col("json")).alias("value")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return written(rows.repartitionByRange("o").sortWithinPartitions("o").select("value"), "graphml")


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, x, y), streets (edge, u, v, i, x, y, highway) and turn rules (kind, from, via, to) of a GraphML graph.

    Attributes are found by their names whatever their ids. A street without geometry is straight between its nodes, one
    without a number keeps a null; rules that are no JSON are none.
    """
    names = {(r[1], r[2]): r[0] for r in elements(spark, path, "key", "_id string, _for string, `_attr.name` string").collect()}

    def value(belongs: str, name: str) -> Column:
        return F.get(F.transform(F.filter("data", lambda d: d["_key"] == F.lit(names.get((belongs, name)))), lambda d: d["_VALUE"]), F.lit(0))

    nodes = elements(spark, path, "node", f"_id string, {ELEMENT}").select(F.col("_id").cast("long").alias("node"), value("node", "x").try_cast("double").alias("x"), value("node", "y").try_cast("double").alias("y"))
    e = elements(spark, path, "edge", f"_source string, _target string, _id string, {ELEMENT}")
    e = e.select(value("edge", "osmid").try_cast("long").alias("edge"), F.col("_source").cast("long").alias("u"), F.col("_target").cast("long").alias("v"), value("edge", "highway").alias("highway"), value("edge", "geometry").alias("shape"))
    part = lambda t, i: F.get(F.split(F.trim(t), r"\s+"), F.lit(i)).try_cast("double")
    drawn = F.transform(F.split(F.regexp_extract("shape", r"\(([^)]*)\)", 1), ","), lambda t: F.struct(part(t, 0).alias("x"), part(t, 1).alias("y")))
    curved = e.where("shape is not null").select("edge", "u", "v", "highway", drawn.alias("p"))
    flat = e.where("shape is null").join(nodes.select(F.col("node").alias("u"), F.struct("x", "y").alias("a")), "u").join(nodes.select(F.col("node").alias("v"), F.struct("x", "y").alias("b")), "v")
    streets = curved.unionByName(flat.select("edge", "u", "v", "highway", F.array("a", "b").alias("p"))).select("edge", "u", "v", "highway", F.posexplode("p").alias("i", "q"))
    told = elements(spark, path, "data", "_VALUE string, _key string").where(F.col("_key") == F.lit(names.get(("graph", "turn_restrictions_json"))))
    rules = told.select(F.explode(F.from_json("_VALUE", RULE)).alias("r")).select("r.kind", "r.from", "r.via", "r.to")
    return nodes, streets.select("edge", "u", "v", F.col("i").cast("long").alias("i"), "q.x", "q.y", "highway"), rules
