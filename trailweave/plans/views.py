"""Trajectory tables over the driver's tables, and their SQL.

Each view is built from integers and single divisions, without running sums, so that both engines hold equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAT0, LON0 = 59.93, 30.36
EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position fixes: one trip per user, an hour of events as one second; errors are jumps of two kilometres."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", "props")
    e = e.withColumn("seq", F.row_number().over(w)).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.withColumn("t", F.expr(EPOCH) / 3600000000.0).withColumn("raw_course", F.col("k") * 3.6 + F.col("value"))
    east = (30 * F.col("seq") + F.col("k") - 50).cast("double")
    north = ((F.col("event_id") * 7) % 13 * 10 + F.when(F.col("event_type") == "error", 2000).otherwise(0)).cast("double")
    return e.select(
        F.col("user_id").alias("trip_id"), "event_id", "seq", "t", (F.col("value") / 10.0).alias("speed"), "k", (5.0 + F.col("k")).alias("acc"),
        (F.col("raw_course") - 360.0 * F.floor(F.col("raw_course") / 360.0)).alias("course"),
        east.alias("east"), north.alias("north"), (LAT0 + north / 111320.0).alias("lat"), (LON0 + east / 55660.0).alias("lon"),
        (F.col("event_type") != "error").alias("good"), (F.col("event_type") == "signup").alias("synthetic"), "event_type", "value",
    )


FIXES = """fixes as (
  select trip_id, event_id, seq, t, value / 10.0e0 as speed, k, 5.0e0 + k as acc,
    raw_course - 360.0e0 * floor(raw_course / 360.0e0) as course,
    east, north, 59.93e0 + north / 111320.0e0 as lat, 30.36e0 + east / 55660.0e0 as lon,
    event_type <> 'error' as good, event_type = 'signup' as synthetic, event_type, value
  from (
    select *, k * 3.6e0 + value as raw_course, cast(30 * seq + k - 50 as double) as east,
      cast((event_id * 7) % 13 * 10 + case when event_type = 'error' then 2000 else 0 end as double) as north
    from (
      select user_id as trip_id, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as seq,
        (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 3600000000.0e0 as t,
        cast(json_extract_string(props, '$.k') as bigint) as k from events)))"""


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three motion samples per fix, a tenth of a second apart from its sequence number on."""
    f = fixes(spark, sf_dir).select("trip_id", "event_id", "seq", "k")
    rows = f.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n, h = (F.col("seq") - 1) * 3 + F.col("j"), (F.col("event_id") * 31 + F.col("j") * 17 + F.col("k")) % 101
    return rows.select("trip_id", n.alias("n"), (n / 10.0).alias("t"), ((h - 50) / 25.0).alias("a_long"), (((h * 7) % 101 - 50) / 250.0).alias("yaw"), h.alias("h"))


IMU = """imu as (
  select trip_id, n, n / 10.0e0 as t, (h - 50) / 25.0e0 as a_long, ((h * 7) % 101 - 50) / 250.0e0 as yaw, h
  from (select trip_id, (seq - 1) * 3 + j as n, (event_id * 31 + j * 17 + k) % 101 as h from fixes cross join (values (0), (1), (2)) v(j)))"""


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted particles on road edges: one filter per part."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    return x.select(F.col("l_partkey").alias("trip_id"), F.row_number().over(w).alias("i"), (F.col("l_suppkey") % 7).alias("edge"), (F.col("l_quantity") * 8.0).alias("s"), F.col("l_extendedprice").cast("double").alias("w"), ((F.col("l_orderkey") % 628) / 100.0).alias("heading"))


PARTICLES = """particles as (
  select l_partkey as trip_id, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) as i,
    l_suppkey % 7 as edge, l_quantity * 8.0e0 as s, cast(l_extendedprice as double) as w, (l_orderkey % 628) / 100.0e0 as heading from lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions: nations on a shaken grid of 500 m."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("node"), ((n % 5) * 500 + (n * 37) % 41).cast("double").alias("x"), (F.floor(n / 5) * 500 + (n * 53) % 43).cast("double").alias("y"))


NODES = """nodes as (
  select n_nationkey as node, cast((n_nationkey % 5) * 500 + (n_nationkey * 37) % 41 as double) as x, cast((n_nationkey // 5) * 500 + (n_nationkey * 53) % 43 as double) as y from nation)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed streets between neighbours of the grid, some one way: edge, u, v, end points, class."""
    a, b = nodes(spark, sf_dir).alias("a"), nodes(spark, sf_dir).alias("b")
    step = F.col("b.node") - F.col("a.node")
    beside = (F.abs(step) == 1) & (F.floor(F.col("a.node") / 5) == F.floor(F.col("b.node") / 5)) | (F.abs(step) == 5)
    # neighbours by key, so this is an equi join
    near = a.withColumn("to", F.explode(F.array(*[F.col("node") + d for d in (-5, -1, 1, 5)]))).alias("a").join(b, F.col("a.to") == F.col("b.node")).where(beside)
    near = near.where(~((step < 0) & ((F.col("a.node") * 7 + F.col("b.node")) % 6 == 0)))
    kind = F.element_at(F.array(*map(F.lit, ("primary", "secondary", "residential", "service_link"))), ((F.col("a.node") * 3 + F.col("b.node")) % 4 + 1).cast("int"))
    return near.select((F.col("a.node") * 25 + F.col("b.node")).alias("edge"), F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), kind.alias("highway"))


EDGES = """edges as (
  select a.node * 25 + b.node as edge, a.node as u, b.node as v, a.x as x0, a.y as y0, b.x as x1, b.y as y1,
    case (a.node * 3 + b.node) % 4 when 0 then 'primary' when 1 then 'secondary' when 2 then 'residential' else 'service_link' end as highway
  from nodes a join nodes b on (abs(b.node - a.node) = 1 and a.node // 5 = b.node // 5) or abs(b.node - a.node) = 5
  where not (b.node < a.node and (a.node * 7 + b.node) % 6 = 0))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to be found on the road: customers."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("point"), ((c * 131) % 2200 - 50).cast("double").alias("px"), ((c * 197) % 2250 - 60).cast("double").alias("py"))


POINTS = """points as (
  select c_custkey as point, cast((c_custkey * 131) % 2200 - 50 as double) as px, cast((c_custkey * 197) % 2250 - 60 as double) as py from customer)"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference track per trip: every third fix, moved a little."""
    return fixes(spark, sf_dir).where("seq % 3 = 1").select("trip_id", "t", (F.col("east") + F.col("k") % 5).alias("re"), (F.col("north") - F.col("k") % 7).alias("rn"))


REFERENCE = """reference as (select trip_id, t, east + k % 5 as re, north - k % 7 as rn from fixes where seq % 3 = 1)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of trust: the state of each fix from its kind of event."""
    f = fixes(spark, sf_dir)
    state = F.when(F.col("event_type").isin("view", "click"), "TRUSTED").when(F.col("event_type") == "purchase", "SUSPECT").when(F.col("event_type") == "error", "LOST").otherwise("RECOVERING")
    return f.select("trip_id", "seq", "t", state.alias("state"), (F.col("event_type") != "error").alias("accepted"), "k", "value")


STATES = """states as (
  select trip_id, seq, t, case when event_type in ('view', 'click') then 'TRUSTED' when event_type = 'purchase' then 'SUSPECT' when event_type = 'error' then 'LOST' else 'RECOVERING' end as state,
    event_type <> 'error' as accepted, k, value from fixes)"""

SQL = {"fixes": ([], FIXES), "imu": (["fixes"], IMU), "particles": ([], PARTICLES), "nodes": ([], NODES), "edges": (["nodes"], EDGES), "points": ([], POINTS), "reference": (["fixes"], REFERENCE), "states": (["fixes"], STATES)}


def sql(body: str, *views: str) -> str:
    """``body`` after the definitions of the views that it names."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for x in SQL[name][0]:
            want(x)
        if name not in wanted:
            wanted.append(name)

    for v in views:
        want(v)
    body = body.strip()
    if not views:
        return body
    start = "with recursive " if body.startswith("with recursive ") else "with "
    more = body.removeprefix(start) if body.startswith("with ") else None
    return start + ",\n".join(SQL[v][1] for v in wanted) + (",\n" + more if more else "\n" + body)
