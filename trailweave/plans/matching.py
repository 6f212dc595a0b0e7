"""Queries over map matching, attitudes, curves and live trips, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import matching, roads
from trailweave.operators.lineage import shared_folder, written
from trailweave.operators.trust import histories
from trailweave.sources import geojson, logs
from trailweave.streaming import live

from .evidence import rounded
from .live import at, ended, source
from .network import RULES, legal
from .views import edges, fixes, imu, nodes, points, sql, table

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


def map_matched(spark, d):
    """Trips of fifty customers each, walked from place to place, matched to the roads."""
    w = Window.partitionBy("trip_id").orderBy("point")
    p = points(spark, d).withColumn("trip_id", F.floor(c("point") / 50)).withColumn("seq", c("point"))
    p = p.withColumn("step", F.coalesce(F.hypot(c("px") - F.lag("px").over(w), c("py") - F.lag("py").over(w)), F.lit(0.0))).withColumn("t", c("point") * 1.0)
    hits = roads.within(points(spark, d), edges(spark, d), 200.0).select("point", "edge", "s", "offset")
    ways = roads.reachable_within(edges(spark, d), legal(spark, d), edges(spark, d), 3000.0).select("start", "edge", "way")
    return matching.matched(matching.candidates(hits, p), ways, 60.0, 400.0)


put("ST-26", map_matched, None)


def levelled(spark, d):
    """Attitudes of a phone that lies still at an angle and is then turned: how far its up is from the measured one."""
    rows = imu(spark, d).select("trip_id", "n", F.lit(0.1).alias("dt"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), c("yaw").alias("gz"), F.lit(0.3).alias("ax"), F.lit(-0.2).alias("ay"), F.lit(0.93).alias("az"))
    q = matching.mahony(rows)
    w, x, y, z = (c("q")[i] for i in range(4))
    return rounded(q.select("trip_id", "n", (2 * (x * z - w * y)).alias("ux"), (2 * (y * z + w * x)).alias("uy"), (w * w - x * x - y * y + z * z).alias("uz")), 4)


put("ST-24", levelled, None)
put("ML-05", lambda spark, d: rounded(matching.monotone(fixes(spark, d).withColumn("y", c("speed") + c("k") / 5.0), "k", "y"), 4), None)

put("ST-15", lambda spark, d: rounded(roads.reachable_within(edges(spark, d), legal(spark, d), edges(spark, d), 2200.0).join(edges(spark, d).select(c("edge").alias("start"), c("x0").alias("ax"), c("y0").alias("ay")), "start").join(edges(spark, d).select("edge", c("x0").alias("bx"), c("y0").alias("by")), "edge").select("start", "edge", "way", (c("way") <= F.greatest(F.lit(100.0), 1.5 * F.hypot(c("ax") - c("bx"), c("ay") - c("by")))).alias("accepted")), 4),
    "with recursive " + RULES + """, l as (select edge, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) as len from edges), w as (select edge as start, edge, 0.0e0 as way from l union all select w.start, s.nxt, w.way + l.len from w join l on l.edge = w.edge join ok s on s.edge = w.edge where w.way + l.len <= 2200.0e0), m as (select start, edge, min(way) as way from w group by 1, 2)
select start, m.edge, round(way, 4) as way, way <= greatest(100.0e0, 1.5e0 * sqrt(pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2))) as accepted from m join edges a on a.edge = start join edges b on b.edge = m.edge""", "nodes", "edges")  # fmt: skip


def live_trust(spark, d):
    """The states of a stream of fixes, against those of the same fixes as a table."""
    f = fixes(spark, d).selectExpr("trip_id", "cast(seq as int) as seq", "t", "good as accepted")
    out = ended(live.trust(source(spark, f.select("trip_id", at(c("t")).alias("ts"), "t", "accepted"))))
    # the end of the stream tells every trip to be lost once it has been silent; those rows are no fixes
    got = out.join(f.groupBy("trip_id").agg(F.max("t").alias("end")), "trip_id").where("t <= end")
    # fix by fix; those of one time count in the order of their states
    nth = lambda rows, name: rows.select("trip_id", "t", c("state").alias(name), F.row_number().over(Window.partitionBy("trip_id", "t").orderBy("state")).alias("k"))
    return rounded(nth(got, "live").join(nth(histories(f), "batch"), ["trip_id", "t", "k"], "full").select("trip_id", "t", "k", "live", "batch"))


put("SS-12", live_trust, None)


def live_results(spark, d):
    """Results appended as JSON lines in batches while a stream runs, read back."""
    f = source(spark, fixes(spark, d).select("trip_id", at(c("seq") * 1.0).alias("ts"), "seq", "speed"))
    path = f"{shared_folder(spark)}/live-{spark.sparkContext.applicationId}-{id(f)}"
    lines = f.select(F.to_json(F.struct("trip_id", "seq", "speed")).alias("value"))
    lines.writeStream.format("text").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.text(f"{path}/out").select(F.from_json("value", "trip_id long, seq long, speed double").alias("x")).select("x.*")
    return rows.where("trip_id >= 0").groupBy("trip_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


put("SRC-30", live_results, "select trip_id, count(*) as n, max(seq) as last from fixes group by 1", "fixes")


def replayed(spark, d):
    """A recorded trip file as a stream of its samples."""
    lines = fixes(spark, d).select(F.to_json(F.struct(F.lit("location").alias("type"), c("t").alias("monotonic_time"), c("lat").alias("latitude"), c("lon").alias("longitude"), c("acc").alias("horizontal_accuracy"), c("trip_id").alias("course"))).alias("value"))
    stream = logs.parsed(spark.readStream.text(written(lines, "replay")))
    return ended(stream.select(c("course").cast("long").alias("trip_id"), "monotonic_time", "kind")).groupBy("trip_id", "kind").agg(F.count("*").alias("n"), F.round(F.max("monotonic_time"), 6).alias("last"))


put("SRC-31", replayed, "select trip_id, 'location' as kind, count(*) as n, round(max(t), 6) as last from fixes group by 1", "fixes")


def imported(spark, d):
    """A layer of points, lines and polygons read as one."""
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("trip_id"))
    x = lambda i: F.array((c("trip_id") + i).cast("double"), (c("trip_id") * 2 + i * i).cast("double"))
    point = geojson.feature(F.lit("Point"), F.to_json(x(0)), [c("trip_id")])
    line = geojson.feature(F.lit("LineString"), F.to_json(F.array(x(0), x(1), x(2))), [c("trip_id")])
    ring = geojson.feature(F.lit("Polygon"), F.to_json(F.array(F.array(x(0), x(1), x(2), x(0)))), [c("trip_id")])
    lines = s.select(F.explode(F.array(point, line, ring)).alias("value"))
    return geojson.read(spark, written(lines, "layer")).groupBy("trip_id", "kind").agg(F.count("*").alias("n"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"))


put("SRC-32", imported, "select s_suppkey as trip_id, kind, n, s_suppkey * n + l + 0.0e0 as lon, s_suppkey * 2 * n + q + 0.0e0 as lat from supplier cross join (values ('Point', 1::bigint, 0, 0), ('LineString', 3::bigint, 3, 5), ('Polygon', 4::bigint, 3, 5)) v(kind, n, l, q)")
