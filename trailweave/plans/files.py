"""Queries that write a format and read it back, over whole tables; files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators.lineage import written
from trailweave.sources import geojson, logs

from .evidence import rounded
from .views import fixes, imu, particles, sql, states

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


def trip_lines(spark, d):
    """One JSON line per fix and motion sample, and one cut-off and one unknown line for every hundredth fix."""
    f = fixes(spark, d)
    located = f.select(F.to_json(F.struct(F.lit("location").alias("type"), c("t").alias("monotonic_time"), c("lat").alias("latitude"), c("lon").alias("longitude"), F.when(c("k") % 10 != 0, c("k") - 20.0).alias("horizontal_accuracy"), "speed", "course")).alias("value"))
    moved = imu(spark, d).select(F.to_json(F.struct(F.lit("motion").alias("type"), c("t").alias("monotonic_time"), F.array("a_long", F.lit(0.0), F.lit(0.0)).alias("user_acceleration_g"))).alias("value"))
    bad = f.where("event_id % 100 = 0").select(F.explode(F.array(F.lit('{"type": "loca'), F.lit('{"type": "other"}'), F.lit("  "))).alias("value"))
    return written(located.unionByName(moved).unionByName(bad), "trip-lines")


put("SRC-01", lambda spark, d: logs.samples(spark, trip_lines(spark, d))[2],
    "select 'location' as kind, count(*) as n from fixes union all select 'motion', count(*) from imu union all select 'malformed', count(*) from fixes where event_id % 100 = 0 union all select 'unknown', count(*) from fixes where event_id % 100 = 0", "imu")


def loaded(spark, d):
    """What the loader keeps and why it drops the rest, with the span of each."""
    kept, dropped = logs.usable_samples(spark, trip_lines(spark, d))
    return kept.agg(F.lit("kept").alias("why"), F.count("*").alias("n")).unionByName(dropped)


put("SRC-02", loaded, "with x as (select *, case when k % 10 <> 0 then k - 20.0e0 end as a from fixes) select case when coalesce(a >= 0, false) then 'kept' when coalesce(a, 0) = 0 or a < 0 then 'negative_accuracy' end as why, count(*) as n from x group by 1", "fixes")


def gps_log(spark, d):
    f = fixes(spark, d)
    return written(f.select((c("t") * 1000).alias("timestamp_ms"), F.when(c("k") % 20 == 0, "x").otherwise(c("lat").cast("string")).alias("lat"), "lon", F.when(c("k") % 9 == 0, "nan").otherwise(c("speed").cast("string")).alias("speed"), "course", F.lit("z").alias("more")), "gps-log", "csv")


put("SRC-05", lambda spark, d: rounded(logs.gps(spark, gps_log(spark, d)).agg(F.count("*").alias("n"), F.count("speed").alias("speeds"), F.avg("lat").alias("lat"), F.avg("speed").alias("speed"))),
    "select count(*) as n, count(*) filter (where k % 9 <> 0) as speeds, round(avg(lat), 6) as lat, round(avg(case when k % 9 <> 0 then speed end), 6) as speed from fixes where k % 20 <> 0", "fixes")


def imu_log(spark, d):
    rows = imu(spark, d).select(c("t").alias("timestamp"), F.when(c("h") % 13 == 0, "").otherwise(c("a_long").cast("string")).alias("acc_x"), *[F.lit(float(i)).alias(n) for i, n in enumerate(("acc_y", "acc_z", "gyr_x", "gyr_y"))], c("yaw").alias("gyr_z"), *[F.lit(0.5).alias(f"quat_{a}") for a in "wxyz"])
    return written(rows, "imu-log", "csv")


put("SRC-06", lambda spark, d: rounded(logs.imu(spark, imu_log(spark, d), 2.0, 9.0).groupBy("timestamp").agg(F.count("*").alias("n"), F.sum("acc_x").alias("a"), F.sum("gyr_z").alias("w"))),
    "select round(t, 6) as timestamp, count(*) as n, round(sum(a_long), 6) as a, round(sum(yaw), 6) as w from imu where h % 13 <> 0 and t >= 2 and t <= 9 group by t", "imu")
put("SRC-07", lambda spark, d: rounded(logs.timeline(spark, imu_log(spark, d)).groupBy("timestamp").agg(F.count("*").alias("n"))), "select round(t, 6) as timestamp, count(*) as n from imu group by t", "imu")


def nmea_log(spark, d):
    f = fixes(spark, d)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = c("event_id") % 86400
    line = F.concat(F.when(c("k") % 7 == 0, "$GNRMC").otherwise("$GPGGA"), F.lit(","), two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60), F.lit(".50,5955.8,N,03021.6,E,"), (c("k") % 3).cast("string"), F.lit(","), (c("k") % 13).cast("string"), F.lit(",0.9,5.0,M,,M,,*00"))
    return written(f.select(line.alias("value")), "nmea")


put("SRC-08", lambda spark, d: logs.gga(spark, nmea_log(spark, d)).groupBy("quality").agg(F.count("*").alias("n"), F.sum("tod").alias("tod"), F.sum("satellites").alias("satellites"), F.round(F.max("hdop"), 3).alias("hdop")),
    "select cast(k % 3 as integer) as quality, count(*) as n, sum(event_id % 86400 + 0.5e0) as tod, cast(sum(k % 13) as bigint) as satellites, 0.9e0 as hdop from fixes where k % 7 <> 0 group by 1", "fixes")


def anchor_log(spark, d):
    f = fixes(spark, d).where("good")
    rows = f.select(F.lit("car-1").alias("device_id"), (c("t") * 1000).alias("host_time_ms"), c("k").cast("string").alias("anchor_id"), (c("t") * 1000 + 3).alias("anchor_ts_ms"), (c("course") * 2 - 90).alias("heading"), "lat", "lon", F.when(c("k") % 4 == 0, "True").otherwise("false").alias("clamped"), F.when(c("k") % 5 != 0, c("k") * 1.5).alias("dt_residual_ms"))
    return written(rows, "rfid", "csv")


put("SRC-09", lambda spark, d: rounded(logs.anchors(spark, anchor_log(spark, d)).groupBy("anchor_id").agg(F.count("*").alias("n"), F.count_if("clamped").alias("clamped"), F.avg("course").alias("course"), F.count("dt_residual_ms").alias("residuals"), F.count("imu_sample_ts_ms").alias("bound")), 7),
    "select cast(k as varchar) as anchor_id, count(*) as n, count(*) filter (where k % 4 = 0) as clamped, round(avg(course * 2 - 90 - 360.0e0 * floor((course * 2 - 90) / 360.0e0)), 7) as course, count(*) filter (where k % 5 <> 0) as residuals, 0::bigint as bound from fixes where good group by k", "fixes")


SI_COLUMNS = ["time", "ax", "ay", "az", "gx", "gy", "gz", "quat_w", "quat_x", "quat_y", "quat_z", *(f"x{i}" for i in range(10))]


def si_log(spark, d):
    """A log in as many files as tasks wrote; its columns are told beside it."""
    cells = [c("t"), c("a_long"), F.lit(0.0), F.lit(9.80665), F.lit(0.0), F.lit(0.0), c("yaw"), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    full = F.concat_ws(",", *[x.cast("string") for x in cells], *[F.lit("0")] * 9, F.when(c("h") % 17 == 0, "0,0").otherwise("0"))
    return written(imu(spark, d).select(full.alias("value")), "si-imu")


put("SRC-10", lambda spark, d: rounded(logs.imu_si(spark, si_log(spark, d), header=SI_COLUMNS).groupBy("time").agg(F.count("*").alias("n"), F.sum("ax").alias("ax"), F.max("az").alias("az"), F.sum("gz").alias("gz")), 5),
    "select round(t, 5) as time, count(*) as n, round(sum(a_long / 9.80665e0), 5) as ax, 1.0e0 as az, round(sum(degrees(yaw)), 5) as gz from imu where h % 17 <> 0 group by t", "imu")


def file_names(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-07-01").cast("date"), (c("event_id") % 90).cast("int")), "yyyy-MM-dd")
    f = fixes(spark, d)
    name = lambda kind: F.concat(F.lit(f"{kind}_"), day, F.lit(".csv"))
    return f.where("k % 3 = 0 and event_id % 90 < 70").select(name("gps").alias("name")), f.where("k % 5 = 0 and event_id % 90 > 10").select(name("imu").alias("name"))


put("SRC-11", lambda spark, d: logs.days(*file_names(spark, d)),
    "select distinct strftime(date '2024-07-01' + cast(event_id % 90 as integer), '%Y-%m-%d') as day from fixes where k % 3 = 0 and event_id % 90 < 70 intersect select distinct strftime(date '2024-07-01' + cast(event_id % 90 as integer), '%Y-%m-%d') from fixes where k % 5 = 0 and event_id % 90 > 10", "fixes")


def tracks(spark, d):
    """Tracks as GeoJSON, broken where the state was LOST, read back: parts and points per trip, and the last point."""
    rows = states(spark, d).select("trip_id", "seq", (c("state") == "LOST").alias("lost")).join(fixes(spark, d).select("trip_id", "seq", "lat", "lon"), ["trip_id", "seq"])
    lines = geojson.tracks(rows, "lost")
    back = geojson.read(spark, written(lines.select("value"), "tracks"))
    return rounded(back.groupBy("trip_id", "kind").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("points"), F.max_by("lon", F.struct("part", "place")).alias("lon"), F.max_by("lat", F.struct("part", "place")).alias("lat")), 6)


put("SRC-21", tracks,
    """with p as (select s.trip_id, s.seq, s.state = 'LOST' as lost, lat, lon, sum(case when s.state = 'LOST' then 1 else 0 end) over (partition by s.trip_id order by s.seq) as part from states s join fixes f on f.trip_id = s.trip_id and f.seq = s.seq
), g as (select trip_id, part, count(*) as n, arg_max(lon, seq) as lon, arg_max(lat, seq) as lat from p where not lost group by 1, 2), k as (select * from g where n >= 2)
select trip_id, case when count(*) > 1 then 'MultiLineString' else 'LineString' end as kind, count(*) as parts, cast(sum(n) as bigint) as points, round(arg_max(lon, part), 6) as lon, round(arg_max(lat, part), 6) as lat from k group by 1""", "states")  # fmt: skip


def raw_fixes(spark, d):
    """Fixes as GeoJSON points with their properties, read back."""
    lines = geojson.points(fixes(spark, d).where("good"), ["seq", "speed", "event_type"])
    back = geojson.read(spark, written(lines.select("value"), "points"))
    return rounded(back.groupBy("trip_id", F.get_json_object("properties", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg(F.get_json_object("properties", "$.speed").cast("double")).alias("speed")), 5)


put("SRC-22", raw_fixes, "select trip_id, event_type, count(*) as n, round(avg(lat), 5) as lat, round(avg(speed), 5) as speed from fixes where good group by 1, 2", "fixes")


def uncertainty(spark, d):
    """Rectangles of the three heaviest edges of each belief as GeoJSON polygons, read back with their areas."""
    p = particles(spark, d).groupBy("trip_id", "edge").agg(F.sum("w").alias("w"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("trip_id").orderBy(F.round("w", 6).desc(), "edge"))).where("rank <= 3")
    ring = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((c("s0"), c("edge") * 10), (c("s1"), c("edge") * 10), (c("s1"), c("edge") * 10 + 8), (c("s0"), c("edge") * 10 + 8), (c("s0"), c("edge") * 10))])
    lines = geojson.polygons(p.select("trip_id", "rank", "edge", F.array(ring).alias("rings")), ["rank", "edge"])
    back = geojson.read(spark, written(lines.select("value"), "regions"))
    return rounded(geojson.areas(back, ["trip_id", F.get_json_object("properties", "$.rank").cast("int").alias("rank")]), 4)


put("SRC-23", uncertainty,
    """with g as (select trip_id, edge, sum(w) as w, min(s) as s0, max(s) as s1 from particles group by 1, 2), r as (select *, row_number() over (partition by trip_id order by round(w, 6) desc, edge) as rank from g)
select trip_id, cast(rank as integer) as rank, round((s1 - s0) * 8.0e0, 4) as area from r where rank <= 3""", "particles")  # fmt: skip
