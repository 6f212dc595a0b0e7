"""Queries over sessions, as-of joins, rolling windows, beliefs and metrics, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import asof, belief, islands, rolling, trust

from .views import fixes, imu, particles, reference, sql, states, table

c = F.col
r4, r6 = (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text, *uses)


SESSIONS = """
with j as (
  select *, lag(t) over w as t_, lag(lat) over w as lat_, lag(lon) over w as lon_, lag(speed) over w as v_ from fixes window w as (partition by trip_id order by t, seq)
), i as (
  select *, sum(case when t - t_ > 60.0e0 then 1 else 0 end) over (partition by trip_id order by t, seq rows unbounded preceding) as island from j
), s as (
  select *, case when t - t_ <= 60.0e0 then t - t_ end as dt,
    case when t - t_ <= 60.0e0 then 2.0e0 * 6371000.0e0 * asin(least(1.0e0, sqrt(pow(sin((radians(lat) - radians(lat_)) / 2), 2) + cos(radians(lat_)) * cos(radians(lat)) * pow(sin(radians(lon - lon_) / 2), 2)))) end as step from i
), g as (
  select trip_id, island, min(t) as t0, max(t) as t1, count(*) as fixes, coalesce(sum(case when v_ > 1.0e0 then dt end), 0.0e0) as moving_s,
    coalesce(sum(step), 0.0e0) as distance_m, count(*) filter (where step > 60.0e0 * greatest(dt, 0.05e0)) as jumps
  from s group by 1, 2 having max(t) - min(t) >= 60.0e0
)
select trip_id, row_number() over (partition by trip_id order by t0) - 1 as session, round(t0, 6) as t0, round(t1, 6) as t1, fixes, round(moving_s, 4) as moving_s, round(distance_m, 2) as distance_m, jumps from g
"""


def session_summary(spark, d):
    s = islands.sessions(fixes(spark, d))
    return s.select("trip_id", "session", r6(c("t0")).alias("t0"), r6(c("t1")).alias("t1"), "fixes", r4(c("moving_s")).alias("moving_s"), F.round("distance_m", 2).alias("distance_m"), "jumps")


put("AG-01", session_summary, SESSIONS, "fixes")
put("WN-01", lambda spark, d: islands.by_gap(fixes(spark, d), ["trip_id"], "t", ["t", "seq"], 60.0).select("trip_id", "seq", "island"),
    "select trip_id, seq, sum(case when t - t_ > 60.0e0 then 1 else 0 end) over (partition by trip_id order by t, seq rows unbounded preceding) as island from (select *, lag(t) over (partition by trip_id order by t, seq) as t_ from fixes)", "fixes")
RUNS = "with a as (select *, case when state is distinct from lag(state) over (partition by trip_id order by seq) then 1 else 0 end as b from states), r as (select *, sum(b) over (partition by trip_id order by seq rows unbounded preceding) as island from a) "
put("AG-09", lambda spark, d: islands.intervals(states(spark, d)).select("trip_id", "state", r6(c("start")).alias("start"), r6(c("end")).alias("end"), "rows"),
    RUNS + 'select trip_id, min(state) as state, round(min(t), 6) as start, round(max(t), 6) as "end", count(*) as rows from r group by trip_id, island', "states")
put("AG-10", lambda spark, d: islands.outages(states(spark, d)).select("trip_id", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"), "state"), """
with a as (select *, state <> 'TRUSTED' as o, lead(t) over (partition by trip_id order by seq) as nxt, min(t) over (partition by trip_id) as t0, max(t) over (partition by trip_id) as t9 from states),
b as (select *, case when o is distinct from lag(o) over (partition by trip_id order by seq) then 1 else 0 end as ch from a),
r as (select *, sum(ch) over (partition by trip_id order by seq rows unbounded preceding) as island from b),
g as (select trip_id, round(min(t) - min(t0), 2) as start_s, round(coalesce(arg_max(coalesce(nxt, t9), seq), min(t9)) - min(t0), 2) as end_s, arg_max(state, seq) as state from r where o group by trip_id, island)
select * from g where end_s - start_s > 1.0e0 and start_s > 0.5e0""", "states")
put("WN-02", lambda spark, d: islands.motion_start(fixes(spark, d), 5.0, 20.0).select("trip_id", r6(c("t")).alias("t")), """
with a as (select *, speed >= 5.0e0 as m from fixes), b as (select *, case when m is distinct from lag(m) over (partition by trip_id order by t, seq) then 1 else 0 end as ch from a),
r as (select *, sum(ch) over (partition by trip_id order by t, seq rows unbounded preceding) as island from b),
g as (select trip_id, min(t) as t from r where m group by trip_id, island having max(t) - min(t) >= 20.0e0)
select trip_id, round(min(t), 6) as t from g group by 1""", "fixes")


def rolled(**more):
    return lambda spark, d: imu(spark, d).select("trip_id", "n", *[f().alias(k) for k, f in more.items()])


FRAME = "over (partition by trip_id order by n rows between {} preceding and {} following)"
put("WN-05", rolled(sd=lambda: r6(rolling.rolling_std("a_long", 5))), f"select trip_id, n, round(stddev_pop(a_long) {FRAME.format(5, 5)}, 6) as sd from imu", "imu")
put("WN-06", rolled(mean=lambda: F.round(rolling.rolling_mean("a_long", 3), 9)), f"select trip_id, n, 0.0e0 + round(avg(a_long) {FRAME.format(3, 3)}, 9) as mean from imu", "imu")
put("WN-07", rolled(mean=lambda: F.round(rolling.boxcar("a_long", 5), 9)), f"select trip_id, n, 0.0e0 + round(sum(a_long) {FRAME.format(2, 2)} / 5, 9) as mean from imu", "imu")
put("WN-09", rolled(rest=lambda: (rolling.rolling_std("a_long", 5) < 1.0) & (rolling.rolling_std("yaw", 5) < 0.11)), f"select trip_id, n, stddev_pop(a_long) {FRAME.format(5, 5)} < 1.0e0 and stddev_pop(yaw) {FRAME.format(5, 5)} < 0.11e0 as rest from imu", "imu")
put("WN-04", lambda spark, d: rolling.hampel(imu(spark, d), "a_long", 3, 1.5, 0.05).select("trip_id", "n", F.round("clean", 9).alias("clean")), """
with p as (
  select trip_id, n, a_long, list(a_long) over (partition by trip_id order by n rows between 3 preceding and 3 following) as w,
    row_number() over (partition by trip_id order by n) as i, count(*) over (partition by trip_id) as m,
    first_value(a_long) over (partition by trip_id order by n) as a, first_value(a_long) over (partition by trip_id order by n desc) as z from imu
), q as (
  select *, list_sort(list_concat(list_concat(list_transform(range(0, greatest(0, 4 - i)), lambda x: a), w), list_transform(range(0, greatest(0, i + 3 - m)), lambda x: z)))[4] as mid,
    list_concat(list_concat(list_transform(range(0, greatest(0, 4 - i)), lambda x: a), w), list_transform(range(0, greatest(0, i + 3 - m)), lambda x: z)) as p from p
), r as (select *, list_sort(list_transform(p, lambda x: abs(x - mid)))[4] as mad from q)
select trip_id, n, 0.0e0 + round(case when abs(a_long - mid) > 1.5e0 * greatest(1.4826e0 * mad, 0.05e0) then mid else a_long end, 9) as clean from r""", "imu")
put("WN-10", lambda spark, d: islands.stops(imu(spark, d), F.abs("a_long") < 0.9, 3, 0.1).select("trip_id", "n", "stationary", r6(c("stopped_s")).alias("stopped_s")), """
with a as (select *, abs(a_long) < 0.9e0 as q from imu), b as (select *, case when q is distinct from lag(q) over (partition by trip_id order by n) then 1 else 0 end as ch from a),
r as (select *, sum(ch) over (partition by trip_id order by n rows unbounded preceding) as island from b),
s as (select *, q and count(*) over (partition by trip_id, island) >= 3 as st, row_number() over (partition by trip_id, island order by n) as k from r)
select trip_id, n, st as stationary, round(case when st then k * 0.1e0 else 0.0e0 end, 6) as stopped_s from s""", "imu")
put("WN-11", lambda spark, d: rolling.thinned(imu(spark, d), 5).select("trip_id", "n", "h"), "select trip_id, n, h from (select *, row_number() over (partition by trip_id order by n) - 1 as r from imu) where r % 5 = 0", "imu")
put("WN-03", lambda spark, d: rolling.resampled(imu(spark, d).where("h % 7 <> 0"), 4).select("trip_id", "bin", F.round("a", 9).alias("a"), F.round("peak", 9).alias("peak"), "samples"), """
with d as (select * from imu where h % 7 <> 0), s as (select trip_id, min(n) as lo, max(n) as hi from d group by 1),
g as (select trip_id, unnest(range(0, (hi - lo) // 4 + 1)) as bin from s),
b as (select d.trip_id, (n - lo) // 4 as bin, quantile_cont(a_long, 0.5) as a, max(abs(yaw)) as peak, count(*) as samples from d join s on s.trip_id = d.trip_id group by 1, 2)
select g.trip_id, g.bin, 0.0e0 + round(coalesce(a, 0.0e0), 9) as a, round(coalesce(peak, 0.0e0), 9) as peak, coalesce(samples, 0) as samples from g left join b on b.trip_id = g.trip_id and b.bin = g.bin""", "imu")
put("WN-17", lambda spark, d: islands.turns(imu(spark, d), 0.1, least_rate=0.15, least_delta=0.06, max_gap=0.1).select("trip_id", r6(c("t_start")).alias("t_start"), r6(c("t_end")).alias("t_end"), r6(c("t_peak")).alias("t_peak"), r6(c("delta")).alias("delta"), r6(c("peak_rate")).alias("peak_rate")), """
with a as (select *, abs(yaw) > 0.15e0 as act from imu), b as (select *, max(case when act then n end) over (partition by trip_id order by n rows unbounded preceding) as last_ from a),
k as (select *, lag(last_) over (partition by trip_id order by n) as before_, last_ is not null and n - last_ <= 2 as inside from b),
r as (select *, sum(case when act and (before_ is null or n - before_ > 2) then 1 else 0 end) over (partition by trip_id order by n rows unbounded preceding) as island from k),
g as (select trip_id, island, min(t) as t_start, max(t) as t_end, sum(yaw) * 0.1e0 as delta, max(abs(yaw)) as top from r where inside group by 1, 2),
p as (select r.trip_id, r.island, min(n) as n from r join g on g.trip_id = r.trip_id and g.island = r.island where inside and abs(yaw) = top group by 1, 2)
select g.trip_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(r.t, 6) as t_peak, round(delta, 6) as delta, round(r.yaw, 6) as peak_rate
from g join p on p.trip_id = g.trip_id and p.island = g.island join r on r.trip_id = p.trip_id and r.n = p.n where abs(delta) >= 0.06e0""", "imu")
put("WN-21", lambda spark, d: fixes(spark, d).select("trip_id", "seq", F.round(rolling.trailing("avg(speed)", 20.0), 9).alias("mean20"), F.round(rolling.trailing("max(speed)", 30.0), 9).alias("max30")),
    "select trip_id, seq, round(avg(speed) over (partition by trip_id order by t range between 20.0e0 preceding and current row), 9) as mean20, round(max(speed) over (partition by trip_id order by t range between 30.0e0 preceding and current row), 9) as max30 from fixes", "fixes")
put("WN-24", lambda spark, d: fixes(spark, d).withColumn("dt", F.coalesce(c("t") - F.lag("t").over(Window.partitionBy("trip_id").orderBy("seq")), F.lit(0.0))).select("trip_id", "seq", F.round(F.sum(c("speed") * c("dt")).over(Window.partitionBy("trip_id").orderBy("seq")), 4).alias("way")),
    "select trip_id, seq, round(sum(speed * dt) over (partition by trip_id order by seq rows unbounded preceding), 4) as way from (select *, coalesce(t - lag(t) over (partition by trip_id order by seq), 0.0e0) as dt from fixes)", "fixes")
put("WN-26", lambda spark, d: fixes(spark, d).withColumn("m", F.expr("percentile(speed, 0.5) over (partition by trip_id order by course range between 20.0D preceding and 20.0D following)")).select("trip_id", "seq", F.round(c("speed") - c("m"), 6).alias("rest")),
    "select trip_id, seq, 0.0e0 + round(speed - quantile_cont(speed, 0.5) over (partition by trip_id order by course range between 20.0e0 preceding and 20.0e0 following), 6) as rest from fixes", "fixes")
put("WN-29", lambda spark, d: imu(spark, d).where("abs(yaw) < 0.1").groupBy("trip_id").agg(F.count("*").alias("n"), r6(F.when(F.count("*") >= 20, F.avg("a_long"))).alias("accel_bias"), r6(F.when(F.count("*") >= 20, F.expr("percentile(yaw, 0.5)"))).alias("gyro_bias")),
    "select trip_id, count(*) as n, 0.0e0 + round(case when count(*) >= 20 then avg(a_long) end, 6) as accel_bias, 0.0e0 + round(case when count(*) >= 20 then quantile_cont(yaw, 0.5) end, 6) as gyro_bias from imu where abs(yaw) < 0.1e0 group by 1", "imu")
put("WN-30", lambda spark, d: fixes(spark, d).groupBy("trip_id").agg(r6(F.coalesce(F.min_by(F.when(c("speed") > 3.0, c("course")), F.when(c("speed") > 3.0, c("seq"))), F.lit(0.0))).alias("course")),
    "select trip_id, round(coalesce(arg_min(course, seq) filter (where speed > 3.0e0), 0.0e0), 6) as course from fixes group by 1", "fixes")
put("WN-32", lambda spark, d: islands.numbered(fixes(spark, d), ["trip_id"], ["seq"], c("event_type") == "error", "segment").select("trip_id", "seq", "segment"),
    "select trip_id, seq, sum(case when event_type = 'error' then 1 else 0 end) over (partition by trip_id order by seq rows unbounded preceding) as segment from fixes", "fixes")
put("WN-28", lambda spark, d: fixes(spark, d).where("event_type = 'signup'").withColumn("t1", F.lead("t").over(Window.partitionBy("trip_id").orderBy("seq"))).withColumn("s1", F.lead("seq").over(Window.partitionBy("trip_id").orderBy("seq"))).where("t1 - t > 0 and t1 - t <= 240.0 and s1 - seq >= 3").select("trip_id", "seq", (c("s1") - c("seq")).alias("fixes"), r6(c("t1") - c("t")).alias("lap_s")),
    "select trip_id, seq, s1 - seq as fixes, round(t1 - t, 6) as lap_s from (select *, lead(t) over (partition by trip_id order by seq) as t1, lead(seq) over (partition by trip_id order by seq) as s1 from fixes where event_type = 'signup') where t1 - t > 0 and t1 - t <= 240.0e0 and s1 - seq >= 3", "fixes")
put("WN-18", lambda spark, d: fixes(spark, d).withColumn("d", (c("k") - 50) / 40.0).withColumn("nd", F.lead("d").over(Window.partitionBy("trip_id").orderBy("seq"))).withColumn("nt", F.lead("t").over(Window.partitionBy("trip_id").orderBy("seq"))).select("trip_id", "seq", F.coalesce((F.abs("d") < 0.8) & (F.abs("nd") < 0.8) & (c("d") * c("nd") < 0) & (c("nt") - c("t") <= 8.0), F.lit(False)).alias("lane_change")),
    "select trip_id, seq, coalesce(abs(d) < 0.8e0 and abs(nd) < 0.8e0 and d * nd < 0 and nt - t <= 8.0e0, false) as lane_change from (select *, lead(d) over (partition by trip_id order by seq) as nd, lead(t) over (partition by trip_id order by seq) as nt from (select *, (k - 50) / 40.0e0 as d from fixes))", "fixes")
put("FL-15", lambda spark, d: fixes(spark, d).select("trip_id", "seq", ((rolling.trailing("avg(case when speed > 15 then 1D else 0D end)", 30.0) > 0.02) | (rolling.trailing("max(speed)", 20.0) > 15.0)).alias("gate")),
    "select trip_id, seq, avg(case when speed > 15.0e0 then 1.0e0 else 0.0e0 end) over (partition by trip_id order by t range between 30.0e0 preceding and current row) > 0.02e0 or max(speed) over (partition by trip_id order by t range between 20.0e0 preceding and current row) > 15.0e0 as gate from fixes", "fixes")

ASOF = """
with b as (select f.trip_id, f.seq, f.t, max(r.t) as tb from fixes f left join reference r on r.trip_id = f.trip_id and r.t <= f.t group by 1, 2, 3),
n as (select b.*, x.tn from b left join (select f.trip_id, f.seq, min(r.t) as tn from fixes f join reference r on r.trip_id = f.trip_id and r.t >= f.t group by 1, 2) x on x.trip_id = b.trip_id and x.seq = b.seq),
j as (select n.*, p.re as pe, p.rn as pn, q.re as qe, q.rn as qn from n left join reference p on p.trip_id = n.trip_id and p.t = n.tb left join reference q on q.trip_id = n.trip_id and q.t = n.tn)
"""


def joined(f):
    def run(spark, d):
        left = fixes(spark, d).select("trip_id", "seq", "t")
        return f(left, reference(spark, d)).select("trip_id", "seq", r6(c("re")).alias("re"), r6(c("rn")).alias("rn"))

    return run


LERP = "case when tb = t then pe when tn = t then qe when tn - tb <= {g} then pe + (qe - pe) * (t - tb) / (tn - tb) {e} end"
put("JN-02", joined(lambda a, b: asof.backward(a, b, ["trip_id"], ["re", "rn"], 10.0)), ASOF + "select trip_id, seq, round(case when t - tb <= 10.0e0 then pe end, 6) as re, round(case when t - tb <= 10.0e0 then pn end, 6) as rn from j", "fixes", "reference")
put("JN-01", joined(lambda a, b: asof.nearest(a, b, ["trip_id"], ["re", "rn"], 10.0)), ASOF + "select trip_id, seq, round(case when least(coalesce(t - tb, tn - t), coalesce(tn - t, t - tb)) <= 10.0e0 then case when tn is null or t - tb <= tn - t then pe else qe end end, 6) as re, round(case when least(coalesce(t - tb, tn - t), coalesce(tn - t, t - tb)) <= 10.0e0 then case when tn is null or t - tb <= tn - t then pn else qn end end, 6) as rn from j", "fixes", "reference")
put("JN-03", joined(lambda a, b: asof.interpolated(a, b, ["trip_id"], ["re", "rn"], 40.0)), ASOF + "select trip_id, seq, round(" + LERP.format(g="40.0e0", e="") + ", 6) as re, round(" + LERP.format(g="40.0e0", e="").replace("pe", "pn").replace("qe", "qn") + ", 6) as rn from j", "fixes", "reference")
put("JN-04", joined(lambda a, b: asof.interpolated(a, b, ["trip_id"], ["re", "rn"], None, clamp=True)), ASOF + "select trip_id, seq, round(" + LERP.format(g="1e18", e="when tn is null then pe when tb is null then qe") + ", 6) as re, round(" + LERP.format(g="1e18", e="when tn is null then pe when tb is null then qe").replace("pe", "pn").replace("qe", "qn") + ", 6) as rn from j", "fixes", "reference")
put("JN-23", lambda spark, d: asof.backward(fixes(spark, d).select("trip_id", "seq", "t"), reference(spark, d).withColumn("edge", c("re").cast("long") % 9), ["trip_id"], ["edge"]).join(reference(spark, d).groupBy("trip_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by(c("re").cast("long") % 9, "t").alias("e0")), "trip_id").select("trip_id", "seq", F.when(c("t").between(c("t0") - 2.0, c("t1") + 2.0), F.coalesce("edge", "e0")).alias("edge")), ASOF + "select j.trip_id, seq, case when t >= t0 - 2.0e0 and t <= t1 + 2.0e0 then coalesce(cast(trunc(pe) as bigint) % 9, e0) end as edge from j join (select trip_id, min(t) as t0, max(t) as t1, cast(trunc(arg_min(re, t)) as bigint) % 9 as e0 from reference group by 1) s on s.trip_id = j.trip_id", "fixes", "reference")


def fixes_in_sessions(spark, d):
    s = islands.sessions(fixes(spark, d)).select(c("trip_id").alias("id"), "session", "t0", "t1")
    f = fixes(spark, d)
    return f.join(s, (c("trip_id") == c("id")) & c("t").between(c("t0"), c("t1"))).select("trip_id", "session", "seq")


put("JN-05", fixes_in_sessions, SESSIONS.strip().rpartition("\nselect")[0] + ", n as (select trip_id, t0, t1, row_number() over (partition by trip_id order by t0) - 1 as session from g) select f.trip_id, n.session, f.seq from fixes f join n on n.trip_id = f.trip_id and f.t between n.t0 and n.t1", "fixes")
put("JN-21", lambda spark, d: table(spark, d, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("m")).select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "m.l_linenumber", "m.l_partkey", "m.l_suppkey"),
    "select l_orderkey, strftime(l_shipdate, '%Y-%m-%d') as day, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_shipdate order by l_linenumber desc, l_partkey desc, l_suppkey desc) as r from lineitem) where r = 1")
put("JN-22", lambda spark, d: fixes(spark, d).select("trip_id", "t", F.lit(0).alias("kind"), c("seq").alias("place")).unionByName(imu(spark, d).select("trip_id", "t", F.lit(1).alias("kind"), c("n").alias("place"))).withColumn("pos", F.row_number().over(Window.partitionBy("trip_id").orderBy("t", "kind", "place"))).select("trip_id", "kind", "place", "pos"),
    "select trip_id, kind, place, row_number() over (partition by trip_id order by t, kind, place) as pos from (select trip_id, t, 0 as kind, seq as place from fixes union all select trip_id, t, 1, n from imu)", "fixes", "imu")


def errors(spark, d):
    e = asof.interpolated(fixes(spark, d), reference(spark, d), ["trip_id"], ["re", "rn"], 40.0)
    return e.withColumn("err", F.hypot(c("east") - c("re"), c("north") - c("rn")))


ERR = ASOF.rstrip() + ", e as (select f.*, j.re, j.rn, sqrt((f.east - j.re) * (f.east - j.re) + (f.north - j.rn) * (f.north - j.rn)) as err from fixes f join (select trip_id, seq, " + LERP.format(g="40.0e0", e="") + " as re, " + LERP.format(g="40.0e0", e="").replace("pe", "pn").replace("qe", "qn") + " as rn from j) j on j.trip_id = f.trip_id and j.seq = f.seq) "
put("AG-02", lambda spark, d: errors(spark, d).groupBy("trip_id").agg(r4(F.avg("err")).alias("mean"), r4(F.expr("percentile(err, 0.5)")).alias("median"), r4(F.expr("percentile(err, 0.95)")).alias("p95"), r4(F.max("err")).alias("worst"), F.count("err").alias("n")),
    ERR + "select trip_id, round(avg(err), 4) as mean, round(quantile_cont(err, 0.5), 4) as median, round(quantile_cont(err, 0.95), 4) as p95, round(max(err), 4) as worst, count(err) as n from e group by 1", "fixes", "reference")
put("AG-03", lambda spark, d: errors(spark, d).where("err is not null").groupBy("trip_id").agg(r6(F.avg((c("err") <= c("acc") * 2).cast("double"))).alias("coverage"), r4(F.avg(c("acc") * c("acc"))).alias("area"), F.count("*").alias("n")),
    ERR + "select trip_id, round(avg(case when err <= acc * 2 then 1.0e0 else 0.0e0 end), 6) as coverage, round(avg(acc * acc), 4) as area, count(*) as n from e where err is not null group by 1", "fixes", "reference")
put("AG-05", lambda spark, d: states(spark, d).groupBy("trip_id").agg(r6(F.try_divide(F.count_if(~c("accepted") & (c("k") % 4 != 0)), F.count_if(c("k") % 4 != 0))).alias("rejected_good"), r6(F.try_divide(F.count_if(c("accepted") & (c("k") % 4 == 0)), F.count_if(c("k") % 4 == 0))).alias("accepted_false")),
    "select trip_id, round(cast(count(*) filter (where not accepted and k % 4 <> 0) as double) / nullif(count(*) filter (where k % 4 <> 0), 0), 6) as rejected_good, round(cast(count(*) filter (where accepted and k % 4 = 0) as double) / nullif(count(*) filter (where k % 4 = 0), 0), 6) as accepted_false from states group by 1", "states")
put("AG-07", lambda spark, d: errors(spark, d).where("err is not null").groupBy("trip_id").agg(r4(F.min_by(F.when(F.abs(c("t") - 300.0) <= 2.0, c("err")), F.struct(F.abs(c("t") - 300.0), c("seq")))).alias("err")),
    ERR + "select trip_id, case when abs(t - 300.0e0) <= 2.0e0 then round(err, 4) end as err from (select *, row_number() over (partition by trip_id order by abs(t - 300.0e0), seq) as r from e where err is not null) where r = 1", "fixes", "reference")
put("AG-08", lambda spark, d: states(spark, d).withColumn("whys", F.filter(F.array(F.when(c("k") % 3 == 0, "physical"), F.when(c("k") % 5 == 0, "speed"), F.when(~c("accepted"), "course")), lambda x: x.isNotNull())).withColumn("why", F.explode(F.array_union(c("whys"), F.array(F.lit("tested"), F.when(F.size("whys") == 0, "accepted").otherwise("rejected"))))).groupBy("trip_id").pivot("why", ["tested", "accepted", "rejected", "physical", "speed", "course"]).count().na.fill(0),
    "select trip_id, count(*) as tested, count(*) filter (where k % 3 <> 0 and k % 5 <> 0 and accepted) as accepted, count(*) filter (where k % 3 = 0 or k % 5 = 0 or not accepted) as rejected, count(*) filter (where k % 3 = 0) as physical, count(*) filter (where k % 5 = 0) as speed, count(*) filter (where not accepted) as course from states group by 1", "states")
put("AG-11", lambda spark, d: imu(spark, d).groupBy("trip_id", F.floor(c("n") / 20).alias("bucket")).agg(r6(F.expr("percentile(abs(a_long), 0.9)")).alias("a90"), r6(F.expr("percentile(abs(yaw), 0.9)")).alias("w90"), F.count_if(F.abs("a_long") > 1.8).alias("shocks"), r6(F.avg((F.abs("yaw") < 0.03).cast("double"))).alias("quiet")),
    "select trip_id, n // 20 as bucket, round(quantile_cont(abs(a_long), 0.9), 6) as a90, round(quantile_cont(abs(yaw), 0.9), 6) as w90, count(*) filter (where abs(a_long) > 1.8e0) as shocks, round(avg(case when abs(yaw) < 0.03e0 then 1.0e0 else 0.0e0 end), 6) as quiet from imu group by 1, 2", "imu")
put("AG-13_steps", lambda spark, d: reference(spark, d).withColumn("dt", c("t") - F.lag("t").over(Window.partitionBy("trip_id").orderBy("t"))).withColumn("step", F.hypot(c("re") - F.lag("re").over(Window.partitionBy("trip_id").orderBy("t")), c("rn") - F.lag("rn").over(Window.partitionBy("trip_id").orderBy("t")))).groupBy("trip_id").agg(F.count_if(c("step") > 60 * c("dt")).alias("wild"), F.count_if(c("dt") > 20.0).alias("gaps")),
    "select trip_id, count(*) filter (where step > 60 * dt) as wild, count(*) filter (where dt > 20.0e0) as gaps from (select *, t - lag(t) over w as dt, sqrt((re - lag(re) over w) * (re - lag(re) over w) + (rn - lag(rn) over w) * (rn - lag(rn) over w)) as step from reference window w as (partition by trip_id order by t)) group by 1", "reference")
put("AG-14", lambda spark, d: fixes(spark, d).select("trip_id", "seq", F.round((c("k") - 50) * F.cos(c("course") / 60.0) + c("speed") * F.sin(c("course") / 60.0), 6).alias("along"), F.round(-(c("k") - 50) * F.sin(c("course") / 60.0) + c("speed") * F.cos(c("course") / 60.0), 6).alias("cross")),
    'select trip_id, seq, 0.0e0 + round((k - 50) * cos(course / 60.0e0) + speed * sin(course / 60.0e0), 6) as along, 0.0e0 + round(-(k - 50) * sin(course / 60.0e0) + speed * cos(course / 60.0e0), 6) as "cross" from fixes', "fixes")
put("AG-26", lambda spark, d: fixes(spark, d).withColumn("v", c("course") / 20.0).groupBy("trip_id").agg(r6(F.avg(c("speed") - c("v"))).alias("bias"), r6(F.avg(F.abs(c("speed") - c("v")))).alias("mae"), r6(F.sqrt(F.avg(F.pow(c("speed") - c("v"), 2)))).alias("rmse"), r6(F.when(F.count("*") > 2, F.corr("speed", "v"))).alias("corr"), r6(F.try_divide(F.stddev_pop("speed"), F.stddev_pop("v"))).alias("spread")),
    "select trip_id, round(avg(speed - v), 6) as bias, round(avg(abs(speed - v)), 6) as mae, round(sqrt(avg(pow(speed - v, 2))), 6) as rmse, round(case when count(*) > 2 then corr(speed, v) end, 6) as corr, round(stddev_pop(speed) / nullif(stddev_pop(v), 0), 6) as spread from (select *, course / 20.0e0 as v from fixes) group by 1", "fixes")
def held_out(spark, d):
    """Leave one trip out: the mean of all other trips as the prediction for it, and its errors there.

    The totals are one row of partial sums, so no task sees all trips.
    """
    sums = fixes(spark, d).groupBy("trip_id").agg(F.sum("k").alias("s"), F.count("*").alias("n"))
    total, count = sums.agg(F.sum("s"), F.sum("n")).first()
    others = sums.select("trip_id", ((F.lit(total) - c("s")) / (F.lit(count) - c("n"))).alias("others"))
    rows = fixes(spark, d).select("trip_id", "k").join(others, "trip_id")
    return rows.groupBy("trip_id").agg(F.count("*").alias("n"), r6(F.first("others")).alias("others"), r6(F.avg(F.abs(c("k") - c("others")))).alias("mae"), (r6(F.avg(c("k") - c("others"))) + 0.0).alias("bias"))


put("AG-29", lambda spark, d: fixes(spark, d).groupBy(F.floor(c("speed") / 5).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("acc")).alias("mean"), r6(F.stddev_pop("acc")).alias("sd"), *[r6(F.expr(f"percentile(acc, {q})")).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)]),
    "select cast(floor(speed / 5) as bigint) as bin, count(*) as n, round(avg(acc), 6) as mean, round(stddev_pop(acc), 6) as sd, " + ", ".join(f"round(quantile_cont(acc, {q}), 6) as p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from fixes group by 1", "fixes")
put("AG-31", lambda spark, d: held_out(spark, d),
    """with g as (select trip_id, sum(k) as s, count(*) as n from fixes group by 1), o as (select trip_id, cast((select sum(s) from g) - s as double) / ((select sum(n) from g) - n) as others from g)
select f.trip_id, count(*) as n, round(any_value(others), 6) as others, round(avg(abs(k - others)), 6) as mae, 0.0e0 + round(avg(k - others), 6) as bias from fixes f join o on o.trip_id = f.trip_id group by 1""", "fixes")  # fmt: skip
put("AG-32", lambda spark, d: fixes(spark, d).groupBy("event_type").agg(r6(F.avg(F.abs(c("k") - c("speed")))).alias("mae"), r6(F.sqrt(F.avg(F.pow(c("k") - c("speed"), 2)))).alias("rmse"), r6(F.avg(c("speed") - c("k"))).alias("bias"), r6(1 - F.sum(F.pow(c("k") - c("speed"), 2)) / (F.var_pop("k") * F.count("*"))).alias("r2")),
    "select event_type, round(avg(abs(k - speed)), 6) as mae, round(sqrt(avg(pow(k - speed, 2))), 6) as rmse, round(avg(speed - k), 6) as bias, round(1 - sum(pow(k - speed, 2)) / (var_pop(k) * count(*)), 6) as r2 from fixes group by 1", "fixes")


def spearman(spark, d):
    f = fixes(spark, d).select("trip_id", "speed", "k")
    for x in ("speed", "k"):
        w = Window.partitionBy("trip_id").orderBy(x)
        f = f.withColumn(f"r_{x}", F.rank().over(w) + (F.count("*").over(Window.partitionBy("trip_id", x)) - 1) / 2.0)
    return f.groupBy("trip_id").agg(r6(F.when(F.count("*") > 2, F.corr("r_speed", "r_k"))).alias("rho"))


put("AG-35", spearman, "select trip_id, round(case when count(*) > 2 then corr(a, b) end, 6) as rho from (select trip_id, rank() over (partition by trip_id order by speed) + (count(*) over (partition by trip_id, speed) - 1) / 2.0e0 as a, rank() over (partition by trip_id order by k) + (count(*) over (partition by trip_id, k) - 1) / 2.0e0 as b from fixes) group by 1", "fixes")
put("AG-36_longest", lambda spark, d: islands.by_change(fixes(spark, d).withColumn("bad", c("acc") > 60.0), ["trip_id"], ["seq"], c("bad")).groupBy("trip_id", "island", "bad").agg((F.max("t") - F.min("t")).alias("len"), F.count("*").alias("n")).groupBy("trip_id").agg(r6(F.max(F.when(c("bad"), c("len")))).alias("longest"), r6(F.sum(F.when(c("bad"), c("n")).otherwise(0)) / F.sum("n")).alias("share")), """
with a as (select *, acc > 60.0e0 as bad from fixes), b as (select *, case when bad is distinct from lag(bad) over (partition by trip_id order by seq) then 1 else 0 end as ch from a),
r as (select *, sum(ch) over (partition by trip_id order by seq rows unbounded preceding) as island from b), g as (select trip_id, island, bad, max(t) - min(t) as len, count(*) as n from r group by 1, 2, 3)
select trip_id, round(max(case when bad then len end), 6) as longest, round(cast(sum(case when bad then n else 0 end) as double) / cast(sum(n) as double), 6) as share from g group by 1""", "fixes")
put("AG-37", lambda spark, d: fixes(spark, d).groupBy("trip_id").agg(F.corr("speed", "acc").alias("r"), F.count("*").alias("n")).where("n > 2 and r is not null and not isnan(r)").agg(r6(F.expr("percentile(r, 0.5)")).alias("median"), r6(F.greatest(F.avg((c("r") > 0).cast("double")), F.avg((c("r") < 0).cast("double")))).alias("same_sign")),
    "select round(quantile_cont(r, 0.5), 6) as median, round(greatest(avg(case when r > 0 then 1.0e0 else 0.0e0 end), avg(case when r < 0 then 1.0e0 else 0.0e0 end)), 6) as same_sign from (select trip_id, corr(speed, acc) as r, count(*) as n from fixes group by 1) where n > 2 and r is not null and not isnan(r)", "fixes")
put("AG-38", lambda spark, d: fixes(spark, d).groupBy("trip_id").agg(F.count("*").alias("fixes"), F.count_if("good").alias("usable"), r6(F.max("t") - F.min("t")).alias("duration"), r6(F.max("speed")).alias("top_speed")),
    "select trip_id, count(*) as fixes, count(*) filter (where good) as usable, round(max(t) - min(t), 6) as duration, round(max(speed), 6) as top_speed from fixes group by 1", "fixes")
P = "p as (select *, w / sum(w) over (partition by trip_id) as q from particles) "
norm = lambda spark, d: belief.normalized(particles(spark, d))
put("AG-19", lambda spark, d: norm(spark, d).select("trip_id", "i", F.round("w", 9).alias("w")), "with " + P + "select trip_id, i, round(q, 9) as w from p", "particles")
put("AG-18", lambda spark, d: norm(spark, d).groupBy("trip_id").agg(r6(belief.effective_size(c("w"))).alias("ess")), "with " + P + "select trip_id, round(1.0e0 / sum(q * q), 6) as ess from p group by 1", "particles")
put("AG-17", lambda spark, d: particles(spark, d).groupBy("trip_id").agg(*[r6(x).alias(n) for x, n in zip(belief.circular(c("heading"), c("w")), ("heading", "length"), strict=True)]), "select trip_id, round(atan2(sum(w * sin(heading)), sum(w * cos(heading))), 6) as heading, round(sqrt(pow(sum(w * cos(heading)), 2) + pow(sum(w * sin(heading)), 2)) / sum(w), 6) as length from particles group by 1", "particles")
put("AG-16", lambda spark, d: particles(spark, d).groupBy("trip_id").agg(*[x.alias(n) for x, n in zip(belief.circular(c("heading"), c("w")), ("heading", "length"), strict=True)]).select("trip_id", r6("heading").alias("heading"), r6(F.sqrt(-2 * F.log(F.least(F.greatest("length", F.lit(1e-12)), F.lit(1.0))))).alias("spread")), "select trip_id, round(atan2(sum(w * sin(heading)), sum(w * cos(heading))), 6) as heading, round(sqrt(-2 * ln(least(1.0e0, greatest(1e-12, sqrt(pow(sum(w * cos(heading)), 2) + pow(sum(w * sin(heading)), 2)) / sum(w))))), 6) as spread from particles group by 1", "particles")
put("AG-20", lambda spark, d: norm(spark, d).groupBy("trip_id", "edge").agg(r6(F.sum("w")).alias("mass")), "with " + P + "select trip_id, edge, round(sum(q), 6) as mass from p group by 1, 2", "particles")
put("AG-21", lambda spark, d: norm(spark, d).groupBy("trip_id", "edge").agg(F.sum("w").alias("m")).groupBy("trip_id").agg(r6(F.exp(-F.sum(c("m") * F.log("m")))).alias("streets")), "with " + P + "select trip_id, round(exp(-sum(m * ln(m))), 6) as streets from (select trip_id, edge, sum(q) as m from p group by 1, 2) group by 1", "particles")
put("AG-23", lambda spark, d: belief.merged(norm(spark, d)).select("trip_id", "edge", "cell", r6(c("best")).alias("best"), r6(c("mass")).alias("mass"), "n"), "with " + P + "select trip_id, edge, cast(floor(s / 8.0e0) as bigint) as cell, round(max(ln(q)), 6) as best, round(ln(sum(q)), 6) as mass, count(*) as n from p group by 1, 2, 3", "particles")
put("SL-02", lambda spark, d: belief.densest(norm(spark, d), 0.9).select("trip_id", "i"), "with " + P + "select trip_id, i from (select *, coalesce(sum(q) over (partition by trip_id order by w desc, i rows between unbounded preceding and 1 preceding), 0) as b from p) where b < 0.9e0", "particles")
put("SL-03", lambda spark, d: belief.resampled(norm(spark, d), 0.37).select("trip_id", "i", "copies"), "with " + P + "select trip_id, i, cast(greatest(0, least(m, ceil(hi * m - 0.37e0))) - greatest(0, least(m, ceil(lo * m - 0.37e0))) as bigint) as copies from (select *, count(*) over (partition by trip_id) as m, sum(q) over (partition by trip_id order by i rows unbounded preceding) as hi, coalesce(sum(q) over (partition by trip_id order by i rows between unbounded preceding and 1 preceding), 0.0e0) as lo from p)", "particles")
put("SL-05", lambda spark, d: belief.reduced(norm(spark, d), 8, 1.5).select("trip_id", "i", r6(c("p")).alias("p")), "with " + P + ", r as (select *, row_number() over (partition by trip_id order by ln(q) desc, i) as rk, max(ln(q)) over (partition by trip_id) as m from p), k as (select *, exp(ln(q) - m) as e from r where rk <= 8 and ln(q) >= m - 1.5e0) select trip_id, i, round(e / sum(e) over (partition by trip_id), 6) as p from k", "particles")
put("SL-07", lambda spark, d: norm(spark, d).groupBy("trip_id", "edge").agg(F.sum("w").alias("m")).withColumn("rank", F.row_number().over(Window.partitionBy("trip_id").orderBy(c("m").desc(), "edge"))).where("rank <= 5").select("trip_id", "edge", "rank", r6(c("m")).alias("mass")), "with " + P + "select trip_id, edge, rk as rank, round(m, 6) as mass from (select trip_id, edge, sum(q) as m, row_number() over (partition by trip_id order by sum(q) desc, edge) as rk from p group by 1, 2) where rk <= 5", "particles")
put("SL-08", lambda spark, d: belief.decided(norm(spark, d).groupBy("trip_id", c("edge").alias("zone")).agg(F.sum("w").alias("p")), 0.4, 0.1).select("trip_id", "zone", r6(c("p")).alias("p"), "status"), "with " + P + ", z as (select trip_id, edge, sum(q) as m from p group by 1, 2), k as (select *, row_number() over (partition by trip_id order by m desc, edge) as rk, coalesce(lead(m) over (partition by trip_id order by m desc, edge), 0.0e0) as m2 from z) select trip_id, edge as zone, round(m, 6) as p, case when m <= 0 then 'outside' when m >= 0.4e0 and m - m2 >= 0.1e0 then 'confident' else 'ambiguous' end as status from k where rk = 1", "particles")
put("ST-12_one_branch", lambda spark, d: norm(spark, d).groupBy("trip_id", "edge").agg(F.sum("w").alias("m"), (F.sum(c("w") * c("s")) / F.sum("w")).alias("s")).groupBy("trip_id").agg(F.max(F.struct("m", (-c("edge")).alias("e"), "s")).alias("b")).select("trip_id", (-c("b.e")).alias("edge"), r6(c("b.s")).alias("s")), "with " + P + ", z as (select trip_id, edge, sum(q) as m, sum(q * s) / sum(q) as s from p group by 1, 2) select trip_id, edge, round(s, 6) as s from (select *, row_number() over (partition by trip_id order by m desc, edge) as rk from z) where rk = 1", "particles")
put("UD-05", lambda spark, d: belief.normalized(particles(spark, d).withColumn("w", c("w") * (1 + c("edge") / 10.0))).select("trip_id", "i", F.round("w", 9).alias("w")), "select trip_id, i, round(w * (1 + edge / 10.0e0) / sum(w * (1 + edge / 10.0e0)) over (partition by trip_id), 9) as w from particles", "particles")
put("FN-24", lambda spark, d: particles(spark, d).withColumn("x", c("s") / 100.0).withColumn("e", F.exp(c("x") - F.max("x").over(Window.partitionBy("trip_id")))).select("trip_id", "i", F.round(c("e") / F.sum("e").over(Window.partitionBy("trip_id")), 9).alias("p")), "select trip_id, i, round(e / sum(e) over (partition by trip_id), 9) as p from (select *, exp(s / 100.0e0 - max(s / 100.0e0) over (partition by trip_id)) as e from particles)", "particles")
put("ST-08", lambda spark, d: fixes(spark, d).select("trip_id", "seq", *[F.last(F.when(c("good"), c(x)), ignorenulls=True).over(Window.partitionBy("trip_id").orderBy("seq")).alias(x) for x in ("east", "north")]), "select trip_id, seq, last_value(case when good then east end ignore nulls) over w as east, last_value(case when good then north end ignore nulls) over w as north from fixes window w as (partition by trip_id order by seq rows unbounded preceding)", "fixes")
put("ST-13", lambda spark, d: fixes(spark, d).withColumn("h", F.sqrt(F.pow((c("acc") - c("k") / 2.0) / 2, 2) + F.pow(c("speed"), 2))).select("trip_id", "seq", r6(F.sqrt(5.991 * F.greatest((c("acc") + c("k") / 2.0) / 2 + c("h"), F.lit(1.0)))).alias("radius")), "select trip_id, seq, round(sqrt(5.991e0 * greatest((acc + k / 2.0e0) / 2 + sqrt(pow((acc - k / 2.0e0) / 2, 2) + pow(speed, 2)), 1.0e0)), 6) as radius from fixes", "fixes")
put("SE-01", lambda spark, d: fixes(spark, d).select("trip_id", r6(c("t")).alias("t"), F.lit("fix").alias("src")).unionByName(reference(spark, d).select("trip_id", r6(c("t")).alias("t"), F.lit("ref").alias("src"))), "select trip_id, round(t, 6) as t, 'fix' as src from fixes union all select trip_id, round(t, 6), 'ref' from reference", "fixes", "reference")
put("SE-02", lambda spark, d: fixes(spark, d).where("good").select(F.floor(c("t") / 24).alias("day")).intersect(fixes(spark, d).where("synthetic").select(F.floor(c("t") / 24).alias("day"))), "select cast(floor(t / 24) as bigint) as day from fixes where good intersect select cast(floor(t / 24) as bigint) from fixes where synthetic", "fixes")
put("SE-03", lambda spark, d: fixes(spark, d).select("trip_id", "seq").exceptAll(fixes(spark, d).where("seq % 3 = 1").select("trip_id", "seq")), "select trip_id, seq from fixes where seq % 3 <> 1", "fixes")
put("SL-01", lambda spark, d: fixes(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("trip_id").orderBy("speed", "seq"))).select("trip_id", "seq", "pos"), "select trip_id, seq, row_number() over (partition by trip_id order by speed, seq) as pos from fixes", "fixes")
put("TX-10", lambda spark, d: belief.normalized(particles(spark, d).join(table(spark, d, "part").where("p_size > 20").select(c("p_partkey").alias("id"), (c("p_size") / 50.0).alias("score")), c("trip_id") == c("id"), "left").withColumn("w", c("w") * F.when(c("edge") < 3, F.coalesce(1 + 2.0 * c("score"), F.lit(1.0))).otherwise(1.0))).select("trip_id", "i", F.round("w", 9).alias("w")), "with b as (select x.*, w * case when edge < 3 then coalesce(1 + 2.0e0 * (p.p_size / 50.0e0), 1.0e0) else 1.0e0 end as b from particles x left join part p on p.p_partkey = x.trip_id and p.p_size > 20) select trip_id, i, round(b / sum(b) over (partition by trip_id), 9) as w from b", "particles")
put("ST-01", lambda spark, d: trust.histories(fixes(spark, d).selectExpr("trip_id", "cast(seq as int) as seq", "t", "good as accepted")), None)
put("FL-03", lambda spark, d: islands.by_change(imu(spark, d).withColumn("q", (F.abs("a_long") < 1.2) & (F.abs("yaw") < 0.15)), ["trip_id"], ["n"], c("q")).select("trip_id", "n", (c("q") & (c("n") - F.min("n").over(Window.partitionBy("trip_id", "island")) >= 2)).alias("quiet")), """
with a as (select *, abs(a_long) < 1.2e0 and abs(yaw) < 0.15e0 as q from imu), b as (select *, case when q is distinct from lag(q) over (partition by trip_id order by n) then 1 else 0 end as ch from a),
r as (select *, sum(ch) over (partition by trip_id order by n rows unbounded preceding) as island from b)
select trip_id, n, q and n - min(n) over (partition by trip_id, island) >= 2 as quiet from r""", "imu")
put("FL-05", lambda spark, d: fixes(spark, d).select("trip_id", "seq", F.coalesce(c("t") - F.lag("t").over(Window.partitionBy("trip_id").orderBy("seq")) > 20.0, F.lit(False)).alias("gap")), "select trip_id, seq, coalesce(t - lag(t) over (partition by trip_id order by seq) > 20.0e0, false) as gap from fixes", "fixes")
put("FL-14", lambda spark, d: fixes(spark, d).where("good and not synthetic and speed >= 5").select("trip_id", "seq", r6(c("speed")).alias("speed")), "select trip_id, seq, round(speed, 6) as speed from fixes where good and not synthetic and speed >= 5", "fixes")
put("AG-30", lambda spark, d: fixes(spark, d).withColumn("a", F.abs(c("speed") - 10.0)).withColumn("b", F.abs(c("speed") - c("acc") / 5.0)).groupBy(F.floor(c("speed") / 10).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("a")).alias("mae_a"), r6(F.avg("b")).alias("mae_b"), r6(100 * (1 - F.avg("b") / F.avg("a"))).alias("gain")),
    "select cast(floor(speed / 10) as bigint) as bin, count(*) as n, round(avg(a), 6) as mae_a, round(avg(b), 6) as mae_b, round(100 * (1 - avg(b) / avg(a)), 6) as gain from (select *, abs(speed - 10.0e0) as a, abs(speed - acc / 5.0e0) as b from fixes) group by 1", "fixes")
put("SL-06", lambda spark, d: particles(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("trip_id").orderBy("w", "i"))).where("rank <= 3").select("trip_id", "i", "rank"), "select trip_id, i, rk as rank from (select *, row_number() over (partition by trip_id order by w, i) as rk from particles) where rk <= 3", "particles")
put("SL-04", lambda spark, d: particles(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("trip_id").orderBy(c("w").desc(), "i"))).withColumn("best", F.max("w").over(Window.partitionBy("trip_id"))).where("rank <= 20 and (rank <= 4 or w >= 0.5D * best)").select("trip_id", "i", "rank"), "select trip_id, i, rk as rank from (select *, row_number() over (partition by trip_id order by w desc, i) as rk, max(w) over (partition by trip_id) as best from particles) where rk <= 20 and (rk <= 4 or w >= 0.5e0 * best)", "particles")
put("SS-06", lambda spark, d: imu(spark, d).groupBy("trip_id", F.floor(c("n") / 2).alias("step")).agg(F.round(F.avg("a_long"), 9).alias("a"), F.round(F.avg("yaw"), 9).alias("yaw")), "select trip_id, n // 2 as step, 0.0e0 + round(avg(a_long), 9) as a, 0.0e0 + round(avg(yaw), 9) as yaw from imu group by 1, 2", "imu")
put("WN-25", lambda spark, d: fixes(spark, d).withColumn("dt", F.coalesce(c("t") - F.lag("t").over(Window.partitionBy("trip_id").orderBy("seq")), F.lit(0.0))).select("trip_id", "seq", F.round(F.least(F.lit(300.0), F.sum(F.greatest(F.lit(0.0), c("acc") / 5.0 - c("speed")) * c("dt")).over(Window.partitionBy("trip_id").orderBy("seq"))), 4).alias("delta")), "select trip_id, seq, round(least(300.0e0, sum(greatest(0.0e0, acc / 5.0e0 - speed) * dt) over (partition by trip_id order by seq rows unbounded preceding)), 4) as delta from (select *, coalesce(t - lag(t) over (partition by trip_id order by seq), 0.0e0) as dt from fixes)", "fixes")
