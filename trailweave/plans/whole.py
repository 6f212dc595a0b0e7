"""Queries that cover a row of the inventory in full where an earlier one holds a part of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.functions.digests import fnv1a
from trailweave.operators import curves, islands, models, roads, scores

from .curves import STREETS, streets
from .evidence import rounded
from .views import fixes, imu, reference, sql

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


put("FN-38", lambda spark, d: fixes(spark, d).withColumn("s", F.concat_ws(":", "event_type", c("event_id").cast("string"))).select("trip_id", "seq", F.sha2("s", 256).alias("sha"), fnv1a(c("s")).alias("fnv")),
    """with h as (select trip_id, seq, event_type || ':' || event_id as s from fixes), b as (select *, hex(encode(s)) as x from h)
select trip_id, seq, sha256(s) as sha, lower(lpad(hex(cast(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(x), 2), lambda i: cast(('0x' || substr(x, i, 2)) as hugeint))), lambda a, b: (xor(a, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as ubigint)), 16, '0')) as fnv from b""", "fixes")  # fmt: skip


def split_by_motion(spark, d):
    """Fixes shown and withheld: a warm-up of five minutes counts from where the trip moves, or from its start if it never does."""
    f = fixes(spark, d)
    start = islands.motion_start(f, 5.0, 20.0).withColumnRenamed("t", "moves")
    first = f.groupBy("trip_id").agg(F.min("t").alias("t0")).join(start, "trip_id", "left").select("trip_id", (F.coalesce("moves", "t0") + 300.0).alias("until"))
    rows = f.join(first, "trip_id")
    return rounded(rows.groupBy("trip_id", "until").agg(F.count_if(c("t") <= c("until")).alias("visible"), F.count_if(c("t") > c("until")).alias("withheld")))


put("FL-13", split_by_motion, """with a as (select *, speed >= 5.0e0 as m from fixes), b as (select *, case when m is distinct from lag(m) over (partition by trip_id order by t, seq) then 1 else 0 end as ch from a),
r as (select *, sum(ch) over (partition by trip_id order by t, seq rows unbounded preceding) as island from b), g as (select trip_id, min(t) as t from r where m group by trip_id, island having max(t) - min(t) >= 20.0e0), s as (select trip_id, min(t) as moves from g group by 1),
u as (select f.trip_id, coalesce(any_value(moves), min(t)) + 300.0e0 as until from fixes f left join s on s.trip_id = f.trip_id group by 1)
select f.trip_id, round(until, 6) as until, count(*) filter (where t <= until) as visible, count(*) filter (where t > until) as withheld from fixes f join u on u.trip_id = f.trip_id group by f.trip_id, until""", "fixes")  # fmt: skip


def reference_checks(spark, d):
    """Steps that are too long, gaps, and the share of the track, at every n div 1000-th place, that lies on the network."""
    w = Window.partitionBy("trip_id").orderBy("t", "re", "rn")
    r = reference(spark, d).withColumn("dt", c("t") - F.lag("t").over(w)).withColumn("step", F.hypot(c("re") - F.lag("re").over(w), c("rn") - F.lag("rn").over(w)))
    r = r.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("trip_id")))
    checked = r.where(c("i") % F.greatest(F.lit(1), F.floor(c("n") / 1000)) == 0).select("trip_id", F.concat_ws(":", "trip_id", "i").alias("point"), c("re").alias("px"), c("rn").alias("py"))
    near = roads.within(checked.select("point", "px", "py"), curves.pieces(streets(spark, d)).select("edge", "x0", "y0", "x1", "y1"), 30.0).select("point").distinct().withColumn("on", F.lit(1.0))
    share = checked.join(near, "point", "left").groupBy("trip_id").agg(F.count("*").alias("checked"), F.avg(F.coalesce("on", F.lit(0.0))).alias("on_roads"))
    found = r.groupBy("trip_id").agg(F.count_if(c("step") > 60 * F.greatest(F.lit(0.0), c("dt")) + 30.0).alias("wild"), F.count_if(c("dt") > 2.0).alias("gaps"))
    return rounded(found.join(share, "trip_id"))


put("AG-13", reference_checks, "with " + STREETS + """, r as (
  select *, t - lag(t) over w as dt, sqrt(pow(re - lag(re) over w, 2) + pow(rn - lag(rn) over w, 2)) as step, row_number() over w - 1 as i, count(*) over (partition by trip_id) as n from reference window w as (partition by trip_id order by t, re, rn)
), k as (
  select trip_id, i, re as px, rn as py from r where i % greatest(1, n // 1000) = 0
), f as (
  select k.*, exists (select 1 from p where sqrt(pow(px - x0 - greatest(0.0e0, least(1.0e0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (len * len))) * (x1 - x0), 2) + pow(py - y0 - greatest(0.0e0, least(1.0e0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (len * len))) * (y1 - y0), 2)) <= 30.0e0) as on_ from k
), s as (
  select trip_id, count(*) as checked, avg(case when on_ then 1.0e0 else 0.0e0 end) as on_roads from f group by 1
)
select r.trip_id, count(*) filter (where step > 60 * greatest(0.0e0, dt) + 30.0e0) as wild, count(*) filter (where dt > 2.0e0) as gaps, any_value(checked) as checked, round(any_value(on_roads), 6) as on_roads from r join s on s.trip_id = r.trip_id group by 1""", "reference")  # fmt: skip


def odometers(spark, d):
    rows = fixes(spark, d).withColumn("true", c("seq") * 10.0)
    rows = rows.withColumn("route", c("true") + c("k") - 50).withColumn("pos", c("true") + (c("k") - 50) * 0.6 + (c("event_id") * 7) % 13 - 6)
    return rounded(scores.run_errors(rows, (5.0, 10.0, 20.0), (15.0, 25.0)))


put("AG-36", odometers, """with o as (select trip_id, seq, t, abs(k - 50.0e0) as er, abs((k - 50) * 0.6e0 + (event_id * 7) % 13 - 6) as ep, (k - 50) * 0.6e0 + (event_id * 7) % 13 - 6 as sp, t - lag(t) over (partition by trip_id order by seq) as dt from fixes),
r as (select *, sum(case when ep > 15 then 0 else 1 end) over (partition by trip_id order by seq rows unbounded preceding) as r15, sum(case when ep > 25 then 0 else 1 end) over (partition by trip_id order by seq rows unbounded preceding) as r25 from o),
a as (select trip_id, max(n) as n from (select trip_id, r15, count(*) as n from r where ep > 15 group by 1, 2) group by 1), b as (select trip_id, max(n) as n from (select trip_id, r25, count(*) as n from r where ep > 25 group by 1, 2) group by 1),
m as (select trip_id, median(er) as med_route, median(ep) as med_pos, quantile_cont(er, 0.95) as p95_route, quantile_cont(ep, 0.95) as p95_pos, max(er) as max_route, max(ep) as max_pos, max(sp) as lead, min(sp) as lag, avg((ep < 5)::int) as b5, avg((ep < 10)::int) as b10, avg((ep < 20)::int) as b20,
  avg((ep >= 15)::int) as f15, avg((ep >= 25)::int) as f25, avg((ep < er)::int) as closer, median(dt) as step from o group by 1)
select m.trip_id, round(med_route, 6) as med_route, round(med_pos, 6) as med_pos, round(p95_route, 6) as p95_route, round(p95_pos, 6) as p95_pos, round(max_route, 6) as max_route, round(max_pos, 6) as max_pos, round(lead, 6) as lead, round(lag, 6) as lag, round(b5, 6) as below_5, round(b10, 6) as below_10, round(b20, 6) as below_20,
  round(f15, 6) as from_15, round(f25, 6) as from_25, round(closer, 6) as closer, round(coalesce(a.n * step, 0.0e0), 6) as run_15, round(coalesce(b.n * step, 0.0e0), 6) as run_25 from m left join a on a.trip_id = m.trip_id left join b on b.trip_id = m.trip_id""", "fixes")  # fmt: skip

put("WN-15", lambda spark, d: rounded(models.refined_offset(imu(spark, d), 20, 5)), """with j as (
  select a.trip_id, l.k as lag_, corr(a.yaw, b.a_long) as r from imu a cross join (select unnest(range(-25, 26)) as k) l join imu b on b.trip_id = a.trip_id and b.n = a.n + l.k group by 1, 2
), ok as (select * from j where r is not null and not isnan(r)), rough as (
  select trip_id, lag_ as mid from (select *, row_number() over (partition by trip_id order by round(r, 9) desc, lag_) as rk from ok where lag_ % 5 = 0 and abs(lag_) <= 20) where rk = 1 and r > 0
), best as (
  select o.*, row_number() over (partition by o.trip_id order by round(r, 9) desc, lag_) as rk from ok o join rough on rough.trip_id = o.trip_id and abs(lag_ - mid) <= 5
) select trip_id, lag_ as lag, round(r, 6) as corr, case when r < 0.35e0 then 'weak' else 'ok' end as note from best where rk = 1""", "imu")  # fmt: skip
