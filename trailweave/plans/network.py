"""Queries over the road graph, faults and models, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import faults, models, roads

from .views import edges, fixes, imu, nodes, points, sql, table

c = F.col
r4, r6 = (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text, *uses)


HIT = """h as (
  select point, edge, f * sqrt(dx * dx + dy * dy) as s, sqrt(pow(px - x0 - f * dx, 2) + pow(py - y0 - f * dy, 2)) as off from (
    select *, greatest(0.0e0, least(1.0e0, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy))) as f from (select *, x1 - x0 as dx, y1 - y0 as dy from points cross join edges)))"""
put("JN-06", lambda spark, d: roads.nearest(points(spark, d), edges(spark, d), 3, 60.0).select("point", "edge", "rank", r4(c("offset")).alias("offset")),
    "with " + HIT + ", r as (select *, row_number() over (partition by point order by round(off, 6), edge) as rk from h) select point, edge, rk as rank, round(off, 4) as offset from r where rk = 1 or (rk <= 3 and off <= 60.0e0)", "nodes", "edges", "points")
put("JN-07", lambda spark, d: roads.nearest(points(spark, d), edges(spark, d), 1, 60.0).select("point", r4(c("offset")).alias("metres")),
    "with " + HIT + " select point, round(min(off), 4) as metres from h group by 1", "nodes", "edges", "points")
put("JN-08", lambda spark, d: roads.within(points(spark, d), edges(spark, d), 200.0).select("point", "edge", r4(c("s")).alias("s"), r4(c("offset")).alias("offset")),
    "with " + HIT + " select point, edge, round(s, 4) as s, round(off, 4) as offset from h where off <= 200.0e0", "nodes", "edges", "points")
put("JN-09", lambda spark, d: roads.nearest(points(spark, d), edges(spark, d), 1, 60.0).select("point", "edge", r4(c("s")).alias("s"), r4(c("offset")).alias("offset")),
    "with " + HIT + " select point, edge, round(s, 4) as s, round(off, 4) as offset from (select *, row_number() over (partition by point order by round(off, 6), edge) as rk from h) where rk = 1", "nodes", "edges", "points")
put("SL-09", lambda spark, d: roads.nearest(points(spark, d), edges(spark, d), 8, 45.0).where("offset <= 45").withColumn("w", F.exp(-c("offset") / 20.0)).select("point", "edge", r6(c("w") / F.sum("w").over(Window.partitionBy("point"))).alias("p")),
    "with " + HIT + ", r as (select *, exp(-off / 20.0e0) as w, row_number() over (partition by point order by round(off, 6), edge) as rk from h where off <= 45.0e0) select point, edge, round(w / sum(w) over (partition by point), 6) as p from r where rk <= 8", "nodes", "edges", "points")
put("JN-10_straight", lambda spark, d: roads.at(edges(spark, d), points(spark, d).join(edges(spark, d).select("edge", (c("edge") % 61).alias("m")), c("point") % 61 == c("m")).select("point", "edge", (c("px") / 3).alias("s"))).select("point", "edge", r4(c("x")).alias("x"), r4(c("y")).alias("y"), r6(c("bearing")).alias("bearing")),
    "select point, edge, round(x0 + g * (x1 - x0), 4) as x, round(y0 + g * (y1 - y0), 4) as y, round(atan2(y1 - y0, x1 - x0), 6) as bearing from (select *, greatest(0.0e0, least(1.0e0, px / 3 / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))) as g from points join edges on point % 61 = edge % 61)", "nodes", "edges", "points")
put("JN-12", lambda spark, d: roads.twins(edges(spark, d)), "select a.edge, min(b.edge) as twin from edges a join edges b on b.u = a.v and b.v = a.u group by 1", "nodes", "edges")
STEPS = "steps as (select a.edge, b.edge as nxt from edges a join edges b on b.u = a.v and b.v <> a.u)"
put("JN-13", lambda spark, d: roads.successors(edges(spark, d)), "with " + STEPS + " select edge, nxt as next from steps", "nodes", "edges")
put("JN-14", lambda spark, d: roads.successors(edges(spark, d)).select(c("next").alias("edge"), c("edge").alias("before")), "with " + STEPS + " select nxt as edge, edge as before from steps", "nodes", "edges")


def rules(spark, d):
    s = roads.successors(edges(spark, d)).where((c("edge") * 3 + c("next")) % 11 == 0)
    return s.select(F.when(c("edge") % 2 == 0, "no").otherwise("only").alias("kind"), "edge", "next")


RULES = STEPS + ", rules as (select case when edge % 2 = 0 then 'no' else 'only' end as kind, edge, nxt from steps where (edge * 3 + nxt) % 11 = 0), ok as (select s.* from steps s where not exists (select 1 from rules r where r.kind = 'no' and r.edge = s.edge and r.nxt = s.nxt) and (not exists (select 1 from rules r where r.kind = 'only' and r.edge = s.edge) or exists (select 1 from rules r where r.kind = 'only' and r.edge = s.edge and r.nxt = s.nxt)))"
legal = lambda spark, d: roads.allowed(roads.successors(edges(spark, d)), rules(spark, d))
put("JN-16", legal, "with " + RULES + " select edge, nxt as next from ok", "nodes", "edges")
put("JN-17", lambda spark, d: roads.successors(edges(spark, d)).join(edges(spark, d).where("(u + v) % 7 = 0").select(c("edge").alias("next")), "next", "left_anti").select("edge", "next"), "with " + STEPS + " select s.edge, s.nxt as next from steps s join edges e on e.edge = s.nxt where (e.u + e.v) % 7 <> 0", "nodes", "edges")
put("GR-01_straight", lambda spark, d: edges(spark, d).select("edge", r4(roads.length()).alias("length"), r6(roads.bearing()).alias("bearing")).where("length > 0.001"), "select edge, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 4) as length, round(atan2(y1 - y0, x1 - x0), 6) as bearing from edges where sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) > 0.001e0", "nodes", "edges")
put("GR-03", lambda spark, d: roads.clipped(edges(spark, d), 1000.0, 1000.0, 900.0).select("edge"), "select edge from edges where sqrt(pow(x0 - 1000.0e0, 2) + pow(y0 - 1000.0e0, 2)) <= 900.0e0 and sqrt(pow(x1 - 1000.0e0, 2) + pow(y1 - 1000.0e0, 2)) <= 900.0e0", "nodes", "edges")
put("GR-04", lambda spark, d: roads.reachable(roads.successors(edges(spark, d)), edges(spark, d), 4), "with recursive " + STEPS.replace("steps as", "steps as") + ", w as (select edge as start, edge, 0 as hops from edges union select w.start, s.nxt, w.hops + 1 from w join steps s on s.edge = w.edge where w.hops < 4) select start, edge, min(hops) as hops from w group by 1, 2", "nodes", "edges")
put("GR-05", lambda spark, d: roads.reachable_within(edges(spark, d), legal(spark, d), edges(spark, d), 2200.0).select("start", "edge", r4(c("way")).alias("way")), "with recursive " + RULES + ", l as (select edge, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) as len, u from edges), w as (select edge as start, edge, 0.0e0 as way from l union all select w.start, s.nxt, w.way + l.len from w join l on l.edge = w.edge join ok s on s.edge = w.edge where w.way + l.len <= 2200.0e0) select start, edge, round(min(way), 4) as way from w group by 1, 2", "nodes", "edges")
TURN = STEPS + ", b as (select edge, atan2(y1 - y0, x1 - x0) as b, highway as h from edges), t as (select s.edge, s.nxt, x.h as h0, y.h as h1, y.b - x.b + pi() - 2.0e0 * pi() * floor((y.b - x.b + pi()) / (2.0e0 * pi())) - pi() as turn from steps s join b x on x.edge = s.edge join b y on y.edge = s.nxt)"
put("GR-11", lambda spark, d: roads.turns(edges(spark, d), roads.successors(edges(spark, d))).select("edge", "next", r6(c("turn")).alias("turn")), "with " + TURN + " select edge, nxt as next, 0.0e0 + round(turn, 6) as turn from t", "nodes", "edges")
put("GR-13_straight", lambda spark, d: edges(spark, d).groupBy("u").agg(F.array_join(F.array_sort(F.collect_list("edge")).cast("array<string>"), ",").alias("out")), "select u, array_to_string(list_sort(list(edge)), ',') as out from edges group by 1", "nodes", "edges")
_rank = "case {} when 'primary' then 4.0e0 when 'secondary' then 3.0e0 when 'residential' then 1.0e0 else -1.0e0 end"
put("GR-15", lambda spark, d: roads.class_prior(roads.turns(edges(spark, d), roads.successors(edges(spark, d)))).select("edge", "next", F.round(c("prior") + 0.0, 6).alias("prior")), "with " + TURN + " select edge, nxt as next, 0.0e0 + round(-0.5e0 * greatest(0.0e0, " + _rank.format("h0") + " - " + _rank.format("h1") + "), 6) as prior from t", "nodes", "edges")
put("GR-16", lambda spark, d: roads.turns(edges(spark, d), roads.successors(edges(spark, d))).where("turn > 0").groupBy("edge").agg(r6(F.min(F.abs(F.degrees("turn") - 70.0))).alias("gap")), "with " + TURN + " select edge, round(min(abs(degrees(turn) - 70.0e0)), 6) as gap from t where turn > 0 group by 1", "nodes", "edges")


def graph_fit(spark, d):
    """Per trip of points: distances to the road over every n div 60-th point, and whether they are too far."""
    w = Window.partitionBy("trip").orderBy("point")
    rows = points(spark, d).withColumn("trip", c("point") % 10).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("trip")))
    rows = rows.where(c("i") % F.greatest(F.lit(1), F.floor(c("n") / 60)) == 0)
    near = roads.nearest(rows.select("point", "px", "py"), edges(spark, d), 1, 60.0).join(rows.select("point", "trip"), "point")
    return near.groupBy("trip").agg(F.count("*").alias("checked"), r4(F.expr("percentile(offset, 0.5)")).alias("median"), r4(F.max("offset")).alias("worst"), (F.expr("percentile(offset, 0.5)") > 30.0).alias("warning"))


put("AG-12", graph_fit, "with " + HIT + """, p as (select point, point % 10 as trip, row_number() over (partition by point % 10 order by point) - 1 as i, count(*) over (partition by point % 10) as n from points
), m as (select h.point, any_value(trip) as trip, min(off) as o from h join p on p.point = h.point where i % greatest(1, n // 60) = 0 group by 1)
select trip, count(*) as checked, round(quantile_cont(o, 0.5), 4) as median, round(max(o), 4) as worst, quantile_cont(o, 0.5) > 30.0e0 as warning from m group by 1""", "nodes", "edges", "points")

FAULTS = [("offset", 100.0, 200.0, 300.0, -40.0), ("drift", 250.0, 400.0, 2.0, 1.0), ("dropout", 500.0, 560.0, 0.0, 0.0)]
F_SQL = "f as (select *, t >= 100.0e0 and t < 200.0e0 as o, t >= 250.0e0 and t < 400.0e0 as dr, t >= 500.0e0 and t < 560.0e0 as dp from fixes)"
put("FI-01", lambda spark, d: faults.covered(fixes(spark, d), FAULTS).select("trip_id", "seq", "kind"), "with " + F_SQL + " select trip_id, seq, 'offset' as kind from f where o union all select trip_id, seq, 'drift' from f where dr union all select trip_id, seq, 'dropout' from f where dp", "fixes")
put("FI-02", lambda spark, d: faults.injected(fixes(spark, d), FAULTS).select("trip_id", "seq", r4(c("east")).alias("east"), r4(c("north")).alias("north"), "synthetic"), "with " + F_SQL + " select trip_id, seq, round(east + case when o then 300.0e0 else 0.0e0 end + case when dr then 2.0e0 * (t - 250.0e0) else 0.0e0 end, 4) as east, round(north + case when o then -40.0e0 else 0.0e0 end + case when dr then t - 250.0e0 else 0.0e0 end, 4) as north, synthetic or o or dr as synthetic from f where not dp", "fixes")
put("FI-03", lambda spark, d: faults.false_recovery(fixes(spark, d), 300.0, 3).select("trip_id", "seq", "rank", r4(c("acc")).alias("acc")), "select trip_id, seq, rk as rank, round(250.0e0 / (1 + rk), 4) as acc from (select *, row_number() over (partition by trip_id order by t, seq) as rk from fixes where t >= 300.0e0) where rk <= 3", "fixes")
put("FI-05", lambda spark, d: faults.covered(fixes(spark, d), FAULTS).groupBy("kind").agg(F.count("*").alias("n")), "with " + F_SQL + " select 'offset' as kind, count(*) as n from f where o union all select 'drift', count(*) from f where dr union all select 'dropout', count(*) from f where dp", "fixes")
put("ML-06", lambda spark, d: models.threshold_fit(fixes(spark, d).select(c("acc").alias("x"), c("speed").alias("y")), [10.0, 30.0, 50.0, 70.0]).select("knot", r4(c("slope")).alias("slope"), r4(c("sse")).alias("sse")), "with k as (select unnest([10.0e0, 30.0e0, 50.0e0, 70.0e0]) as knot), h as (select knot, greatest(0.0e0, acc - knot) as x, speed as y from fixes cross join k), m as (select knot, regr_slope(y, x) as slope, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) as sse from h group by 1) select knot, round(slope, 4) as slope, round(sse, 4) as sse from m", "fixes")
put("ML-04", lambda spark, d: models.lookup(fixes(spark, d), "acc", [(0.0, 0.0), (20.0, 1.5), (60.0, 2.0), (90.0, 6.0)]).select("trip_id", "seq", r6(c("y")).alias("y")), "select trip_id, seq, round(case when acc <= 20.0e0 then 0.0e0 + 1.5e0 * (acc - 0.0e0) / 20.0e0 when acc <= 60.0e0 then 1.5e0 + 0.5e0 * (acc - 20.0e0) / 40.0e0 when acc <= 90.0e0 then 2.0e0 + 4.0e0 * (acc - 60.0e0) / 30.0e0 else 6.0e0 end, 6) as y from fixes", "fixes")
put("ML-01_pooled", lambda spark, d: models.ridge(fixes(spark, d), ["acc", "course"], "speed", 1.0), None)
put("WN-15_coarse", lambda spark, d: models.clock_offset(imu(spark, d), [-2, -1, 0, 1, 2]).select("trip_id", "lag", r6(c("corr")).alias("corr")), "with l as (select unnest([-2, -1, 0, 1, 2]) as lag_), j as (select a.trip_id, l.lag_, corr(a.yaw, b.a_long) as r from imu a cross join l join imu b on b.trip_id = a.trip_id and b.n = a.n + l.lag_ group by 1, 2) select trip_id, lag_ as lag, round(r, 6) as corr from (select *, row_number() over (partition by trip_id order by round(r, 9) desc, lag_) as rk from j where r is not null and not isnan(r)) where rk = 1", "fixes", "imu")
put("TX-11", lambda spark, d: models.places(table(spark, d, "embeddings"), 100, 3).select("query", "vec_id", "rank", F.round("sim", 5).alias("sim")), "with q as (select vec_id as query, embedding as e from embeddings where vec_id % 100 = 0), s as (select query, v.vec_id, list_sum(list_transform(range(1, 65), lambda i: cast(q.e[i] as double) * cast(v.embedding[i] as double))) / (sqrt(list_sum(list_transform(q.e, lambda x: cast(x as double) * cast(x as double)))) * sqrt(list_sum(list_transform(v.embedding, lambda x: cast(x as double) * cast(x as double))))) as sim from q cross join embeddings v where v.vec_id <> q.query) select query, vec_id, rk as rank, round(sim, 5) as sim from (select *, row_number() over (partition by query order by sim desc, vec_id) as rk from s) where rk <= 3")
