"""Queries over gates, intervals and scores, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import gating, scores

from .views import edges, fixes, imu, particles, reference, sql, states, table

c = F.col
r4, r6 = (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    """Rounding makes -0.0 in one engine and 0.0 in the other; adding zero makes it 0.0 in both."""
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


def rounded(df, digits=6):
    """All doubles of a result rounded, -0.0 made 0.0."""
    return df.select(*[(F.round(c(n), digits) + 0.0).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


WRAPPED = lambda e: f"abs(degrees(({e}) + pi() - 2.0e0 * pi() * floor((({e}) + pi()) / (2.0e0 * pi())) - pi()))"
LAST = """g as (
  select *, last_value(case when {good} then struct_pack(t := t, e := east, n := north, v := speed, c := course, a := acc) end ignore nulls)
    over (partition by trip_id order by seq rows between unbounded preceding and 1 preceding) as l from fixes)"""

put("FL-04", lambda spark, d: rounded(gating.shocks(imu(spark, d), (F.abs("a_long") * 5 >= 9.0) | (F.abs("yaw") * 20 >= 4.0)).select("trip_id", "n", "shaken", "yaw_trust")),
    """with u as (select trip_id, n, t, max(case when abs(a_long) * 5 >= 9.0e0 or abs(yaw) * 20 >= 4.0e0 then t + 1.0e0 end) over (partition by trip_id order by n rows unbounded preceding) as until from imu)
select trip_id, n, coalesce(t <= until, false) as shaken, case when not coalesce(t <= until, false) and coalesce(t <= until + 5.0e0, false) then 0.5e0 else 1.0e0 end as yaw_trust from u""", "imu")  # fmt: skip

put("FL-06", lambda spark, d: gating.gated(fixes(spark, d), c("good"), c("synthetic")).select("trip_id", "seq", "why"),
    "with " + LAST.format(good="good and not synthetic") + """, h as (
  select *, t - l.t as dt, radians(90.0e0 - l.c) as psi, pow(greatest(5.0e0, acc), 2) + pow(greatest(5.0e0, l.a) + 2.0e0 * (t - l.t), 2) as s, greatest(0.0e0, least(45.0e0, l.v)) as v0 from g
), i as (
  select *, sqrt(pow(east - l.e, 2) + pow(north - l.n, 2)) as far, pow(east - l.e - l.v * dt * cos(psi), 2) + pow(north - l.n - l.v * dt * sin(psi), 2) as r2, """ + WRAPPED("radians(90.0e0 - course) - psi") + """ as turned,
    25.0e0 + case when dt <= (45.0e0 - v0) / 6.0e0 then v0 * dt + 3.0e0 * dt * dt else v0 * (45.0e0 - v0) / 6.0e0 + 3.0e0 * pow((45.0e0 - v0) / 6.0e0, 2) + 45.0e0 * (dt - (45.0e0 - v0) / 6.0e0) end as reach from h)
select trip_id, seq, array_to_string(list_filter([case when not good then 'invalid_fix' end, case when synthetic then 'simulated_by_software' end, case when far > reach then 'physical_gate' end,
  case when r2 / s > 9.21e0 then 'mahalanobis_gate' end, case when abs(speed - l.v) > 8.0e0 then 'speed_mismatch' end, case when speed >= 3.0e0 and l.v >= 3.0e0 and turned > 60.0e0 then 'course_mismatch' end], lambda x: x is not null), ',') as why from i""", "fixes")  # fmt: skip

put("FL-07", lambda spark, d: gating.fix_to_fix(fixes(spark, d), c("good"), lost_gap=30.0).select("trip_id", "seq", "why"),
    "with " + LAST.format(good="good") + """, h as (
  select *, t - l.t as dt, sqrt(pow(east - l.e, 2) + pow(north - l.n, 2)) as step, sqrt(pow(greatest(5.0e0, acc), 2) + pow(greatest(5.0e0, l.a), 2)) as noise, """ + WRAPPED("radians(90.0e0 - course) - atan2(north - l.n, east - l.e)") + """ as off_ from g)
select trip_id, seq, array_to_string(list_filter([case when dt <= 0 then 'out_of_order' end,
  case when dt > 0 and dt <= 30.0e0 and abs(speed - step / dt) > 6.0e0 + 2 * noise / dt then 'speed_inconsistent_with_previous_fix' end,
  case when dt > 0 and dt <= 30.0e0 and step >= greatest(4.0e0, 2 * noise) and step / dt >= 3.0e0 and off_ > 55.0e0 then 'course_inconsistent_with_previous_fix' end], lambda x: x is not null), ',') as why from h""", "fixes")  # fmt: skip

put("FL-08", lambda spark, d: gating.last_good(fixes(spark, d), c("good") & (c("acc") <= 80), ["t", "east", "north"]).select("trip_id", "seq", ((c("acc") > 0) & (c("acc") <= 80) & F.coalesce(F.hypot(c("east") - F.coalesce("last_east", F.lit(0.0)), c("north") - F.coalesce("last_north", F.lit(0.0))) <= 45.0 * F.greatest(c("t") - F.coalesce("last_t", F.lit(0.0)), F.lit(0.0)) + 25.0, F.lit(False))).alias("reachable")),
    "with " + LAST.format(good="good and acc <= 80") + " select trip_id, seq, acc > 0 and acc <= 80 and sqrt(pow(east - coalesce(l.e, 0.0e0), 2) + pow(north - coalesce(l.n, 0.0e0), 2)) <= 45.0e0 * greatest(t - coalesce(l.t, 0.0e0), 0.0e0) + 25.0e0 as reachable from g", "fixes")

put("FL-09", lambda spark, d: rounded(gating.terminal_cluster(fixes(spark, d), 300.0, 20.0, 3, 400.0), 4),
    """with tail as (select * from (select *, max(t) over (partition by trip_id) as end_ from fixes) where t >= end_ - 300.0e0 and speed <= 20.0e0
), m as (select trip_id, quantile_cont(east, 0.5) as me, quantile_cont(north, 0.5) as mn from tail group by 1 having count(*) >= 3)
select trip_id, count(*) as n, round(sum(east / pow(greatest(acc, 5.0e0), 2)) / sum(1.0e0 / pow(greatest(acc, 5.0e0), 2)), 4) as east, round(sum(north / pow(greatest(acc, 5.0e0), 2)) / sum(1.0e0 / pow(greatest(acc, 5.0e0), 2)), 4) as north
from tail join m using (trip_id) where sqrt(pow(east - me, 2) + pow(north - mn, 2)) <= 400.0e0 group by 1 having count(*) >= 3""", "fixes")  # fmt: skip

put("FL-10", lambda spark, d: fixes(spark, d).select("trip_id", "seq", gating.interval_reason(c("k") * 300.0 - 500.0, c("value") * 5.0, (c("k") - 50) * 3.0, c("k") % 7 != 0, c("k") % 11 != 0, c("event_id") % 13 - 11, c("event_id") % 17 - 15, c("event_type") == "error", c("event_id") % 5 != 0).alias("why")),
    """select trip_id, seq, case when k * 300.0e0 - 500.0e0 < 40.0e0 or k * 300.0e0 - 500.0e0 > 20000.0e0 then 'length' when value * 5.0e0 > 1800.0e0 then 'duration' when abs((k - 50) * 3.0e0) > 120.0e0 then 'drift'
  when k % 7 = 0 then 'endpoint A' when k % 11 = 0 then 'endpoint B' when event_id % 13 > 11 then 'low-confidence junction inside' when event_id % 17 > 15 then 'unresolved fork upstream' when event_type = 'error' then 'rollback inside' when event_id % 5 = 0 then 'not a single chain' end as why from fixes""", "fixes")  # fmt: skip


def endpoint_quality(spark, d):
    """Whether a turn anchors an interval: its residual, angle and local probability, and that nothing pends."""
    f = fixes(spark, d)
    residual, z, p = F.abs(c("k") - 50) * 1.0, F.abs(c("speed") - 12.5) / 4.0, (c("event_id") % 100) / 100.0
    ok = (residual <= 40.0) & (z <= 2.0) & (p >= 0.6) & (c("event_type") != "error")
    grade = F.when(ok & (residual <= 15.0) & (z <= 1.0), "strong").when(ok, "fair").otherwise("weak")
    return f.select("trip_id", "seq", ok.alias("ok"), grade.alias("grade"), F.when(residual > 40.0, "residual").when(z > 2.0, "angle").when(p < 0.6, "probability").when(c("event_type") == "error", "pending").alias("why"))


put("FL-11", endpoint_quality, """with x as (select trip_id, seq, abs(k - 50) * 1.0e0 as residual, abs(speed - 12.5e0) / 4.0e0 as z, (event_id % 100) / 100.0e0 as p, event_type = 'error' as pending from fixes
), y as (select *, residual <= 40.0e0 and z <= 2.0e0 and p >= 0.6e0 and not pending as ok from x)
select trip_id, seq, ok, case when ok and residual <= 15.0e0 and z <= 1.0e0 then 'strong' when ok then 'fair' else 'weak' end as grade, case when not ok then case when residual > 40.0e0 then 'residual' when z > 2.0e0 then 'angle' when p < 0.6e0 then 'probability' else 'pending' end end as why from y""", "fixes")  # fmt: skip

HYP = "select trip_id, i, edge, s, w / sum(w) over (partition by trip_id) as w from particles"


def shares(spark, d):
    return particles(spark, d).withColumn("w", c("w") / F.sum("w").over(Window.partitionBy("trip_id")))


put("FL-16", lambda spark, d: rounded(gating.agreed_length(shares(spark, d).select("trip_id", c("i").alias("route"), "w", (c("s") * 4 + 30).alias("length")), ["trip_id"], spread=0.3), 4),
    "with h as (" + HYP + """), x as (select trip_id, i, w, s * 4 + 30 as length from h), f as (select *, first_value(length) over (partition by trip_id order by w desc, i) as centre, count(*) over (partition by trip_id) as routes from x
), g as (select trip_id, max(routes) as routes, sum(case when near then w end) as mass, count(*) filter (where near) as agreeing, sum(case when near then w * length end) / sum(case when near then w end) as length
  from (select *, abs(length - centre) <= greatest(0.3e0 * greatest(abs(centre), 1.0e0), 12.0e0) as near from f) group by 1)
select trip_id, routes, agreeing, round(mass, 4) as mass, round(length, 4) as length, case when routes < 2 then 'only one hypothesis' when mass < 0.5e0 then 'route mass' when length < 40.0e0 or length > 3000.0e0 then 'length' end as why from g""", "particles")  # fmt: skip

put("AG-24", lambda spark, d: rounded(gating.corroborated(shares(spark, d).select("trip_id", c("edge").alias("route"), "w", (c("s") / 10 - 20).alias("y")), ["trip_id"], least_mass=0.005), 4),
    "with h as (" + HYP + """), r as (select trip_id, edge, sum(w) as w, sum(w * (s / 10 - 20)) / sum(w) as y from h where w > 0 group by 1, 2 having sum(w) >= 0.005e0
), p as (select a.trip_id, a.edge, a.y as seed, b.y, b.w from r a join r b on b.trip_id = a.trip_id and abs(b.y - a.y) <= greatest(0.06e0 * greatest(abs(a.y), 1.0e0), 12.0e0)
), m as (select trip_id, seed, count(*) as agreeing, sum(w) as mass, sum(w * y) / sum(w) as drift, sum(w) * sum(w) / sum(w * w) as effective, row_number() over (partition by trip_id order by round(sum(w), 9) desc, seed, edge) as k from p group by trip_id, edge, seed
), n as (select trip_id, count(*) as routes from r group by 1)
select trip_id, routes, agreeing, round(mass, 4) as mass, round(drift, 4) as drift, round(effective, 4) as effective,
  case when routes < 2 then 'too few routes' when mass < 0.5e0 then 'too little mass' when agreeing < 2 then 'a single route' when effective < 1.5e0 then 'too few effective routes' end as why from m join n using (trip_id) where k = 1""", "particles")  # fmt: skip

put("JN-26", lambda spark, d: fixes(spark, d).select("trip_id", "seq", gating.divergence(c("k") % 6 == 0, c("seq") == 1, c("event_id") % 3 != 0, F.when(c("event_type") != "view", c("speed")), F.when(c("k") % 4 != 0, c("k") * 2.0 - 100), c("event_id") % 4 != 0).alias("cause")),
    """with x as (select *, case when event_type <> 'view' then speed end as gap, case when k % 4 <> 0 then k * 2.0e0 - 100 end as err from fixes)
select trip_id, seq, case when k % 6 = 0 then case when seq = 1 then 'seed' else 'diverged earlier' end
  when event_id % 3 = 0 then case when coalesce(gap > 8.0e0 and abs(err) > 40.0e0, false) or coalesce(abs(err) > 60.0e0, false) or event_id % 4 = 0 then 'junction timing mismatch' else 'successor not generated' end
  when coalesce(gap > 8.0e0 and abs(err) > 40.0e0, false) then 'temporal misalignment' else 'out-scored on the turn angle' end as cause from x""", "fixes")  # fmt: skip


def branches(spark, d):
    """Branches of each tick: the three lines of an order share, whether the reference lies in them."""
    return fixes(spark, d).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), c("k") % 4))).select("trip_id", "seq", c("b").alias("branch"), ((c("event_id") * 31 + c("b") * 17) % 23 / 23.0).alias("p"), ((c("event_id") + c("b")) % 3 == 0).alias("hit"))


put("AG-04", lambda spark, d: rounded(scores.branch_accuracy(branches(spark, d), ["seq"])),
    """with b as (select trip_id, seq, b as branch, (event_id * 31 + b * 17) % 23 / 23.0e0 as p, (event_id + b) % 3 = 0 as hit from (select *, unnest(range(0, k % 4 + 1)) as b from fixes)
), r as (select *, row_number() over (partition by trip_id, seq order by p desc, branch) as k from b
), t as (select trip_id, seq, max(case when hit and k = 1 then 1 else 0 end) as a, max(case when hit and k <= 3 then 1 else 0 end) as b, count(*) as n from r group by 1, 2)
select trip_id, round(avg(a), 6) as top1, round(avg(b), 6) as top3, count(*) as ticks, round(avg(n), 6) as mean_branches, max(n) as max_branches from t group by 1""", "fixes")  # fmt: skip

RECOVER = """run as (select *, sum(case when state = 'LOST' then 1 else 0 end) over (partition by trip_id order by seq) as run from states
), st as (select trip_id, run, min(seq) as s0, arg_min(t, seq) as t0 from run where run > 0 and state <> 'LOST' and accepted group by 1, 2
), rec as (select r.trip_id, r.run, arg_min(r.t, r.seq) as t, arg_min(r.t, r.seq) - min(st.t0) as seconds from run r join st on st.trip_id = r.trip_id and st.run = r.run and r.seq >= st.s0 where r.state = 'TRUSTED' group by 1, 2)"""
put("AG-06", lambda spark, d: rounded(scores.recoveries(states(spark, d)).groupBy("trip_id").agg(F.count("*").alias("events"), F.avg("seconds").alias("mean"), F.max("seconds").alias("worst"))),
    "with " + RECOVER + " select trip_id, count(*) as events, round(avg(seconds), 6) as mean, round(max(seconds), 6) as worst from rec group by 1", "states")


def metrics_bundle(spark, d):
    """One document per trip: gates, recoveries and track in one JSON object."""
    s = states(spark, d).groupBy("trip_id").agg(F.count("*").alias("tested"), F.count_if("accepted").alias("accepted"), F.count_if(~c("accepted")).alias("rejected"))
    rec = scores.recoveries(states(spark, d)).groupBy("trip_id").agg(F.count("*").alias("events"), F.round(F.max("seconds"), 3).alias("worst"))
    way = fixes(spark, d).groupBy("trip_id").agg(F.count("*").alias("fixes"), F.round(F.max("speed"), 3).alias("top_speed"))
    rows = s.join(rec, "trip_id", "left").join(way, "trip_id")
    return rows.select("trip_id", F.to_json(F.struct(F.struct("tested", "accepted", "rejected").alias("gates"), F.struct(F.coalesce("events", F.lit(0)).alias("events"), "worst").alias("recovery"), F.struct("fixes", "top_speed").alias("track"))).alias("document"))


put("AG-15", lambda spark, d: metrics_bundle(spark, d).select("trip_id", *[F.get_json_object("document", f"$.{a}.{b}").cast(t).alias(b) for a, b, t in (("gates", "tested", "long"), ("gates", "accepted", "long"), ("gates", "rejected", "long"), ("recovery", "events", "long"), ("recovery", "worst", "double"), ("track", "fixes", "long"), ("track", "top_speed", "double"))]),
    "with " + RECOVER + """, r as (select trip_id, count(*) as events, round(max(seconds), 3) as worst from rec group by 1), g as (select trip_id, count(*) as tested, count(*) filter (where accepted) as accepted, count(*) filter (where not accepted) as rejected from states group by 1)
select g.trip_id, tested, accepted, rejected, coalesce(events, 0) as events, worst, fixes, top_speed from g left join r on r.trip_id = g.trip_id join (select trip_id, count(*) as fixes, round(max(speed), 3) as top_speed from fixes group by 1) f on f.trip_id = g.trip_id""", "states")  # fmt: skip


def frames(spark, d):
    """What a tracker shows at each fix: its five best edges, the true edge, its error and whether the corridor holds it."""
    f = fixes(spark, d)
    return f.select("trip_id", "seq", "t", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: (c("event_id") * (j + 3) + j * 5) % 11).alias("top"), ((c("event_id") * 7) % 11).alias("truth"), (c("k") * 1.0).alias("error"), (c("k") % 3 != 0).alias("covered"))


FRAMES = "fr as (select trip_id, seq, t, [(event_id * (j + 3) + j * 5) % 11 for j in range(0, 5)] as top, (event_id * 7) % 11 as truth, k * 1.0e0 as error, k % 3 <> 0 as covered from fixes)"
put("AG-25", lambda spark, d: rounded(scores.survival(frames(spark, d))),
    "with " + FRAMES + """, x as (select *, coalesce(list_position(top, truth), 99) as at_ from fr)
select trip_id, count(*) as ticks, round(avg(case when at_ <= 5 then 1.0e0 else 0.0e0 end), 6) as alive, round(avg(case when at_ <= 1 then 1.0e0 else 0.0e0 end), 6) as top1, round(avg(case when at_ <= 3 then 1.0e0 else 0.0e0 end), 6) as top3, round(avg(case when at_ <= 5 then 1.0e0 else 0.0e0 end), 6) as top5,
  round(avg(case when error <= 25 then 1.0e0 else 0.0e0 end), 6) as near, round(avg(error), 6) as mean, round(quantile_cont(error, 0.5), 6) as median, round(quantile_cont(error, 0.95), 6) as p95, round(max(error), 6) as worst, round(avg(case when covered then 1.0e0 else 0.0e0 end), 6) as coverage from x group by 1""", "fixes")  # fmt: skip
put("AG-28", lambda spark, d: rounded(scores.deaths(frames(spark, d), 50.0)),
    "with " + FRAMES + """, x as (select *, list_position(top, truth) is not null and list_position(top, truth) > 0 as alive from fr), y as (select trip_id, max(case when alive then t end) as la, min(case when not alive then t end) as f0 from x group by 1)
select x.trip_id, round(any_value(f0), 6) as first_loss, round(min(case when la is null or t > la then t end), 6) as permanent_loss, case when any_value(f0) is not null then count(*) filter (where alive and t < f0 and t >= f0 - 50.0e0) end as held_before from x join y on y.trip_id = x.trip_id group by 1""", "fixes")  # fmt: skip

put("AG-27", lambda spark, d: rounded(scores.calibration(fixes(spark, d).select("trip_id", "seq", "t", (c("seq") * 25.0 + c("k")).alias("way"), (10.0 + c("k")).alias("sigma"), c("speed").alias("true_speed"), F.lit(1.0).alias("dt"))), 5),
    """with a as (select trip_id, seq, seq * 25.0e0 + k as way, 10.0e0 + k as sigma, sum(speed * 1.0e0) over (partition by trip_id order by seq) as s from fixes
), b as (select *, s - first_value(s) over w + first_value(way) over w as truth from a window w as (partition by trip_id order by seq rows between unbounded preceding and unbounded following)
), e as (select *, way - truth as err, abs((way - truth) / sigma) as z from b)
select trip_id, round(case when abs(arg_max(truth, seq)) > 1 then arg_max(way, seq) / arg_max(truth, seq) end, 5) as ratio, round(avg(abs(err)), 5) as mean, round(quantile_cont(abs(err), 0.5), 5) as median, round(max(abs(err)), 5) as worst,
  round(avg(case when z <= 1 then 1.0e0 else 0.0e0 end), 5) as within1, round(avg(case when z <= 2 then 1.0e0 else 0.0e0 end), 5) as within2, round(quantile_cont(z, 0.5), 5) as median_z from e group by 1""", "fixes")  # fmt: skip


def updates(spark, d):
    return fixes(spark, d).select("trip_id", "seq", c("event_type").alias("kind"), (c("k") - 50.0).alias("residual"), (1.0 / (1 + c("event_id") % 4)).alias("gain"))


put("AG-33", lambda spark, d: rounded(scores.authority(updates(spark, d)), 4),
    """with u as (select trip_id, seq, event_type as kind, k - 50.0e0 as residual, 1.0e0 / (1 + event_id % 4) as gain from fixes
), i as (select trip_id, kind, seq - row_number() over (partition by trip_id, kind order by seq) as isle from u), l as (select kind, max(n) as longest from (select trip_id, kind, isle, count(*) as n from i group by 1, 2, 3) group by 1)
select u.kind, count(*) as n, round(avg(residual), 4) as bias, round(avg(abs(residual)), 4) as mae, round(sqrt(avg(residual * residual)), 4) as rmse, round(avg(gain), 4) as gain, round(sum(gain * residual), 4) as moved, any_value(longest) as longest from u join l on l.kind = u.kind group by 1""", "fixes")  # fmt: skip
put("AG-34", lambda spark, d: rounded(scores.attribution(fixes(spark, d).select("trip_id", "seq", F.when(c("good"), "gps").otherwise("imu").alias("kind"), (c("k") / 10.0).alias("moved"), (c("seq") * 3.0 + c("k")).alias("value")), F.floor(c("seq") / 10)), 4),
    """with a as (select trip_id, seq // 10 as bin, good, k / 10.0e0 as moved, seq * 3.0e0 + k - coalesce(lag(seq * 3.0e0 + k) over (partition by trip_id order by seq), 0.0e0) as step from fixes)
select trip_id, bin, round(sum(step), 4) as change, round(sum(case when good then moved else 0.0e0 end), 4) as by_gps, round(sum(case when good then 0.0e0 else moved end), 4) as by_others, round(sum(step) - sum(moved), 4) as unexplained from a group by 1, 2""", "fixes")  # fmt: skip
