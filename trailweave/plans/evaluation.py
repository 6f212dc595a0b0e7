"""Queries that score models on what they have not seen, and compare groups by ranks and by a bootstrap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import evaluation

from .evidence import rounded
from .views import fixes, sql

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


def ablation(spark, d):
    """Speed from the error class, and from the course besides, learnt from a quarter, a half and all of the other trips."""
    f = fixes(spark, d).select("trip_id", c("k").cast("double").alias("k"), "course", "speed")
    shares = {s: c("trip_id") % 4 < n for s, n in (("quarter", 1), ("half", 2), ("all", 4))}
    return rounded(evaluation.stages(f, "trip_id", {"error": ["k"], "error and course": ["k", "course"]}, "speed", shares), 5)


COV = lambda a, b: f"(p_{a}{b} / n - s_{a} * s_{b} / n / n)"
put("ML-09", ablation, f"""with own as (
  select f.trip_id, share, count(*) as n, sum(k) as s_x, sum(course) as s_z, sum(speed) as s_y, sum(1.0e0 * k * k) as p_xx, sum(k * course) as p_xz, sum(k * speed) as p_xy, sum(course * course) as p_zz, sum(course * speed) as p_zy, sum(speed * speed) as p_yy
  from fixes f join (values ('quarter', 1), ('half', 2), ('all', 4)) s(share, top) on f.trip_id % 4 < top group by 1, 2
), tot as (
  select share, sum(n) as n, sum(s_x) as s_x, sum(s_z) as s_z, sum(s_y) as s_y, sum(p_xx) as p_xx, sum(p_xz) as p_xz, sum(p_xy) as p_xy, sum(p_zz) as p_zz, sum(p_zy) as p_zy from own group by 1
), rest as (
  select g.trip_id, t.share, t.n - coalesce(o.n, 0) as n, t.s_x - coalesce(o.s_x, 0) as s_x, t.s_z - coalesce(o.s_z, 0) as s_z, t.s_y - coalesce(o.s_y, 0) as s_y, t.p_xx - coalesce(o.p_xx, 0) as p_xx, t.p_xz - coalesce(o.p_xz, 0) as p_xz,
    t.p_xy - coalesce(o.p_xy, 0) as p_xy, t.p_zz - coalesce(o.p_zz, 0) as p_zz, t.p_zy - coalesce(o.p_zy, 0) as p_zy
  from (select distinct trip_id from fixes) g cross join tot t left join own o on o.trip_id = g.trip_id and o.share = t.share
), co as (
  select *, {COV('x', 'x')} as cxx, {COV('z', 'z')} as czz, {COV('x', 'z')} as cxz, {COV('x', 'y')} as cxy, {COV('z', 'y')} as czy from rest where n >= 20
), be as (
  select *, cxy * n / (n * cxx + cxx) as b1, (n * cxx + cxx) * (n * czz + czz) - pow(n * cxz, 2) as det from co
), fit as (
  select trip_id, share, 'error' as stage, b1 as bx, 0.0e0 as bz, (s_y - b1 * s_x) / n as b0 from be
  union all
  select trip_id, share, 'error and course', bx, bz, (s_y - bx * s_x - bz * s_z) / n from (select *, (n * cxy * (n * czz + czz) - n * cxz * n * czy) / det as bx, (n * czy * (n * cxx + cxx) - n * cxz * n * cxy) / det as bz from be)
), o as (
  select stage, share, speed as y, b0 + bx * k + bz * course - speed as e from fixes f join fit on fit.trip_id = f.trip_id
)
select stage, share, count(*) as n, round(avg(abs(e)), 5) as mae, round(sqrt(avg(e * e)), 5) as rmse, round(avg(e), 5) as bias, round(1 - sum(e * e) / (var_pop(y) * count(*)), 5) as r2 from o group by 1, 2""", "fixes")  # fmt: skip


def intervals(spark, d):
    """Distances between every fourth fix of a trip, and the fixes between them as windows."""
    f = fixes(spark, d)
    marks = f.where("seq % 4 = 1").select("trip_id", "seq", "east")
    w = Window.partitionBy("trip_id").orderBy("seq")
    out = marks.select("trip_id", (c("seq") * 1.0).alias("start"), (F.lead("seq").over(w) * 1.0).alias("end"), F.abs(F.lead("east").over(w) - c("east")).alias("distance")).where("end is not null")
    return f.select("trip_id", (c("seq") * 1.0).alias("t"), c("k").cast("double").alias("k")), out


def interval_models(spark, d):
    windows, spans = intervals(spark, d)
    out = evaluation.interval_ridge(windows, spans, ["k"], least=8)
    return rounded(out.select("trip_id", "intervals", "reason", "intercept", c("beta")[0].alias("slope"), "sigma", "in_sample"), 5)


FIT = lambda name, source: f"""{name}_m as (select trip_id, median(duration) as median from {source} group by 1), {name}_w as (
  select s.*, greatest(0.25e0, least(4.0e0, duration / greatest(median, 1e-6))) as w from {source} s join {name}_m m on m.trip_id = s.trip_id
), {name}_s as (
  select trip_id, sum(w) as n, sum(w * k) / sum(w) as mx, sum(w * speed) / sum(w) as my, sum(w * k * k) / sum(w) - pow(sum(w * k) / sum(w), 2) as cxx, sum(w * k * speed) / sum(w) - sum(w * k) * sum(w * speed) / sum(w) / sum(w) as cxy from {name}_w group by 1
), {name} as (
  select trip_id, my - slope * mx as intercept, slope from (select *, n * cxy / (n * cxx + 3.0e0 * pow(greatest(sqrt(greatest(cxx, 0.0e0)), 0.2e0), 2)) as slope from {name}_s)
)"""  # noqa: E731
put("ML-02", interval_models, """with marks as (
  select trip_id, seq * 1.0e0 as start, lead(seq) over w * 1.0e0 as end_, abs(lead(east) over w - east) as distance from fixes where seq % 4 = 1 window w as (partition by trip_id order by seq)
), held as (
  select m.trip_id, start, end_, distance, avg(k) as k, end_ - start as duration, distance / (end_ - start) as speed from marks m join fixes f on f.trip_id = m.trip_id and f.seq * 1.0e0 > start and f.seq * 1.0e0 <= end_ group by 1, 2, 3, 4 having count(*) >= 3
), rows as (
  select *, count(*) over (partition by trip_id) as many, row_number() over (partition by trip_id order by start) as at_ from held
), enough as (
  select *, at_ <= least(greatest(4, floor(many * 0.7e0)), many - 5) as train from rows where many >= 8
), early as (select * from enough where train), """ + FIT("one", "early") + ", " + FIT("fin", "enough") + """, tried as (
  select e.trip_id, sqrt(avg(case when not train then pow(intercept + slope * k - speed, 2) end)) as out_, sqrt(avg(case when train then pow(intercept + slope * k - speed, 2) end)) as in_ from enough e join one on one.trip_id = e.trip_id group by 1
), n as (
  select t.trip_id, count(start) as n from (select distinct trip_id from fixes) t left join held h on h.trip_id = t.trip_id group by 1
)
select n.trip_id, n.n as intervals, case when n.n < 8 then 'too few intervals: ' || n.n else 'ok' end as reason, round(intercept, 5) as intercept, round(slope, 5) as slope, round(case when out_ is not null then greatest(1.5e0, least(12.0e0, out_)) end, 5) as sigma, round(in_, 5) as in_sample
from n left join fin on fin.trip_id = n.trip_id left join tried on tried.trip_id = n.trip_id""", "fixes")  # fmt: skip


def compared(spark, d):
    """Speeds of views against those of all other events, by error class of ten: rank test and range of the medians' difference."""
    f = fixes(spark, d).select("event_id", F.floor(c("k") / 10).alias("class"), "speed", (c("event_type") == "view").alias("one"))
    ranks = evaluation.rank_test(f, ["class"], "speed", c("one"))
    return rounded(ranks.join(evaluation.bootstrap_medians(f, ["class"], c("event_id"), "speed", c("one"), 100), "class"), 5)


Z = "greatest(0.0e0, abs(u - n1 * n2 / 2.0e0) - 0.5e0) / sqrt(var)"
put("AG-35_tests", compared, """with f as (
  select event_id, k // 10 as class, speed, event_type = 'view' as one from fixes
), by_ as (
  select class, speed, count(*) as t, count(*) filter (where one) as a from f group by 1, 2
), rk as (
  select *, sum(t) over (partition by class order by speed rows unbounded preceding) - (t - 1) / 2.0e0 as r from by_
), mw as (
  select class, cast(sum(a) as bigint) as n1, cast(sum(t) - sum(a) as bigint) as n2, sum(a * r) - sum(a) * (sum(a) + 1) / 2.0e0 as u, sum(t * t * t - t) as ties from rk group by 1
), zz as (
  select *, """ + Z + """ as z from (select *, n1 * n2 / 12.0e0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) as var from mw)
), pz as (
  select *, 1 / (1 + 0.3275911e0 * z / sqrt(2.0e0)) as q from zz
), reps as (
  select class, one, speed, rep, case when rep = 0 then 0.5e0 else cast('0x' || substr(md5(event_id || ':' || rep), 1, 8) as bigint) / 4294967296.0e0 end as h from f cross join (select unnest(range(0, 101)) as rep)
), wt as (
  select *, case when rep = 0 then 1 else (h >= exp(-1.0e0))::int + (h >= 2 * exp(-1.0e0))::int + (h >= 2.5e0 * exp(-1.0e0))::int + (h >= (2.5e0 + 1.0e0 / 6) * exp(-1.0e0))::int + (h >= (2.5e0 + 1.0e0 / 6 + 1.0e0 / 24) * exp(-1.0e0))::int
    + (h >= (2.5e0 + 1.0e0 / 6 + 1.0e0 / 24 + 1.0e0 / 120) * exp(-1.0e0))::int + (h >= (2.5e0 + 1.0e0 / 6 + 1.0e0 / 24 + 1.0e0 / 120 + 1.0e0 / 720) * exp(-1.0e0))::int end as w from reps
), vs as (
  select class, one, rep, speed, sum(w) as w from wt where w > 0 group by 1, 2, 3, 4
), cu as (
  select *, sum(w) over (partition by class, one, rep order by speed rows unbounded preceding) as upto, sum(w) over (partition by class, one, rep) as total from vs
), md as (
  select class, rep, max(case when one then m end) - max(case when not one then m end) as diff from (select class, one, rep, min(speed) as m from cu where 2 * upto >= total group by 1, 2, 3) group by 1, 2
), bs as (
  select class, max(case when rep = 0 then diff end) as diff, quantile_cont(case when rep > 0 then diff end, 0.025) as low, quantile_cont(case when rep > 0 then diff end, 0.975) as high, count(*) filter (where rep > 0) as used from md where diff is not null group by 1
)
select pz.class, n1, n2, round(u, 5) as u, round(z, 5) as z, round(q * (0.254829592e0 + q * (-0.284496736e0 + q * (1.421413741e0 + q * (-1.453152027e0 + q * 1.061405429e0)))) * exp(-z * z / 2), 5) as p,
  round(diff, 5) as diff, round(low, 5) as low, round(high, 5) as high, used from pz join bs on bs.class = pz.class""", "fixes")  # fmt: skip


def trip_models(spark, d):
    """Speed of each trip from the error class and the course, refused where a trip is short or slow."""
    f = fixes(spark, d).select("trip_id", "seq", c("k").cast("double").alias("k"), "course", "speed")
    out = evaluation.speed_models(f, "seq", ["k", "course"], least=14, moving=6)
    return rounded(out.select("trip_id", "n", "reason", "intercept", c("beta")[0].alias("of_error"), c("beta")[1].alias("of_course"), "sigma", "corr", "in_sample", "gap"), 5)


PAIR = lambda name, source: f"""{name}_s as (
  select trip_id, count(*) as n, avg(k) as mx, avg(course) as mz, avg(speed) as my, var_pop(k) * count(*) + 1 as xx, var_pop(course) * count(*) + 1 as zz, covar_pop(k, course) * count(*) as xz, covar_pop(k, speed) * count(*) as xy, covar_pop(course, speed) * count(*) as zy from {source} group by 1
), {name} as (
  select trip_id, bx, bz, my - bx * mx - bz * mz as b0 from (select *, (xy * zz - xz * zy) / (xx * zz - xz * xz) as bx, (zy * xx - xz * xy) / (xx * zz - xz * xz) as bz from {name}_s)
)"""  # noqa: E731
put("ML-01", trip_models, """with r as (
  select trip_id, seq, k, course, speed, count(*) over (partition by trip_id) as many, count(*) filter (where speed > 2.0e0) over (partition by trip_id) as fast, row_number() over (partition by trip_id order by seq) as at_ from fixes
), enough as (
  select *, at_ <= least(greatest(7, floor(many * 0.7e0)), many - 5) as train from r where many >= 14 and fast >= 6
), early as (select * from enough where train), """ + PAIR("one", "early") + ", " + PAIR("fin", "enough") + """, g as (
  select e.*, b0 + bx * k + bz * course as guess from enough e join one on one.trip_id = e.trip_id
), t as (
  select trip_id, stddev_pop(guess) filter (where not train) as spread, sqrt(avg(pow(guess - speed, 2)) filter (where not train)) as out_, corr(guess, speed) filter (where not train) as corr_, sqrt(avg(pow(guess - speed, 2)) filter (where train)) as in_ from g group by 1
), n as (select trip_id, count(*) as n, any_value(fast) as fast from r group by 1)
select n.trip_id, n.n, case when n.n < 14 or fast < 6 then 'too few rows: ' || n.n || ', moving ' || fast when spread < 1e-9 then 'constant prediction' else 'ok' end as reason,
  round(case when spread >= 1e-9 then b0 end, 5) as intercept, round(case when spread >= 1e-9 then bx end, 5) as of_error, round(case when spread >= 1e-9 then bz end, 5) as of_course, round(case when spread >= 1e-9 then greatest(1.5e0, least(12.0e0, out_)) end, 5) as sigma,
  round(case when spread >= 1e-9 then case when corr_ is null or isnan(corr_) then 0.0e0 else corr_ end end, 5) as corr, round(case when spread >= 1e-9 then in_ end, 5) as in_sample, round(case when spread >= 1e-9 then out_ / greatest(in_, 1e-6) end, 5) as gap
from n left join t on t.trip_id = n.trip_id left join fin on fin.trip_id = n.trip_id""", "fixes")  # fmt: skip
