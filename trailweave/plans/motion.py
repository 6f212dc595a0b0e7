"""Queries over motion, routes and tracks, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import islands, motion, roads

from .evidence import rounded
from .views import edges, fixes, imu, nodes, particles, points, sql, states

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    """Rounding makes -0.0 in one engine and 0.0 in the other; adding zero makes it 0.0 in both."""
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


put("WN-12", lambda spark, d: rounded(motion.thinned(fixes(spark, d), 60.0).groupBy("trip_id").agg(F.count("*").alias("n"), F.sum("t").alias("total"), F.max("t").alias("last")), 4),
    """with recursive k as (select trip_id, min(t) as t from fixes group by 1 union all select k.trip_id, min(f.t) as t from k join fixes f on f.trip_id = k.trip_id and f.t - k.t >= 60.0e0 group by k.trip_id)
select trip_id, count(*) as n, round(sum(t), 4) as total, round(max(t), 4) as last from k group by 1""", "fixes")  # fmt: skip

QUAT = "1.0e0 + h % 7 as w0, (h % 5 - 2) * 1.1e0 as x0, (n % 3 - 1) * 1.3e0 as y0, case when h % 4 = 0 then -3.0e0 else 1.0e0 end as z0"


def attitudes(spark, d):
    return imu(spark, d).withColumn("q", F.array(1.0 + c("h") % 7, (c("h") % 5 - 2) * 1.1, (c("n") % 3 - 1) * 1.3, F.when(c("h") % 4 == 0, -3.0).otherwise(1.0))).withColumn("q", F.when(c("h") % 6 == 0, F.transform("q", lambda v: -v)).otherwise(c("q")))


put("WN-13", lambda spark, d: rounded(motion.angular_velocity(attitudes(spark, d)), 4),
    "with q0 as (select trip_id, n, t, case when h % 6 = 0 then -1.0e0 else 1.0e0 end as g, " + QUAT + """ from imu), q1 as (select trip_id, n, t, g / sqrt(w0 * w0 + x0 * x0 + y0 * y0 + z0 * z0) as k, w0, x0, y0, z0 from q0
), q2 as (select trip_id, n, t, w0 * k as w, x0 * k as x, y0 * k as y, z0 * k as z from q1), q3 as (select *, case when w * lag(w) over o + x * lag(x) over o + y * lag(y) over o + z * lag(z) over o < 0 then 1 else 0 end as turn from q2 window o as (partition by trip_id order by n)
), q4 as (select *, case when sum(turn) over (partition by trip_id order by n) % 2 = 1 then -1.0e0 else 1.0e0 end as s from q3), q5 as (select trip_id, n, t, w * s as w, x * s as x, y * s as y, z * s as z from q4
), q6 as (select *, coalesce(lag(t) over o, t) as tb, coalesce(lead(t) over o, t) as ta, lag(w) over o as wb, lead(w) over o as wa, lag(x) over o as xb, lead(x) over o as xa, lag(y) over o as yb, lead(y) over o as ya, lag(z) over o as zb, lead(z) over o as za from q5 window o as (partition by trip_id order by n)
), q7 as (select *, """ + ", ".join(f"coalesce(case when tb < t and ta > t then ({v}a - {v}) / (ta - t) * (t - tb) / (ta - tb) + ({v} - {v}b) / (t - tb) * (ta - t) / (ta - tb) end, ({v}a - {v}) / (ta - t), ({v} - {v}b) / (t - tb), 0.0e0) as d{v}" for v in "wxyz") + """ from q6)
select trip_id, n, round(2 * (w * dx - x * dw - y * dz + z * dy), 4) as wx, round(2 * (w * dy + x * dz - y * dw - z * dx), 4) as wy, round(2 * (w * dz - x * dy + y * dx - z * dw), 4) as wz from q7""", "imu")  # fmt: skip

put("WN-14", lambda spark, d: rounded(motion.leaky(imu(spark, d), "yaw", 5.0), 4),
    "with x as (select a.trip_id, a.n, b.yaw, b.n as m, a.t - b.t as age from imu a join imu b on b.trip_id = a.trip_id and b.n <= a.n) select trip_id, n, round(sum(case when m > 0 then yaw * 0.1e0 * exp(-age / 5.0e0) else 0.0e0 end), 4) as leaky from x group by 1, 2", "imu")

put("WN-08", lambda spark, d: rounded(imu(spark, d).withColumn("smooth", motion.padded_mean("yaw", 5)).where("n % 2 = 1").select("trip_id", "n", "smooth")),
    """with m as (select trip_id, max(n) as last from imu group by 1), x as (select i.trip_id, i.n, least(greatest(i.n + j, 0), last) as at_ from imu i join m on m.trip_id = i.trip_id cross join (select unnest(range(-5, 6)) as j))
select x.trip_id, x.n, round(avg(i.yaw), 6) as smooth from x join imu i on i.trip_id = x.trip_id and i.n = x.at_ where x.n % 2 = 1 group by 1, 2""", "imu")  # fmt: skip

put("FN-35", lambda spark, d: rounded(motion.gaussian(imu(spark, d), "a_long", 2.0)),
    """with m as (select trip_id, max(n) as last from imu group by 1), kern as (select j, exp(-0.5e0 * (j / 2.0e0) * (j / 2.0e0)) as g from (select unnest(range(-6, 7)) as j)), x as (
  select i.trip_id, i.n, g, ((i.n + j) % greatest(1, 2 * last) + greatest(1, 2 * last)) % greatest(1, 2 * last) as r, last from imu i join m on m.trip_id = i.trip_id cross join kern)
select x.trip_id, x.n, round(sum(g * a_long) / sum(g), 6) as smooth from x join imu i on i.trip_id = x.trip_id and i.n = least(r, 2 * last - r) group by 1, 2""", "imu")  # fmt: skip


def headings(spark, d):
    """Heading integrated over two seconds of each trip, its sigma and the time about which it turned; null where it stood still.

    The sums for that time run over the first samples of all fixes, then the second and the third, as those of SQL do, so
    that a time on half of the last digit rounds alike.
    """
    rows = imu(spark, d).groupBy("trip_id", F.floor(c("n") / 20).alias("window"))
    turned = F.abs("yaw").alias("a")
    rows = rows.agg(F.sum(c("yaw") * 0.1).alias("delta"), (F.sqrt(F.count("*")) * 0.02).alias("sigma"), F.array_sort(F.collect_list(F.struct((c("n") % 3).alias("j"), "n", turned, "t"))).alias("all"))
    total = lambda f: F.aggregate("all", F.lit(0.0), lambda s, r: s + f(r))
    return rows.select("trip_id", "window", "delta", "sigma", F.try_divide(total(lambda r: r["a"] * r["t"]), total(lambda r: r["a"])).alias("centre"))


put("WN-19", lambda spark, d: rounded(headings(spark, d)), "select trip_id, n // 20 as window, round(sum(yaw * 0.1e0), 6) as delta, round(sqrt(count(*)) * 0.02e0, 6) as sigma, round(case when sum(abs(yaw)) > 0 then sum(abs(yaw) * t) / sum(abs(yaw)) end, 6) as centre from imu group by 1, 2", "imu")


def features(spark, d):
    """Features of windows of 40 samples every 20: moments, slopes, integrals and shares."""
    w = Window.partitionBy("trip_id").orderBy("n")
    rows = imu(spark, d).withColumn("trap", (c("a_long") + F.lag("a_long").over(w)) / 2 * (c("t") - F.lag("t").over(w)))
    rows = rows.withColumn("win", F.explode(F.array(F.floor(c("n") / 20), F.floor(c("n") / 20) - 1))).where("win >= 0")
    inner = F.when(c("n") > c("win") * 20, c("trap"))
    return rows.groupBy("trip_id", "win").agg(
        F.count("*").alias("n"), F.avg("a_long").alias("a_mean"), F.stddev_pop("a_long").alias("a_std"), F.min("a_long").alias("a_min"), F.max("a_long").alias("a_max"), F.sqrt(F.avg(F.pow("a_long", 2))).alias("a_rms"),
        (F.covar_pop("t", "a_long") / F.nullif(F.var_pop("t"), F.lit(0.0))).alias("a_slope"), F.sum(inner).alias("a_integral"), F.avg("yaw").alias("w_mean"), F.stddev_pop("yaw").alias("w_std"), F.avg(F.abs("yaw")).alias("w_abs"), F.max(F.abs("yaw")).alias("w_peak"),
        F.avg((F.abs("yaw") < 0.03).cast("double")).alias("quiet"), F.sum(F.when(c("a_long") > 0, c("a_long")).otherwise(0.0)).alias("push"), F.sum(F.when(c("a_long") < 0, c("a_long")).otherwise(0.0)).alias("brake"), F.corr("a_long", "yaw").alias("r"),
    ).na.fill(0.0, ["a_slope", "r"]).withColumn("r", F.when(F.isnan("r"), 0.0).otherwise(c("r")))


put("WN-22", lambda spark, d: rounded(features(spark, d).drop("r"), 7),
    """with w as (select *, (a_long + lag(a_long) over o) / 2 * (t - lag(t) over o) as trap from imu window o as (partition by trip_id order by n)), x as (select *, n // 20 as win from w union all select *, n // 20 - 1 as win from w where n >= 20)
select trip_id, win, count(*) as n, round(avg(a_long), 7) as a_mean, round(stddev_pop(a_long), 7) as a_std, round(min(a_long), 7) as a_min, round(max(a_long), 7) as a_max, round(sqrt(avg(a_long * a_long)), 7) as a_rms, round(coalesce(case when var_pop(t) > 0 then covar_pop(t, a_long) / var_pop(t) end, 0.0e0), 7) as a_slope,
  round(sum(case when n > win * 20 then trap end), 7) as a_integral, round(avg(yaw), 7) as w_mean, round(stddev_pop(yaw), 7) as w_std, round(avg(abs(yaw)), 7) as w_abs, round(max(abs(yaw)), 7) as w_peak, round(avg(case when abs(yaw) < 0.03e0 then 1.0e0 else 0.0e0 end), 7) as quiet,
  round(sum(case when a_long > 0 then a_long else 0.0e0 end), 7) as push, round(sum(case when a_long < 0 then a_long else 0.0e0 end), 7) as brake from x group by 1, 2""", "imu")  # fmt: skip

put("WN-23", lambda spark, d: rounded(motion.redistributed(fixes(spark, d).select("trip_id", "seq", "t", (c("seq") * 25.0).alias("way"), "speed", F.when(c("seq") % 10 == 0, c("k") - 50.0).alias("jump"))), 4),
    """with a as (select trip_id, seq, t, seq * 25.0e0 as way, speed, seq % 10 = 0 as anchor, greatest(0.0e0, least(2.0e0, t - lag(t) over (partition by trip_id order by seq))) as d0 from fixes
), b as (select *, coalesce(d0, lead(d0) over (partition by trip_id order by seq)) as dt, seq // 10 as part from a), j as (select trip_id, seq // 10 - 1 as part, k - 50.0e0 as jump from fixes where seq % 10 = 0
), e as (select b.*, case when not anchor and speed > 2.0e0 then dt else 0.0e0 end as busy, jump from b left join j on j.trip_id = b.trip_id and j.part = b.part
), f as (select *, sum(busy) over (partition by trip_id, part) as total from e), g as (select *, case when total > 0 and jump is not null then jump * busy / total else 0.0e0 end as share from f)
select trip_id, seq, round(way + sum(share) over (partition by trip_id, part order by seq), 4) as way, round(speed + case when dt > 0 then share / dt else 0.0e0 end, 4) as speed from g""", "fixes")  # fmt: skip


def yaw_offset(spark, d):
    """Direction of the strongest tenth of the accelerations in the first 30 seconds, against a given heading.

    Sums in the order of SQL's, as in ``headings``: where the sides cancel, the sign of what rounding leaves tells pi from -pi.
    """
    rows = imu(spark, d).where("t <= 30").select("trip_id", "n", "a_long", (c("yaw") * 5).alias("side")).withColumn("m", F.hypot("a_long", "side")).where("m > 0")
    least = rows.groupBy("trip_id").agg(F.expr("percentile(m, 0.9)").alias("least"))
    strong = rows.join(least, "trip_id").where(c("m") >= F.greatest("least", F.lit(0.2)) - 1e-12)
    strong = strong.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct((c("n") % 3).alias("j"), "n", "a_long", "side"))).alias("all"))
    mean = lambda f: F.aggregate("all", F.lit(0.0), lambda s, r: s + r[f]) / F.size("all")
    return strong.select("trip_id", F.size("all").cast("long").alias("n"), F.atan2(mean("side"), mean("a_long")).alias("measured"))


put("WN-31", lambda spark, d: rounded(yaw_offset(spark, d), 5),
    "with r as (select trip_id, a_long, yaw * 5 as side, sqrt(a_long * a_long + 25 * yaw * yaw) as m from imu where t <= 30), l as (select trip_id, quantile_cont(m, 0.9) as least_ from r where m > 0 group by 1) select r.trip_id, count(*) as n, round(atan2(avg(side), avg(a_long)), 5) as measured from r join l on l.trip_id = r.trip_id where m > 0 and m >= greatest(least_, 0.2e0) - 1e-12 group by 1", "imu")


def traversal(spark, d):
    """The true edges one after another: where each begins, how many rows it lasts, and which comes next."""
    rows = fixes(spark, d).select("trip_id", "seq", "t", F.floor(c("seq") / 3 + c("k") / 50).cast("long").alias("edge"))
    runs = islands.by_change(rows, ["trip_id"], [c("seq")], c("edge"), "run").groupBy("trip_id", "run", "edge").agg(F.min("t").alias("t"), F.count("*").alias("n"))
    return runs.withColumn("next", F.lead("edge").over(Window.partitionBy("trip_id").orderBy("run"))).select("trip_id", "t", "edge", "n", "next")


put("JN-24", lambda spark, d: rounded(traversal(spark, d)),
    """with e as (select trip_id, seq, t, cast(floor(seq / 3.0e0 + k / 50.0e0) as bigint) as edge from fixes), b as (select *, case when edge = lag(edge) over (partition by trip_id order by seq) then 0 else 1 end as new from e), r as (select *, sum(new) over (partition by trip_id order by seq) as run from b
), g as (select trip_id, run, any_value(edge) as edge, min(t) as t, count(*) as n from r group by 1, 2) select trip_id, round(t, 6) as t, edge, n, lead(edge) over (partition by trip_id order by run) as next from g""", "fixes")  # fmt: skip


def crossings(spark, d):
    """The first crossing within each outage and five seconds about it."""
    out = states(spark, d).where("state = 'LOST'").select("trip_id", "seq", "t")
    hits = out.join(fixes(spark, d).where("k % 5 = 0").select("trip_id", c("seq").alias("crossing"), c("t").alias("at")), "trip_id").where(c("at").between(c("t") - 25.0, c("t") + 25.0))
    return hits.groupBy("trip_id", "seq").agg(F.min_by("crossing", F.struct("at", "crossing")).alias("crossing"))


put("JN-18", crossings, "select trip_id, seq, crossing from (select s.trip_id, s.seq, f.seq as crossing, row_number() over (partition by s.trip_id, s.seq order by f.t, f.seq) as r from states s join fixes f on f.trip_id = s.trip_id and f.k % 5 = 0 and f.t >= s.t - 25.0e0 and f.t <= s.t + 25.0e0 where s.state = 'LOST') where r = 1", "states")


def bound_events(spark, d):
    """Which edge of its trip's chain each event lies on, by the way travelled: an as-of match on the chain's offsets."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    chain = fixes(spark, d).where("seq % 4 = 1").select("trip_id", "seq", (10.0 + c("k")).alias("len")).withColumn("offset", F.sum("len").over(w) - c("len"))
    events = fixes(spark, d).where("good").select("trip_id", c("seq").alias("event"), (c("seq") * 11.0).alias("at"))
    both = chain.select("trip_id", c("offset").alias("at"), F.lit(0).alias("kind"), F.struct("seq", "offset", "len").alias("e"), F.lit(None).cast("long").alias("event"))
    both = both.unionByName(events.select("trip_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<seq:bigint,offset:double,len:double>").alias("e"), "event"))
    at = Window.partitionBy("trip_id").orderBy("at", "kind", "e.seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("e", F.last("e", ignorenulls=True).over(at)).where((c("kind") == 1) & (c("at") <= c("e.offset") + c("e.len")))
    return rows.select("trip_id", "event", c("e.seq").alias("place"), (c("at") - c("e.offset")).alias("along"))


put("JN-20", lambda spark, d: rounded(bound_events(spark, d)),
    """with ch as (select trip_id, seq, 10.0e0 + k as len, sum(10.0e0 + k) over (partition by trip_id order by seq) - (10.0e0 + k) as offset_ from fixes where seq % 4 = 1), h as (
  select f.trip_id, f.seq as event, ch.seq as place, f.seq * 11.0e0 - offset_ as along, row_number() over (partition by f.trip_id, f.seq order by offset_ desc, ch.seq desc) as r from fixes f join ch on ch.trip_id = f.trip_id and f.seq * 11.0e0 >= offset_ and f.seq * 11.0e0 <= offset_ + len where good)
select trip_id, event, place, round(along, 6) as along from h where r = 1""", "fixes")  # fmt: skip


def twin_artefacts(spark, d, gap: float = 520.0):
    """Edges that begin near where another ends without following it: candidates for a reference snapped to a twin."""
    e, steps = edges(spark, d), roads.successors(edges(spark, d), True)
    ends = e.select("edge", c("x1").alias("px"), c("y1").alias("py"), "highway").withColumn("cell", F.explode(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.struct((F.floor(c("px") / gap) + i).alias("a"), (F.floor(c("py") / gap) + j).alias("b")))))))
    starts = e.select(c("edge").alias("truth"), "x0", "y0", c("highway").alias("other")).withColumn("cell", F.struct(F.floor(c("x0") / gap).alias("a"), F.floor(c("y0") / gap).alias("b")))
    far = F.hypot(c("px") - c("x0"), c("py") - c("y0"))
    near = ends.join(starts, "cell").where((c("edge") != c("truth")) & (far <= gap) & ((c("highway") == c("other")) | (far <= gap / 2)))
    return near.select("edge", "truth", far.alias("gap")).join(steps.select("edge", c("next").alias("truth")), ["edge", "truth"], "left_anti")


put("JN-25", lambda spark, d: rounded(twin_artefacts(spark, d), 4),
    """select a.edge, b.edge as truth, round(sqrt(pow(a.x1 - b.x0, 2) + pow(a.y1 - b.y0, 2)), 4) as gap from edges a join edges b on a.edge <> b.edge and sqrt(pow(a.x1 - b.x0, 2) + pow(a.y1 - b.y0, 2)) <= case when a.highway = b.highway then 520.0e0 else 260.0e0 end where a.v <> b.u""", "nodes", "edges")  # fmt: skip


def polylines(spark, d):
    """Routes along the rows of the grid: their points without the doubled joints, and the way up to each."""
    w = Window.partitionBy("route").orderBy("edge", "end")
    e = edges(spark, d).where("v = u + 1").withColumn("route", F.floor(c("u") / 5))
    ends = e.select("route", "edge", F.posexplode(F.array(F.struct(c("x0").alias("x"), c("y0").alias("y")), F.struct(c("x1").alias("x"), c("y1").alias("y")))).alias("end", "p")).select("route", "edge", "end", "p.x", "p.y")
    step = F.hypot(c("x") - F.lag("x").over(w), c("y") - F.lag("y").over(w))
    kept = ends.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("first", F.row_number().over(w) == 1).where("first or step > 0")
    return kept.select("route", (F.row_number().over(w) - 1).alias("i"), "x", "y", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("way"))


put("GR-08", lambda spark, d: rounded(polylines(spark, d), 4),
    """with p as (select distinct node // 5 as route, node, x, y from nodes), q as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from p window w as (partition by route order by node))
select route, row_number() over (partition by route order by node) - 1 as i, x, y, round(coalesce(sum(step) over (partition by route order by node), 0.0e0), 4) as way from q""", "nodes")  # fmt: skip

by_seq = lambda: Window.partitionBy("trip_id").orderBy("seq")
put("GR-14", lambda spark, d: fixes(spark, d).select("trip_id", "seq", F.row_number().over(by_seq()).cast("long").alias("n"), F.array_join(F.transform(F.collect_list(c("k") % 9).over(by_seq().rowsBetween(-2, 0)), lambda x: x.cast("string")), ",").alias("tail")),
    "select trip_id, seq, count(*) over w as n, array_to_string(list_slice(list(k % 9) over w, -3, -1), ',') as tail from fixes window w as (partition by trip_id order by seq)", "fixes")


def mixture(spark, d):
    """Modes of one edge and cell made one: weight by the log of the sum, mean and variance by moments."""
    rows = particles(spark, d).withColumn("cell", F.floor(c("s") / 50)).withColumn("lw", F.log("w")).withColumn("var", 4.0 + c("i") % 3)
    top = F.max("lw").over(Window.partitionBy("trip_id", "edge", "cell"))
    g = rows.withColumn("top", top).withColumn("u", F.exp(c("lw") - c("top"))).groupBy("trip_id", "edge", "cell")
    total, mean = F.sum("u"), F.sum(c("u") * c("s")) / F.sum("u")
    return g.agg((F.first("top") + F.log(total)).alias("log_w"), mean.alias("mean"), (F.sum(c("u") * (c("var") + c("s") * c("s"))) / total - mean * mean).alias("var"))


put("AG-22", lambda spark, d: rounded(mixture(spark, d), 4), "select trip_id, edge, cast(floor(s / 50) as bigint) as cell, round(ln(sum(w)), 4) as log_w, round(sum(w * s) / sum(w), 4) as mean, round(sum(w * (4.0e0 + i % 3 + s * s)) / sum(w) - pow(sum(w * s) / sum(w), 2), 4) as var from particles group by 1, 2, 3", "particles")


def map_evidence(spark, d):
    """Whether the belief is sure enough of one edge to correct the free estimate: mass, spread and distance from it."""
    p = particles(spark, d).withColumn("w", c("w") / F.sum("w").over(Window.partitionBy("trip_id")))
    best = p.groupBy("trip_id", "edge").agg(F.sum("w").alias("mass"), (F.sum(c("w") * c("s")) / F.sum("w")).alias("s"), F.sqrt(F.greatest(F.sum(c("w") * c("s") * c("s")) / F.sum("w") - F.pow(F.sum(c("w") * c("s")) / F.sum("w"), 2), F.lit(0.0))).alias("spread"))
    best = best.groupBy("trip_id").agg(F.max_by(F.struct("edge", "mass", "s", "spread"), F.struct(F.round("mass", 9), -c("edge"))).alias("b")).select("trip_id", "b.*")
    why = F.when(c("mass") < 0.35, "mass").when(c("spread") > 120.0, "spread").when(F.abs(c("s") - 200.0) > 150.0, "offset")
    return best.select("trip_id", "edge", "mass", "s", "spread", why.alias("why"))


put("ST-14", lambda spark, d: rounded(map_evidence(spark, d), 4),
    """with p as (select trip_id, edge, s, w / sum(w) over (partition by trip_id) as q from particles), b as (select trip_id, edge, sum(q) as mass, sum(q * s) / sum(q) as s, sqrt(greatest(0.0e0, sum(q * s * s) / sum(q) - pow(sum(q * s) / sum(q), 2))) as spread from p group by 1, 2
), r as (select *, row_number() over (partition by trip_id order by round(mass, 9) desc, edge) as k from b)
select trip_id, edge, round(mass, 4) as mass, round(s, 4) as s, round(spread, 4) as spread, case when mass < 0.35e0 then 'mass' when spread > 120.0e0 then 'spread' when abs(s - 200.0e0) > 150.0e0 then 'offset' end as why from r where k = 1""", "particles")  # fmt: skip


def standardized_ridge(spark, d, penalty: float = 0.5):
    """Per kind of event, the coefficients of accuracy by speed and k, both standardized, with a penalty per row."""
    g = fixes(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{v}") for v in ("speed", "k")], *[F.stddev_pop(v).alias(f"s{v}") for v in ("speed", "k")], F.covar_pop("speed", "k").alias("r"), F.covar_pop("speed", "t").alias("a"), F.covar_pop("k", "t").alias("b"), F.avg("t").alias("intercept"))
    r, a, b = c("r") / (c("sspeed") * c("sk")), c("a") / c("sspeed"), c("b") / c("sk")
    det = (1 + penalty) * (1 + penalty) - r * r
    return g.select("event_type", "n", "intercept", (((1 + penalty) * a - r * b) / det).alias("by_speed"), (((1 + penalty) * b - r * a) / det).alias("by_k"))


put("ML-07", lambda spark, d: rounded(standardized_ridge(spark, d), 4),
    """with z as (select event_type, t, (speed - avg(speed) over w) / stddev_pop(speed) over w as u, (k - avg(k) over w) / stddev_pop(k) over w as v, t - avg(t) over w as y from fixes window w as (partition by event_type)
), m as (select event_type, count(*) as n, avg(t) as i, avg(u * v) as r, avg(u * y) as a, avg(v * y) as b from z group by 1)
select event_type, n, round(i, 4) as intercept, round((1.5e0 * a - r * b) / (2.25e0 - r * r), 4) as by_speed, round((1.5e0 * b - r * a) / (2.25e0 - r * r), 4) as by_k from m""", "fixes")  # fmt: skip

put("FN-36", lambda spark, d: fixes(spark, d).select("trip_id", "seq", F.when(c("k") % 9 == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", c("k") / 4.0 + 0.03), F.lit(" %"))).alias("share")),
    "select trip_id, seq, case when k % 9 = 0 then 'n/a' else printf('%.1f', k / 4.0e0 + 0.03e0) || ' %' end as share from fixes", "fixes")

put("ST-03", lambda spark, d: rounded(fixes(spark, d).select("trip_id", "seq", motion.nudged(c("k") / 10.0, c("speed") / 3.0, 0.2).alias("heading"))),
    "select trip_id, seq, round(k / 10.0e0 + 0.2e0 * atan2(sin(speed / 3.0e0 - k / 10.0e0), cos(speed / 3.0e0 - k / 10.0e0)), 6) as heading from fixes", "fixes")


def dead_reckoning(spark, d):
    """The filter over the fixes of each trip; those of errors are withheld."""
    rows = fixes(spark, d).select("trip_id", "seq", F.lit(1.0).alias("dt"), ((c("k") - 50) / 50.0).alias("a"), ((c("k") % 11 - 5) / 50.0).alias("w"), F.when(c("good"), c("east")).alias("east"), F.when(c("good"), c("north")).alias("north"), "acc", F.when(c("good"), c("speed")).alias("speed"))
    return rounded(motion.dead_reckoned(rows), 4)


put("ST-02", dead_reckoning, None)
