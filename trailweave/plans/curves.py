"""Queries over polylines: a street network whose junctions are the customers, so it grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.operators import curves, roads
from trailweave.sources import graphml

from .evidence import rounded
from .views import sql, table

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("))


def streets(spark, d):
    """Vertices (edge, u, v, i, x, y, highway) of streets of one to five pieces between neighbours on a shaken grid, some one way.

    Both directions of a street hold the same vertices, in turn.
    """
    n = c("c_custkey")
    nodes = table(spark, d, "customer").select(n.alias("node"), ((n % 100) * 120 + (n * 37) % 31).cast("double").alias("x"), (F.floor(n / 100) * 120 + (n * 53) % 29).cast("double").alias("y"))
    ways = F.array(*[F.struct(F.lit(s).cast("long").alias("step"), F.lit(k).alias("way")) for k, s in enumerate((1, 100, -1, -100))])
    a = nodes.select(c("node").alias("u"), F.explode(ways).alias("w")).select("u", (c("u") + c("w.step")).alias("v"), "w.step", "w.way")
    a = a.where(~((c("step") == 1) & (c("u") % 100 == 99)) & ~((c("step") == -1) & (c("u") % 100 == 0)) & ~((c("step") < 0) & ((c("u") * 7 + c("v")) % 6 == 0)))
    a = a.withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v"))
    a = a.join(nodes.select(c("node").alias("lo"), c("x").alias("xl"), c("y").alias("yl")), "lo").join(nodes.select(c("node").alias("hi"), c("x").alias("xh"), c("y").alias("yh")), "hi")
    a = a.withColumn("m", 1 + c("lo") % 5).withColumn("bow", ((c("lo") * 13 + c("hi")) % 41 - 20) / 2.0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "m")))
    j = F.when(c("step") > 0, c("i")).otherwise(c("m") - c("i"))
    a = a.withColumn("j", j).withColumn("off", c("bow") * c("j") * (c("m") - c("j")))
    flat = F.abs("step") == 1
    x = c("xl") + (c("xh") - c("xl")) * c("j") / c("m") + F.when(flat, 0.0).otherwise(c("off"))
    y = c("yl") + (c("yh") - c("yl")) * c("j") / c("m") + F.when(flat, c("off")).otherwise(0.0)
    kind = F.element_at(F.array(*map(F.lit, ("primary", "secondary", "residential", "service_link"))), ((c("lo") * 3 + c("hi")) % 4 + 1).cast("int"))
    return a.select((c("u") * 8 + c("way")).alias("edge"), "u", "v", "i", x.alias("x"), y.alias("y"), kind.alias("highway"))


STREETS = """nodes as (
  select c_custkey as node, cast((c_custkey % 100) * 120 + (c_custkey * 37) % 31 as double) as x, cast((c_custkey // 100) * 120 + (c_custkey * 53) % 29 as double) as y from customer
), ways as (
  select node as u, node + step as v, step, way, least(node, node + step) as lo, greatest(node, node + step) as hi from nodes cross join (values (1, 0), (100, 1), (-1, 2), (-100, 3)) w(step, way)
  where not (step = 1 and node % 100 = 99) and not (step = -1 and node % 100 = 0) and not (step < 0 and (node * 7 + node + step) % 6 = 0)
), spots as (
  select w.*, l.x as xl, l.y as yl, h.x as xh, h.y as yh, 1 + lo % 5 as m, ((lo * 13 + hi) % 41 - 20) / 2.0e0 as bow, unnest(range(0, 2 + lo % 5)) as i from ways w join nodes l on l.node = lo join nodes h on h.node = hi
), bowed as (
  select *, case when step > 0 then i else m - i end as j, bow * (case when step > 0 then i else m - i end) * (m - (case when step > 0 then i else m - i end)) as off from spots
), streets as (
  select u * 8 + way as edge, u, v, i, xl + (xh - xl) * j / m + case when abs(step) = 1 then 0.0e0 else off end as x, yl + (yh - yl) * j / m + case when abs(step) = 1 then off else 0.0e0 end as y,
    case (lo * 3 + hi) % 4 when 0 then 'primary' when 1 then 'secondary' when 2 then 'residential' else 'service_link' end as highway from bowed
), raw as (
  select edge, i, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from streets window w as (partition by edge order by i)
), long as (
  select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len, atan2(y1 - y0, x1 - x0) as bearing from raw
), pieces as (
  select *, row_number() over w - 1 as piece, sum(len) over (partition by edge order by i rows unbounded preceding) as b, lead(i) over w is null as final from long where len > 1e-9 window w as (partition by edge order by i)
), p as (
  select *, coalesce(lag(b) over (partition by edge order by i), 0.0e0) as a from pieces)"""

put("GR-01", lambda spark, d: rounded(curves.table(streets(spark, d)).select("edge", "pieces", "length", "first", c("final").alias("last"), "lox", "hix", "loy", "hiy")),
    "with " + STREETS + """, box as (select edge, min(x) as lox, max(x) as hix, min(y) as loy, max(y) as hiy from streets group by 1), e as (
  select edge, count(*) as pieces, max(b) as length, arg_min(bearing, piece) as first, arg_max(bearing, piece) as last from p group by 1)
select e.edge, pieces, round(length, 6) as length, round(first, 6) as first, round(last, 6) as last, round(lox, 6) as lox, round(hix, 6) as hix, round(loy, 6) as loy, round(hiy, 6) as hiy from e join box on box.edge = e.edge where length > 0.001e0""")  # fmt: skip


def places(spark, d):
    """A place for each order: some way along, or beyond, a street that leaves its customer."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", (c("o_custkey") * 8 + c("o_orderkey") % 4).alias("edge"), ((c("o_orderkey") * 7) % 173 - 10.0 + 0.3).alias("s"))


PLACES = "places as (select o_orderkey, o_custkey * 8 + o_orderkey % 4 as edge, (o_orderkey * 7) % 173 - 10.0e0 + 0.3e0 as s from orders)"

put("JN-10", lambda spark, d: rounded(curves.at(streets(spark, d), places(spark, d)).select("o_orderkey", "edge", "x", "y", "bearing")),
    "with " + STREETS + ", " + PLACES + """ select o_orderkey, q.edge, round(x0 + f * (x1 - x0), 6) as x, round(y0 + f * (y1 - y0), 6) as y, round(bearing, 6) as bearing from (
  select o_orderkey, p.*, least(1.0e0, (greatest(0.0e0, s) - a) / len) as f from places join p on p.edge = places.edge and greatest(0.0e0, s) >= a and (greatest(0.0e0, s) < b or final)) q""")  # fmt: skip

WRAP = "({0}) + pi() - 2.0e0 * pi() * floor((({0}) + pi()) / (2.0e0 * pi())) - pi()"


def smooth(name: str, of: str, value: str) -> str:
    """SQL of a smoothed column of samples: the row with its turned and level ends, then a weighted sum."""
    return f"""{name}_e as (
  select *, first_value({value}) over (partition by edge order by k) as f, last_value({value}) over (partition by edge order by k rows between unbounded preceding and unbounded following) as l, n - 1 as far, {value} as val from {of}
), {name}_x as (
  select edge, k as p, val as x from {name}_e
  union all select edge, -k, 2 * f - val from {name}_e where k between 1 and 15
  union all select edge, 2 * far - k, 2 * l - val from {name}_e where far - k between 1 and 15
  union all select edge, unnest(range(-15, -far)), 2 * f - val from {name}_e where k = far and far < 15
  union all select edge, unnest(range(2 * far + 1, far + 16)), 2 * l - val from {name}_e where k = 0 and far < 15
), {name}_s as (
  select s.edge, s.k, sum(g * x) / sum(g) as smooth from {of} s cross join kern join {name}_x e on e.edge = s.edge and e.p = s.k + kern.j group by 1, 2
)"""


SLOPE = "coalesce((lead({0}) over w - lag({0}) over w) / (2 * step), (lead({0}) over w - {0}) / step, ({0} - lag({0}) over w) / step)"
PROFILE = STREETS + ", kern as (select j, exp(-0.5e0 * (j / 5.0e0) * (j / 5.0e0)) as g from (select unnest(range(-15, 16)) as j))" + """, grid as (
  select *, max(b) over (partition by edge) as length, coalesce(""" + WRAP.format("bearing - lag(bearing) over (partition by edge order by piece)") + """, bearing) as turn from p
), sized as (
  select *, greatest(2, cast(ceil(round(length / 2.0e0, 6)) as bigint) + 1) as n, sum(turn) over (partition by edge order by piece rows unbounded preceding) as raw from grid
), samples as (
  select edge, n, length / (n - 1) as step, raw, unnest(range(cast(ceil(round(a / (length / (n - 1)), 6)) as bigint), case when final then n else cast(ceil(round(b / (length / (n - 1)), 6)) as bigint) end)) as k from sized
), """ + smooth("h", "samples", "raw") + """, heads as (
  select s.*, case when n <= 2 then raw else smooth end as heading, abs(raw - case when n <= 2 then raw else smooth end) as rest from samples s join h_s on h_s.edge = s.edge and h_s.k = s.k
), """ + smooth("r", "heads", "rest") + """, bent as (
  select s.*, case when n <= 2 then rest else smooth end as rough, case when n <= 2 then 0.0e0 else """ + SLOPE.format("heading") + """ end as kap
  from heads s join r_s on r_s.edge = s.edge and r_s.k = s.k window w as (partition by s.edge order by s.k)
), bent2 as (
  select *, case when n <= 2 then 0.0e0 else """ + SLOPE.format("kap") + """ end as gra from bent window w as (partition by edge order by k)
), profile as (
  select edge, k, n, step, heading, case when abs(kap) < 1e-9 then 0.0e0 else kap end as kappa, case when abs(gra) < 1e-9 then 0.0e0 else gra end as grad,
    0.002e0 + 0.6e0 * case when rough < 1e-9 then 0.0e0 else rough end / 10.0e0 as sigma from bent2)"""  # fmt: skip
put("GR-09", lambda spark, d: rounded(curves.profile(streets(spark, d)).select("edge", "k", "s", "heading", "kappa", "grad", "sigma")),
    "with " + PROFILE + " select edge, k, round(k * step, 6) as s, round(heading, 6) as heading, round(kappa, 6) as kappa, round(grad, 6) as grad, round(sigma, 6) as sigma from profile")
put("GR-10", lambda spark, d: rounded(curves.looked_up(curves.profile(streets(spark, d)), places(spark, d)).select("o_orderkey", "edge", F.cos("heading").alias("east"), F.sin("heading").alias("north"), "kappa", "grad", "sigma")),
    "with " + PROFILE + ", " + PLACES + ", z as (select edge, n, step from profile where k = 0), near as (select o_orderkey, z.edge, least(n - 1, cast(round_even(round(greatest(0.0e0, least(s, step * (n - 1))) / step, 6), 0) as bigint)) as k from places join z on z.edge = places.edge) select o_orderkey, near.edge, round(cos(heading), 6) as east, round(sin(heading), 6) as north, round(kappa, 6) as kappa, round(grad, 6) as grad, round(sigma, 6) as sigma from near join profile q on q.edge = near.edge and q.k = near.k")


def adjacency(spark, d):
    """Streets out of each junction in order, with how many stand before them, and the grid cells in order with theirs."""
    s = streets(spark, d)
    text = lambda x: F.array_join(F.array_sort(F.collect_list(x)).cast("array<string>"), ",")
    out = s.where("i = 0").groupBy(F.lit("out").alias("kind"), F.lit(None).cast("long").alias("row"), c("u").alias("col")).agg(text("edge").alias("edges"))
    grid = curves.cells(s).groupBy(F.lit("cell").alias("kind"), "row", "col").agg(text("edge").alias("edges"))
    return out.unionByName(grid)


put("GR-13", adjacency, "with " + STREETS + """, low as (select min(x) as lx, min(y) as ly from streets), spot as (
  select edge, x, y from streets union all select edge, (x0 + x1) / 2, (y0 + y1) / 2 from raw where x1 is not null
), cells as (
  select distinct cast(floor((y - ly) / 250.0e0) as bigint) as r, cast(floor((x - lx) / 250.0e0) as bigint) as k, edge from spot cross join low
) select 'out' as kind, cast(null as bigint) as row, u as col, array_to_string(list_sort(list(edge)), ',') as edges from streets where i = 0 group by u
union all select 'cell', r, k, array_to_string(list_sort(list(edge)), ',') from cells group by 2, 3""")  # fmt: skip


def rules(spark, d):
    """Turn rules between streets: some turns are forbidden, some are the only ones."""
    steps = roads.successors(streets(spark, d).where("i = 0").select("edge", "u", "v")).where((c("edge") * 3 + c("next")) % 11 == 0)
    return steps.select(F.when(c("edge") % 2 == 0, "no").otherwise("only").alias("kind"), c("edge").alias("from"), F.array().cast("array<bigint>").alias("via"), c("next").alias("to"))


def graph_file(spark, d):
    return graphml.read(spark, graphml.write(streets(spark, d), rules(spark, d)))


put("SRC-12", lambda spark, d: rounded(graph_file(spark, d)[1]), "with " + STREETS + " select edge, u, v, i, round(x, 6) as x, round(y, 6) as y, highway from streets")
put("SRC-12_rules", lambda spark, d: graph_file(spark, d)[2].select("kind", "from", "to"),
    "with " + STREETS + ", e as (select distinct edge, u, v from streets) select case when a.edge % 2 = 0 then 'no' else 'only' end as kind, a.edge as \"from\", b.edge as \"to\" from e a join e b on b.u = a.v and b.v <> a.u where (a.edge * 3 + b.edge) % 11 = 0")
