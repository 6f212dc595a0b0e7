"""Queries over signs, routes and graph sources, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.operators import photo, roads

from .evidence import rounded
from .network import RULES, legal
from .views import edges, nodes, points, sql, table

c = F.col
QUERIES: dict[str, tuple] = {}


def put(name: str, run, text: str | None, *uses: str) -> None:
    QUERIES[name] = run, text and sql(text.replace(" round(", " 0.0e0 + round("), *uses)


def sign_lines(spark, d):
    """Three lines of a photographed sign per turn of a conversation, with how sure the reader is of each."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array(
        F.struct(F.lit(0).alias("line"), F.concat(F.lit("Улица Новая"), (c("conv_id") % 7).cast("string")).alias("text")),
        F.struct(F.lit(1).alias("line"), F.concat(F.lit("дом "), (c("conv_id") % 300 + 1).cast("string")).alias("text")),
        F.struct(F.lit(2).alias("line"), F.when(c("turn") % 2 == 0, F.concat(F.lit("Зона "), (1000 + c("turn")).cast("string"))).otherwise("08:00-21:00").alias("text")),
    )).alias("x")).select("conv_id", "turn", "x.*")
    return t.withColumn("confidence", ((c("conv_id") + c("line") * 3) % 10) / 10.0)


put("TX-02", lambda spark, d: photo.parsed(sign_lines(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("streets", ",").alias("streets"), F.array_join("houses", ",").alias("houses"), F.array_join("zones", ",").alias("zones"), F.size("lines").cast("long").alias("lines"), F.round("confidence", 6).alias("confidence")),
    """with l as (select conv_id, turn, unnest([0, 1, 2]) as line from conversations), k as (select *, ((conv_id + line * 3) % 10) / 10.0e0 as conf from l)
select conv_id, turn, coalesce(max(case when line = 0 then 'новая' || cast(conv_id % 7 as varchar) end), '') as streets, coalesce(max(case when line = 1 then cast(conv_id % 300 + 1 as varchar) end), '') as houses,
  coalesce(max(case when line = 2 and turn % 2 = 0 then cast(1000 + turn as varchar) end), '') as zones, count(*) as lines, round(avg(conf), 6) as confidence from k where conf >= 0.3e0 group by 1, 2""")  # fmt: skip


def part_names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name")


def likened(spark, d):
    """Each distinct part name, with two letters of its second word changed about, against all part names."""
    names = part_names(spark, d).select(F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.substring("p_name", 5, 60)).alias("name"))
    return rounded(photo.matched(names, part_names(spark, d).select(c("p_name").alias("road"))))


put("TX-07", lambda spark, d: rounded(part_names(spark, d).select("p_partkey", photo.name_similarity(c("p_name"), F.concat(F.substring("p_name", 2, 60), F.lit("s"))).alias("score"))), None)
put("TX-08", likened, None)


def street_places(spark, d):
    """Middles of the edges, each named after a part."""
    n = part_names(spark, d).select("p_name").distinct().withColumn("k", F.pmod(F.crc32(c("p_name").cast("binary")), F.lit(40)))
    e = edges(spark, d).withColumn("k", F.pmod(c("edge"), F.lit(40)))
    return e.join(n, "k").select(c("p_name").alias("road"), "edge", ((c("x0") + c("x1")) / 2).alias("x"), ((c("y0") + c("y1")) / 2).alias("y"))


def photo_places(spark, d):
    """The best places of a sign that names a part's street, among regions about customers."""
    regions = points(spark, d).where("point % 5 = 0").select(c("px").alias("x"), c("py").alias("y"), (20.0 + c("point") % 60).alias("r"), F.lit(0.01).alias("p"))
    matches = likened(spark, d).select("name", "road", "score")
    return rounded(photo.localized(matches, street_places(spark, d), regions, ["name"], 150.0))


put("TX-09", photo_places, None)
put("TX-12", lambda spark, d: photo.parsed(sign_lines(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", F.to_json(F.struct("streets", "houses", F.size("zones").alias("zones"), F.round("confidence", 3).alias("confidence"))).alias("document")).select("conv_id", "turn", F.get_json_object("document", "$.zones").cast("long").alias("zones"), F.get_json_object("document", "$.confidence").cast("double").alias("confidence")),
    "with l as (select conv_id, turn, unnest([0, 1, 2]) as line from conversations), k as (select *, ((conv_id + line * 3) % 10) / 10.0e0 as conf from l) select conv_id, turn, count(*) filter (where line = 2 and turn % 2 = 0) as zones, round(avg(conf), 3) as confidence from k where conf >= 0.3e0 group by 1, 2")


def routes(spark, d):
    """The shortest legal way between two places on edges, beginning 30 m along the one and ending 40 m along the other."""
    way = roads.reachable_within(edges(spark, d), legal(spark, d), edges(spark, d), 2200.0)
    return rounded(way.where("start <> edge").select("start", c("edge").alias("goal"), (c("way") - 30.0 + 40.0).alias("metres")), 4)


put("GR-06", routes, "with recursive " + RULES + """, l as (select edge, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) as len from edges), w as (select edge as start, edge, 0.0e0 as way from l union all select w.start, s.nxt, w.way + l.len from w join l on l.edge = w.edge join ok s on s.edge = w.edge where w.way + l.len <= 2200.0e0)
select start, edge as goal, round(min(way) + 10.0e0, 4) as metres from w where start <> edge group by 1, 2""", "nodes", "edges")  # fmt: skip


def resolved(spark, d):
    """Turn restrictions of ways made those of directed edges; a member that fits no edge or several drops the relation."""
    way = lambda u, v: F.least(u, v) * 100 + F.greatest(u, v)
    e = edges(spark, d).select("edge", "u", "v", way(c("u"), c("v")).alias("way"))
    # a relation per step of the graph, by the two ways and the node between them; every fifth names a node that is not there
    a, b = e.select("way", c("v").alias("via"), c("u").alias("a")), e.select(c("way").alias("to_way"), c("u").alias("via"), c("v").alias("b"))
    relations = a.join(b, "via").where("a <> b").select("way", "to_way", F.when((c("way") + c("to_way")) % 5 == 0, c("via") + 1000).otherwise(c("via")).alias("via"), F.when(c("to_way") % 3 == 0, "only").otherwise("no").alias("kind")).distinct()
    ends = e.groupBy("way", c("v").alias("via")).agg(F.count("*").alias("n"), F.min("edge").alias("from_edge")).where("n = 1").drop("n")
    starts = e.groupBy(c("way").alias("to_way"), c("u").alias("via")).agg(F.count("*").alias("n"), F.min("edge").alias("to_edge")).where("n = 1").drop("n")
    return relations.join(ends, ["way", "via"]).join(starts, ["to_way", "via"]).select("kind", "from_edge", "to_edge")


put("JN-15", resolved, """with e as (select edge, u, v, least(u, v) * 100 + greatest(u, v) as way from edges), r as (
  select distinct a.way, b.way as to_way, a.v as via, (a.way + b.way) % 5 = 0 as lost, case when b.way % 3 = 0 then 'only' else 'no' end as kind from e a join e b on b.u = a.v and b.v <> a.u)
select kind, (select edge from e where e.way = r.way and e.v = r.via) as from_edge, (select edge from e where e.way = r.to_way and e.u = r.via) as to_edge from r where not lost""", "nodes", "edges")  # fmt: skip


def built_graph(spark, d):
    """A graph from polylines in metres: corners snapped to a centimetre are its nodes, pieces its edges, both ways unless
    one way."""
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("line"), (c("s_suppkey") % 4 == 0).alias("oneway"))
    corner = lambda i: F.struct((((c("line") * 13 + i * 7) % 50) + c("line") * 0.0001).alias("x"), (((c("line") * 29 + i * 11) % 40) + i * 0.0002).alias("y"))
    p = s.select("line", "oneway", F.posexplode(F.array(*map(corner, range(4)))).alias("i", "p"))
    p = p.select("line", "oneway", "i", F.round(c("p.x") * 100).cast("long").alias("cx"), F.round(c("p.y") * 100).cast("long").alias("cy"))
    w = Window.partitionBy("line").orderBy("i")
    piece = p.withColumn("dx", F.lead("cx").over(w)).withColumn("dy", F.lead("cy").over(w)).where("dx is not null and (dx <> cx or dy <> cy)")
    both = piece.select("cx", "cy", "dx", "dy").unionByName(piece.where("not oneway").select(c("dx").alias("cx"), c("dy").alias("cy"), c("cx").alias("dx"), c("cy").alias("dy")))
    # a node is named by its place, so no order over all nodes is needed
    name = lambda x, y: F.concat(c(x), F.lit(":"), c(y))
    return both.select(name("cx", "cy").alias("u"), name("dx", "dy").alias("v"), F.hypot((c("dx") - c("cx")) / 100.0, (c("dy") - c("cy")) / 100.0).alias("length"))


put("SRC-15", lambda spark, d: rounded(built_graph(spark, d).groupBy("u").agg(F.count("*").alias("out"), F.sum("length").alias("length")), 4),
    """with p as (select s_suppkey as line, s_suppkey % 4 = 0 as oneway, i, cast(round((((s_suppkey * 13 + i * 7) % 50) + s_suppkey * 0.0001e0) * 100) as bigint) as cx, cast(round((((s_suppkey * 29 + i * 11) % 40) + i * 0.0002e0) * 100) as bigint) as cy from supplier cross join (select unnest(range(0, 4)) as i)
), q as (select *, lead(cx) over w as dx, lead(cy) over w as dy from p window w as (partition by line order by i)), g as (select * from q where dx is not null and (dx <> cx or dy <> cy)), b as (select cx, cy, dx, dy from g union all select dx, dy, cx, cy from g where not oneway)
select cast(cx as varchar) || ':' || cast(cy as varchar) as u, count(*) as out, round(sum(sqrt(pow((dx - cx) / 100.0e0, 2) + pow((dy - cy) / 100.0e0, 2))), 4) as length from b group by 1""")  # fmt: skip
