"""Spatial joins and traversals over a road graph: edges (edge, u, v, x0, y0, x1, y1, highway), one straight piece each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.angles import wrap_angle
from trailweave.functions.roads import class_rank

from .lineage import cut


def length() -> Column:
    return F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def bearing() -> Column:
    return F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))


def projection(px: Column, py: Column) -> tuple[Column, Column]:
    """Way along the piece to the foot of a point, and the point's distance from it."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = ((px - F.col("x0")) * dx + (py - F.col("y0")) * dy) / (dx * dx + dy * dy)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return along * F.hypot(dx, dy), F.hypot(px - F.col("x0") - along * dx, py - F.col("y0") - along * dy)


def within(points: DataFrame, edges: DataFrame, radius: float, cell: float = 250.0) -> DataFrame:
    """Pairs of points (point, px, py) and edges not farther than ``radius``: an equi join on grid cells.

    An edge is entered in each cell that its bounding box, widened by the radius, touches; a point lies in one cell, so
    each pair meets once.
    """
    lo = lambda a, b: F.floor((F.least(a, b) - radius) / cell)
    hi = lambda a, b: F.floor((F.greatest(a, b) + radius) / cell)
    e = edges.withColumn("cx", F.explode(F.sequence(lo(F.col("x0"), F.col("x1")), hi(F.col("x0"), F.col("x1")))))
    e = e.withColumn("cy", F.explode(F.sequence(lo(F.col("y0"), F.col("y1")), hi(F.col("y0"), F.col("y1")))))
    p = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    s, offset = projection(F.col("px"), F.col("py"))
    return p.join(e, ["cx", "cy"]).withColumn("s", s).withColumn("offset", offset).where(F.col("offset") <= radius).drop("cx", "cy")


def nearest(points: DataFrame, edges: DataFrame, k: int, radius: float) -> DataFrame:
    """The ``k`` nearest edges within the radius, else the nearest of all: point, edge, s, offset, rank.

    Points without an edge in reach look again in circles four times as wide until each has one.
    """
    rank = Window.partitionBy("point").orderBy(F.round("offset", 6), "edge")  # twins of one street tie
    cols = ["point", "edge", "s", "offset", "rank"]
    found = cut(within(points, edges, radius).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(cols))
    box = edges.agg(F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1")), F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1"))).first()
    rest = cut(points.where("px is not null and py is not null").join(found.select("point").distinct(), "point", "left_anti"))
    while box[0] is not None and not rest.isEmpty():
        radius *= 4
        more = cut(within(rest, edges, radius, cell=radius).withColumn("rank", F.row_number().over(rank)).where("rank = 1").select(cols))
        found, rest = found.unionByName(more), cut(rest.join(more.select("point"), "point", "left_anti"))
    return found


def at(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Points and bearings of places (edge, s) on their edges; s is kept on the edge."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / length()))
    d = places.join(edges, "edge")
    return d.select(*places.columns, (F.col("x0") + share * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + share * (F.col("y1") - F.col("y0"))).alias("y"), bearing().alias("bearing"))


def twins(edges: DataFrame) -> DataFrame:
    """The edge that leads back, the least of them if several: edge, twin."""
    back = edges.groupBy(F.col("v").alias("bu"), F.col("u").alias("bv")).agg(F.min("edge").alias("twin"))
    return edges.join(back, (F.col("u") == F.col("bu")) & (F.col("v") == F.col("bv"))).select("edge", "twin")


def successors(edges: DataFrame, u_turns: bool = False) -> DataFrame:
    """edge, next: the edges that begin where an edge ends, without the way back."""
    b = edges.select(F.col("edge").alias("next"), F.col("u").alias("nu"), F.col("v").alias("nv"))
    d = edges.join(b, F.col("v") == F.col("nu"))
    return (d if u_turns else d.where(F.col("nv") != F.col("u"))).select("edge", "next")


def allowed(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """``steps`` (edge, next) under turn rules (kind, edge, next): "no" takes a step away, "only" leaves just those it names."""
    no = rules.where("kind = 'no'").select("edge", "next")
    only = rules.where("kind = 'only'").select("edge", "next")
    left = steps.join(no, ["edge", "next"], "left_anti")
    free = left.join(only.select("edge").distinct(), "edge", "left_anti")
    return free.unionByName(left.join(only, ["edge", "next"], "left_semi"))


def turns(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Signed angle of each step."""
    a = edges.select("edge", bearing().alias("b0"), F.col("highway").alias("h0"))
    b = edges.select(F.col("edge").alias("next"), bearing().alias("b1"), F.col("highway").alias("h1"))
    return steps.join(a, "edge").join(b, "next").select("edge", "next", wrap_angle(F.col("b1") - F.col("b0")).alias("turn"), "h0", "h1")


def class_prior(steps: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Log prior of staying on a road of no lower class; ``steps`` as ``turns`` gives them."""
    return steps.withColumn("prior", -penalty * F.greatest(F.lit(0.0), class_rank(F.col("h0")) - class_rank(F.col("h1"))))


def reachable(steps: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, edge, hops: edges reached in at most ``hops`` steps, with the fewest."""
    found = starts.select(F.col("edge").alias("start"), "edge", F.lit(0).alias("hops"))
    front = found
    for h in range(1, hops + 1):
        front = front.select("start", "edge").join(steps, "edge").select("start", F.col("next").alias("edge")).distinct()
        front = cut(front.join(found, ["start", "edge"], "left_anti").withColumn("hops", F.lit(h)))
        found = found.unionByName(front)
    return found


def reachable_within(edges: DataFrame, steps: DataFrame, starts: DataFrame, budget: float) -> DataFrame:
    """start, edge, way, first: edges whose beginning lies within ``budget`` metres, the shortest way and its first edge.

    Each round carries only the ways that it shortened, until none is left; the budget ends that.
    """
    long = edges.select("edge", length().alias("len"))
    best = starts.join(long, "edge").select(F.col("edge").alias("start"), "edge", F.lit(0.0).alias("way"), F.lit(None).cast("long").alias("first"), "len")
    front = best
    while True:
        ahead = front.join(steps, "edge").where(F.col("way") + F.col("len") <= budget)
        ahead = ahead.select("start", F.col("next").alias("edge"), (F.col("way") + F.col("len")).alias("way"), F.coalesce("first", F.col("next")).alias("first"))
        ahead = ahead.groupBy("start", "edge").agg(F.min(F.struct("way", "first")).alias("b")).select("start", "edge", "b.way", "b.first").join(long, "edge")
        old = best.select("start", "edge", F.col("way").alias("old"))
        front = ahead.join(old, ["start", "edge"], "left").where(F.col("old").isNull() | (F.col("way") < F.col("old"))).drop("old")
        front = cut(front)
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("start", "edge").agg(F.min(F.struct("way", "first", "len")).alias("b")).select("start", "edge", "b.way", "b.first", "b.len"))
    return best.drop("len")


def clipped(edges: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Edges with both ends within the radius."""
    near = lambda a, b: F.hypot(F.col(a) - x, F.col(b) - y) <= radius
    return edges.where(near("x0", "y0") & near("x1", "y1"))


def inside(px: Column, py: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies strictly inside a ring, by the crossings of a ray."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 == y1:
            continue
        hit = ((F.lit(y0) > py) != (F.lit(y1) > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def in_zones(points: DataFrame, corners: DataFrame, cell: float = 100.0) -> DataFrame:
    """points (x, y, ...) with the zone (zone, place, x, y of its corners, the last equal to the first) that holds each.

    A zone is entered under the grid cells of its bounding box; a point in one of them is inside if a ray from it to the
    right crosses an odd number of sides.
    """
    zones = corners.groupBy("zone").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), *[f(a).alias(f"{n}{a}") for a in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda a: F.sequence(F.floor(F.col(f"lo{a}") / cell), F.floor(F.col(f"hi{a}") / cell))
    zones = zones.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y"))).select("zone", "ring", "cx", "cy")
    met = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(zones, ["cx", "cy"])

    def crosses(i):
        a, b = F.get(F.col("ring"), i), F.get(F.col("ring"), i + 1)
        level = (a["y"] > F.col("y")) != (b["y"] > F.col("y"))
        return F.when(level & (F.col("x") < (b["x"] - a["x"]) * (F.col("y") - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0)

    sides = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), crosses), F.lit(0), lambda n, x: n + x)
    return met.where(sides % 2 == 1).drop("cx", "cy", "ring")


def grid(columns: int, rows: int, spacing: float):
    """A street grid for trials: both directions of each side, as a function of the session."""

    def build(spark) -> DataFrame:
        n = spark.range(columns * rows).select(F.floor(F.col("id") / rows).alias("i"), (F.col("id") % rows).alias("j"))
        to = n.select("i", "j", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s"))
        to = to.select("i", "j", (F.col("i") + F.col("s.a")).alias("k"), (F.col("j") + F.col("s.b")).alias("m")).where(F.col("k").between(0, columns - 1) & F.col("m").between(0, rows - 1))
        return to.select((F.col("i") * rows + F.col("j")).alias("u"), (F.col("k") * rows + F.col("m")).alias("v"), (F.col("i") * spacing).alias("x0"), (F.col("j") * spacing).alias("y0"), (F.col("k") * spacing).alias("x1"), (F.col("m") * spacing).alias("y1"))

    return build
