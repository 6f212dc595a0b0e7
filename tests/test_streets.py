"""Polylines, corridors, bends and evaluation against plain versions, and their queries against SQL."""

import math
import random

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from trailweave.operators import bends, corridors, curves, evaluation
from trailweave.plans import catalog

NEW = ["GR-09", "JN-10", "GR-13", "ST-11", "ST-12", "ST-23", "GR-12", "WN-34", "ST-19", "ML-01", "ML-02", "ML-09", "AG-35_tests", "SS-04", "SS-05", "SS-11", "SS-13", "SS-15"]
VERTICES = "edge long, u long, v long, i long, x double, y double, highway string"


@pytest.mark.parametrize("name", NEW)
def test_equals_sql(spark, sf, name):
    same(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])


def lines():
    rng, out = random.Random(3), []
    for edge, (n, step) in enumerate([(2, 0.9), (2, 30.0), (3, 4.0), (4, 9.0), (8, 25.0), (12, 3.0)]):
        x = y = 0.0
        for i in range(n):
            out.append((edge, edge, edge + 1, i, x, y, "primary"))
            angle = rng.uniform(-3, 3)
            x, y = x + step * math.cos(angle), y + step * math.sin(angle)
    return out


def plain_profile(points, spacing=2.0, smooth=10.0):
    """heading, kappa and sigma of one polyline, sample by sample."""
    d = np.diff(points, axis=0)
    size = np.hypot(*d.T)
    way = np.r_[0.0, np.cumsum(size)]
    n = max(2, math.ceil(round(way[-1] / spacing, 6)) + 1)
    s = np.linspace(0.0, way[-1], n)
    piece = np.clip(np.searchsorted(np.round(way, 6), np.round(s, 6), side="right") - 1, 0, len(size) - 1)
    raw = np.unwrap(np.arctan2(d[:, 1], d[:, 0]))[piece]
    sigma = smooth / spacing
    half = math.ceil(3 * sigma)
    w = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-half, half + 1)]

    def at(values, k):
        last, turn = len(values) - 1, lambda a, b: 2 * a - b
        if k < 0:
            return turn(values[0], values[min(-k, last)])
        return values[k] if k <= last else turn(values[last], values[max(2 * last - k, 0)])

    blur = lambda values: np.array([sum(g * at(values, k + j) for g, j in zip(w, range(-half, half + 1), strict=True)) / sum(w) for k in range(n)])
    if n <= 2:
        return raw, np.zeros(n), np.full(n, 0.002)
    heading = blur(raw)
    rough = blur(np.abs(raw - heading))  # turned about its ends it can fall below zero there
    return heading, np.gradient(heading, s[1]), 0.002 + 0.6 * np.where(rough < 1e-9, 0.0, rough) / smooth


def test_profile_equals_a_plain_one(spark):
    rows = lines()
    got = curves.profile(spark.createDataFrame(rows, VERTICES)).orderBy("edge", "k").collect()
    for edge in {r[0] for r in rows}:
        mine = [r for r in got if r["edge"] == edge]
        heading, kappa, sigma = plain_profile(np.array([r[4:6] for r in rows if r[0] == edge]))
        assert [r["k"] for r in mine] == list(range(len(heading)))
        for name, want in (("heading", heading), ("kappa", kappa), ("sigma", sigma)):
            assert np.allclose([r[name] for r in mine], want, atol=1e-8), (edge, name)


def test_places_and_lookups(spark):
    rows = lines()
    v = spark.createDataFrame(rows, VERTICES)
    places = spark.createDataFrame([(e, float(s)) for e in range(6) for s in (-5, 0, 1, 7, 1e6)], "edge long, s double")
    assert curves.at(v, places).count() == curves.looked_up(curves.profile(v), places).count() == 30
    ends = {r["edge"]: (r["x"], r["y"]) for r in curves.at(v, places).where("s > 1000").collect()}
    for edge, end in ends.items():
        assert np.allclose(end, [r[4:6] for r in rows if r[0] == edge][-1])
    assert curves.profile(v.limit(0)).count() == curves.at(v.limit(0), places).count() == 0


def test_gap_of_pieces(spark):
    rng = random.Random(4)
    pieces = [[rng.uniform(0, 10) for _ in range(8)] for _ in range(200)]
    names = [f"{w}{n}" for w in "ab" for n in ("x0", "y0", "x1", "y1")]
    got = [r[0] for r in spark.createDataFrame(pieces, names).select(corridors.gap("a", "b")).collect()]
    t = np.linspace(0, 1, 201)[:, None]
    for p, g in zip(pieces, got, strict=True):
        a, b = (np.array(q[:2]) + t * (np.array(q[2:]) - np.array(q[:2])) for q in (p[:4], p[4:]))
        want = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)).min()
        assert g <= want + 1e-9 and want - g < 0.1


def test_forgetful_sums(spark):
    rng, t, want, rows = random.Random(5), 0.0, 0.0, []
    for _ in range(400):
        dt, x = rng.choice([0.1, 1.0, 40.0]), rng.gauss(0, 3)
        t, want = t + dt, want * math.exp(-dt / 2.0) + x
        rows.append((1, t, x, want))
    out = bends.forgetful(spark.createDataFrame(rows, "k long, t double, x double, want double"), ["k"], "t", 2.0, got="x")
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in out.collect())


def test_turn_sequences_equal_a_search(spark):
    rng = random.Random(6)
    steps = [(e, rng.randrange(30), math.radians(rng.choice([0, 5, -20, 60, 85, -70, -95, 110]))) for e in range(30) for _ in range(3)]
    seen = [(b, rng.randrange(30), [math.radians(rng.choice([80, -80, 95, -60])) for _ in range(rng.randrange(4))]) for b in range(25)]
    near, within, sigma = math.radians(28), math.radians(35), math.radians(8)

    def search(edge, want, k, left):
        if k == len(want):
            return 0.0
        found = []
        for e, nxt, turn in steps:
            if e == edge and left:
                dz = (turn - want[k] + math.pi) % (2 * math.pi) - math.pi
                if abs(dz) <= within and turn * want[k] > 0:
                    more = search(nxt, want, k + 1, left - 1)
                    found += [] if more is None else [more - 2.5 * math.log1p((dz / sigma) ** 2 / 4)]
                elif abs(turn) < near:
                    more = search(nxt, want, k, left - 1)
                    found += [] if more is None else [more]
        return max(found, default=None)

    b = spark.createDataFrame(seen, "branch long, edge long, observed array<double>")
    t = spark.createDataFrame(steps, "edge long, next long, turn double")
    got = {r["branch"]: r["loglik"] for r in bends.sequence_scores(b, t, sigma).collect()}
    for branch, edge, want in seen:
        best = search(edge, want, 0, min(4 + 5 * len(want), 9))
        deep = got[branch]
        assert best is None or deep is not None and deep >= best - 1e-9


def test_rank_test_counts_pairs(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.randrange(6)), rng.random() < 0.4) for g in (1, 2) for _ in range(60)] + [(3, 1.0, True)]
    got = {r["g"]: r for r in evaluation.rank_test(spark.createDataFrame(rows, "g long, x double, one boolean"), ["g"], "x", F.col("one")).collect()}
    for g in (1, 2):
        a, b = ([x for h, x, one in rows if h == g and one is side] for side in (True, False))
        assert got[g]["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got[3]["z"] is None and got[3]["n2"] == 0
