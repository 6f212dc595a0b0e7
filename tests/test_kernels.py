"""Kernels and matches that SQL does not express, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import matching, motion, photo, roads, signals
from trailweave.plans import places


def test_names_meet_all_that_are_alike(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 7)))
    names = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    roads_ = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    got = {(r["name"], r["road"]): r["score"] for r in photo.matched(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in roads_], "road string")).collect()}
    want = {(a, b): photo.similarity(a, b) for a, b in itertools.product(set(names), set(roads_))}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.6} and len(got) > 10
    assert photo.similarity("main", "main") == 1 and photo.similarity("", "a") == 0 and photo.similarity("green stret", "green street") == pytest.approx((1 + 10 / 11) / 2)


def test_photo_places_equal_all_pairs(spark, sf):
    got = sorted((r["name"], r["edge"], r["rank"]) for r in places.QUERIES["TX-09"][0](spark, sf).collect())
    at = [r.asDict() for r in places.street_places(spark, sf).collect()]
    regions = [((r["px"], r["py"]), 20.0 + r["point"] % 60) for r in places.points(spark, sf).where("point % 5 = 0").collect()]
    prior = {(p["road"], p["edge"]): 0.01 * sum(math.hypot(p["x"] - x, p["y"] - y) <= 150 + r for (x, y), r in regions) for p in at}
    score = {}
    for m in places.likened(spark, sf).collect():
        for (road, edge), w in prior.items():
            if road == m["road"] and w > 0:
                score[m["name"], edge, round(w, 6)] = max(score.get((m["name"], edge, round(w, 6)), 0), m["score"])
    by_name = {}
    for (name, edge, w), s in score.items():
        by_name.setdefault(name, []).append((-round(s * w, 6), edge))
    want = [(n, e, i) for n, some in by_name.items() for i, (_, e) in enumerate(sorted(some)[:5], 1)]
    assert len(got) == len(want) and {g[:2] for g in got} == {w[:2] for w in want}


def chain(spark, n):
    rows = [(i, i, i + 1, 10.0 * i, 0.0, 10.0 * i + 10, 0.0, "primary") for i in range(n)]
    return spark.createDataFrame(rows, "edge long, u long, v long, x0 double, y0 double, x1 double, y1 double, highway string")


def test_reach_is_bounded_by_metres_alone(spark):
    edges = chain(spark, 16)
    got = roads.reachable_within(edges, roads.successors(edges), edges.where("edge = 0"), 2200.0).collect()
    assert sorted((r["edge"], r["way"]) for r in got) == [(i, 10.0 * i) for i in range(16)]


def trip(spark, rows):
    return spark.createDataFrame(rows, "trip_id long, seq long, dt double, a double, w double, east double, north double, acc double, speed double")


def test_filter_follows_a_straight_line_and_grows_unsure_without_fixes(spark):
    rows = [(1, i, 1.0, 0.0, 0.0, 10.0 * i if i < 30 else None, 0.0 if i < 30 else None, 5.0, 10.0 if i < 30 else None) for i in range(60)]
    got = motion.dead_reckoned(trip(spark, rows)).orderBy("seq").collect()
    assert abs(got[29]["east"] - 290) < 1 and abs(got[59]["east"] - 590) < 15 and abs(got[59]["north"]) < 5
    sigma = [r["sigma"] for r in got]
    assert all(b > a for a, b in zip(sigma[30:], sigma[31:], strict=False)) and sigma[29] < 5 < sigma[59]


def test_filter_turns_with_the_yaw_rate(spark):
    w = math.pi / 2 / 20  # a quarter turn in twenty seconds at ten metres a second
    r = 10 / w
    truth = [(r * math.sin(w * i), r * (1 - math.cos(w * i))) for i in range(21)]
    rows = [(2, i, 1.0, 0.0, w, x if i < 12 else None, y if i < 12 else None, 3.0, 10.0 if i < 12 else None) for i, (x, y) in enumerate(truth)]
    last = motion.dead_reckoned(trip(spark, rows)).where("seq = 20").first()
    assert math.hypot(last["east"] - truth[20][0], last["north"] - truth[20][1]) < 12


def test_leaky_sum_and_thinning_on_odd_trips(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 1.0, 2.0), (1, 2, 100.0, 1.0), (2, 0, 5.0, 1.0)], "trip_id long, n long, t double, v double")
    got = {(r["trip_id"], r["n"]): r["leaky"] for r in motion.leaky(rows, "v", 4.0).collect()}
    assert got == {(1, 0): 0.0, (1, 1): pytest.approx(2.0), (1, 2): pytest.approx(2.0 * math.exp(-1) + 4.0), (2, 0): 0.0}
    kept = motion.thinned(spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 0.5, 1.0, 1.0, 2.5, 3.4])], "trip_id long, seq long, t double"), 1.0)
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 4]
    assert motion.leaky(rows.where("false"), "v", 4.0).collect() == []


def test_gaussian_mirrors_its_ends(spark):
    x = np.random.default_rng(1).normal(size=30)
    got = [r["smooth"] for r in motion.gaussian(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "trip_id long, n long, v double"), "v", 1.5).orderBy("n").collect()]
    k = np.exp(-0.5 * (np.arange(-4, 5) / 1.5) ** 2)
    assert got == pytest.approx(np.convolve(np.pad(x, 4, mode="reflect"), k / k.sum(), "valid"))


def test_random_words_equal_the_recurrence(spark):
    seed, stream = 42, signals.STREAM
    inc, mask, state, want = (stream << 1) | 1, 2**64 - 1, 0, []

    def step():
        nonlocal state
        old, state = state, (state * signals.MULTIPLIER + inc) & mask
        mixed = (((old >> 18) ^ old) >> 27) & 0xFFFFFFFF
        turn = old >> 59
        return ((mixed >> turn) | (mixed << (-turn & 31))) & 0xFFFFFFFF

    step()
    state = (state + seed) & mask
    step()
    want = [step() for _ in range(400)]
    got = [r["w"] for r in spark.range(400).select("id", signals.random_words(F.col("id"), seed).alias("w")).orderBy("id").collect()]
    assert got == want
    u = [r["u"] for r in spark.range(200).select("id", signals.uniform(F.col("id"), seed).alias("u")).orderBy("id").collect()]
    assert u == [((want[2 * i] << 32 | want[2 * i + 1]) >> 11) / 2**53 for i in range(200)]


def test_spectra_equal_a_plain_transform(spark):
    rng = np.random.default_rng(2)
    t, x = np.arange(300) / 50.0, rng.normal(size=300) + np.sin(np.arange(300))
    rows = [(1, float(a), float(b)) for a, b in zip(t, x, strict=True)] + [(2, float(a), 1.0) for a in t[:50]]
    got = signals.spectra(spark.createDataFrame(rows, "trip_id long, t double, v double"), ["v"]).orderBy("t").collect()
    assert [r["trip_id"] for r in got] == [1] * len(range(0, 300 - 128, 25))
    for r, s in zip(got, range(0, 300 - 128, 25), strict=True):
        part = (x[s : s + 128] - x[s : s + 128].mean()) * np.hanning(128)
        freq = np.arange(65) / np.median(np.diff(t)) / 128
        power = np.array([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(128) / 128))) ** 2 for k in range(65)])
        want = [math.log(power[(freq >= a) & (freq < b)].sum() + 1e-12) for a, b in signals.BANDS] + [math.log(power.sum() + 1e-12)]
        assert r["features"] == pytest.approx(want, rel=1e-6, abs=1e-6) and r["t"] == t[s + 64]


def test_hull_holds_all_points(spark):
    rng = random.Random(3)
    square = [(1, x, y) for x in (0.0, 4.0) for y in (0.0, 3.0)] + [(1, rng.uniform(0, 4), rng.uniform(0, 3)) for _ in range(50)] + [(2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0)]
    got = {r["trip_id"]: r["area"] for r in signals.hull_area(spark.createDataFrame(square, "trip_id long, x double, y double")).collect()}
    assert got == {1: pytest.approx(12.0), 2: 0.0, 3: 0.0}


def test_step_derivatives_are_those_of_differences():
    v, psi, a, w, dt = 12.0, 0.7, 0.4, 0.05, 1.0

    def moved(v, psi, ba, bw):
        step, middle = v * dt + 0.5 * (a - ba) * dt * dt, psi + 0.5 * (w - bw) * dt
        return np.array([step * math.cos(middle), step * math.sin(middle)])

    step, middle, h = v + 0.5 * a, psi + 0.5 * w, 1e-6
    c, s = math.cos(middle), math.sin(middle)
    want = np.array([[c, -step * s, -0.5 * c, 0.5 * step * s], [s, step * c, -0.5 * s, -0.5 * step * c]])
    x = [v, psi, 0.0, 0.0]
    got = np.stack([(moved(*[q + h * (k == i) for k, q in enumerate(x)]) - moved(*[q - h * (k == i) for k, q in enumerate(x)])) / (2 * h) for i in range(4)], axis=1)
    assert got == pytest.approx(want, abs=1e-6)


def test_matching_finds_the_likeliest_walk(spark):
    rng = random.Random(4)
    edges = list(range(5))
    way = {(a, b): rng.uniform(0, 300) for a in edges for b in edges if a != b and rng.random() < 0.8}
    fixes = [(1, i, float(i), rng.uniform(20, 200), some, [rng.uniform(0, 50) for _ in some], [rng.uniform(0, 60) for _ in some]) for i in range(6) for some in [sorted(rng.sample(edges, 3))]]
    rows = spark.createDataFrame(fixes, "trip_id long, seq long, t double, step double, edges array<long>, s array<double>, offsets array<double>")
    ways = spark.createDataFrame([(a, b, w) for (a, b), w in way.items()], "start long, edge long, way double")
    got = [r["edge"] for r in matching.matched(rows, ways).orderBy("seq").collect()]

    def score(walk):
        total = 0.0
        for i, k in enumerate(walk):
            _, _, _, step, some, s, off = fixes[i]
            total -= 0.5 * (off[k] / 15.0) ** 2
            if i:
                e0, s0, e1, s1 = fixes[i - 1][4][walk[i - 1]], fixes[i - 1][5][walk[i - 1]], some[k], s[k]
                road = s1 - s0 if e0 == e1 and s1 >= s0 else way.get((e0, e1), math.inf) - s0 + s1
                total -= abs(road - step) / 40.0
        return total

    best = max(itertools.product(range(3), repeat=6), key=score)
    assert got == [fixes[i][4][k] for i, k in enumerate(best)]
    # without any way between edges each fix stands for itself
    alone = [r["edge"] for r in matching.matched(rows, ways.where("false")).orderBy("seq").collect()]
    assert len(alone) == 6


def test_attitude_levels_to_gravity(spark):
    rows = [(1, i, 0.1, 0.0, 0.0, 0.0, 0.3, -0.2, 0.93) for i in range(400)]
    last = matching.mahony(spark.createDataFrame(rows, "trip_id long, n long, dt double, gx double, gy double, gz double, ax double, ay double, az double")).where("n = 399").first()["q"]
    w, x, y, z = last
    up, force = np.array([2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]), np.array([0.3, -0.2, 0.93])
    assert up == pytest.approx(force / np.linalg.norm(force), abs=1e-2)


def test_monotone_curve_pools_neighbours(spark):
    rng = random.Random(7)
    data = [(float(i), i / 10 + rng.gauss(0, 1)) for i in range(60)]
    blocks = []
    for x, y in data:
        blocks.append([y, 1, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y, n, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + y * n) / (b[1] + n), b[1] + n, hi
    got = {r["x"]: r["y"] for r in matching.monotone(spark.createDataFrame(data, "k double, v double"), "k", "v").collect()}
    for y, _, lo, hi in blocks:
        assert got[lo] == pytest.approx(y) and got[hi] == pytest.approx(y)


def test_live_trust_equals_the_table(spark, sf):
    from trailweave.plans import matching as plans

    assert all(r["live"] == r["batch"] for r in plans.live_trust(spark, sf).collect())
