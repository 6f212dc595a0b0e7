import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions import angles, attitude, gates, geo, roads, signs
from trailweave.operators import asof, belief, islands
from trailweave.operators import roads as network


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_wrap_angle_is_half_open(spark):
    for x in (math.pi, -math.pi, 3 * math.pi):
        assert value(spark, angles.wrap_angle(F.lit(x))) == pytest.approx(math.pi)
    assert value(spark, angles.wrap_angle_deg(F.lit(-180.0))) == 180.0


def test_vincenty_round_trip_and_known_distance():
    metres, azimuth = geo.inverse_arrays(np.array([59.93]), np.array([30.36]), np.array([59.94]), np.array([30.40]))
    lat, lon = geo.direct_arrays(np.array([59.93]), np.array([30.36]), azimuth, metres)
    assert lat[0] == pytest.approx(59.94, abs=1e-9) and lon[0] == pytest.approx(30.40, abs=1e-9)
    quarter, _ = geo.inverse_arrays(np.array([0.0]), np.array([0.0]), np.array([90.0]), np.array([0.0]))
    assert quarter[0] == pytest.approx(10_001_965.729, abs=0.01)


def test_haversine_of_nothing_is_null(spark):
    assert value(spark, geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))) is None


def test_rotation_of_empty_quaternion_is_identity(spark):
    assert value(spark, attitude.rotation_matrix(F.array(*[F.lit(0.0)] * 4))) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_singular_covariance_fails_closed(spark):
    assert value(spark, gates.mahalanobis(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == math.inf


def test_zero_accuracy_with_bad_coordinates_counts_as_negative(spark):
    a = F.lit(0.0)
    assert value(spark, gates.rejection(gates.usable(F.lit(1.0), F.lit(95.0), F.lit(0.0), a), a)) == "negative_accuracy"


def test_speed_tags(spark):
    assert value(spark, roads.speed_limit_ms(F.lit("50 mph"), F.lit("primary"))) == pytest.approx(22.352)
    assert value(spark, roads.speed_limit_ms(F.lit("signals"), F.lit("motorway"))) == pytest.approx(110 / 3.6)


def test_clock_times_are_no_house_numbers(spark):
    assert value(spark, signs.house_number(F.lit("Парковка 08:00-21:00"))) is None
    assert value(spark, signs.house_number(F.lit("улица Ленина, д. 12"))) == "12"
    assert value(spark, signs.street_names(F.lit("Невский проспект 28"))) == ["невский"]


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 2.0), ("a", 3, 9.0)], "trip_id string, seq int, t double")
    right = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 6.0, 7.0)], "trip_id string, t double, x double")
    near = {r["seq"]: r["x"] for r in asof.nearest(left, right, ["trip_id"], ["x"], 1.0).collect()}
    assert near == {1: 1.0, 2: 5.0, 3: None}
    line = {r["seq"]: r["x"] for r in asof.interpolated(left, right, ["trip_id"], ["x"]).collect()}
    assert line == {1: 2.0, 2: 5.0, 3: None}


def test_open_outage_ends_with_the_trip(spark):
    rows = [("a", i, float(i), s) for i, s in enumerate(["TRUSTED", "TRUSTED", "LOST", "LOST", "LOST"])]
    out = islands.outages(spark.createDataFrame(rows, "trip_id string, seq int, t double, state string")).collect()
    assert [(r["start_s"], r["end_s"], r["state"]) for r in out] == [(2.0, 4.0, "LOST")]


def test_weights_that_are_none_become_equal(spark):
    d = spark.createDataFrame([("a", 1, 0, 0.0, -1.0), ("a", 2, 0, 0.0, float("nan"))], "trip_id string, i int, edge int, s double, w double")
    assert [r["w"] for r in belief.normalized(d).collect()] == [0.5, 0.5]


def test_far_points_find_the_nearest_road(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 100.0, 0.0, "primary"), (2, 1, 0, 100.0, 0.0, 0.0, 0.0, "primary")], "edge long, u long, v long, x0 double, y0 double, x1 double, y1 double, highway string")
    points = spark.createDataFrame([(1, 50.0, 10.0), (2, 5000.0, 0.0), (3, None, None)], "point long, px double, py double")
    found = {(r["point"], r["edge"]): r["offset"] for r in network.nearest(points, edges, 1, 30.0).collect()}
    assert found == {(1, 1): 10.0, (2, 1): 4900.0}


def test_only_rules_restrict_and_no_rules_remove(spark):
    steps = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (4, 6)], "edge long, next long")
    rules = spark.createDataFrame([("no", 1, 2), ("only", 4, 5)], "kind string, edge long, next long")
    assert sorted(map(tuple, network.allowed(steps, rules).collect())) == [(1, 3), (4, 5)]
