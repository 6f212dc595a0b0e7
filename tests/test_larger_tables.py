"""Cases that only larger tables held: ties, thresholds and sizes."""

import os

import duckdb
from oracle import same
from pyspark.sql import functions as F

from trailweave.operators import rolling
from trailweave.plans import catalog

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar"


def with_table(tmp_path, sf, name, kind, rows):
    """A folder of the tables of ``sf`` with one of its own."""
    for f in os.listdir(sf):
        if f != f"{name}.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    con = duckdb.connect()
    con.execute(f"create table t ({kind})")
    con.executemany(f"insert into t values ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"copy t to '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


def events(*rows):
    """Events (event_id, k) of one user, a minute apart."""
    return [(i, f"2024-01-01 {n // 60:02d}:{n % 60:02d}:00", 7, "view", 10.0, f'{{"k": {k}}}') for n, (i, k) in enumerate(rows)]


def test_a_window_that_stands_still_has_no_centre(spark, sf, tmp_path):
    # the third sample of the seventh fix is alone in its window and has no yaw
    d = with_table(tmp_path, sf, "events", EVENTS, events(*[(i, 3) for i in range(6)], (6, (36 - 6 * 31 - 34) % 101)))
    name = "WN-19"
    assert [r["centre"] for r in catalog.queries()[name](spark, d).where("window = 1").collect()] == [None]
    same(spark, d, catalog.queries()[name], catalog.oracle_sql()[name])


def test_a_deviation_at_a_threshold_falls_as_in_sql(spark):
    # their deviation is one exactly
    values = [1.0, 1.68, -1.68, 0.44, 1.12, 1.8, -0.32, 0.36, 1.04, -0.24]
    rows = spark.createDataFrame([(1, n, x) for n, x in enumerate(values)], "trip_id long, n long, x double")
    sd = [r["sd"] for r in rows.select("n", rolling.rolling_std("x", 5).alias("sd")).orderBy("n").collect()]
    assert sd[4] == 1.0
    assert sd == [r[0] for r in duckdb.sql(f"select stddev_pop(x) over (order by n rows between 5 preceding and 5 following) from (select unnest(range(10)) as n, unnest({values}) as x) order by n").fetchall()]


def test_a_turn_of_just_the_limit_falls_as_in_sql(spark, sf, tmp_path):
    # courses of k * 3.6 + value, 60 degrees apart two by two
    pairs = [(78, 44.14), (88, 68.14), (31, 78.16), (7, 104.56), (42, 40.47), (15, 77.67), (15, 76.08), (2, 62.88)]
    rows = [(n, f"2024-01-01 00:{n:02d}:00", 7, "view", value, f'{{"k": {k}}}') for n, (k, value) in enumerate(pairs)]
    same(spark, with_table(tmp_path, sf, "events", EVENTS, rows), catalog.queries()["FL-06"], catalog.oracle_sql()["FL-06"])


def test_sides_that_cancel_point_as_in_sql(spark, sf, tmp_path):
    # in order of time their rounding errors add up to another sign than in that of SQL, which tells -pi from pi
    pairs = [(104111, 48), (105600, 27), (107110, 3), (107546, 1), (108017, 37), (111369, 44), (115884, 11), (118029, 86), (120125, 19), (121167, 0), (122925, 48), (122970, 65), (123722, 18), (124273, 92), (126796, 60), (128164, 4), (134611, 30), (139044, 88), (140611, 81), (143819, 0), (148219, 31), (148225, 35), (148856, 10), (150066, 57), (150638, 74), (151210, 24), (156110, 68), (160198, 21), (161534, 45), (162002, 50), (162049, 0), (163157, 94), (163428, 75), (164317, 33), (165919, 22), (167970, 48), (168120, 11), (168788, 25), (169048, 45), (170551, 52), (172652, 6), (175812, 96), (177923, 31), (177931, 76), (178835, 95), (180618, 91), (184655, 19), (186669, 96), (187065, 32), (190118, 44), (190433, 48), (191445, 42), (195270, 54), (196541, 99), (197263, 0), (198913, 2)]
    d = with_table(tmp_path, sf, "events", EVENTS, events(*pairs))
    assert catalog.queries()["WN-31"](spark, d).first()["measured"] == 3.14159
    same(spark, d, catalog.queries()["WN-31"], catalog.oracle_sql()["WN-31"])


def test_zones_of_many_conversations_are_read(spark, sf, tmp_path):
    rows = [(n, turn, "user", "text") for n in (0, 8999, 9000, 99000, 1234567) for turn in range(3)]
    d = with_table(tmp_path, sf, "conversations", "conv_id bigint, turn bigint, role varchar, text varchar", rows)
    same(spark, d, catalog.queries()["TX-04"], catalog.oracle_sql()["TX-04"])
