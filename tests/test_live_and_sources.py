import json
import zipfile

from trailweave.operators.trust import histories
from trailweave.plans.views import fixes
from trailweave.sources import graphml, logs, trips
from trailweave.streaming import live


def test_trust_machine(spark):
    ok = [1, 1, 1, 1, 0, 1, 0, 0, 0, 1]
    rows = [(1, i, float(i), bool(x)) for i, x in enumerate(ok)] + [(1, 10, 30.0, True)]
    got = [r["state"] for r in histories(spark.createDataFrame(rows, "trip_id long, seq int, t double, accepted boolean")).orderBy("seq").collect()]
    assert got == ["RECOVERING"] * 3 + ["TRUSTED", "SUSPECT", "RECOVERING", "LOST", "LOST", "LOST", "RECOVERING", "RECOVERING"]


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = fixes(spark, sf).selectExpr("trip_id", "cast(seq as int) as seq", "t", "good as accepted")
    batch.selectExpr("trip_id", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "t", "accepted").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trip_id long, ts timestamp, t double, accepted boolean").parquet(str(tmp_path / "in"))
    q = live.trust(stream, gap=5.0).writeStream.format("memory").queryName("trusted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted((r["trip_id"], r["t"], r["state"]) for r in spark.table("trusted").where("not late").collect())
    finally:
        q.stop()
    assert got == sorted((r["trip_id"], r["t"], r["state"]) for r in histories(batch).collect())


def test_logger_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("lon,timestamp_ms,lat,speed,course,extra\n30,1,59,2,nan,x\n30,x,59,2,3,x\n200,3,59,1,1,x\n30,4")
    assert [(r["timestamp_ms"], r["course"]) for r in logs.gps(spark, str(tmp_path / "g.csv")).collect()] == [(1.0, None)]
    (tmp_path / "n.txt").write_text("$GPGGA,123519.50,4807.038,N,01131.000,E,1,08,0.9,545.4,M,,\n$GPRMC,1\n")
    assert [tuple(r) for r in logs.gga(spark, str(tmp_path / "n.txt")).collect()] == [(45319.5, 1, 8, 0.9)]
    lines = [json.dumps({"type": "location", "monotonic_time": 1.0, "latitude": 59.0}), "", json.dumps({"type": "motion", "monotonic_time": 2.0}), json.dumps({"type": "x"}), '{"type": "loc']
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    located, moved, report = logs.samples(spark, str(tmp_path / "s.jsonl"))
    assert located.count() == moved.count() == 1 and {r["kind"]: r["n"] for r in report.collect()} == {"location": 1, "motion": 1, "unknown": 1, "malformed": 1}


def test_trip_packages(spark, tmp_path):
    fix = json.dumps({"type": "location", "monotonic_time": 1.0, "latitude": 59.0, "longitude": 30.0})
    packs = {
        "a.zip": {"samples.jsonl": f"{fix}\n" + json.dumps({"type": "motion", "monotonic_time": 2.0}) + "\n\n{", "metadata.json": "{}", "photos/p.json": "x"},
        "b.geotrace": {"trip/samples.jsonl": fix, "trip/reference.jsonl": f"{fix}\n{fix}"}, "c.zip": {"../samples.jsonl": fix}, "d.zip": {"deep/er/samples.jsonl": fix},
    }
    for name, members in packs.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members.items():
                z.writestr(member, text)
    (tmp_path / "e.zip").write_bytes(b"no archive")
    fixes, motion, reference, about = trips.load_packages(spark, str(tmp_path))
    assert sorted(r["package"] for r in fixes.collect()) == ["a.zip", "b.geotrace"]
    assert motion.count() == about.count() == 1 and [r["package"] for r in reference.collect()] == ["b.geotrace"] * 2
    refused = trips.unpacked(spark, str(tmp_path)).where("part = 'refused'")
    assert sorted(r["package"] for r in refused.collect()) == ["c.zip", "d.zip", "e.zip"]


def test_graph_file_of_another_writer(spark, tmp_path):
    keys = '<key id="d9" for="node" attr.name="x" /><key id="d2" for="node" attr.name="y" /><key id="d4" for="edge" attr.name="geometry" /><key id="d1" for="edge" attr.name="highway" />'
    nodes = '<node id="5"><data key="d2">59.5</data><data key="d9">30.5</data></node>\n<node id="6"><data key="d9">30.6</data><data key="d2">59.6</data></node>'
    edges = '<edge source="5" target="6" id="0"><data key="d1">a &amp; b</data></edge><edge source="6" target="5" id="0"><data key="d4">LINESTRING (30.6 59.6, 1 2,30.5 59.5)</data></edge>'
    (tmp_path / "g.graphml").write_text(f'<?xml version="1.0"?><graphml>{keys}<graph edgedefault="directed">{nodes}{edges}</graph></graphml>')
    found, streets, rules = graphml.read(spark, str(tmp_path / "g.graphml"))
    assert found.count() == 2 and rules.count() == 0
    got = sorted((r["u"], r["i"], r["x"], r["y"], r["highway"]) for r in streets.collect())
    assert got == [(5, 0, 30.5, 59.5, "a & b"), (5, 1, 30.6, 59.6, "a & b"), (6, 0, 30.6, 59.6, None), (6, 1, 1.0, 2.0, None), (6, 2, 30.5, 59.5, None)]
