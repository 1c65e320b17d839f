"""Checks, states, graph walks, chunks, retention, alarms and reports."""

import pytest
from fixtures import NOW, machine, make
from pyspark.sql import functions as F
from twinloom import functions as fn
from twinloom.operators import checks, diagnosis, graph, merging, series, states
from twinloom.plans import check_rows, parse_check


@pytest.fixture(scope="module")
def checked(spark):
    entities = [("Motor", "MotorOK", {"spec.current.max": "10", "spec.current.unit": "A"}), ("Motor", "MotorBad", {"spec.current.max": "10"}), ("Motor", "MotorNoSpec", {"spec.current.max": "ten"}), ("Motor", "MotorNoSeries", {"spec.current.max": "10"})]
    points = {"MotorOK.current": [(NOW - 600, 9.0), (NOW - 300, 10.0)], "MotorBad.current": [(NOW - 600, 8.0), (NOW - 300, 12.5)], "MotorNoSpec.current": [(NOW - 300, 5.0)]}
    return make(spark, entities, points=points)


def test_statuses(checked):
    got = {r["entity"]: (r["status"], r["observed"], r["deviation"], r["points_checked"]) for r in checks.checked(checked, checked.entities, "current", NOW - 3600, NOW).collect()}
    assert got == {"MotorOK": ("OK", 10.0, 0.0, 2), "MotorBad": ("VIOLATION", 12.5, 2.5, 2), "MotorNoSpec": ("NO_SPEC", 5.0, None, 1), "MotorNoSeries": ("NO_DATA", None, None, 0)}


def test_statement_fields(checked):
    q = parse_check("CHECK m.current FOR (m:Motor) WHERE m.name < 'MotorNoT' DURING last(1h) RETURN status, expected, observed, deviation, entity, unit, points", NOW)
    rows = {r["f_entity"]: tuple(r[f"f_{f}"] for f in q.fields if f != "entity") for r in check_rows(checked, q).collect()}
    assert rows["MotorBad"] == ("VIOLATION", "10", "12.5", "2.5", "-", "2")
    assert rows["MotorNoSpec"] == ("NO_SPEC", "-", "5", "-", "-", "1") and rows["MotorNoSeries"] == ("NO_DATA", "10", "-", "-", "-", "0")
    assert check_rows(checked, parse_check("CHECK x.current FOR (m:Motor) DURING last(1h) RETURN status", NOW)).count() == 0


def test_points_above_bounds(checked):
    assert [(r["entity"], r["v"]) for r in checks.violations(checked, "current").collect()] == [("MotorBad", 12.5)]


def test_report(spark):
    twin = machine(spark, {"spec.current.max": "10", "spec.vibration.max": "5.0"}, {"Motor42.current": [(NOW - 1200, 8.0), (NOW - 600, 12.5)], "Motor42.vibration": [(NOW - 1200, 2.0), (NOW - 600, 3.0)], "Pump17.pressure": [(NOW - 600, 1.5)]})
    r = diagnosis.diagnose(twin, "Motor42", NOW - 1800, NOW)
    assert r["component"]["type_name"] == "Motor" and [m["signal"] for m in r["measurements"]] == ["current", "vibration"]
    assert [(c["signal"], c["status"]) for c in r["checks"]] == [("current", "VIOLATION"), ("vibration", "OK")]
    assert [a["deviation"] for a in r["anomalies"]] == [2.5] and r["causal_paths"][0]["upstream"] == ["Drive12"] and r["causal_paths"][0]["confidence"] == 0.5
    assert [(t["topology"], t["edge_count"]) for t in r["topology"]] == [("electrical", 1), ("mechanical", 1)] and r["events"] == []
    empty = diagnosis.diagnose(twin, "nobody", 0, 1)
    assert empty["component"] is None and empty["checks"] == []


def test_dotted_entity_names(spark):
    twin = make(spark, [("Line", "Line1", {}), ("Motor", "Line1.MotorM", {"spec.vib.max": "1"})], points={"Line1.MotorM.vib": [(5, 2.0)]})
    assert [r["signal"] for r in checks.measurements(twin, "Line1", 0, 9).collect()] == ["MotorM.vib"]
    assert [r["entity"] for r in checks.anomalies(twin, 0, 9).collect()] == ["Line1.MotorM"]


def test_state_intervals(spark):
    writes = [("Motor42", "state", "STOPPED", 100), ("Motor42", "state", "RUNNING", 200), ("V1", "pos", "OPEN", 300), ("V1", "pos", "CLOSING", 100), ("Motor42", "state", "OVERLOAD", 300), ("T", "k", "no", 7), ("T", "k", "yes", 7), ("T", "k", "last", 7)]
    twin = make(spark, states=writes)
    history = lambda e, k: [tuple(r) for r in states.history(twin, e, k).collect()]
    assert history("Motor42", "state") == [("STOPPED", 100, 200), ("RUNNING", 200, 300), ("OVERLOAD", 300, -1)]
    assert history("V1", "pos") == [("OPEN", 300, 100), ("CLOSING", 100, -1)]
    at = lambda e, t: [r["value"] for r in states.at(twin, t).where(F.col("entity") == e).collect()]
    assert at("Motor42", 250) == ["RUNNING"] and at("Motor42", 200) == ["RUNNING"] and at("Motor42", 300) == ["OVERLOAD"] and at("Motor42", 99) == []
    assert at("V1", 299) == ["CLOSING"] and at("V1", 400) == ["CLOSING"] and at("V1", 50) == [] and at("T", 7) == ["last"]


def test_events(spark):
    twin = make(spark, events=[("a", "M", 10, 5, "x" * 30), ("b", "N", 20, 1, ""), ("c", "M", 30, 9, "é")])
    got = [(r["name"], r["provenance"], r["details"]) for r in states.events(twin, "M", 10, 30).orderBy("seq").collect()]
    assert got == [("a", "Event", "x" * 20), ("c", "Unknown", "é")] and states.events(twin, None, 11, 29).count() == 1


def test_reach_on_a_chain_and_a_cycle(spark):
    n = 12
    chain = make(spark, [("N", f"n{i}", {}) for i in range(n)], [(f"n{i}", f"n{i + 1}", "t:x", 0, -1, 0) for i in range(n - 1)] + [(f"n{n - 1}", "n0", "t:x", 0, 5, 0), ("n0", "n5", "u:y", 0, -1, 0)])
    start = graph.key_of(chain, "n0")
    hops = lambda *a, **k: {r["key"]: r["hops"] for r in graph.reach(chain, start, *a, **k).collect()}
    assert hops(100, "t") == {i: i for i in range(1, n)} and hops(2, "t") == {1: 1, 2: 2}
    assert hops(100)[11] == 7 and hops(3, out=False) == {11: 1, 10: 2, 9: 3} and hops(3, out=False, at=6) == {}


def test_trace_takes_the_earliest_of_the_shortest(spark):
    twin = make(spark, [("N", x, {}) for x in "abcde"], [("a", "c", "t:1", 0, -1, 0), ("a", "b", "t:0", 0, -1, 1), ("b", "d", "t:2", 0, -1, 0), ("c", "d", "t:3", 0, -1, 0), ("a", "b", "t:4", 0, -1, 0), ("d", "e", "t:5", 0, 1, 0)])
    path = lambda a, b, hops=6: [r["path"] for r in graph.trace(twin, graph.key_of(twin, a), graph.key_of(twin, b), hops).collect()]
    assert path("a", "d") == [[0, 3]] and path("a", "e") == [[0, 3, 5]] and path("a", "b") == [[1]]
    assert path("a", "a") == [[]] and path("d", "a") == [] and path("a", "e", 2) == []
    steps = graph.steps(twin, graph.trace(twin, graph.key_of(twin, "a"), graph.key_of(twin, "d"))).collect()
    assert [(s["from"], s["to"], s["relation_idx"]) for s in steps] == [("a", "c", 0), ("c", "d", 3)]


def test_unknown_ends_are_shown(spark):
    twin = machine(spark)
    loose = twin.using(entities=twin.entities.where("name <> 'Pump17'"))
    assert "<key:3>" in [r["to"] for r in graph.graph_edges(loose).collect()]


def test_chunks_and_retention(spark):
    t0 = 1_700_000_000
    twin = make(spark, points={f"Machine{k:02}.load": [(t0 + 5 * i, 10 + i % 7) for i in range(512)] for k in range(5)})
    assert series.chunks(twin).count() == 10
    gone = series.expired(twin, t0 + 1920).agg(F.sum("count"), F.count(F.lit(1))).first()
    assert tuple(gone) == (5 * 256, 5) and series.retained(twin, t0 + 1920).count() == 5 * 256
    straddle = make(spark, points={"m.x": [(i, 1.0) for i in range(128)]})
    assert series.expired(straddle, 64).count() == 0
    stats = series.chunk_statistics(twin).first()
    assert (stats["count"], stats["min"], stats["max"]) == (512, 10.0, 16.0)


def test_chunks_end_with_batches(spark):
    twin = make(spark, points={"m.x": [(i, float(i)) for i in range(10)]})
    twin = twin.using(points=twin.points.withColumn("batch_id", F.col("seq").cast("int") % 2))
    assert sorted((r["batch_id"], r["chunk"], r["count"]) for r in series.chunks(twin, 3).collect()) == [(0, 0, 3), (0, 1, 2), (1, 0, 3), (1, 1, 2)]


def test_unsorted_points_are_found(spark):
    twin = make(spark, points={"m.x": [(30, 3.0), (10, 1.0), (20, 2.0), (10, 1.5)]})
    assert [tuple(r) for r in series.scan(twin, "m.x", 10, 20).collect()] == [(10, 1.0), (10, 1.5), (20, 2.0)]
    assert [(r["t"], r["v"]) for r in series.latest(twin, 0, 25).collect()] == [(20, 2.0)]


def test_crossings_and_alarms(spark):
    twin = make(spark, points={"m.x": [(1, 9.0), (2, 9.0), (3, 1.0), (4, float("nan")), (5, 8.0)], "m.y": [(1, 9.0)], "m.b": [(1, 0.0), (2, 1.0)]})
    x = twin.points.where(F.col("sid") == fn.series_id(F.lit("m.x")))
    assert [(r["t"], r["over"]) for r in series.crossings(x, 5).orderBy("t").collect()] == [(2, True), (3, False), (5, True)]
    rules = spark.createDataFrame([("m.x", "m", "high", 5.0, "I={obs}A>{thr}A", "I={obs}A<={thr}A")], "series string, entity string, name string, threshold double, detail string, detail_clear string")
    assert [(r["name"], r["ts"], r["details"]) for r in series.alarms(twin.points, rules).orderBy("ts").collect()] == [("high", 2, "I=9.0A>5.0A"), ("high_clear", 3, "I=1.0A<=5.0A"), ("high", 5, "I=8.0A>5.0A")]
    assert {r["series"]: r["discrete"] for r in series.discrete(twin, 0, 9).collect()} == {"m.x": False, "m.y": False, "m.b": True}


def test_merging(spark):
    old = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], "key int, pos int, k string, v string")
    new = spark.createDataFrame([(1, 0, "b", None), (1, 1, "a", "z"), (1, 2, "c", None), (2, 0, "d", "w")], "key int, pos int, k string, v string")
    got = [(r["key"], r["k"], r["v"]) for r in merging.merge_props(old, new).orderBy("key", "pos").collect()]
    assert got == [(1, "a", "z"), (1, "b", "y"), (1, "c", ""), (2, "d", "w")]
    live = spark.createDataFrame([(1, 2, "t", "x")], "src int, dst int, topology string, rel_type string")
    want = spark.createDataFrame([(2, 1, "t", "x"), (1, 1, "t", "x"), (1, 2, "t", "y"), (2, 1, "t", "y")], live.schema)
    assert merging.fresh_relations(live, want).count() == 1
