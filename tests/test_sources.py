"""Generators and packs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinloom.operators import checks
from twinloom.plans import bind, measure, parse_temporal
from twinloom.api import Agent
from twinloom.sources import generate, pack, payloads
from twinloom.sources.store import Store


def test_closed_form_of_the_generator():
    seed, want = 12345, []
    s = seed
    for _ in range(50):
        s = (s * generate.FACTOR + generate.STEP) % 2**64
        want.append(s)
    assert generate.states(seed, 50).tolist() == want and generate.states(seed, 10, 40).tolist() == want[40:]


def test_fleet(spark):
    twin = generate.fleet(spark, machines=3, signals=2, points=200)
    assert (twin.entities.count(), twin.relations.count(), twin.series.count(), twin.points.count()) == (12, 9, 6, 1200)
    q = parse_temporal(f"MATCH (m:Motor) MEASURE m.current DURING {generate.START}..{generate.START + 3600} RETURN count(current)", 0)
    assert [r["count"] for r in measure(twin, bind(twin, q)).collect()] == [61.0] * 3
    first = twin.points.join(twin.series.where("name = 'Motor_000001.current'"), "sid").orderBy("t").select("v").toPandas()["v"].to_numpy()
    assert np.all(np.abs(first - (4 + 6 * np.arange(200) / 199)) <= 0.4) and np.std(first - (4 + 6 * np.arange(200) / 199)) > 0.1


PACK = {
    "ts_base": 1000,
    "entities": [{"name": "EM", "type": "Motor", "props": {"spec.current.max": "3"}}, {"name": "S1", "type": "Sensor", "props": {}}],
    "relations": [{"from": "S1", "to": "EM", "type": "instrumentation:measures"}],
    "states_packbase": [{"entity": "EM", "key": "mode", "value": "AUTO", "offset_s": -60}],
    "alarm_rules": [{"name": "high", "entity": "EM", "series": "EM.current", "threshold": 3.0, "detail": "I={obs}>{thr}", "detail_clear": "I={obs}<={thr}"}],
    "demo_scenarios": [
        {"name": "calm", "ts_start": 1000, "dt_s": 10, "points_per_series": 120, "signals": {"EM.current": {"shape": "wave", "base": 2, "amp": 0.5, "noise": 0.1, "period_s": 300, "max": 2.4}, "S1.on": {"shape": "pulse", "period_s": 30, "duty": 0.4}}, "events": [{"name": "begin", "entity": "EM", "offset_s": 5, "details": "calm"}]},
        {"name": "jam", "ts_start": 5000, "dt_s": 10, "points_per_series": 101, "signals": {"EM.current": {"shape": "waypoints", "points": [[0, 2.0], [0.5, 4.0], [1, 2.0]], "dec": 2}}, "states": [{"entity": "EM", "key": "mode", "value": "JAM", "offset_s": 0}]},
    ],
}


def test_pack(spark, tmp_path):
    (tmp_path / "pack.json").write_text(json.dumps(PACK))
    twin = pack.load(spark, str(tmp_path / "pack.json"))
    assert (twin.entities.count(), twin.relations.count(), twin.states.count(), twin.points.count()) == (2, 1, 2, 341)
    status = lambda lo, hi: checks.checked(twin, twin.entities.where("name = 'EM'"), "current", lo, hi).first()
    calm, jam = status(1000, 2200), status(5000, 6000)
    assert (calm["status"], calm["observed"] <= 2.4) == ("OK", True) and (jam["status"], jam["observed"], jam["points_checked"]) == ("VIOLATION", 4.0, 101)
    assert [(r["name"], r["ts"]) for r in twin.events.orderBy("ts").collect()] == [("begin", 1005), ("high", 5260), ("high_clear", 5750)]
    on = twin.points.join(twin.series.where("name = 'S1.on'"), "sid").agg(F.collect_set("v")).first()[0]
    assert sorted(on) == [0.0, 1.0] and twin.relations.first()["valid_from"] == 1000
    found = pack.verify(twin, PACK, {"calm": {("EM", "current"): "OK"}, "jam": {("EM", "current"): "VIOLATION"}}, 1200)
    assert all(ok for _, ok, _ in found) and len(found) == 9
    assert [what for what, ok, _ in pack.verify(twin, PACK, {"calm": {("EM", "current"): "VIOLATION"}}, 1200) if not ok] == ["calm: EM.current is VIOLATION"]


def test_payloads(spark, tmp_path):
    assert payloads.ingest_call([5, 1.5], "e", "s") == ("e", "s", [(5, 1.5)])
    assert payloads.ingest_call({"entity": "a", "signal": "b", "points": [[1, 2], [3, 4]]}, "e", "s") == ("a", "b", [(1, 2.0), (3, 4.0)])
    for bad in ([5, "x"], {"entity": "a", "signal": "b", "points": []}, [1, 2, 3], None):
        with pytest.raises(ValueError):
            payloads.ingest_call(bad, "e", "s")
    agent = Agent(Store(spark, str(tmp_path)), role="ingest")
    result = payloads.gateway_reading(agent, [32, 30], "EM", "current", 1000)
    assert (result["status"], result["observed"], result["expected_max"]) == ("VIOLATION", 3.2, 3.0) and payloads.violations(result) == [result]
    assert payloads.violations(payloads.gateway_reading(agent, [28, 30], "EM", "current", 9000)) == []
