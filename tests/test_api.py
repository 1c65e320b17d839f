"""Methods, roles, stored writes, JSON-RPC, HTTP and streams."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest
from fixtures import NOW, machine
from twinloom import streaming
from twinloom.__main__ import smoke
from twinloom.api import Agent, WriteForbidden
from twinloom.rpc import dispatch, http_server, serve
from twinloom.sources.store import Store


@pytest.fixture(scope="module")
def reader(spark):
    points = {"Motor42.current": [(NOW - 600, 9.0), (NOW - 300, 12.5)], "Pump17.pressure": [(NOW - 300, 183.0)]}
    twin = machine(spark, points=points, states=[("Motor42", "state", "RUNNING", 100)], events=[("start", "Motor42", 50, 5, "x")])
    return Agent(twin, clock=lambda: NOW)


def call(agent, method, params=None, **more):
    return dispatch(agent, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params} | more)


def test_inventory(reader):
    s = reader.schema()
    assert s["entity_types"] == ["Drive", "Motor", "PLC", "Pump"] and s["relation_topologies"] == ["electrical", "mechanical", "network"] and s["series"] == ["Motor42.current", "Pump17.pressure"]
    listed = reader.list_entities(limit=2)
    assert (len(listed["entities"]), listed["total"], listed["entities_in_db"], listed["truncated"]) == (2, 4, 4, True)
    assert reader.list_entities("Motor")["entities"] == [{"key": 2, "name": "Motor42", "type": "Motor"}]
    g = reader.graph(1)
    assert (g["relations_total"], g["truncated"], g["relations"][0]["relation_type"]) == (3, True, "network:profinet")
    card = reader.get_entity(2)
    assert card["properties"]["spec.current.max"] == "10" and card["relations_in"][0]["from"] == "Drive12" and card["relations_out"][0]["provenance"] == "Observation"
    assert reader.get_entity(99) == {"error": "unknown entity key 99"}
    assert [r["relation_idx"] for r in reader.provenance()["relations"]] == [0, 1, 2]


def test_queries(reader):
    got = reader.query("MATCH (d:Drive)-[:electrical]->(m:Motor) RETURN m")
    assert got["n"] == 1 and set(got["rows"][0]) == {"d", "m"} and got["rows"][0]["m"]["name"] == "Motor42"
    assert set(reader.query("MATCH (d:Drive)-[:electrical]->(m:Motor) RETURN m", project_return=True)["rows"][0]) == {"m"}
    assert reader.query("MATCH (m:Motor) RETURN m LIMIT") == {"error": "parse error: unexpected token: expected number"}
    row = reader.query_temporal("MATCH (m:Motor) MEASURE m.current DURING last(1h) RETURN max(current), count(current)")["rows"][0]
    assert row["max"] == {"kind": "Max", "value": 12.5} and row["count"]["value"] == 2.0
    assert "max" not in reader.query_temporal("MATCH (d:Drive) MEASURE d.current DURING last(1h) RETURN max(current)")["rows"][0]
    assert reader.check("Motor42", "current")["status"] == "VIOLATION" and reader.check("Pump17", "pressure")["status"] == "NO_SPEC"
    assert reader.check("X", "y") == {"error": "unknown entity 'X'"}
    m = reader.get_measurements("Motor42", "current", NOW - 400, NOW)
    assert (m["count"], m["min"], m["max"]) == (1, 12.5, 12.5) and reader.get_measurements("A", "b") == {"error": "no series named 'A.b'"}
    t = reader.trace("PLC01", "Pump17")
    assert t["found"] and t["n_hops"] == 3 and [p["name"] for p in t["path"]] == ["PLC01", "Drive12", "Motor42", "Pump17"]
    assert "n_hops" not in reader.trace("PLC01", "PLC01") and reader.trace("Pump17", "PLC01")["found"] is False
    assert reader.get_state("Motor42", "state") == {"value": "RUNNING", "valid_from": 100} and reader.get_state("Motor42", "state", 5) is None
    assert reader.get_events("Motor42")["events"][0]["provenance"] == "Event" and reader.diagnose("Motor42")["anomalies"]


def test_roles_and_audit(reader):
    with pytest.raises(WriteForbidden, match="-32003"):
        reader.ingest_points("M", "x", [(1, 1.0)])
    assert "refused" in reader.set_hypothesis("M", "why")["error"]
    entries = reader.audit()["entries"]
    assert entries[-1]["method"] == "audit_log" and any("REFUSED" in e["params_summary"] for e in entries)


def test_writes_and_reopening(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a = Agent(store, role="writer", clock=lambda: NOW)
    assert a.upsert_entity("PLC01", "PLC", [("vendor", "Siemens")]) == {"key": 0, "created": True, "relations_added": 0}
    assert a.upsert_entity("Motor42", "Motor", [], [("PLC01", "network:profinet", None)], "sensor") == {"key": 1, "created": True, "relations_added": 1}
    assert a.upsert_entity("PLC01", "Ignored", [("vendor", None), ("fw", None), ("model", "S7")], [("Motor42", "network:profinet", 5)])["relations_added"] == 0
    before = store.manifest["version"]
    for more, error in (([("X", "a:b", None)], "does not exist"), ([("Motor42", "a:b", None)], "self-relations"), ([("PLC01", "ab", None)], "must be 'topology:type'")):
        assert error in a.upsert_entity("Motor42", "Motor", [], more)["error"]
    assert "unknown source" in a.upsert_entity("Z", "Z", source="other")["error"] and "inline cap (49 > 44 bytes)" in a.upsert_entity("Z", "Z", [("k", "v" * 46)])["error"]
    assert store.manifest["version"] == before
    assert a.ingest_points("Motor42", "current", [(NOW + i, 5 + 0.1 * (i % 60)) for i in range(300)]) == {"accepted": 300, "chunks_flushed": 2, "series_id": 0}
    assert a.ingest_points("Motor42", "current", [(NOW + 300, 1.0)])["chunks_flushed"] == 1
    assert "too long" in a.ingest_points("x" * 20, "signal", [(1, 1.0)])["error"]
    a.set_state("Motor42", "state", "RUNNING", 100)
    a.set_state("Motor42", "state", "STOPPED", 200)
    a.log_event("alarm", "Motor42", 7, 261, "é" * 15)
    again = Agent(Store(spark, str(tmp_path)))
    assert again.get_entity(0)["properties"] == {"vendor": "Siemens", "fw": "", "model": "S7"} and again.get_entity(0)["type"] == "PLC"
    assert again.get_measurements("Motor42", "current")["count"] == 301 and again.state_history("Motor42", "state")["history"][0]["valid_to"] == 200
    event = again.get_events()["events"][0]
    assert (event["provenance_byte"], event["details"]) == (5, "é" * 10)
    # appended later, kept: the second batch's chunk ends after the bound
    assert a.retain(NOW + 256) == {"points_removed": 256, "chunks_removed": 1} and a.retain(NOW + 256) == {"points_removed": 0, "chunks_removed": 0}
    assert a.get_measurements("Motor42", "current")["count"] == 45 and again.get_measurements("Motor42", "current")["count"] == 301
    a.remove_relation(0)
    assert a.graph()["relations"] == [] and a.schema()["relation_topologies"] == ["network"]


def test_rpc(reader):
    assert call(reader, "entities", ["Motor", 5])["result"]["total"] == 1
    assert call(reader, "get_entity", {"key": "2"})["result"]["name"] == "Motor42"
    code = lambda *a, **k: call(reader, *a, **k)["error"]["code"]
    assert code("nothing") == -32601 and code("query") == -32602 and code("list_entities", {"limit": -1}) == -32602
    assert code("ingest_points", {"entity": "a", "signal": "b", "points": []}) == -32602 and code("ingest_points", {"entity": "a", "signal": "b", "points": [[1.5, 2]]}) == -32602
    assert code("ingest_points", {"entity": "a", "signal": "b", "points": [{"ts": 1, "value": 2}]}) == -32003 and code("log_event", ["n", "e"]) == -32003
    assert code("upsert_entity", {"name": "a", "type": "b", "relations": [["x", "nocolon"]]}) == -32602
    assert dispatch(reader, [1])["error"]["code"] == -32600 and dispatch(reader, {"id": 4})["error"]["code"] == -32600
    assert dispatch(reader, {"method": "audit"}) is None
    out = io.StringIO()
    lines = ["", "{bad", json.dumps({"id": 7, "method": "list_entities", "params": {"type": "Pump"}}), "quit", json.dumps({"id": 8, "method": "audit"})]
    assert serve(reader, lines, out) == 2
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert answers[0]["error"]["code"] == -32700 and answers[1]["id"] == 7 and answers[2]["result"] == {"bye": True}


def test_http(reader):
    server = http_server(reader, port=0, token="s3")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None, method=None, token="s3"):
        request = urllib.request.Request(base + path, None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert ask("/health") == (200, "ok agent Reader\n") and ask("/health", token="no")[0] == 401
        assert json.loads(ask("/schema")[1])["entity_types"] and ask("/other")[0] == 404 and ask("/rpc")[0] == 405
        assert ask("/rpc", method="OPTIONS")[0] == 204 and ask("/rpc", b"{")[0] == 400
        assert ask("/rpc", {"id": 1, "method": "list_entities"})[0] == 200 and ask("/rpc", {"id": 1, "method": "nothing"})[0] == 400
        assert ask("/rpc", {"id": 1, "method": "retain"})[0] == 403
    finally:
        server.shutdown()


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "twin"))
    rows = lambda part: spark.createDataFrame([("M", "x", t, v) for t, v in part], "entity string, signal string, t bigint, v double")
    source = str(tmp_path / "in")
    read = lambda: spark.readStream.schema("entity string, signal string, t bigint, v double").option("maxFilesPerTrigger", 1).parquet(source)
    rows([(1, 9.0), (2, 9.0)]).coalesce(1).write.parquet(source)
    streaming.ingest(read(), store, str(tmp_path / "c1")).awaitTermination()
    rows([(4, 8.0), (3, 1.0)]).coalesce(1).write.mode("append").parquet(source)
    streaming.ingest(read(), store, str(tmp_path / "c1")).awaitTermination()
    agent = Agent(store)
    assert [p["t"] for p in agent.get_measurements("M", "x")["points"]] == [1, 2, 3, 4] and store.manifest["version"] == 2
    store.commit(stream=("ingest", 0), points=[])
    assert store.manifest["version"] == 2
    for name, df, mode in (("latest", streaming.latest(read()), "complete"), ("alarms", streaming.alarms(read(), 5.0), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert [tuple(r) for r in spark.table("latest").collect()] == [("M.x", 4, 8.0)]
    assert sorted((r["t"], r["over"]) for r in spark.table("alarms").collect()) == [(2, True), (3, False), (4, True)]


def test_smoke(spark, capsys):
    assert smoke(spark) == 0 and capsys.readouterr().out.count("VIOLATION") == 2
