"""Writers that meet, buckets that cut groups, and clients."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from twinloom import __main__ as command
from twinloom import scenarios
from twinloom.api import Agent
from twinloom.client import CallError, Client
from twinloom.model import Twin
from twinloom.operators import series, windows
from twinloom.rpc import http_server
from twinloom.sources import generate
from twinloom.sources.store import Conflict, Store
from twinloom.sources.tables import TABLES


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (Agent(Store(spark, str(tmp_path)), n, "writer") for n in "ab")
    one.ingest_points("M", "x", [(1, 1.0), (2, 2.0)])
    two.ingest_points("N", "y", [(3, 3.0)])
    assert two.upsert_entity("M", "Motor")["key"] == 0 and one.upsert_entity("N", "Motor")["key"] == 1
    late = Store(spark, str(tmp_path))
    assert one.retain(2) == {"points_removed": 0, "chunks_removed": 0} and one.retain(3) == {"points_removed": 2, "chunks_removed": 1}
    with pytest.raises(Conflict):
        late.commit(events=[(1, "lost", "M", 1, 1, "")])
    now = Agent(Store(spark, str(tmp_path)))
    assert now.get_measurements("N", "y")["count"] == 1 and now.schema()["series"] == ["M.x", "N.y"] and now.get_events()["n"] == 0
    assert [e["method"] for e in two.audit()["entries"]].count("ingest_points") == 1


def test_writers_at_once(spark, tmp_path):
    agents = [Agent(Store(spark, str(tmp_path)), str(i), "writer") for i in range(3)]
    failed = []

    def work(a, i):
        try:
            for j in range(2):
                a.log_event(f"e{i}{j}", "M", 10 * i + j)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(a, i)) for i, a in enumerate(agents)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and sorted(e["name"] for e in Agent(Store(spark, str(tmp_path))).get_events()["events"]) == [f"e{i}{j}" for i in range(3) for j in range(2)]


def test_periodic_retention(spark, tmp_path):
    a = Agent(Store(spark, str(tmp_path)), "w", "writer")
    a.ingest_points("M", "x", [(1000, 1.0)])
    own = Agent(Store(spark, str(tmp_path)), "keeper", "writer")
    a.ingest_points("M", "x", [(9 * 86_400, 2.0)])
    assert command.retain_once(own, 2, 10 * 86_400.0) == {"points_removed": 1, "chunks_removed": 1}


def test_neighbours_across_buckets(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1, 2])) for i in r.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    for back in (False, True):
        got = {x["i"]: (x["_n"], x["_last"]) for x in windows.neighbours(df, ["k"], F.floor(F.col("i") / 97), ["i"], F.col("v"), back).collect()}
        for k in ("a", "b", None):
            mine = sorted((x for x in rows if x[0] == k), key=lambda x: -x[1] if back else x[1])
            assert [got[x[1]] for x in mine] == [(n + 1, mine[n - 1][2] if n else None) for n in range(len(mine))]


def test_quantiles_and_places(spark):
    r = random.Random(2)
    rows = [(k, v) for k, n in (("hot", 3000), (None, 7), ("one", 1)) for v in [r.choice([0.0, r.random(), float(r.randint(0, 5))]) for _ in range(n)]] + [("hot", None), ("empty", None)]
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {x["k"]: x for x in windows.discrete_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares, 16).collect()}
    assert set(got) == {"hot", None, "one"}
    for k, x in got.items():
        mine = sorted(v for o, v in rows if o == k and v is not None)
        assert all(x[n] == mine[max(1, -int(-p * len(mine) // 1)) - 1] for n, p in shares.items())
    names = spark.createDataFrame([(f"n{i:04d}",) for i in r.sample(range(2000), 500)], "name string")
    placed = sorted((x["name"], x["p"]) for x in windows.places(names, "name", "p", 40).collect())
    assert [p for _, p in placed] == list(range(500))


def test_overdue_chunks_behind_later_ones(spark):
    names = spark.createDataFrame([("M.x",)], "name string").select(F.xxhash64("name").alias("sid"), "name", F.lit("M").alias("entity"), F.lit("x").alias("signal"), F.lit(0).cast("long").alias("ord"))
    points = names.select("sid").crossJoin(spark.createDataFrame([(0, i, t, float(t)) for i, t in enumerate([1, 2, 90, 91, 3, 4])], "batch_id long, seq long, t long, v double"))
    twin = Twin.of(spark, series=names, points=points)
    left = lambda parity: sorted(x["t"] for x in series.retained(twin, 50, 2, parity).collect())
    assert left(False) == [3, 4, 90, 91] and left(True) == [90, 91]


def test_refresh_shows_values_of_any_time(spark, tmp_path):
    """Points past the test tables' end, before 1970 and without a time, and a series without a name."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, "click", -5, 1.0), (0, "click", scenarios.NOW + 133, 0.0), (0, "view", -7, 2.0), (1, "view", None, 1.0), (1, "click", 9, None), (1, "click", None, 1.0), (1, None, 3, 0.0)]
    events = spark.createDataFrame([(i, u, k, t, v) for i, (u, k, t, v) in enumerate(rows)], "event_id long, user_id long, event_type string, t long, value double")
    stamp = F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")
    events.select("event_id", stamp, "user_id", "event_type", "value", F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"C{i}", 0, 0.0, "") for i in range(2)], TABLES["customer"]).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in scenarios.QUERIES["series_refresh"](spark, str(tmp_path)).collect()]
    assert len(got) == 5 and sorted(got, key=str) == sorted(con.sql(scenarios.ORACLE_SQL["series_refresh"]).fetchall(), key=str)


def test_client(spark):
    agent = Agent(generate.line(spark), clock=lambda: 0)
    local = Client.of(agent)
    assert local.schema()["series"] == ["Motor_000001.current"] and local.call("get_measurements", entity="Motor_000001", signal="current", from_=0)["count"] == 300
    server = http_server(agent, port=0, token="t")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/rpc"
    try:
        remote = Client.over_http(url, "t")
        assert remote.list_entities("Motor", 5)["total"] == 1
        for code, call in ((0, lambda: remote.check("none", "x")), (-32601, lambda: remote.call("none")), (-32003, lambda: remote.ingest_points("M", "x", [[1, 2.0]])), (401, lambda: Client.over_http(url).schema())):
            with pytest.raises(CallError) as e:
                call()
            assert e.value.code == code
    finally:
        server.shutdown()
