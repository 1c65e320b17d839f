"""Queries that write, stream, call and fail: what the methods do to a stored twin, as rows, with their SQL for DuckDB.

Each opens a store of its own in the shared folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom import streaming
from twinloom.api import Agent
from twinloom.catalog import AT, BEFORE, C_KEY, CHUNKS, HI, LO, N_KEY, NOW, POINTS, RELATIONS, SEC, measured, measured_sql, named
from twinloom.client import CallError, Client
from twinloom.operators import checks, graph, series
from twinloom.rpc import RpcError, points_of, props_of, relations_of
from twinloom.shared import shared_dir
from twinloom.sources.store import Conflict, Store
from twinloom.sources.tables import CUSTOMER, TABLES, TableTwin, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of a twin as a query; sql is its oracle."""
    def add(build: Callable[[TableTwin], DataFrame]) -> Callable[[TableTwin], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(twin(spark, sf_dir))
        ORACLE_SQL[build.__name__] = sql
        return build

    return add


def stored(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/twinloom/store-{uuid.uuid4().hex}")


def writer(store: Store) -> Agent:
    return Agent(store, "catalog", "writer", clock=lambda: NOW)


# ---- writes ------------------------------------------------------------------

_GEO = "SELECT n_nationkey::BIGINT AS idx, n_name AS src, r_name AS dst, 'geo:part_of' AS kind, 0 AS since, 0 AS provenance FROM nation JOIN region ON n_regionkey = r_regionkey"
_FIRST = "(SELECT min(n_nationkey) FROM nation)"
_LAST = "(SELECT max(n_nationkey) FROM nation)"


@query(f"""SELECT 'entity' AS what, name, CASE WHEN name = (SELECT n_name FROM nation WHERE n_nationkey = {_FIRST}) THEN 'pop=1;seen=' WHEN name = 'Atlantis' THEN 'k=v;none=' ELSE '' END AS detail, type AS more, key::BIGINT AS number
FROM (SELECT n_name AS name, 'Nation' AS type, {N_KEY} AS key FROM nation UNION ALL SELECT r_name, 'Region', r_regionkey FROM region UNION ALL SELECT 'Atlantis', 'Nation', (SELECT max({N_KEY}) FROM nation) + 1)
UNION ALL SELECT 'relation', src, dst, kind || ' ' || since || ' ' || provenance, idx FROM ({_GEO}) WHERE idx <> {_LAST}
UNION ALL SELECT 'relation', (SELECT n_name FROM nation WHERE n_nationkey = {_FIRST}), (SELECT min(r_name) FROM region), 'geo:near 5 1', (SELECT max(n_nationkey) + 1 FROM nation)
UNION ALL SELECT 'relation', 'Atlantis', (SELECT min(r_name) FROM region), 'geo:part_of 0 0', (SELECT max(n_nationkey) + 2 FROM nation)
UNION ALL SELECT 'refused', 'self-relations are not supported', '', '', 0 UNION ALL SELECT 'conflict', 'Conflict', '', '', 0""")
def write_entities(t: TableTwin) -> DataFrame:
    """A bulk load of nations and regions, upserts that change, create, link and repeat, a removal, a refusal, and a second writer."""
    store = stored(t.spark)
    store.commit(entities=t.entities.where("type in ('Nation', 'Region')"), relations=t.relations.where("rel_type = 'part_of'"))
    a, late = writer(store), Store(t.spark, store.root)
    first, target = t.entities.where("type = 'Nation'").orderBy("key").first()["name"], t.entities.where("type = 'Region'").agg(F.min("name")).first()[0]
    a.upsert_entity(first, "Ignored", [("pop", "1"), ("seen", None)], [(target, "geo:near", 5)], "agent")
    a.upsert_entity("Atlantis", "Nation", [("k", "v"), ("none", None)], [(target, "geo:part_of", None), (target, "geo:part_of", 7)])
    refused = a.upsert_entity(first, "Nation", [], [(first, "geo:near", None)])["error"]
    a.remove_relation(t.relations.where("rel_type = 'part_of'").agg(F.max("idx")).first()[0])
    try:
        late.commit(entities=[(10**9, "Nation", "Lost", [])])
        lost = "committed"
    except Conflict:
        lost = "Conflict"
    now = Store(t.spark, store.root).twin()
    props = F.array_join(F.transform("props", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")
    entities = now.entities.select(F.lit("entity").alias("what"), "name", props.alias("detail"), F.col("type").alias("more"), F.col("key").alias("number"))
    links = graph.named(now, now.live()).select(F.lit("relation"), "src_name", "dst_name", F.concat_ws(" ", fn.joined_type(F.col("topology"), F.col("rel_type")), "valid_from", "provenance"), "idx")
    return entities.union(links).union(t.spark.createDataFrame([("refused", refused, "", "", 0), ("conflict", lost, "", "", 0)], entities.schema))


@query("SELECT * FROM (VALUES ('ingest', 300, 2, 0), ('ingest', 1, 1, 0), ('read', 301, NULL, NULL), ('retain', 256, 1, NULL), ('retain', 0, 0, NULL), ('read', 45, NULL, NULL)) v(step, n, chunks, series_id)")
def write_points(t: TableTwin) -> DataFrame:
    """Ingest in chunks of 256, and retention of whole chunks."""
    a, rows = writer(stored(t.spark)), []
    for points in ([(NOW + i, 5.0 + i % 60) for i in range(300)], [(NOW + 300, 1.0)]):
        got = a.ingest_points("Motor42", "current", points)
        rows.append(("ingest", got["accepted"], got["chunks_flushed"], got["series_id"]))
    rows.append(("read", a.get_measurements("Motor42", "current")["count"], None, None))
    for _ in range(2):
        got = a.retain(NOW + 256)
        rows.append(("retain", got["points_removed"], got["chunks_removed"], None))
    rows.append(("read", a.get_measurements("Motor42", "current")["count"], None, None))
    return t.spark.createDataFrame(rows, "step string, n int, chunks int, series_id int")


@query(f"SELECT * FROM (VALUES ('state', 'RUNNING', 100, 200, ''), ('state', 'STOPPED', 200, -1, ''), ('at', 'RUNNING', 100, NULL, ''), ('event', 'alarm', 7, 5, repeat('é', 10)), ('event', 'note', {NOW}, 1, 'short'), ('hypothesis', 'refused', NULL, NULL, '')) v(what, value, since, number, detail)")
def write_states_events(t: TableTwin) -> DataFrame:
    a = writer(stored(t.spark))
    a.set_state("Motor42", "state", "RUNNING", 100)
    a.set_state("Motor42", "state", "STOPPED", 200)
    a.log_event("alarm", "Motor42", 7, 261, "é" * 15)
    a.log_event("note", "Motor42", None, 1, "short")
    rows = [("state", r["value"], r["valid_from"], r["valid_to"], "") for r in a.state_history("Motor42", "state")["history"]]
    got = a.get_state("Motor42", "state", 150)
    rows.append(("at", got["value"], got["valid_from"], None, ""))
    rows += [("event", r["name"], r["timestamp"], r["provenance_byte"], r["details"]) for r in a.get_events()["events"]]
    rows.append(("hypothesis", a.set_hypothesis("Motor42", "why")["error"].split(":")[0], None, None, ""))
    return t.spark.createDataFrame(rows, "what string, value string, since int, number int, detail string")


@query(f"SELECT name, count(*) AS n, min(t) AS lo, max(t) AS hi, round(sum(v), 2) AS total FROM ({POINTS}) GROUP BY name")
def stream_ingest(t: TableTwin) -> DataFrame:
    """All events as a stream of readings into a store; epochs that come again change nothing."""
    store = stored(t.spark)
    owners = t.read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("entity"))
    t.read("events").write.parquet(f"{store.root}/arrivals")  # a stream is read from a folder
    rows = t.spark.readStream.schema(TABLES["events"]).parquet(f"{store.root}/arrivals").join(owners, "user_id")
    readings = rows.select("entity", F.col("event_type").alias("signal"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))
    for _ in range(2):
        streaming.ingest(readings, store, f"{store.root}/checkpoint", name=f"ingest_{uuid.uuid4().hex}").awaitTermination()
    store.refresh()
    now = store.twin()
    got = now.points.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.round(F.sum("v"), 2).alias("total"))
    return now.series.select("sid", "name").join(got, "sid").drop("sid")


# ---- calls -------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('points', '[[1, 2.5], [3, 4.0]]', 0), ('points', '', -32602), ('points', '', -32602), ('props', '[["a", "x"], ["b", null]]', 0), ('props', '[["a", "x"]]', 0),
('relations', '[["X", "a:b", 5], ["Y", "c:d", null]]', 0), ('relations', '', -32602)) v(parser, value, code)""")
def rpc_parameters(t: TableTwin) -> DataFrame:
    cases = [
        ("points", points_of, [[1, 2.5], {"ts": 3, "value": 4}]), ("points", points_of, []), ("points", points_of, [[1.5, 2]]), ("props", props_of, {"a": "x", "b": 5}), ("props", props_of, [["a", "x"]]),
        ("relations", relations_of, [{"to": "X", "relation_type": "a:b", "valid_from": 5}, ["Y", "c:d"]]), ("relations", relations_of, [["Y", "cd"]]),
    ]
    rows = []
    for name, parser, raw in cases:
        try:
            rows.append((name, json.dumps(parser(raw)), 0))
        except RpcError as e:
            rows.append((name, "", e.code))
    return t.spark.createDataFrame(rows, "parser string, value string, code int")


@query("""SELECT 'return names all' AS what, count(*) AS n, 'n,r' AS detail FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'projected', count(*), 'r' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'anonymous', count(*), '' FROM nation
UNION ALL SELECT 'limited', 3, '' UNION ALL SELECT 'limit ignored', count(*), '' FROM nation UNION ALL SELECT 'listed', 4, count(*) || ' True' FROM customer
UNION ALL SELECT 'parse error', 0, '0' UNION ALL SELECT 'unbound', 0, '0' UNION ALL SELECT 'forbidden', 0, '-32003' UNION ALL SELECT 'unknown method', 0, '-32601'""")
def client_calls(t: TableTwin) -> DataFrame:
    """Named results, limits and errors as a client of a reader sees them."""
    client = Client.of(Agent(t, clock=lambda: NOW))
    agent = Agent(t, clock=lambda: NOW)
    both = "MATCH (n:Nation)-[:GEO]->(r:Region) RETURN r"
    measured_ = "MATCH (n:Nation) MEASURE n.x DURING 5..6 RETURN max(x) LIMIT 3"
    got = agent.query(both)
    rows = [("return names all", got["n"], ",".join(got["rows"][0]))]
    got = agent.query(both, project_return=True)
    rows.append(("projected", got["n"], ",".join(got["rows"][0])))
    got = agent.query("MATCH (Nation) RETURN n")
    rows.append(("anonymous", got["n"], ",".join(got["rows"][0])))
    rows.append(("limited", agent.query_temporal(measured_)["n"], ""))
    rows.append(("limit ignored", agent.query_temporal(measured_, parity=True)["n"], ""))
    got = client.list_entities("Customer", 4)
    rows.append(("listed", len(got["entities"]), f"{got['total']} {got['truncated']}"))
    for what, call in (("parse error", lambda: client.query("MATCH (")), ("unbound", lambda: client.query("MATCH (n:Nation) WHERE m.x = 'a' RETURN n")), ("forbidden", lambda: client.call("ingest_points", entity="M", signal="x", points=[[1, 2]])), ("unknown method", lambda: client.call("no_such"))):
        try:
            call()
            rows.append((what, 1, ""))
        except CallError as e:
            rows.append((what, 0, str(e.code)))
    return t.spark.createDataFrame(rows, "what string, n long, detail string")


# ---- the rest of the surface -------------------------------------------------


@query(f"SELECT p.name AS series, event_type AS signal, count(*) FILTER (t BETWEEN {LO} AND {HI}) AS points, min(v) FILTER (t BETWEEN {LO} AND {HI}) AS min, max(v) FILTER (t BETWEEN {LO} AND {HI}) AS max FROM ({POINTS}) p WHERE c_name = (SELECT min(c_name) FROM ({POINTS})) GROUP BY ALL")
def entity_measurements(t: TableTwin) -> DataFrame:
    entity = t.series.agg(F.min("entity")).first()[0]
    return checks.measurements(t, entity, LO, HI).drop("ord")


@query(measured_sql(f"t BETWEEN {LO} AND {HI}", "max"))
def measure_selected(t: TableTwin) -> DataFrame:
    """Aggregates of other signals are left out, and two of a kind are one."""
    return measured(t, f"MATCH (c:Customer) MEASURE c.purchase DURING {LO}..{HI} RETURN max(purchase), max(x.purchase), count(click)")


@query(f"SELECT {C_KEY} AS key, unnest([{{'k': 'segment', 'v': c_mktsegment}}, {{'k': 'flag', 'v': ''}}, {{'k': 'sum', 'v': c_custkey || '=' || c_custkey}}], recursive := true) FROM customer")
def props_decoded(t: TableTwin) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit("segment="), F.col("c_mktsegment"), F.lit("\u0000flag\u0000sum="), key, F.lit("="), key, F.lit("\u0000"))
    return t.read("customer").select((F.col("c_custkey") + CUSTOMER).alias("key"), F.explode(fn.decoded_props(raw)).alias("p")).select("key", "p.k", "p.v")


@query(f"SELECT src AS key, dst AS other, rel_type, idx FROM ({RELATIONS}) WHERE topology = 'supply' AND valid_from <= {AT} AND (valid_to = -1 OR {AT} < valid_to)")
def neighbors_at(t: TableTwin) -> DataFrame:
    return graph.neighbours(t, t.entities, "supply", True, AT).select("key", "other", "rel_type", "idx")


@query(f"SELECT topology, provenance = 1 AS comparable, count(*) AS n FROM ({RELATIONS}) GROUP BY ALL")
def comparability(t: TableTwin) -> DataFrame:
    return t.live().groupBy("topology", fn.comparable(F.col("provenance")).alias("comparable")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT name, count(*) AS chunks, sum(count)::BIGINT AS points FROM ({CHUNKS}) WHERE t_end < {BEFORE} GROUP BY name")
def overdue_chunks(t: TableTwin) -> DataFrame:
    return named(t, series.overdue(t, BEFORE, 8).groupBy("sid").agg(F.count(F.lit(1)).alias("chunks"), F.sum("count").alias("points")))


_CRC_TABLE = "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


@query(f"""SELECT event_id AS id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) AS crc
FROM (SELECT event_id, list_transform(range(1, length(c_name || event_type) + 1), lambda i: ascii((c_name || event_type)[i])::BIGINT) AS bytes, {_CRC_TABLE} AS tbl FROM events JOIN customer ON user_id = c_custkey)""")
def crc_of_names(t: TableTwin) -> DataFrame:
    return t.events.select(F.col("seq").alias("id"), F.crc32(F.concat("entity", "name")).alias("crc"))


@query(f"SELECT name, discrete, {SEC.format('ts')} AS t FROM (SELECT c_name || '.' || event_type AS name, max(ts) AS ts, coalesce(bool_and(value IN (0, 1)), false) AS discrete FROM events JOIN customer ON user_id = c_custkey GROUP BY 1)")
def series_refresh(t: TableTwin) -> DataFrame:
    """What a refresh of the address space shows of every variable: its kind and the time of its newest value, whenever that was."""
    kinds = series.discrete(t)
    return series.latest(t).join(kinds, F.col("name").eqNullSafe(F.col("series"))).select("name", "discrete", "t")
