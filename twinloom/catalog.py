"""Queries of the engine by name, over the twin of the star-schema tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import Twin
from twinloom.operators import checks, graph, merging, series, states
from twinloom.operators.windows import discrete_quantiles
from twinloom.plans import bind, check_rows, measure, parse, parse_check, parse_temporal
from twinloom.plans.compile import limited
from twinloom.sources.tables import CUSTOMER, NATION, ORDER, SUPPLIER, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The test window, an instant among the orders, the end of the events, and bounds beyond all of them.
LO, HI, AT, NOW, BEFORE = 1_704_672_000, 1_705_881_600, 852_076_800, 1_706_659_032, 1_705_320_000
SMALL_CHUNK, THRESHOLD = 8, 100.0


def query(sql: str | None = None):
    """Registers a function of a twin as a query; sql is its oracle."""
    def add(build: Callable[[Twin], DataFrame]) -> Callable[[Twin], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(twin(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


def nodes(bound, *names: str) -> list:
    """key and name of the named nodes, as columns <var>_key and <var>_name."""
    shown = bound.shown()
    return [c for v in names for c in (shown[v]["key"].alias(f"{v}_key"), shown[v]["name"].alias(f"{v}_name"))]


def matched(t: Twin, text: str, *names: str) -> DataFrame:
    bound = bind(t, parse(text))
    return limited(bound.df, bound).select(*nodes(bound, *names))


SEC = "(epoch_us({0}) // 1000000)"
C_KEY, N_KEY, S_KEY, O_KEY = f"c_custkey + {CUSTOMER}", f"n_nationkey::BIGINT + {NATION}", f"s_suppkey + {SUPPLIER}", f"o_orderkey + {ORDER}"
POINTS = f"SELECT c_name || '.' || event_type AS name, c_name, event_type, event_id, {SEC.format('ts')} AS t, value AS v FROM events JOIN customer ON user_id = c_custkey"
BOUND = "CASE WHEN c_custkey % 5 <> 0 THEN (100 + 10 * (c_custkey % 10))::DOUBLE END"
#: Live relations with both ends by name, as (idx, src, dst, src_name, dst_name, topology, rel_type, valid_from, valid_to, provenance).
RELATIONS = f"""
SELECT n_nationkey::BIGINT AS idx, {N_KEY} AS src, n_regionkey::BIGINT AS dst, n_name AS src_name, r_name AS dst_name, 'geo' AS topology, 'part_of' AS rel_type, 0::BIGINT AS valid_from, -1::BIGINT AS valid_to, 0 AS provenance FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT {S_KEY}, {S_KEY}, {N_KEY}, s_name, n_name, 'geo', 'located_in', 0, -1, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT {C_KEY}, {C_KEY}, {N_KEY}, c_name, n_name, 'geo', 'located_in', 0, -1, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT {O_KEY}, {O_KEY}, {C_KEY}, 'O' || o_orderkey, c_name, 'commerce', 'placed_by', {SEC.format('o_orderdate')}, -1, 1 FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT {2 * ORDER} + l_orderkey * 16 + l_linenumber, l_orderkey + {ORDER}, {S_KEY}, 'O' || l_orderkey, s_name, 'supply', 'ships_from', {SEC.format('l_shipdate')}, {SEC.format('l_shipdate')} + 7776000, 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
"""
CLASS = "CASE provenance WHEN 0 THEN 'Fact' WHEN 1 THEN 'Observation' WHEN 5 THEN 'Event' END"


# ---- patterns ----------------------------------------------------------------


@query(f"SELECT {S_KEY} AS s_key, s_name FROM supplier")
def match_type(t: Twin) -> DataFrame:
    return matched(t, "MATCH (s:Supplier) RETURN s", "s")


@query(f"SELECT {C_KEY} AS c_key, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def match_where_str(t: Twin) -> DataFrame:
    return matched(t, 'MATCH (c:Customer) WHERE c.mktsegment = "BUILDING" RETURN c', "c")


@query(f"SELECT {C_KEY} AS c_key, c_name FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 9000.5")
def match_where_num(t: Twin) -> DataFrame:
    return matched(t, "MATCH (c:Customer) WHERE c.acctbal > 5000 AND c.acctbal <= 9000.5 RETURN c", "c")


@query(f"SELECT {C_KEY} AS c_key, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment < 'C' AND c_acctbal < 0.5)")
def match_and_or(t: Twin) -> DataFrame:
    return matched(t, "MATCH (c:Customer) WHERE c.mktsegment = 'BUILDING' OR c.mktsegment < 'C' AND c.acctbal < 0.5 RETURN c", "c")


@query(f"SELECT {N_KEY} AS n_key, n_name FROM nation")
def match_missing_prop_ne(t: Twin) -> DataFrame:
    return matched(t, "MATCH (n:Nation) WHERE n.nothing != 'x' RETURN n", "n")


@query(f"SELECT {C_KEY} AS c_key, c_name FROM customer WHERE c_custkey % 5 <> 0 AND 100 + 10 * (c_custkey % 10) >= 150")
def match_dotted_prop(t: Twin) -> DataFrame:
    return matched(t, "MATCH (c:Customer) WHERE c.spec.purchase.max >= 150 RETURN c", "c")


@query(f"SELECT {C_KEY} AS c_key, c_name, {N_KEY} AS n_key, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hop1(t: Twin) -> DataFrame:
    return matched(t, "MATCH (c:Customer)-[:GEO]->(n:Nation) RETURN c, n", "c", "n")


@query(f"SELECT {C_KEY} AS c_key, c_name, {N_KEY} AS n_key, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def hop2_chain(t: Twin) -> DataFrame:
    return matched(t, 'MATCH (c:Customer)-[:GEO]->(n:Nation)-[:geo]->(r:Region) WHERE r.name = "ASIA" RETURN c', "c", "n")


@query(f"SELECT l_orderkey + {ORDER} AS o_key, 'O' || l_orderkey AS o_name, {S_KEY} AS s_key, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE {SEC.format('l_shipdate')} <= {AT} AND {AT} < {SEC.format('l_shipdate')} + 7776000")
def hop_at(t: Twin) -> DataFrame:
    return matched(t, f"MATCH (o:Order)-[:SUPPLY]->(s:Supplier) AT {AT} RETURN o, s", "o", "s")


@query(f"SELECT {S_KEY} AS s_key, s_name, {N_KEY} AS n_key, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_suppkey LIMIT 7")
def hop_limit(t: Twin) -> DataFrame:
    return matched(t, "MATCH (s:Supplier)-[:geo]->(n:Nation) RETURN s, n LIMIT 7", "s", "n")


# ---- telemetry ---------------------------------------------------------------


def measured(t: Twin, text: str) -> DataFrame:
    bound = bind(t, parse_temporal(text, NOW))
    out = measure(t, bound)
    rounded = [F.round(c, 4).alias(c) if c in ("avg", "sum") else F.col(c) for c in out.columns if c in ("max", "min", "avg", "sum", "count", "has_series")]
    return out.select(*nodes(bound, "c"), *rounded)


def measured_sql(condition: str, kinds: str, source: str = "customer", where: str = "true") -> str:
    columns = {"max": "max(v) AS max", "min": "min(v) AS min", "avg": "round(avg(v), 4) AS avg", "sum": "round(CASE WHEN s.c_name IS NOT NULL THEN coalesce(sum(v), 0) END, 4) AS sum", "count": "CASE WHEN s.c_name IS NOT NULL THEN count(v)::DOUBLE END AS count"}
    return f"""
WITH p AS ({POINTS}), s AS (SELECT DISTINCT c_name FROM p WHERE event_type = 'purchase')
SELECT {C_KEY} AS c_key, c.c_name AS c_name, s.c_name IS NOT NULL AS has_series, {', '.join(columns[k] for k in kinds.split())}
FROM {source} c LEFT JOIN s ON s.c_name = c.c_name LEFT JOIN p ON p.c_name = c.c_name AND p.event_type = 'purchase' AND {condition}
WHERE {where} GROUP BY c.c_custkey, c.c_name, s.c_name"""


@query(measured_sql(f"t BETWEEN {LO} AND {HI}", "max min avg sum count"))
def measure_aggs(t: Twin) -> DataFrame:
    return measured(t, f"MATCH (c:Customer) MEASURE c.purchase DURING {LO}..{HI} RETURN max(purchase), min(purchase), avg(c.purchase), sum(purchase), count(purchase)")


@query(measured_sql("t BETWEEN 5 AND 6", "max avg sum count"))
def measure_empty_window(t: Twin) -> DataFrame:
    return measured(t, "MATCH (c:Customer) MEASURE c.purchase DURING 5..6 RETURN max(purchase), avg(purchase), sum(purchase), count(purchase)")


@query(measured_sql(f"t BETWEEN {NOW - 7 * 86400} AND {NOW}", "max count"))
def measure_last(t: Twin) -> DataFrame:
    return measured(t, "MATCH (c:Customer) MEASURE c.purchase DURING last(7d) RETURN max(purchase), count(purchase)")


@query(measured_sql(f"t BETWEEN {LO} AND {HI}", "max count", "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)", "r_name = 'ASIA'"))
def measure_over_hops(t: Twin) -> DataFrame:
    return measured(t, f'MATCH (c:Customer)-[:GEO]->(n:Nation)-[:GEO]->(r:Region) WHERE r.name = "ASIA" MEASURE c.purchase DURING {LO}..{HI} RETURN max(purchase), count(purchase)')


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the purchases of every Asian customer over a fortnight."""
    return QUERIES["measure_over_hops"](spark, sf_dir)


FIRST_SERIES = f"(SELECT min(name) FROM ({POINTS}))"


@query(f"SELECT t, v FROM ({POINTS}) WHERE name = {FIRST_SERIES} AND t BETWEEN {LO - 600_000} AND {HI}")
def range_scan(t: Twin) -> DataFrame:
    name = t.series.agg(F.min("name")).first()[0]
    return series.scan(t, name, LO - 600_000, HI)


@query(f"WITH p AS ({POINTS}) SELECT s.name, count(p.t) AS count, round(coalesce(sum(v), 0), 2) AS sum, min(v) AS min, max(v) AS max FROM (SELECT DISTINCT name FROM p) s LEFT JOIN p ON p.name = s.name AND t BETWEEN {LO} AND {HI} GROUP BY s.name")
def series_stats(t: Twin) -> DataFrame:
    return series.statistics(t, LO, HI).withColumn("sum", F.round("sum", 2))


CHUNKS = f"SELECT name, chunk, arg_min(t, event_id) AS t0, arg_max(t, event_id) AS t_end, count(*) AS count, min(v) AS min, max(v) AS max FROM (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY event_id) - 1) // {SMALL_CHUNK} AS chunk FROM ({POINTS})) GROUP BY name, chunk"


def named(t: Twin, df: DataFrame) -> DataFrame:
    return df.join(t.series.select("sid", "name"), "sid").drop("sid")


@query(CHUNKS)
def chunk_index(t: Twin) -> DataFrame:
    return named(t, series.chunks(t, SMALL_CHUNK).drop("batch_id"))


@query(f"SELECT name, count(*) AS chunks, sum(count)::BIGINT AS count, min(min) AS min, max(max) AS max FROM ({CHUNKS}) GROUP BY name")
def chunk_stats(t: Twin) -> DataFrame:
    return named(t, series.chunk_statistics(t, SMALL_CHUNK))


GONE = f"SELECT * FROM (SELECT *, max(CASE WHEN t_end >= {BEFORE} THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS kept FROM ({CHUNKS})) WHERE kept = 0"


@query(f"SELECT name, count(*) AS chunks_removed, sum(count)::BIGINT AS points_removed FROM ({GONE}) GROUP BY name")
def retain_plan(t: Twin) -> DataFrame:
    return named(t, series.expired(t, BEFORE, SMALL_CHUNK).groupBy("sid").agg(F.count(F.lit(1)).alias("chunks_removed"), F.sum("count").alias("points_removed")))


@query(f"SELECT name, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY event_id) - 1) // {SMALL_CHUNK} AS chunk FROM ({POINTS})) p WHERE NOT EXISTS (SELECT 1 FROM ({GONE}) g WHERE g.name = p.name AND g.chunk = p.chunk) GROUP BY name")
def retained_points(t: Twin) -> DataFrame:
    return named(t, series.retained(t, BEFORE, SMALL_CHUNK).groupBy("sid").agg(F.count(F.lit(1)).alias("n")))


@query(f"SELECT name, t, v FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t DESC, event_id DESC) AS rn FROM ({POINTS}) WHERE t BETWEEN {LO} AND {HI}) WHERE rn = 1")
def last_value(t: Twin) -> DataFrame:
    return series.latest(t, LO, HI)


@query(f"WITH o AS (SELECT *, v > {THRESHOLD} AS over, row_number() OVER w AS n, lag(v > {THRESHOLD}) OVER w AS before FROM ({POINTS}) WINDOW w AS (PARTITION BY name ORDER BY t, event_id)) SELECT name, t, v, over FROM o WHERE n >= 2 AND over <> (CASE WHEN n = 2 THEN false ELSE before END)")
def alarm_crossings(t: Twin) -> DataFrame:
    return named(t, series.crossings(t.points, THRESHOLD))


@query(f"WITH o AS (SELECT *, v > 150 AS over, row_number() OVER w AS n, lag(v > 150) OVER w AS before FROM ({POINTS}) WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY name ORDER BY t, event_id)) SELECT CASE WHEN over THEN 'high' ELSE 'high_clear' END AS name, c_name AS entity, t AS ts, CASE WHEN over THEN 'v>150.0' ELSE 'v<=150.0' END AS details FROM o WHERE n >= 2 AND over <> (CASE WHEN n = 2 THEN false ELSE before END)")
def alarm_events(t: Twin) -> DataFrame:
    rules = t.series.where("signal = 'purchase'").select(F.col("name").alias("series"), "entity", F.lit("high").alias("name"), F.lit(150.0).alias("threshold"), F.lit("v>{thr}").alias("detail"), F.lit("v<={thr}").alias("detail_clear"))
    return series.alarms(t.points.drop("ts", "event_type"), rules)


@query(f"SELECT name AS series, coalesce(bool_and(v IN (0, 1)), false) AS discrete FROM ({POINTS}) GROUP BY name")
def discrete_signals(t: Twin) -> DataFrame:
    return series.discrete(t)


@query(f"SELECT event_type AS signal, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events JOIN customer ON user_id = c_custkey GROUP BY event_type")
def percentiles(t: Twin) -> DataFrame:
    rows = t.points.join(t.series.select("sid", "signal"), "sid")
    return discrete_quantiles(rows, "signal", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# ---- checks ------------------------------------------------------------------

CHECKED = f"""
WITH o AS (SELECT c_name, max(v) AS observed, count(*) AS n FROM ({POINTS}) WHERE event_type = 'purchase' AND t BETWEEN {LO} AND {HI} GROUP BY c_name),
r AS (SELECT {C_KEY} AS key, c.c_name AS entity, {BOUND} AS expected_max, CASE WHEN c_custkey % 3 = 0 THEN 'A' END AS unit, o.observed, coalesce(o.n, 0) AS points_checked, c_nationkey FROM customer c LEFT JOIN o ON o.c_name = c.c_name),
checked AS (SELECT *, 'purchase' AS signal, CASE WHEN expected_max IS NULL THEN 'NO_SPEC' WHEN observed IS NULL THEN 'NO_DATA' WHEN observed > expected_max THEN 'VIOLATION' ELSE 'OK' END AS status, round(observed - expected_max, 4) AS deviation FROM r)
"""
CHECK_COLUMNS = "key, entity, signal, status, expected_max, observed, deviation, unit, points_checked"


@query(f"{CHECKED} SELECT {CHECK_COLUMNS} FROM checked")
def check_all(t: Twin) -> DataFrame:
    return checks.checked(t, t.entities.where("type = 'Customer'"), "purchase", LO, HI).withColumn("deviation", F.round("deviation", 4))


@query(f"{CHECKED} SELECT entity, status, CASE WHEN expected_max IS NULL THEN '-' ELSE expected_max::BIGINT::VARCHAR END AS expected, points_checked::VARCHAR AS points, coalesce(unit, '-') AS unit FROM checked JOIN nation ON c_nationkey = n_nationkey WHERE n_name >= 'M'")
def check_statement(t: Twin) -> DataFrame:
    rows = check_rows(t, parse_check(f"CHECK c.purchase FOR (c:Customer)-[:GEO]->(n:Nation) WHERE n.name >= 'M' DURING {LO}..{HI} RETURN entity, status, expected, points, unit", NOW))
    return rows.select(*[F.col(f"f_{c}").alias(c) for c in ("entity", "status", "expected", "points", "unit")])


SPECIFIED = f"{CHECKED} SELECT {CHECK_COLUMNS} FROM checked WHERE expected_max IS NOT NULL AND entity IN (SELECT c_name FROM ({POINTS}) WHERE event_type = 'purchase')"


@query(SPECIFIED)
def diagnose_checks(t: Twin) -> DataFrame:
    return checks.specification_checks(t, LO, HI).withColumn("deviation", F.round("deviation", 4))


@query(f"{SPECIFIED} AND status = 'VIOLATION'")
def diagnose_anomalies(t: Twin) -> DataFrame:
    return checks.anomalies(t, LO, HI).withColumn("deviation", F.round("deviation", 4))


@query(f"SELECT p.c_name AS entity, t, v, {BOUND} AS expected_max FROM ({POINTS}) p JOIN customer c ON c.c_name = p.c_name WHERE event_type = 'purchase' AND v > {BOUND}")
def violations_per_point(t: Twin) -> DataFrame:
    return checks.violations(t, "purchase")


@query(f"SELECT c_name || '.purchase' AS series, 'A' AS unit, 267608::BIGINT AS code FROM customer WHERE c_custkey % 3 = 0 AND c_name IN (SELECT c_name FROM ({POINTS}) WHERE event_type = 'purchase')")
def units_join(t: Twin) -> DataFrame:
    return checks.units(t)


# ---- states and events -------------------------------------------------------

WRITES = f"SELECT o_orderkey AS seq, c_name AS entity, 'order_status' AS key, o_orderstatus AS value, {SEC.format('o_orderdate')} AS wat FROM orders JOIN customer ON o_custkey = c_custkey"
INTERVALS = f"SELECT seq, entity, key, value, wat AS valid_from, coalesce(lead(wat) OVER (PARTITION BY entity, key ORDER BY seq), -1) AS valid_to FROM ({WRITES})"


@query(INTERVALS)
def state_intervals(t: Twin) -> DataFrame:
    return states.intervals(t)


@query(f"SELECT entity, key, value, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY entity, key ORDER BY valid_from DESC, seq) AS rn FROM ({INTERVALS}) WHERE valid_from <= {AT} AND (valid_to = -1 OR {AT} < valid_to)) WHERE rn = 1")
def state_at(t: Twin) -> DataFrame:
    return states.at(t, AT)


@query(f"SELECT value, valid_from, valid_to FROM ({INTERVALS}) WHERE entity = (SELECT min(entity) FROM ({WRITES}))")
def state_history(t: Twin) -> DataFrame:
    return states.history(t, t.states.agg(F.min("entity")).first()[0], "order_status")


@query(f"SELECT event_id AS seq, event_type AS name, c_name AS entity, t AS timestamp, CASE event_type WHEN 'error' THEN 'Event' WHEN 'purchase' THEN 'Fact' ELSE 'Observation' END AS provenance, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 0 ELSE 1 END AS provenance_byte, props[1:20] AS details FROM (SELECT *, {SEC.format('ts')} AS t FROM events JOIN customer ON user_id = c_custkey) WHERE t BETWEEN {LO} AND {HI}")
def events_window(t: Twin) -> DataFrame:
    return states.events(t, None, LO, HI)


@query("SELECT DISTINCT CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 0 ELSE 1 END AS byte, CASE event_type WHEN 'error' THEN 'Event' WHEN 'purchase' THEN 'Fact' ELSE 'Observation' END AS class FROM events JOIN customer ON user_id = c_custkey")
def provenance_map(t: Twin) -> DataFrame:
    return t.events.select(F.col("provenance").alias("byte"), fn.provenance_name(F.col("provenance")).alias("class")).distinct()


# ---- graph -------------------------------------------------------------------

ENTITIES = f"SELECT r_regionkey::BIGINT AS key, r_name AS name, 'Region' AS type FROM region UNION ALL SELECT {N_KEY}, n_name, 'Nation' FROM nation UNION ALL SELECT {S_KEY}, s_name, 'Supplier' FROM supplier UNION ALL SELECT {C_KEY}, c_name, 'Customer' FROM customer UNION ALL SELECT {O_KEY}, 'O' || o_orderkey, 'Order' FROM orders"


@query("SELECT unnest(['Region', 'Nation', 'Supplier', 'Customer', 'Order']) AS type")
def schema_types(t: Twin) -> DataFrame:
    return graph.entity_types(t)


@query("SELECT unnest(['geo', 'commerce', 'supply']) AS topology")
def schema_topologies(t: Twin) -> DataFrame:
    return graph.topologies(t)


@query(f"SELECT key, name, type FROM ({ENTITIES}) WHERE type = 'Nation'")
def list_entities(t: Twin) -> DataFrame:
    return graph.list_entities(t, "Nation")


@query(f"SELECT (SELECT count(*) FROM ({ENTITIES})) AS entities, (SELECT count(*) FROM ({RELATIONS})) AS relations, (SELECT count(DISTINCT name) FROM ({POINTS})) AS series, (SELECT count(*) FROM ({POINTS})) AS points, (SELECT count(*) FROM ({WRITES})) AS states")
def counters(t: Twin) -> DataFrame:
    rows = None
    for name in ("entities", "relations", "series", "points", "states"):
        one = getattr(t, name).agg(F.count(F.lit(1)).alias(name))
        rows = one if rows is None else rows.crossJoin(one)  # one row each
    return rows


@query(f"SELECT idx, src_name AS \"from\", dst_name AS \"to\", topology || ':' || rel_type AS relation_type, valid_from, valid_to, {CLASS} AS provenance FROM ({RELATIONS})")
def graph_edges(t: Twin) -> DataFrame:
    return graph.graph_edges(t)


@query(f"SELECT idx AS relation_idx, src_name AS src, dst_name AS dst, rel_type AS type, topology, provenance AS provenance_byte, {CLASS} AS provenance, valid_from, valid_to FROM ({RELATIONS})")
def prov_relations(t: Twin) -> DataFrame:
    return graph.provenance_relations(t)


CARDS = f"SELECT src AS key, 'out' AS direction, idx, rel_type AS type, topology, dst AS other_key, dst_name AS other, provenance, valid_from, valid_to FROM ({RELATIONS}) UNION ALL SELECT dst, 'in', idx, rel_type, topology, src, src_name, provenance, valid_from, valid_to FROM ({RELATIONS})"


@query(f"SELECT key, direction, idx, type, topology, other, {CLASS} AS provenance, valid_from, valid_to FROM ({CARDS})")
def entity_card(t: Twin) -> DataFrame:
    return graph.cards(t, t.entities).select("key", "direction", "idx", "type", "topology", "other", "provenance", "valid_from", "valid_to")


@query(f"SELECT src AS key, dst AS other, 'out' AS direction FROM ({RELATIONS}) UNION ALL SELECT dst, src, 'in' FROM ({RELATIONS})")
def neighbors_in_out(t: Twin) -> DataFrame:
    both = [graph.neighbours(t, t.entities, None, out).select("key", "other", F.lit("out" if out else "in").alias("direction")) for out in (True, False)]
    return both[0].unionByName(both[1])


@query(f"WITH RECURSIVE e AS ({RELATIONS}), w AS (SELECT key, 0 AS hops FROM ({ENTITIES}) WHERE name = 'ASIA' UNION SELECT e.src, w.hops + 1 FROM w JOIN e ON e.dst = w.key WHERE w.hops < 2) SELECT key, min(hops) AS hops FROM w GROUP BY key HAVING min(hops) > 0")
def reach_k(t: Twin) -> DataFrame:
    return graph.reach(t, graph.key_of(t, "ASIA"), 2, out=False)


@query(f"""WITH p AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))
SELECT 0 AS pos, 'O' || o_orderkey AS "from", 'placed_by' AS relation_type, 'commerce' AS topology, c_name AS "to", 'Observation' AS provenance FROM p
UNION ALL SELECT 1, c_name, 'located_in', 'geo', n_name, 'Fact' FROM p UNION ALL SELECT 2, n_name, 'part_of', 'geo', r_name, 'Fact' FROM p""")
def trace_path(t: Twin) -> DataFrame:
    order = t.entities.where("type = 'Order'").agg(F.min("key").alias("key"))
    bound = bind(t.using(entities=t.entities.join(order, "key", "left_semi").unionByName(t.entities.where("type <> 'Order'"))), parse("MATCH (o:Order)-[:commerce]->(c:Customer)-[:geo]->(n:Nation)-[:geo]->(r:Region) RETURN r"))
    path = graph.trace(t, order, bound.df.select(F.col("n3.key").alias("key")), 6)
    return graph.steps(t, path).select("pos", "from", "relation_type", "topology", "to", "provenance")


@query(f"SELECT c.key, direction, idx, type, topology, other, e.type AS other_type FROM ({CARDS}) c JOIN ({ENTITIES}) e ON e.key = c.other_key".replace("c.key, direction, idx, type,", "c.key, direction, idx, c.type AS type,"))
def deps(t: Twin) -> DataFrame:
    return graph.cards(t, t.entities).select("key", "direction", "idx", "type", "topology", "other", "other_type")


@query(f"SELECT key, topology, count(*) AS edge_count, string_agg(DISTINCT type, ',' ORDER BY type) AS relation_types FROM ({CARDS}) GROUP BY key, topology")
def topology_summary(t: Twin) -> DataFrame:
    return graph.topology_summary(t, t.entities).select("key", "topology", "edge_count", F.concat_ws(",", "relation_types").alias("relation_types"))


@query(f"SELECT kind, count(*) AS n, min(id) AS lo, max(id) AS hi FROM (SELECT 'folder' AS kind, (99 + row_number() OVER (ORDER BY type))::BIGINT AS id FROM (SELECT DISTINCT type FROM ({ENTITIES})) UNION ALL SELECT 'object', 1000 + key FROM ({ENTITIES}) UNION ALL SELECT 'reference', 1000 + dst FROM ({RELATIONS}) UNION ALL SELECT 'variable', 1999 + row_number() OVER (ORDER BY name) FROM (SELECT DISTINCT name FROM ({POINTS})) UNION ALL SELECT 'unit', 3000 + n FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS n FROM (SELECT DISTINCT name, NULL FROM ({POINTS}))) WHERE name IN (SELECT c_name || '.purchase' FROM customer WHERE c_custkey % 3 = 0)) GROUP BY kind")
def address_space(t: Twin) -> DataFrame:
    return graph.address_space(t, series.discrete(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


# ---- merging -----------------------------------------------------------------


@query(f"SELECT {C_KEY} AS key, k, v FROM customer, (VALUES ('mktsegment'), ('acctbal'), ('note'), ('seen')) x(k), LATERAL (SELECT CASE k WHEN 'mktsegment' THEN c_mktsegment WHEN 'acctbal' THEN '7' WHEN 'note' THEN 'n' || c_custkey ELSE '' END AS v)")
def prop_merge(t: Twin) -> DataFrame:
    old = t.entities.where("type = 'Customer'").select("key", F.posexplode("props").alias("pos", "p")).select("key", "pos", "p.k", "p.v").where("k in ('mktsegment', 'acctbal')")
    new = t.entities.where("type = 'Customer'").select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("k"), v.alias("v")) for i, (k, v) in enumerate((("acctbal", F.lit("7")), ("mktsegment", F.lit(None).cast("string")), ("note", F.concat(F.lit("n"), (F.col("key") - CUSTOMER).cast("string"))), ("seen", F.lit(None).cast("string"))))])).alias("p")).select("key", "p.*")
    return merging.merge_props(old, new).select("key", "k", "v")


@query(f"SELECT count(*) AS fresh FROM (SELECT DISTINCT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey <> r_regionkey AND (n_nationkey + r_regionkey) % 3 = 0)")
def relation_dedup(t: Twin) -> DataFrame:
    """Wanted links of nations to regions, in both directions; those that exist are left out, and so is the second of a pair."""
    nation = t.entities.where("type = 'Nation'").select(F.col("key").alias("src"))
    region = t.entities.where("type = 'Region'").select(F.collect_list("key").alias("all"))
    wanted = nation.crossJoin(region).select("src", F.explode("all").alias("dst")).where(((F.col("src") - NATION) + F.col("dst")) % 3 == 0)
    kind = [F.lit("geo").alias("topology"), F.lit("part_of").alias("rel_type")]
    both = wanted.select("src", "dst", *kind).unionByName(wanted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *kind))
    return merging.fresh_relations(t.live(), both).agg(F.count(F.lit(1)).alias("fresh"))


# ---- scalar functions --------------------------------------------------------


@query(f"SELECT event_id AS id, props[1:20] AS clipped, (t + 11644473600) * 10000000 AS ticks, t * 2 AS zigzag, t AS unzigzag, crc32 AS crc, CASE WHEN value = trunc(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS shown, value AS parsed, (ceil((floor(log2(t)) + 1) / 7))::INTEGER AS varint FROM (SELECT *, {SEC.format('ts')} AS t, 0::BIGINT AS crc32 FROM events JOIN customer ON user_id = c_custkey)")
def scalar_functions(t: Twin) -> DataFrame:
    rows = t.points.join(t.events.select(F.col("seq"), "details"), "seq")
    return rows.select(F.col("seq").alias("id"), fn.clipped(F.col("details")).alias("clipped"), fn.ua_ticks(F.col("t")).alias("ticks"), fn.zigzag(F.col("t")).alias("zigzag"), fn.unzigzag(fn.zigzag(F.col("t"))).alias("unzigzag"), (F.crc32(F.lit(b"")) + 0).alias("crc"), fn.shown_number(F.col("v")).alias("shown"), fn.strict_double(F.col("v").cast("string")).alias("parsed"), fn.varint_size(F.col("t")).alias("varint"))
