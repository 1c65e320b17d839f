"""The method surface: named calls over one twin that return JSON-shaped results.

Reads run as DataFrame jobs over the opened snapshot. Writes need the writer
or ingest role and a Store; they are checked as a whole before anything is
written and committed in one step. Every call is audited, refused ones too.
Semantic errors are results of the form {"error": text}; a refused write
raises WriteForbidden.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import CHUNK, EARLIEST, LATEST, PROVENANCE, Twin
from twinloom.operators import checks, diagnosis, graph, series, states
from twinloom.plans import ExecutionError, ParseError, bind, check_rows, measure, parse, parse_check, parse_temporal
from twinloom.plans.compile import limited
from twinloom.sources.store import Conflict, Store

#: Limits of names and inline props in bytes, and the code of a refused write (fixed values).
NAME_MAX, PROPS_MAX, FORBIDDEN = 23, 44, -32003
WRITERS = ("writer", "ingest")
SOURCES = {"plc": 0, "agent": 1, "sensor": 1}


class WriteForbidden(PermissionError):
    """A write was asked of a reader."""


def summary(node: Row) -> dict:
    return {"key": node["key"], "name": node["name"], "type": node["type"], "properties": {p["k"]: p["v"] for p in node["props"] or []}}


def failure(text: str) -> dict:
    return {"error": text}


#: How often a write starts again when others commit before it does.
ATTEMPTS = 8


def write(method: Callable) -> Callable:
    """A method that starts again from the latest snapshot if another writer has committed meanwhile; it is audited once."""
    @functools.wraps(method)
    def again(self: Agent, *args, **named):  # noqa: ANN202
        for left in reversed(range(ATTEMPTS)):
            noted = len(self.entries)
            try:
                return method(self, *args, **named)
            except Conflict:
                if not left:
                    raise
                del self.entries[noted:]
                self.refresh()

    return again


class Agent:
    """One caller of one twin, or of a stored twin."""

    def __init__(self, source: Twin | Store, agent_id: str = "agent", role: str = "reader", clock: Callable[[], float] = time.time, strict_limits: bool = True) -> None:
        if role not in ("reader", *WRITERS):
            raise ValueError(f"unknown role {role}")
        self.store = source if isinstance(source, Store) else None
        self.twin = source.twin() if isinstance(source, Store) else source
        self.agent_id, self.role, self.clock, self.strict = agent_id, role, clock, strict_limits
        self.entries: list[dict] = []

    def now(self) -> int:
        return int(self.clock())

    def _note(self, method: str, text: str = "") -> None:
        self.entries.append({"timestamp": self.now(), "agent_id": self.agent_id, "method": method, "params_summary": text})

    def _writing(self, method: str) -> Store:
        if self.role not in WRITERS:
            self._note(method, f"REFUSED (role=Reader, write forbidden {FORBIDDEN})")
            raise WriteForbidden(f"write forbidden ({FORBIDDEN}): agent '{self.agent_id}' holds role Reader; ingestion of telemetry and topology requires the role writer or ingest. The attempt is recorded in the audit trail.")
        if self.store is None:
            raise ValueError("this twin is not stored")
        return self.store

    def _committed(self) -> None:
        self.twin = self.store.twin()

    def refresh(self) -> None:
        """Opens the latest snapshot."""
        if self.store is not None:
            self.store.refresh()
            self._committed()

    def _key(self, name: str) -> int | None:
        return self.twin.entities.where(F.col("name") == name).agg(F.min("key")).first()[0]

    # ---- inventory -------------------------------------------------------------

    def schema(self) -> dict:
        self._note("schema")
        names = lambda df: sorted(r[0] for r in df.collect())
        listed = self.twin.series.orderBy("ord", "name").select("name").collect()
        return {"entity_types": names(graph.entity_types(self.twin)), "relation_topologies": names(graph.topologies(self.twin)), "series": [r[0] for r in listed], "provenance_classes": list(PROVENANCE)}

    def list_entities(self, type: str | None = None, limit: int = 0) -> dict:
        self._note("list_entities", f"type={type or '(any)'} limit={limit or 'none'}")
        rows = graph.list_entities(self.twin, type)
        total = rows.count()
        shown = rows.orderBy("key").limit(limit) if limit else rows.orderBy("key")
        return {"entities": [r.asDict() for r in shown.collect()], "total": total, "entities_in_db": self.twin.entities.count(), "truncated": bool(limit) and total > limit}

    def graph(self, limit: int = 0) -> dict:
        self._note("graph", f"limit={limit}")
        rows = graph.graph_edges(self.twin)
        total = rows.count()
        shown = rows.orderBy("idx").limit(limit) if limit else rows.orderBy("idx")
        entities = graph.list_entities(self.twin).orderBy("key").collect()
        return {"entities": [r.asDict() for r in entities], "relations": [r.asDict() for r in shown.drop("idx").collect()], "relations_total": total, "truncated": bool(limit) and total > limit}

    def get_entity(self, key: int) -> dict:
        self._note("get_entity", f"key={key}")
        found = self.twin.entities.where(F.col("key") == key).collect()
        if not found:
            return failure(f"unknown entity key {key}")
        rows = graph.cards(self.twin, self.twin.spark.createDataFrame([(key,)], "key bigint")).orderBy("idx").collect()
        side = lambda d, end: [{"relation_idx": r["idx"], "type": r["type"], "topology": r["topology"], end: r["other"], "provenance": r["provenance"], "valid_from": r["valid_from"], "valid_to": r["valid_to"]} for r in rows if r["direction"] == d]
        return summary(found[0]) | {"relations_out": side("out", "to"), "relations_in": side("in", "from")}

    def provenance(self) -> dict:
        self._note("provenance")
        classes = ", ".join(f"{p}={i}" for i, p in enumerate(PROVENANCE))
        if self.role in WRITERS:
            right = "This agent holds a WRITING role: what it ingests enters as Fact (source plc) or Observation (source agent/sensor), never as Hypothesis; set_hypothesis stays refused for every role."
        else:
            right = "This agent holds the Reader role: every write is refused and audited, so every value keeps the provenance recorded at ingestion."
        rows = graph.provenance_relations(self.twin).orderBy("relation_idx").collect()
        return {"note": f"Provenance classes: {classes}. Hypothesis is never promoted to Fact/Observation. {right}", "provenance_classes": list(PROVENANCE), "relations": [r.asDict() for r in rows]}

    # ---- queries ---------------------------------------------------------------

    def _rows(self, df: DataFrame, shown: dict[str, Column], more: Sequence[str] = ()) -> list[Row]:
        return df.select(*[c.alias(f"v_{v}") for v, c in shown.items()], *more).collect()

    def query(self, vql: str, project_return: bool = False) -> dict:
        """All named nodes of each binding; with project_return only those that RETURN names."""
        self._note("query", vql)
        try:
            bound = bind(self.twin, parse(vql))
        except ParseError as e:
            return failure(f"parse error: {e}")
        except ExecutionError as e:
            return failure(f"execution error: {e}")
        asked = {i.var for i in bound.match.items}
        shown = {v: c for v, c in bound.shown().items() if not project_return or v in asked}
        rows = self._rows(limited(bound.df, bound).orderBy(*bound.order()), shown)
        return {"rows": [{v: summary(r[f"v_{v}"]) for v in shown} for r in rows], "n": len(rows)}

    def query_temporal(self, vql: str, now: int | None = None, parity: bool = False) -> dict:
        """As query(), with {kind, value} of each aggregate; parity ignores LIMIT beside MEASURE."""
        self._note("query_temporal", vql)
        try:
            match = parse_temporal(vql, self.now() if now is None else now)
            bound = bind(self.twin, match)
        except ParseError as e:
            return failure(f"parse error: {e}")
        except ExecutionError as e:
            return failure(f"execution error: {e}")
        keep = bound.df if parity and match.measure is not None else limited(bound.df, bound)
        df = measure(self.twin, type(bound)(keep, match))
        kinds = [c for c in ("max", "min", "avg", "sum", "count") if c in df.columns]
        shown = bound.shown()
        rows = self._rows(df.orderBy(*bound.order()), shown, ["has_series", *kinds])
        order = list(dict.fromkeys(i.aggregate for i in match.items if i.aggregate in kinds))
        out = []
        for r in rows:
            aggs = {k: {"kind": k.capitalize(), "value": r[k]} for k in order} if r["has_series"] else {}
            out.append({v: summary(r[f"v_{v}"]) for v in shown} | aggs)
        return {"rows": out, "n": len(out)}

    def check_statement(self, text: str, now: int | None = None) -> list[dict]:
        """The asked fields of a CHECK statement as strings, a dict for each binding."""
        self._note("check_statement", text)
        statement = parse_check(text, self.now() if now is None else now)
        rows = check_rows(self.twin, statement).orderBy("key").collect()
        return [{f: r[f"f_{f}"] for f in statement.fields} for r in rows]

    # ---- telemetry -------------------------------------------------------------

    def _has_series(self, name: str) -> bool:
        return not self.twin.series.where(F.col("name") == name).isEmpty()

    def get_measurements(self, entity: str, signal: str, from_: int = 0, to: int = LATEST) -> dict:
        self._note("get_measurements", f"entity={entity} signal={signal} [{from_}..{to}]")
        name = f"{entity}.{signal}"
        if not self._has_series(name):
            return failure(f"no series named '{name}'")
        rows = series.scan(self.twin, name, from_, to).collect()
        real = [r["v"] for r in rows if r["v"] == r["v"]]
        return {"points": [{"t": r["t"], "value": r["v"]} for r in rows], "count": len(rows), "min": min(real, default=None), "max": max(real, default=None)}

    def check(self, entity: str, signal: str, from_: int = 0, to: int = LATEST) -> dict:
        self._note("check", f"entity={entity} signal={signal} [{from_}..{to}]")
        key = self._key(entity)
        if key is None:
            return failure(f"unknown entity '{entity}'")
        r = checks.checked(self.twin, self.twin.entities.where(F.col("key") == key), signal, from_, to).first()
        return {
            "entity": r["entity"], "signal": signal, "status": r["status"], "expected_max": r["expected_max"], "observed": r["observed"], "deviation": r["deviation"], "unit": r["unit"],
            "expected_provenance": None if r["expected_max"] is None else "Specification", "observed_provenance": None if r["observed"] is None else "Observation",
            "points_checked": r["points_checked"], "window": {"from": from_, "to": to},
        }

    def diagnose(self, entity: str, from_: int = 0, to: int = LATEST) -> dict:
        self._note("diagnose", f"entity={entity} window=[{from_},{to}]")
        return diagnosis.diagnose(self.twin, entity, from_, to)

    def trace(self, from_: str, to: str, max_hops: int = 6) -> dict:
        self._note("trace", f"from={from_} to={to} max_hops={max_hops}")
        ends = []
        for name in (from_, to):
            key = self._key(name)
            if key is None:
                return failure(f"unknown entity '{name}'")
            ends.append(key)
        spark = self.twin.spark
        frames = [spark.createDataFrame([(k,)], "key bigint") for k in ends]
        path = graph.trace(self.twin, *frames, max(0, min(255, max_hops)))
        if not path.take(1):
            return {"found": False, "steps": [], "path": []}
        rows = graph.steps(self.twin, path).collect()
        keys = [ends[0], *(r["dst"] for r in rows)]
        cards = {r["key"]: summary(r) for r in self.twin.entities.where(F.col("key").isin(keys)).collect()}
        out = {"found": True, "steps": [{k: r[k] for k in ("from", "relation_type", "topology", "to", "provenance", "relation_idx")} for r in rows], "path": [cards[k] for k in keys]}
        return out | {"n_hops": len(rows)} if rows else out

    # ---- states and events -----------------------------------------------------

    def get_state(self, entity: str, key: str, at: int | None = None) -> dict | None:
        self._note("get_state", f"entity={entity} key={key} at={'now' if at is None else at}")
        only = self.twin.using(states=self.twin.states.where((F.col("entity") == entity) & (F.col("key") == key)))
        r = states.at(only, self.now() if at is None else at).first()
        return None if r is None else {"value": r["value"], "valid_from": r["valid_from"]}

    def state_history(self, entity: str, key: str) -> dict:
        self._note("state_history", f"entity={entity} key={key}")
        rows = [r.asDict() for r in states.history(self.twin, entity, key).collect()]
        return {"history": rows, "n": len(rows)}

    def get_events(self, entity: str | None = None, from_: int = EARLIEST, to: int = LATEST) -> dict:
        self._note("get_events", f"entity={entity or '*'} [{from_}..{to}]")
        rows = states.events(self.twin, entity, from_, to).orderBy("timestamp", "seq").drop("seq").collect()
        return {"events": [r.asDict() for r in rows], "n": len(rows)}

    def audit(self) -> dict:
        self._note("audit_log")
        return {"entries": list(self.entries), "n": len(self.entries)}

    # ---- writes ----------------------------------------------------------------

    def set_hypothesis(self, entity: str, text: str) -> dict:
        self._note("set_hypothesis", "REFUSED (no hypothesis write in any role)")
        return failure("refused: no agent role may write a hypothesis; a hypothesis must never be promoted to fact by the engine or by an agent")

    @write
    def ingest_points(self, entity: str, signal: str, points: Sequence[tuple[int, float]]) -> dict:
        store = self._writing("ingest_points")
        self._note("ingest_points", f"entity={entity} signal={signal} n={len(points)}")
        name = f"{entity}.{signal}"
        size = len(name.encode())
        known = self._has_series(name)
        if not known and self.strict and size > NAME_MAX:
            return failure(f"series name '{name}' too long ({size} > {NAME_MAX} bytes)")
        spark, version = self.twin.spark, store.manifest["version"] + 1
        rows = spark.createDataFrame([(name, version, i, int(t), float(v)) for i, (t, v) in enumerate(points)], "name string, batch_id bigint, seq bigint, t bigint, v double")
        tables = {"points": rows.select(fn.series_id(F.col("name")).alias("sid"), "batch_id", "seq", "t", "v")}
        if not known:
            first, _, rest = name.partition(".")
            made = spark.createDataFrame([(name, first, rest, self.twin.series.count())], "name string, entity string, signal string, ord bigint")
            tables["series"] = made.select(fn.series_id(F.col("name")).alias("sid"), "name", "entity", "signal", "ord")
        store.commit(**tables)
        self._committed()
        return {"accepted": len(points), "chunks_flushed": -(-len(points) // CHUNK), "series_id": self.twin.series.where(F.col("name") == name).first()["ord"]}

    @write
    def upsert_entity(self, name: str, type: str, props: Sequence[tuple[str, str | None]] = (), relations: Sequence[tuple[str, str, int | None]] = (), source: str = "plc") -> dict:
        """relations: (target's name, 'topology:type', valid_from or None)."""
        store = self._writing("upsert_entity")
        self._note("upsert_entity", f"name={name} type={type} props={len(props)} relations={len(relations)} source={source}")
        if source not in SOURCES:
            return failure(f"unknown source '{source}' (expected \"plc\" | \"agent\" | \"sensor\")")
        if not name or not type:
            return failure("name and type must be non-empty")
        key = self._key(name)
        old = self.twin.entities.where(F.col("key") == key).first() if key is not None else None
        merged: dict[str, str] = {}
        for p in old["props"] if old else []:
            merged.setdefault(p["k"], p["v"])
        for k, v in props:
            merged[k] = v if v is not None else merged.get(k, "")
        size = sum(len(k.encode()) + len(v.encode()) + 2 for k, v in merged.items())
        if self.strict and size > PROPS_MAX:
            return failure(f"merged properties exceed the inline cap ({size} > {PROPS_MAX} bytes) — drop props or store them as telemetry")
        targets = self._targets([to for to, _, _ in relations])
        for to, kind, _ in relations:
            topology, colon, rest = kind.partition(":")
            if not (topology and colon and rest):
                return failure(f"relation_type '{kind}' must be 'topology:type' (e.g. 'electrical:feeds')")
            if to == name if key is None else targets.get(to) == key:
                return failure("self-relations are not supported")
            if to not in targets:
                return failure(f"relation target '{to}' does not exist — create it first (an ingest agent never invents endpoints)")
        created = key is None
        if created:
            last = self.twin.entities.agg(F.max("key")).first()[0]
            key = 0 if last is None else last + 1
        linked = {(min(r["src"], r["dst"]), max(r["src"], r["dst"]), r["topology"], r["rel_type"]) for r in self.twin.live().where((F.col("src") == key) | (F.col("dst") == key)).collect()}
        last = self.twin.relations.agg(F.max("idx")).first()[0] if relations else None
        fresh = []
        for to, kind, since in relations:
            topology, _, rest = kind.partition(":")
            link = (min(key, targets[to]), max(key, targets[to]), topology, rest)
            if link not in linked:
                linked.add(link)
                fresh.append(((-1 if last is None else last) + 1 + len(fresh), key, targets[to], topology, rest, since or 0, -1, SOURCES[source], False))
        tables: dict = {"entities": [(key, old["type"] if old else type, name, list(merged.items()))]}
        if fresh:
            tables["relations"] = fresh
        store.commit(**tables)
        self._committed()
        return {"key": key, "created": created, "relations_added": len(fresh)}

    def _targets(self, names: Sequence[str]) -> dict[str, int]:
        if not names:
            return {}
        return {r["name"]: r["key"] for r in self.twin.entities.where(F.col("name").isin(list(names))).groupBy("name").agg(F.min("key").alias("key")).collect()}

    @write
    def remove_relation(self, idx: int) -> None:
        """Marks a relation as removed; not a method of the wire."""
        store = self._writing("remove_relation")
        self._note("remove_relation", f"idx={idx}")
        store.commit(relations=self.twin.relations.where(F.col("idx") == idx).withColumn("dead", F.lit(True)))
        self._committed()

    @write
    def set_state(self, entity: str, key: str, value: str, at: int | None = None) -> dict:
        store = self._writing("set_state")
        at = self.now() if at is None else at
        self._note("set_state", f"entity={entity} key={key} at={at}")
        store.commit(states=[(store.manifest["version"] + 1, entity, key, value, at)])
        self._committed()
        return {"set": True, "entity": entity, "key": key}

    @write
    def log_event(self, name: str, entity: str, timestamp: int | None = None, provenance: int = 1, details: str = "") -> dict:
        store = self._writing("log_event")
        timestamp = self.now() if timestamp is None else timestamp
        self._note("log_event", f"{name} on {entity} at {timestamp} (prov={provenance % 256})")
        short = details.encode()[:20].decode(errors="ignore")
        store.commit(events=[(store.manifest["version"] + 1, name, entity, timestamp, provenance % 256, short)])
        self._committed()
        return {"logged": True, "event": name, "entity": entity}

    @write
    def retain(self, before: int | None = None) -> dict:
        store = self._writing("retain")
        before = self.now() if before is None else before
        self._note("retain", f"before={before}")
        gone = series.expired(self.twin, before).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("points"), F.count(F.lit(1)).alias("chunks")).first()
        if gone["chunks"]:
            store.commit(replace=True, points=series.retained(self.twin, before))
            self._committed()
        return {"points_removed": gone["points"], "chunks_removed": gone["chunks"]}
