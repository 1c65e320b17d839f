"""Machine packs: a JSON file of entities, relations, states, scenarios and alarm rules becomes a twin.

Scenario telemetry has three shapes: a wave around a base, a line through
way points, and a pulse train. A pack's noise lies in [-1, 0): the generator's
draws less one. Alarm events are computed from the points' crossings.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import SCHEMAS, Twin
from twinloom.operators.series import alarms
from twinloom.sources.generate import unit_noise

#: Points an ingest call takes, and the provenance of events (fixed values).
CALL, EVENT = 100, 5


def shape_values(spec: dict, start: int, every: int, n: int, seed: int) -> list[tuple[int, float]]:
    """The points (t, v) of one scenario series."""
    noise = (unit_noise(seed, n) - 1.0).tolist()
    times = [start + i * every for i in range(n)]
    lo, hi, digits = spec.get("min", -1e9), spec.get("max", 1e9), spec.get("dec", 2)
    if spec["shape"] == "wave":
        raw = [spec["base"] + spec["amp"] * math.sin(2.0 * math.pi * (float(t) % spec["period_s"]) / spec["period_s"]) + spec["noise"] * u for t, u in zip(times, noise, strict=True)]
    elif spec["shape"] == "waypoints":
        raw = [between(spec["points"], i / (n - 1)) + spec.get("noise", 0.0) * noise[i] for i in range(n)]
    elif spec["shape"] == "pulse":
        out = []
        for t, u in zip(times, noise, strict=True):
            phase = (float(t) % spec["period_s"]) / spec["period_s"]
            edge = 1.0 - spec["duty"] + spec.get("jitter", 0.0) * u / 2.5
            out.append((t, 1.0 if edge + spec["duty"] <= 1.0 and edge <= phase < edge + spec["duty"] else 0.0))
        return out
    else:
        raise ValueError(f"unknown shape {spec['shape']}")
    return [(t, round(min(max(v, lo), hi), digits)) for t, v in zip(times, raw, strict=True)]


def between(knots: list, at: float) -> float:
    """Linear interpolation through knots (place, value), constant beyond the ends."""
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        if at <= x1:
            return y0 if at <= x0 else y1 if x1 == x0 else y0 + (y1 - y0) * (at - x0) / (x1 - x0)
    return knots[-1][1] if at > knots[0][0] else knots[0][1]


def load(spark: SparkSession, path: str) -> Twin:
    """The twin of a pack, all scenarios in it."""
    return build(spark, json.loads(spark.read.text(path, wholetext=True).first()[0]))


def build(spark: SparkSession, pack: dict) -> Twin:
    entities = [(i, e["type"], e["name"], [(k, str(v)) for k, v in e.get("props", {}).items()]) for i, e in enumerate(pack["entities"])]
    keys = {e["name"]: i for i, e in enumerate(pack["entities"])}
    base = pack["ts_base"]
    relations = [(i, keys[r["from"]], keys[r["to"]], *r["type"].partition(":")[::2], base, -1, 0, False) for i, r in enumerate(pack["relations"])]
    states = [(s["entity"], s["key"], s["value"], base + s["offset_s"]) for s in pack.get("states_packbase", [])]
    logged, points, order = [], [], {}
    for i, scenario in enumerate(pack["demo_scenarios"]):
        start = scenario["ts_start"]
        states += [(s["entity"], s["key"], s["value"], start + s["offset_s"]) for s in scenario.get("states", [])]
        logged += [(e["name"], e["entity"], start + e["offset_s"], EVENT, e["details"]) for e in scenario.get("events", [])]
        for j, name in enumerate(sorted(scenario["signals"])):
            order.setdefault(name, len(order))
            made = shape_values(scenario["signals"][name], start, scenario["dt_s"], scenario["points_per_series"], i * 100 + j)
            points += [(name, i * 1000 + k // CALL, k, t, v, i) for k, (t, v) in enumerate(made)]
    raw = spark.createDataFrame(points, "name string, batch_id bigint, seq bigint, t bigint, v double, scenario int").withColumn("sid", fn.series_id(F.col("name")))
    series = spark.createDataFrame([(n, *n.partition(".")[::2], i) for n, i in order.items()], "name string, entity string, signal string, ord bigint").withColumn("sid", fn.series_id(F.col("name"))).select("sid", "name", "entity", "signal", "ord")
    rules = pack.get("alarm_rules", [])
    events = spark.createDataFrame([(i, *e) for i, e in enumerate(logged)], SCHEMAS["events"])
    if rules:
        watch = spark.createDataFrame([(r["series"], r["entity"], r["name"], float(r["threshold"]), r["detail"], r["detail_clear"]) for r in rules], "series string, entity string, name string, threshold double, detail string, detail_clear string")
        # every scenario is an hour of its own: crossings don't reach from one into the next
        for i in range(len(pack["demo_scenarios"])):
            found = alarms(raw.where(F.col("scenario") == i).select("sid", "batch_id", "seq", "t", "v"), watch)
            events = events.unionByName(found.select((F.lit(1_000_000 * (i + 1)) + F.monotonically_increasing_id()).alias("seq"), "name", "entity", "ts", F.lit(EVENT).alias("provenance"), "details"))
    return Twin.of(spark, entities=entities, relations=relations, series=series, points=raw.select("sid", "batch_id", "seq", "t", "v"), states=[(i, *s) for i, s in enumerate(states)], events=events)


def verify(twin: Twin, pack: dict, verdicts: dict[str, dict[tuple[str, str], str]] | None = None, seconds: int = 3600) -> list[tuple[str, bool, str]]:
    """Reads a loaded pack back: (what, whether it holds, what was found) for each part.

    The schema holds the pack's types, topologies and series; every relation
    is found by a pattern of its ends; every scenario has its points in its
    window. verdicts: the planned status by scenario and (entity, signal).
    """
    from twinloom.operators import checks, graph, series
    from twinloom.plans import bind, parse

    out: list[tuple[str, bool, str]] = []

    def note(what: str, need: set, have: set) -> None:
        out.append((what, need <= have, f"missing {sorted(need - have)}" if need - have else f"{len(need)} found"))

    note("types", {e["type"] for e in pack["entities"]}, {r[0] for r in graph.entity_types(twin).collect()})
    note("topologies", {r["type"].partition(":")[0] for r in pack["relations"]}, {r[0] for r in graph.topologies(twin).collect()})
    note("series", {n for s in pack["demo_scenarios"] for n in s["signals"]}, {r["name"] for r in twin.series.collect()})
    kinds = {e["name"]: e["type"] for e in pack["entities"]}
    patterns: dict[tuple[str, str, str], int] = {}
    for r in pack["relations"]:
        key = (kinds[r["from"]], r["type"].partition(":")[0], kinds[r["to"]])
        patterns[key] = patterns.get(key, 0) + 1
    for (a, topology, b), n in patterns.items():
        found = bind(twin, parse(f"MATCH (a:{a})-[:{topology}]->(b:{b}) RETURN a")).df.count()
        out.append((f"{a} -{topology}-> {b}", found == n, f"{found} of {n}"))
    for scenario in pack["demo_scenarios"]:
        lo = scenario["ts_start"]
        counts = {r["name"]: r["count"] for r in series.statistics(twin, lo, lo + seconds).collect()}
        for name in scenario["signals"]:
            out.append((f"{scenario['name']}: {name}", counts.get(name) == scenario["points_per_series"], f"{counts.get(name)} points"))
        for (entity, signal), planned in (verdicts or {}).get(scenario["name"], {}).items():
            r = checks.checked(twin, twin.entities.where(F.col("name") == entity), signal, lo, lo + seconds).first()
            out.append((f"{scenario['name']}: {entity}.{signal} is {planned}", r is not None and r["status"] == planned, f"{r['status'] if r else None}, observed {r['observed'] if r else None}"))
    return out
