"""The read-only report on one entity: eight steps assembled from the other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import Twin
from twinloom.operators import checks, graph

#: Texts of the report that callers rely on but for names (fixed values).
NO_EVENTS = "v0 limitation: no event store exists yet (discrete occurrences, Provenance::Event, are planned for a later phase); step 4 returns an empty list rather than inventing data"
SOURCE = "twinloom_diagnose_v0"
NOTE = f"provenance preserved: component/dependencies/topology/measurements are observed (relation records keep their own Fact/Observation/... class), expected values are specification, comparisons are observed-vs-specification; causal paths are hypotheses only — produced by {SOURCE}, never written to the database and never promoted to fact"


def diagnose(twin: Twin, entity: str, lo: int, hi: int) -> dict:
    """Component, dependencies, topology, events, measurements, checks, anomalies and hypotheses of an entity in a window.

    Each part is one small DataFrame over the whole stores; only rows of this
    entity come to the driver. An unknown entity has no component and empty
    lists. The event step is kept empty, with a note.
    """
    report = {
        "entity": entity, "window": {"from": lo, "to": hi}, "component": None, "dependencies": {"upstream": [], "downstream": []}, "topology": [], "events": [], "events_note": NO_EVENTS,
        "measurements": [], "checks": [], "anomalies": [], "causal_paths": [], "provenance_note": NOTE,
    }
    found = twin.entities.where(F.col("name") == entity).orderBy("key").limit(1).collect()
    if not found:
        return report
    own = found[0]
    report["component"] = {"key": own["key"], "name": own["name"], "type_name": own["type"], "props": [{"name": p["k"], "value": p["v"]} for p in own["props"]], "provenance": "observed"}
    keys = twin.spark.createDataFrame([(own["key"],)], "key bigint")
    for r in graph.cards(twin, keys).orderBy((F.col("direction") == "out"), "idx").collect():
        side = "downstream" if r["direction"] == "out" else "upstream"
        report["dependencies"][side].append({"key": r["other_key"], "name": r["other"], "type_name": r["other_type"], "relation_type": r["type"], "topology": r["topology"], "relation_provenance": r["provenance"], "valid_from": r["valid_from"], "valid_to": r["valid_to"]})
    both = report["dependencies"]["upstream"] + report["dependencies"]["downstream"]
    for topology in dict.fromkeys(d["topology"] for d in both):
        mine = [d for d in both if d["topology"] == topology]
        report["topology"].append({"topology": topology, "relation_types": list(dict.fromkeys(d["relation_type"] for d in mine)), "edge_count": len(mine), "provenance": "observed"})
    specified = {p["k"]: p["v"] for p in reversed(own["props"])}
    bound = F.lit(None).cast("string")
    for k, v in specified.items():
        bound = F.when(F.concat(F.lit("spec."), F.col("signal"), F.lit(".max")) == k, v).otherwise(bound)
    rows = checks.measurements(twin, entity, lo, hi).withColumn("text", bound).withColumn("expected", fn.strict_double(F.col("text"))).orderBy("ord", "series").collect()
    for r in rows:
        report["measurements"].append({"series": r["series"], "signal": r["signal"], "points": r["points"], "min": r["min"], "max": r["max"], "provenance": "observed"})
        if r["text"] is None:
            continue
        expected, observed = r["expected"], r["max"]
        status = "NO_SPEC" if expected is None else "NO_DATA" if observed is None else "VIOLATION" if observed > expected else "OK"
        deviation = observed - expected if expected is not None and observed is not None else None
        report["checks"].append({
            "signal": r["signal"], "status": status, "expected_max": expected, "expected_prov": None if expected is None else "Specification", "unit": specified.get(f"spec.{r['signal']}.unit"),
            "observed": observed, "observed_prov": None if observed is None else "Observation", "deviation": deviation, "points_checked": r["points"],
        })
        if status == "VIOLATION":
            report["anomalies"].append({"signal": r["signal"], "observed": observed, "expected_max": expected, "deviation": deviation, "points_checked": r["points"], "provenance": "observed"})
            report["causal_paths"].append({
                "signal": r["signal"], "hypothesis": f"signal {r['signal']} exceeded expected max over window [{lo}, {hi}]", "confidence": 0.5, "provenance": "Hypothesis", "source": SOURCE,
                "upstream": [d["name"] for d in report["dependencies"]["upstream"]],
            })
    return report
