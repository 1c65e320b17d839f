"""Small twins for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from twinloom import functions as fn
from twinloom.model import Twin

NOW = 1_760_000_000


def make(spark, entities=(), relations=(), points=None, states=(), events=()) -> Twin:
    """entities: (type, name, props); relations: (from, to, 'topology:type', valid_from, valid_to, provenance); points: series -> [(t, v)]."""
    keys = {name: i for i, (_, name, _) in enumerate(entities)}
    rows = {
        "entities": [(i, kind, name, list(props.items())) for i, (kind, name, props) in enumerate(entities)],
        "relations": [(i, keys[a], keys[b], *kind.partition(":")[::2], lo, hi, p, False) for i, (a, b, kind, lo, hi, p) in enumerate(relations)],
        "states": [(i, *s) for i, s in enumerate(states)],
        "events": [(i, *e) for i, e in enumerate(events)],
    }
    if points:
        named = spark.createDataFrame([(n, *n.partition(".")[::2], i) for i, n in enumerate(points)], "name string, entity string, signal string, ord bigint")
        rows["series"] = named.select(fn.series_id(F.col("name")).alias("sid"), "name", "entity", "signal", "ord")
        flat = spark.createDataFrame([(n, 0, i, t, float(v)) for n, p in points.items() for i, (t, v) in enumerate(p)], "name string, batch_id bigint, seq bigint, t bigint, v double")
        rows["points"] = flat.select(fn.series_id(F.col("name")).alias("sid"), "batch_id", "seq", "t", "v")
    return Twin.of(spark, **rows)


CHAIN = [("PLC01", "Drive12", "network:profinet", 0, -1, 0), ("Drive12", "Motor42", "electrical:feeds", 0, -1, 0), ("Motor42", "Pump17", "mechanical:drives", 0, -1, 1)]


def machine(spark, motor=None, points=None, **more) -> Twin:
    entities = [("PLC", "PLC01", {"vendor": "Siemens"}), ("Drive", "Drive12", {}), ("Motor", "Motor42", motor or {"spec.current.max": "10", "spec.current.unit": "A"}), ("Pump", "Pump17", {"pressure": "183"})]
    return make(spark, entities, CHAIN, points, **more)
