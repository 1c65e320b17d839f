"""Scalar expressions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F
from twinloom import functions as fn


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_strict_double(spark):
    good = ["1", "-2.5", "+3", ".5", "5.", "1e3", "-1.5E-2", "inf", "-Infinity", "+inf"]
    assert column(spark, good, "string", fn.strict_double) == [float(x) for x in good]
    assert math.isnan(column(spark, ["NaN"], "string", fn.strict_double)[0])
    assert column(spark, ["", " 3 ", "3d", "3f", "0x1p3", "1,5", "e5", ".", "1e", "--1", None], "string", fn.strict_double) == [None] * 11


def test_clipped_keeps_characters(spark):
    texts = ["short", "x" * 30, "é" * 15, "a" * 19 + "é", "a" * 18 + "é", "", None]
    want = [t if t is None else t.encode()[:20].decode(errors="ignore") for t in texts]
    assert column(spark, texts, "string", fn.clipped) == want


def test_shown_number(spark):
    assert column(spark, [10.0, 2.5, -3.0, 0.0001, None, 1e16], "double", fn.shown_number)[:3] == ["10", "2.5", "-3"]
    assert column(spark, [None], "double", fn.shown_number) == ["-"]
    assert "E" not in column(spark, [0.0001234], "double", fn.shown_number)[0]


def test_topology_and_props(spark):
    assert column(spark, ["a:b:c", "plain", ":x"], "string", fn.topology_of) == ["a", "", ""]
    assert column(spark, ["a:b:c", "plain", ":x"], "string", fn.type_of) == ["b:c", "plain", "x"]
    got = column(spark, ["k=v\0a=b=c\0bare\0"], "string", fn.decoded_props)[0]
    assert [(p["k"], p["v"]) for p in got] == [("k", "v"), ("a", "b=c"), ("bare", "")]


def test_integers(spark):
    values = [0, 1, -1, 63, -64, 127, 128, 2**40, -(2**40), 2**62]
    assert column(spark, values, "bigint", lambda c: fn.unzigzag(fn.zigzag(c))) == values
    assert column(spark, [0, -1, 1, -2], "bigint", fn.zigzag) == [0, 1, 2, 3]
    assert column(spark, [0, 1, 127, 128, 16383, 16384, 2**35 - 1], "bigint", fn.varint_size) == [1, 1, 1, 2, 2, 3, 5]
    assert column(spark, [0], "bigint", fn.ua_ticks) == [116_444_736_000_000_000]


@pytest.mark.parametrize(("unit", "code"), [("A", 267608), ("°C", 259827), ("kg", 100 + sum(b"kg")), ("", 100)])
def test_unit_code(spark, unit, code):
    assert column(spark, [unit], "string", fn.unit_code) == [code]


def test_provenance(spark):
    assert column(spark, [0, 4, 7, 9], "int", fn.provenance_name) == ["Fact", "Hypothesis", "Configuration", "Unknown"]
    assert column(spark, ["plc", "sensor", "x"], "string", fn.source_provenance) == [0, 1, None]


def test_aggregates_skip_nan(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    r = rows.agg(*[fn.aggregate(k, F.col("v")).alias(k) for k in ("max", "min", "count")]).first()
    assert (r["max"], r["min"], r["count"]) == (3.0, 1.0, 3.0)
    empty = rows.where("false").agg(*[fn.aggregate(k, F.col("v")).alias(k) for k in ("max", "avg", "sum", "count")]).first()
    assert tuple(empty) == (None, None, 0.0, 0.0)
