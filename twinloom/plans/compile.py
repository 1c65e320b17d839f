"""Syntax trees to DataFrame plans.

A pattern becomes equi-joins entity - relation - entity; WHERE stands above
them and is pushed down by the optimizer. Telemetry is aggregated once by
series for the whole window, below the join with the bindings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import Twin
from twinloom.operators.checks import checked
from twinloom.plans.language import Check, Compare, Match


class ExecutionError(ValueError):
    """A statement that is of the language but can't be run."""


@dataclass(frozen=True)
class Bound:
    """Bindings: columns n0, n1, ... (structs of key, name, type, props) and r1, r2, ... (relations taken)."""

    df: DataFrame
    match: Match

    def first(self, var: str) -> Column | None:
        """The node that conditions and measures see: the first of that name."""
        return next((F.col(f"n{i}") for i, n in enumerate(self.match.nodes) if n.var == var), None)

    def shown(self) -> dict[str, Column]:
        """Named nodes; of a name that comes twice, the last."""
        return {n.var: F.col(f"n{i}") for i, n in enumerate(self.match.nodes) if n.var is not None}

    def order(self) -> list[Column]:
        return [F.col("n0.key"), *(F.col(f"r{i}") for i in range(1, len(self.match.nodes)))]


def _node(twin: Twin, kind: str, i: int) -> DataFrame:
    return twin.entities.where(F.col("type") == kind).select(F.col("key").alias(f"k{i}"), F.struct("key", "name", "type", "props").alias(f"n{i}"))


def _test(bound: Bound, c: Compare) -> Column:
    node = bound.first(c.var)
    if node is None:
        raise ExecutionError(f"unbound variable {c.var}")
    left = node[c.prop] if c.prop in ("name", "type") else F.coalesce(fn.prop(node["props"], c.prop), F.lit(""))
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    if isinstance(c.value, str):
        return ops[c.op](left, F.lit(c.value))
    number = fn.strict_double(left)
    # NaN is unequal to everything, and a text that is no number makes every comparison false
    return F.coalesce(F.when(F.isnan(number), F.lit(c.op == "!=")).otherwise(ops[c.op](number, F.lit(c.value))), F.lit(False))


def bind(twin: Twin, match: Match) -> Bound:
    """All bindings of the pattern that satisfy WHERE, without LIMIT."""
    df = _node(twin, match.nodes[0].type, 0)
    live = twin.live()
    if match.at is not None:
        live = live.where(fn.valid_at(F.col("valid_from"), F.col("valid_to"), match.at))
    for i, topology in enumerate(match.topologies, 1):
        hop = live.where(F.col("topology") == topology).select(F.col("src").alias(f"s{i}"), F.col("dst").alias(f"d{i}"), F.col("idx").alias(f"r{i}"))
        df = df.join(hop, F.col(f"k{i - 1}") == F.col(f"s{i}")).join(_node(twin, match.nodes[i].type, i), F.col(f"d{i}") == F.col(f"k{i}"))
    bound = Bound(df.select(*[f"n{i}" for i in range(len(match.nodes))], *[f"r{i}" for i in range(1, len(match.nodes))]), match)
    if match.where:
        either = None
        for both in match.where:
            test = None
            for c in both:
                test = _test(bound, c) if test is None else test & _test(bound, c)
            either = test if either is None else either | test
        bound = Bound(bound.df.where(either), match)
    return bound


def limited(df: DataFrame, bound: Bound) -> DataFrame:
    """The first LIMIT bindings, in the order of the first node's key and the relations taken."""
    return df if bound.match.limit is None else df.orderBy(*bound.order()).limit(bound.match.limit)


def measure(twin: Twin, bound: Bound) -> DataFrame:
    """Bindings with has_series and a column for each aggregate that is asked of the measured signal.

    Without a series has_series is false; a series without points in the
    window has null aggregates, but 0 for sum and count.
    """
    m = bound.match.measure
    kinds = list(dict.fromkeys(i.aggregate for i in bound.match.items if i.aggregate and m is not None and i.signal == m.signal))
    node = bound.first(m.var) if m is not None else None
    if node is None:
        return bound.df.withColumn("has_series", F.lit(False))
    sid = fn.series_id(fn.series_name(node["name"], m.signal))
    series = twin.series.where(F.endswith("name", F.lit(f".{m.signal}"))).select(F.col("sid").alias("_series")).distinct()
    points = twin.signal_points(m.signal, m.window.lo, m.window.hi).groupBy("sid").agg(*[fn.aggregate(k, F.col("v")).alias(k) for k in kinds] or [F.count(F.lit(1)).alias("_n")])
    df = bound.df.withColumn("_sid", sid).join(series, F.col("_sid") == F.col("_series"), "left").join(points, F.col("_series") == F.col("sid"), "left")
    has = F.col("_series").isNotNull()
    for k in kinds:
        if k in ("sum", "count"):
            df = df.withColumn(k, F.when(has, F.coalesce(k, F.lit(0.0))))
    return df.select(*bound.df.columns, has.alias("has_series"), *kinds)


def check_rows(twin: Twin, check: Check) -> DataFrame:
    """One row for each binding of the checked variable: the result's columns and the asked fields as strings f_<field>."""
    bound = bind(twin, check.match)
    node = bound.first(check.var)
    if node is None:
        return checked(twin, twin.entities.limit(0), check.signal, check.window.lo, check.window.hi)
    rows = bound.df.select(node["key"].alias("key"), node["name"].alias("name"), node["type"].alias("type"), node["props"].alias("props"))
    out = checked(twin, rows, check.signal, check.window.lo, check.window.hi)
    shown = {
        "status": F.col("status"), "expected": fn.shown_number(F.col("expected_max")), "observed": fn.shown_number(F.col("observed")), "deviation": fn.shown_number(F.col("deviation")),
        "entity": F.col("entity"), "name": F.col("entity"), "signal": F.col("signal"), "unit": F.coalesce("unit", F.lit("-")), "points": F.col("points_checked").cast("string"),
    }
    return out.select("*", *[shown[f].alias(f"f_{f}") for f in dict.fromkeys(check.fields)])
