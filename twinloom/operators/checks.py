"""Expected against observed: the deviation check of any number of entities at once, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import Twin


def checked(twin: Twin, entities: DataFrame, signal: str, lo: int, hi: int) -> DataFrame:
    """key, entity, signal, status, expected_max, observed, deviation, unit, points_checked of each row of entities.

    NO_SPEC (no bound, or none that is a number) comes before NO_DATA, then
    VIOLATION (observed above the bound) and OK. One pass over the window's
    points yields maxima and counts of all series.
    """
    points = twin.signal_points(signal, lo, hi).groupBy("sid").agg(fn.aggregate("max", F.col("v")).alias("observed"), F.count(F.lit(1)).alias("_n"))
    rows = entities.select("key", F.col("name").alias("entity"), F.lit(signal).alias("signal"), fn.strict_double(fn.prop(F.col("props"), f"spec.{signal}.max")).alias("expected_max"), fn.prop(F.col("props"), f"spec.{signal}.unit").alias("unit"), fn.series_id(fn.series_name(F.col("name"), signal)).alias("_sid"))
    out = rows.join(points, F.col("_sid") == F.col("sid"), "left")
    status = F.when(F.col("expected_max").isNull(), "NO_SPEC").when(F.col("observed").isNull(), "NO_DATA").when(F.col("observed") > F.col("expected_max"), "VIOLATION").otherwise("OK")
    return out.select("key", "entity", "signal", status.alias("status"), "expected_max", "observed", (F.col("observed") - F.col("expected_max")).alias("deviation"), "unit", F.coalesce("_n", F.lit(0)).alias("points_checked"))


def violations(twin: Twin, signal: str) -> DataFrame:
    """entity, t, v, expected_max of every single point above its entity's bound."""
    bounds = twin.entities.select(F.col("name").alias("entity"), fn.strict_double(fn.prop(F.col("props"), f"spec.{signal}.max")).alias("expected_max"), fn.series_id(fn.series_name(F.col("name"), signal)).alias("sid")).where("expected_max is not null")
    return twin.points.join(bounds, "sid").where((F.col("v") > F.col("expected_max")) & ~F.isnan("v")).select("entity", "t", "v", "expected_max")


def measurements(twin: Twin, entity: str, lo: int, hi: int) -> DataFrame:
    """series, signal, ord, points, min, max of every series whose name begins with the entity's and a dot."""
    own = twin.series.where(F.startswith("name", F.lit(f"{entity}."))).select("sid", F.col("name").alias("series"), F.substring("name", len(entity) + 2, 1 << 30).alias("signal"), "ord")
    points = twin.points_in(lo, hi).join(own.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.count(F.lit(1)).alias("points"), fn.aggregate("min", F.col("v")).alias("min"), fn.aggregate("max", F.col("v")).alias("max"))
    return own.join(points, "sid", "left").select("series", "signal", "ord", F.coalesce("points", F.lit(0)).alias("points"), "min", "max")


def specification_checks(twin: Twin, lo: int, hi: int) -> DataFrame:
    """The check of every (entity, signal) that has both a bound among its props and a series; columns as checked()."""
    bounds = twin.entities.select("key", F.col("name").alias("entity"), F.explode("props").alias("p"), "props").where(F.col("p.k").startswith("spec.") & F.col("p.k").endswith(".max"))
    signal = F.expr("substring(p.k, 6, length(p.k) - 9)")
    bounds = bounds.select("key", "entity", signal.alias("signal"), "props").distinct()
    first = lambda suffix: F.try_element_at(F.filter("props", lambda p: p["k"] == F.concat(F.lit("spec."), F.col("signal"), F.lit(suffix))), F.lit(1))["v"]
    bounds = bounds.select("key", "entity", "signal", fn.strict_double(first(".max")).alias("expected_max"), first(".unit").alias("unit"), fn.series_id(fn.series_name(F.col("entity"), F.col("signal"))).alias("sid"))
    points = twin.points_in(lo, hi).groupBy("sid").agg(fn.aggregate("max", F.col("v")).alias("observed"), F.count(F.lit(1)).alias("_n"))
    out = bounds.join(twin.series.select("sid").distinct(), "sid", "left_semi").join(points, "sid", "left")
    status = F.when(F.col("expected_max").isNull(), "NO_SPEC").when(F.col("observed").isNull(), "NO_DATA").when(F.col("observed") > F.col("expected_max"), "VIOLATION").otherwise("OK")
    return out.select("key", "entity", "signal", status.alias("status"), "expected_max", "observed", (F.col("observed") - F.col("expected_max")).alias("deviation"), "unit", F.coalesce("_n", F.lit(0)).alias("points_checked"))


def anomalies(twin: Twin, lo: int, hi: int) -> DataFrame:
    """The violations among specification_checks()."""
    return specification_checks(twin, lo, hi).where("status = 'VIOLATION'")


def units(twin: Twin) -> DataFrame:
    """series, unit, code of every series whose entity declares the unit of its signal."""
    declared = twin.entities.select("name", F.explode("props").alias("p")).where(F.col("p.k").startswith("spec.") & F.col("p.k").endswith(".unit"))
    declared = declared.select(fn.series_name(F.col("name"), F.expr("substring(p.k, 6, length(p.k) - 10)")).alias("series"), F.col("p.v").alias("unit"))
    return declared.join(twin.series.select(F.col("name").alias("series")).distinct(), "series", "left_semi").select("series", "unit", fn.unit_code(F.col("unit")).cast("bigint").alias("code"))
