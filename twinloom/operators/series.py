"""Telemetry: scans, statistics, chunks, retention, latest values and threshold crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinloom import functions as fn
from twinloom.model import CHUNK, Twin
from twinloom.operators.windows import SPAN, neighbours


def scan(twin: Twin, name: str, lo: int, hi: int) -> DataFrame:
    """t, v of one series in a window with both ends, in order of time, then of appending."""
    return twin.points_in(lo, hi).where(F.col("sid") == fn.series_id(F.lit(name))).orderBy("t", "batch_id", "seq").select("t", "v")


def statistics(twin: Twin, lo: int, hi: int) -> DataFrame:
    """name, count, sum, min, max of every series in a window; 0, 0, null, null for one without points there."""
    got = twin.points_in(lo, hi).groupBy("sid").agg(F.count(F.lit(1)).alias("count"), F.sum("v").alias("sum"), fn.aggregate("min", F.col("v")).alias("min"), fn.aggregate("max", F.col("v")).alias("max"))
    return twin.series.select("sid", "name").join(got, "sid", "left").select("name", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sum", F.lit(0.0)).alias("sum"), "min", "max")


def chunked(twin: Twin, size: int = CHUNK) -> DataFrame:
    """Points with the number of their chunk in their batch."""
    placed = neighbours(twin.points, ["sid", "batch_id"], F.floor(F.col("seq") / SPAN), ["seq"], F.lit(0))
    return placed.withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n", "_last")


def chunks(twin: Twin, size: int = CHUNK) -> DataFrame:
    """sid, batch_id, chunk, t0, t_end, count, min, max: each batch of a series cut into runs of size points as appended.

    t0 and t_end are the first and last point appended, as in a file of
    chunks; for points appended in order of time they bound the chunk.
    """
    rows = chunked(twin, size)
    return rows.groupBy("sid", "batch_id", "chunk").agg(F.min_by("t", "seq").alias("t0"), F.max_by("t", "seq").alias("t_end"), F.count(F.lit(1)).alias("count"), fn.aggregate("min", F.col("v")).alias("min"), fn.aggregate("max", F.col("v")).alias("max"))


def chunk_statistics(twin: Twin, size: int = CHUNK) -> DataFrame:
    """sid, chunks, count, min, max by series, from the chunks' records alone."""
    return chunks(twin, size).groupBy("sid").agg(F.count(F.lit(1)).alias("chunks"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def expired(twin: Twin, before: int, size: int = CHUNK) -> DataFrame:
    """The chunks that retention drops: of each series the leading run that ends before the instant; one that straddles it stays."""
    run = Window.partitionBy("sid").orderBy("batch_id", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    return chunks(twin, size).withColumn("_kept", F.max((F.col("t_end") >= before).cast("int")).over(run)).where("_kept = 0").drop("_kept")


def overdue(twin: Twin, before: int, size: int = CHUNK) -> DataFrame:
    """All chunks that end before the instant, those behind a later one of their series too (which only points out of order make)."""
    return chunks(twin, size).where(F.col("t_end") < before)


def retained(twin: Twin, before: int, size: int = CHUNK, parity: bool = False) -> DataFrame:
    """The points that retention leaves; with parity, overdue() chunks go, and not only the counted expired() ones."""
    gone = (overdue if parity else expired)(twin, before, size).select("sid", "batch_id", "chunk")
    return chunked(twin, size).join(gone, ["sid", "batch_id", "chunk"], "left_anti").select(*twin.points.columns)


def _within(twin: Twin, lo: int | None, hi: int | None) -> DataFrame:
    """The points of a window; without its ends all points, those without a time too."""
    return twin.points if lo is None or hi is None else twin.points_in(lo, hi)


def latest(twin: Twin, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """name, t, v of the newest point of each series in a window, or of all its points."""
    got = _within(twin, lo, hi).groupBy("sid").agg(F.max_by(F.struct("t", "v"), F.struct("t", "batch_id", "seq")).alias("p"))
    return got.join(twin.series.select("sid", "name").distinct(), "sid").select("name", F.col("p.t").alias("t"), F.col("p.v").alias("v"))


def discrete(twin: Twin, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """series, discrete: whether a series has points in the window (or at all) and all are 0 or 1."""
    got = _within(twin, lo, hi).groupBy("sid").agg(F.bool_and(F.col("v").isin(0.0, 1.0)).alias("discrete"))
    return twin.series.select("sid", F.col("name").alias("series")).distinct().join(got, "sid", "left").select("series", F.coalesce("discrete", F.lit(False)).alias("discrete"))


def _edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with _n and _last as neighbours() has them of "over" in order of time; before the second row nothing is over."""
    return neighbours(rows, keys, F.floor(F.col("t") / SPAN), ["t", "batch_id", "seq"], F.col("over")).withColumn("_last", F.when(F.col("_n") == 2, False).otherwise(F.col("_last")))


def crossings(points: DataFrame, threshold: float) -> DataFrame:
    """sid, t, v, over for each change of (v > threshold) between neighbours in time.

    The first point of a series is skipped and the second compared with
    "not over". Null and NaN values are not over.
    """
    rows = points.withColumn("over", F.coalesce((F.col("v") > threshold) & ~F.isnan("v"), F.lit(False)))
    rows = _edges(rows, ["sid"])
    return rows.where((F.col("_n") >= 2) & (F.col("over") != F.col("_last"))).select("sid", "t", "v", "over")


def alarms(points: DataFrame, rules: DataFrame) -> DataFrame:
    """name, entity, ts, details of the events of alarm rules (series, entity, name, threshold, detail, detail_clear).

    A rise is logged under the rule's name, the return as name_clear; {obs} and
    {thr} in the texts stand for the value and the threshold. One pass over
    the points that rules watch, whatever the number of rules.
    """
    watched = points.join(rules.withColumn("sid", fn.series_id(F.col("series"))), "sid")
    rows = watched.withColumn("over", F.coalesce((F.col("v") > F.col("threshold")) & ~F.isnan("v"), F.lit(False)))
    rows = _edges(rows, ["sid", "name"]).where((F.col("_n") >= 2) & (F.col("over") != F.col("_last")))
    text = F.when(F.col("over"), F.col("detail")).otherwise(F.col("detail_clear"))
    text = F.replace(F.replace(text, F.lit("{obs}"), F.col("v").cast("string")), F.lit("{thr}"), F.col("threshold").cast("string"))
    return rows.select(F.when(F.col("over"), F.col("name")).otherwise(F.concat("name", F.lit("_clear"))).alias("name"), "entity", F.col("t").alias("ts"), fn.clipped(text).alias("details"))
