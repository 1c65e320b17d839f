"""Continuous ingest, latest values and alarms as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from twinloom import functions as fn
from twinloom.sources.store import Conflict, Store

#: How often an epoch is tried when other writers commit before it does.
ATTEMPTS = 8


def ingest(readings: DataFrame, store: Store, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Appends a stream of readings (entity, signal, t, v) to a stored twin, each epoch in one commit.

    An epoch that is delivered again is not written again. Late readings are
    appended like any others and take their place when they are read. Rows of
    one series in an epoch are one batch, so chunks are cut from it.
    """
    def append(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            for left in reversed(range(ATTEMPTS)):
                try:
                    return commit(rows, epoch)
                except Conflict:  # another writer was faster: once more from the latest snapshot
                    if not left:
                        raise
        finally:
            rows.unpersist()

    def commit(rows: DataFrame, epoch: int) -> None:
        if rows.isEmpty():
            return
        store.refresh()
        full = rows.select(fn.series_name(F.col("entity"), F.col("signal")).alias("name"), F.col("t").cast("bigint").alias("t"), F.col("v").cast("double").alias("v")).withColumn("sid", fn.series_id(F.col("name")))
        order = F.row_number().over(Window.partitionBy("sid").orderBy("t", "v")) - 1
        points = full.select("sid", F.lit(store.manifest["version"] + 1).cast("bigint").alias("batch_id"), order.cast("bigint").alias("seq"), "t", "v")
        start = store.table("series").count()
        fresh = full.select("sid", "name").distinct().join(store.table("series").select("sid"), "sid", "left_anti")
        place = F.row_number().over(Window.orderBy("name")) - 1 + start  # of new names only
        series = fresh.select("sid", "name", F.substring_index("name", ".", 1).alias("entity"), F.expr("substring(name, instr(name, '.') + 1)").alias("signal"), place.cast("bigint").alias("ord"))
        store.commit(stream=(name, epoch), points=points, series=series)

    return readings.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()


def latest(readings: DataFrame) -> DataFrame:
    """name, t, v of the newest reading of each series so far; for output mode update or complete."""
    named = readings.withColumn("name", fn.series_name(F.col("entity"), F.col("signal")))
    return named.groupBy("name").agg(F.max(F.struct("t", "v")).alias("p")).select("name", F.col("p.t").alias("t"), F.col("p.v").alias("v"))


def alarms(readings: DataFrame, threshold: float) -> DataFrame:
    """name, t, v, over for each crossing of a threshold, as series.crossings() has them, across micro-batches.

    State of a series: how many readings it had (up to two) and whether the
    last was over. Readings of a micro-batch are taken in order of time; one
    that comes after a later one has been seen is compared with that.
    """
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, over = state.get if state.exists else (0, False)
        rows = pd.concat(list(parts)).sort_values(["t", "v"], kind="stable")
        out = []
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist(), strict=True):
            now = v is not None and v > threshold
            if seen == 0:
                seen = 1  # the first reading is skipped
                continue
            before = over if seen > 1 else False
            seen, over = 2, now
            if now != before:
                out.append((key[0], t, v, now))
        state.update((seen, bool(over)))
        yield pd.DataFrame(out, columns=["name", "t", "v", "over"])

    named = readings.select(fn.series_name(F.col("entity"), F.col("signal")).alias("name"), F.col("t").cast("bigint").alias("t"), F.col("v").cast("double").alias("v"))
    return named.groupBy("name").applyInPandasWithState(step, "name string, t bigint, v double, over boolean", "seen int, over boolean", "append", GroupStateTimeout.NoTimeout)
