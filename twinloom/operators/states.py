"""State history as intervals in the order of writing, states at an instant, and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import OPEN, Twin
from twinloom.operators.windows import SPAN, neighbours


def intervals(twin: Twin) -> DataFrame:
    """seq, entity, key, value, valid_from, valid_to: a write is closed by the next one of its (entity, key), however far back that lies."""
    rows = neighbours(twin.states, ["entity", "key"], F.floor(F.col("seq") / SPAN), ["seq"], F.col("wat"), back=True)
    return rows.select("seq", "entity", "key", "value", F.col("wat").alias("valid_from"), F.coalesce("_last", F.lit(OPEN)).alias("valid_to"))


def at(twin: Twin, instant: int) -> DataFrame:
    """entity, key, value, valid_from of every state at the instant; of several intervals the latest, of equals the first written."""
    rows = intervals(twin).where(fn.valid_at(F.col("valid_from"), F.col("valid_to"), instant))
    best = F.max_by(F.struct("value", "valid_from"), F.struct("valid_from", -F.col("seq")))
    return rows.groupBy("entity", "key").agg(best.alias("b")).select("entity", "key", "b.value", "b.valid_from")


def history(twin: Twin, entity: str, key: str) -> DataFrame:
    """value, valid_from, valid_to in the order of writing."""
    only = twin.using(states=twin.states.where((F.col("entity") == entity) & (F.col("key") == key)))
    return intervals(only).orderBy("seq").select("value", "valid_from", "valid_to")


def events(twin: Twin, entity: str | None, lo: int, hi: int) -> DataFrame:
    """Events in a window with both ends, of one entity or all, with provenance by name; unordered but for seq."""
    rows = twin.events.where(F.col("ts").between(lo, hi))
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    return rows.select("seq", "name", "entity", F.col("ts").alias("timestamp"), fn.provenance_name(F.col("provenance")).alias("provenance"), F.col("provenance").alias("provenance_byte"), fn.clipped(F.col("details")).alias("details"))
