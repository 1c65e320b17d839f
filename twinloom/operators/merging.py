"""Merging many upserts at once: props, relations and their dedup as joins.

The api writes one entity at a time; a bulk load merges tables with these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_props(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, k, v, pos of old props (key, pos, k, v) after new ones (key, pos, k, v) are merged in.

    A value overwrites, null leaves what is there and adds '' where nothing
    is; added names come after those that were there.
    """
    old = old.select("key", "k", F.col("v").alias("_old"), F.col("pos").alias("_at"))
    new = new.groupBy("key", "k").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("pos"))).alias("_new"), F.min("pos").alias("_added"))
    both = old.join(new, ["key", "k"], "full")
    return both.select("key", "k", F.coalesce("_new", "_old", F.lit("")).alias("v"), F.coalesce(F.col("_at"), F.col("_added") + (1 << 20)).alias("pos"))


def fresh_relations(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (src, dst, topology, rel_type, ...) without self-relations and those whose ends are linked alike, either way round."""
    ends = lambda df: df.withColumns({"_lo": F.least("src", "dst"), "_hi": F.greatest("src", "dst")})
    return ends(wanted).where("src <> dst").join(ends(live).select("_lo", "_hi", "topology", "rel_type").distinct(), ["_lo", "_hi", "topology", "rel_type"], "left_anti").dropDuplicates(["_lo", "_hi", "topology", "rel_type"]).drop("_lo", "_hi")
