"""Tables of a twin: schemas, provenance classes and the Twin that holds the DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Provenance classes by their byte (fixed values).
PROVENANCE = ("Fact", "Observation", "Specification", "Inference", "Hypothesis", "Event", "Command", "Configuration")
#: Open end of a validity interval (fixed value).
OPEN = -1
#: Default bounds of time windows (fixed values).
EARLIEST, LATEST = -(2**62), 2**62 - 1
#: Points in a chunk (fixed value).
CHUNK = 256

SCHEMAS = {
    "entities": "key bigint, type string, name string, props array<struct<k: string, v: string>>",
    "relations": "idx bigint, src bigint, dst bigint, topology string, rel_type string, valid_from bigint, valid_to bigint, provenance int, dead boolean",
    "series": "sid bigint, name string, entity string, signal string, ord bigint",
    "points": "sid bigint, batch_id bigint, seq bigint, t bigint, v double",
    "states": "seq bigint, entity string, key string, value string, wat bigint",
    "events": "seq bigint, name string, entity string, ts bigint, provenance int, details string",
}


@dataclass(frozen=True)
class Twin:
    """Six tables of one snapshot.

    entities have ordered props (of equal keys the first counts). relations
    are valid in [valid_from, valid_to), where -1 is open; idx is their order
    of insertion. A series' sid is the hash of its name, ``entity.signal``, so
    points can be joined without looking names up; ord is its order of
    creation. seq is the order of appending; wat the instant a state was
    written for.
    """

    spark: SparkSession
    entities: DataFrame
    relations: DataFrame
    series: DataFrame
    points: DataFrame
    states: DataFrame
    events: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **rows: list | DataFrame) -> Twin:
        """A twin of literal rows or DataFrames; tables that are not given are empty. Series of points need no sid."""
        tables = {k: rows.get(k) if isinstance(rows.get(k), DataFrame) else spark.createDataFrame(rows.get(k) or [], s) for k, s in SCHEMAS.items()}
        return cls(spark, **tables)

    def points_in(self, lo: int, hi: int) -> DataFrame:
        """Points with lo <= t <= hi; the filter reaches the scan where t is a column of it."""
        return self.points.where(F.col("t").between(lo, hi))

    def signal_points(self, signal: str, lo: int, hi: int) -> DataFrame:
        """points_in() of the series whose names end in a dot and the signal; series are few beside points, so only theirs are aggregated."""
        own = self.series.where(F.endswith("name", F.lit(f".{signal}"))).select("sid")
        return self.points_in(lo, hi).join(own, "sid", "left_semi")

    def live(self) -> DataFrame:
        """Relations that have not been removed, whatever their validity."""
        return self.relations.where(~F.col("dead"))

    def using(self, **tables: DataFrame) -> Twin:
        return replace(self, **tables)
