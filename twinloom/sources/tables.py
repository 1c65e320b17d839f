"""A twin over the star-schema tables: customers act as machines, their events as telemetry.

Entities are regions, nations, suppliers, customers and orders; keys are their
table's key plus an offset by type. Relations: customers and suppliers are
located in nations (geo:located_in), nations are part of regions
(geo:part_of), orders are placed by customers (commerce:placed_by, from their
second on) and ship from suppliers (supply:ships_from, for 90 days from the
ship date). Every (customer, event type) is a series; order status a state in
the order of order keys; events stay events.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import Twin

#: What is added to a table's key.
NATION, SUPPLIER, CUSTOMER, ORDER = 100, 1_000_000, 1_000_000_000, 1_000_000_000_000
DAY = 86_400
_FIRST, _LAST = -62_135_596_800, 253_402_300_799


def second(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def props(**values: Column) -> Column:
    """Ordered props of the values that are not null; '__' in a name stands for a dot."""
    return F.filter(F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("k"), v.cast("string").alias("v")) for k, v in values.items()]), lambda p: p["v"].isNotNull())


#: Schemas of the tables, so that opening one reads no file.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _entity(df: DataFrame, kind: str, key: str, offset: int, name: Column, values: Column) -> DataFrame:
    return df.select((F.col(key).cast("bigint") + offset).alias("key"), F.lit(kind).alias("type"), name.alias("name"), values.alias("props"))


def _relation(df: DataFrame, idx: Column, src: Column, dst: Column, topology: str, kind: str, since: Column, until: Column, provenance: int) -> DataFrame:
    return df.select(idx.cast("bigint").alias("idx"), src.alias("src"), dst.alias("dst"), F.lit(topology).alias("topology"), F.lit(kind).alias("rel_type"), since.alias("valid_from"), until.alias("valid_to"), F.lit(provenance).alias("provenance"), F.lit(False).alias("dead"))


class TableTwin(Twin):
    """A twin whose tables are planned when they are first used."""

    def __init__(self, spark: SparkSession, sf_dir: str, **tables: DataFrame) -> None:
        self.__dict__.update(spark=spark, sf_dir=sf_dir, **tables)

    def using(self, **tables: DataFrame) -> TableTwin:
        own = {k: v for k, v in self.__dict__.items() if k in ("entities", "relations", "series", "points", "states", "events")}
        return TableTwin(self.spark, self.sf_dir, **(own | tables))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def points_in(self, lo: int, hi: int) -> DataFrame:
        """The filter is on the events' own timestamp, so that the scan can push it down."""
        if lo > hi:
            return self.points.where("false")
        stamp = lambda t: F.lit(datetime.fromtimestamp(min(max(t, _FIRST), _LAST), timezone.utc).replace(tzinfo=None))
        return self.points.where((F.col("ts") >= stamp(lo)) & (F.col("ts") < stamp(min(hi, _LAST - 1) + 1)))

    def signal_points(self, signal: str, lo: int, hi: int) -> DataFrame:
        """Customers' names have no dots, so a signal is an event type; its filter is pushed down too."""
        return self.points_in(lo, hi).where(F.col("event_type") == signal)

    @cached_property
    def entities(self) -> DataFrame:
        none = props(x=F.lit(None))
        bound = F.when(F.col("c_custkey") % 5 != 0, (100 + 10 * (F.col("c_custkey") % 10)).cast("string"))
        unit = F.when(F.col("c_custkey") % 3 == 0, F.lit("A"))
        return (
            _entity(self.read("region"), "Region", "r_regionkey", 0, F.col("r_name"), none)
            .unionByName(_entity(self.read("nation"), "Nation", "n_nationkey", NATION, F.col("n_name"), none))
            .unionByName(_entity(self.read("supplier"), "Supplier", "s_suppkey", SUPPLIER, F.col("s_name"), props(acctbal=F.col("s_acctbal"))))
            .unionByName(_entity(self.read("customer"), "Customer", "c_custkey", CUSTOMER, F.col("c_name"), props(mktsegment=F.col("c_mktsegment"), acctbal=F.col("c_acctbal"), spec__purchase__max=bound, spec__purchase__unit=unit)))
            .unionByName(_entity(self.read("orders"), "Order", "o_orderkey", ORDER, F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), props(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))))
        )

    @cached_property
    def relations(self) -> DataFrame:
        zero, open_ = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
        c, s, n, o = F.col("c_custkey") + CUSTOMER, F.col("s_suppkey") + SUPPLIER, F.col("n_nationkey").cast("bigint") + NATION, F.col("o_orderkey") + ORDER
        shipped = second("l_shipdate")
        return (
            _relation(self.read("nation"), F.col("n_nationkey"), n, F.col("n_regionkey").cast("bigint"), "geo", "part_of", zero, open_, 0)
            .unionByName(_relation(self.read("supplier"), s, s, F.col("s_nationkey").cast("bigint") + NATION, "geo", "located_in", zero, open_, 0))
            .unionByName(_relation(self.read("customer"), c, c, F.col("c_nationkey").cast("bigint") + NATION, "geo", "located_in", zero, open_, 0))
            .unionByName(_relation(self.read("orders"), o, o, F.col("o_custkey") + CUSTOMER, "commerce", "placed_by", second("o_orderdate"), open_, 1))
            .unionByName(_relation(self.read("lineitem"), 2 * ORDER + F.col("l_orderkey") * 16 + F.col("l_linenumber"), F.col("l_orderkey") + ORDER, F.col("l_suppkey") + SUPPLIER, "supply", "ships_from", shipped, shipped + 90 * DAY, 1))
        )

    @cached_property
    def _owners(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("entity"))

    @cached_property
    def series(self) -> DataFrame:
        name = fn.series_name(F.col("entity"), F.col("signal"))
        rows = self.read("events").select("user_id", F.col("event_type").alias("signal")).distinct().join(self._owners, "user_id")
        return rows.select(fn.series_id(name).alias("sid"), name.alias("name"), "entity", "signal", F.lit(0).cast("bigint").alias("ord"))

    @cached_property
    def points(self) -> DataFrame:
        sid = fn.series_id(fn.series_name(F.col("entity"), F.col("event_type")))
        return self.read("events").join(self._owners, "user_id").select(sid.alias("sid"), F.lit(0).cast("bigint").alias("batch_id"), F.col("event_id").alias("seq"), second("ts").alias("t"), F.col("value").alias("v"), "ts", "event_type")

    @cached_property
    def states(self) -> DataFrame:
        rows = self.read("orders").join(self.read("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(F.col("o_orderkey").alias("seq"), F.col("c_name").alias("entity"), F.lit("order_status").alias("key"), F.col("o_orderstatus").alias("value"), second("o_orderdate").alias("wat"))

    @cached_property
    def events(self) -> DataFrame:
        byte = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "purchase", 0).otherwise(1)
        return self.read("events").join(self._owners, "user_id").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), "entity", second("ts").alias("ts"), byte.alias("provenance"), F.col("props").alias("details"))


def twin(spark: SparkSession, sf_dir: str) -> TableTwin:
    return TableTwin(spark, sf_dir)
