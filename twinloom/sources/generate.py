"""Deterministic telemetry and fleets, made where the rows are needed.

Noise comes from a 64-bit linear congruential generator; its states are
computed in closed form, so any point of a series can be made by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import SCHEMAS, Twin

#: Multiplier and increment of the generator, first instant, step, and the seed's factors by machine and signal (fixed values).
FACTOR, STEP = 6364136223846793005, 1442695040888963407
START, EVERY = 1_700_000_000, 60
BY_MACHINE, BY_SIGNAL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Seed of a fleet whose caller gives none.
SEED = 20_260_611
WARM_UP = 4
SIGNALS = ("current", "vibration", "temp")


def states(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """States skip + 1 to skip + n of the generator after the seed."""
    powers = np.full(skip + n + 1, FACTOR, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(powers, dtype=np.uint64)[:-1]))
    return (powers * np.uint64(seed) + sums * np.uint64(STEP))[skip + 1 :]


def unit_noise(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """Draws in [0, 1)."""
    return (states(seed, n, skip) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def values(seed: int, kind: int, n: int) -> np.ndarray:
    """A series of n points: a ramp (kind 0 and 2) or a wave (1) with noise."""
    i = np.arange(n, dtype=np.float64)
    part = i / (n - 1) if n > 1 else np.zeros(n)
    noise = (unit_noise(seed, n, WARM_UP) - 0.5) * 2
    return (4 + 6 * part + 0.4 * noise, 2 + 1.5 * np.sin(0.37 * i) + 0.2 * noise, 35 + 10 * part + 0.5 * noise)[kind % 3]


def signal(j: int) -> str:
    return SIGNALS[j] if j < len(SIGNALS) else f"sig{j}"


def line(spark: SparkSession, points: int = 300, seed: int = SEED) -> Twin:
    """One machine of a fleet with a series of its motor's current: the smallest twin that clients can be tried on."""
    return fleet(spark, 1, 1, points, seed)


def fleet(spark: SparkSession, machines: int = 50, signals: int = 1, points: int = 2000, seed: int = SEED) -> Twin:
    """A fleet of chains PLC - drive - motor - pump whose motors have series on a grid of a minute."""
    m = spark.range(machines).withColumnRenamed("id", "m")
    name = lambda kind: F.format_string(f"{kind}_%06d", F.col("m") + 1)
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    none = F.expr("cast(array() as array<struct<k: string, v: string>>)")
    limit = F.format_string("%.2f", 10 + (F.col("m") % 4) * 0.25)
    kinds = [("PLC", F.array(pair("vendor", F.lit("Siemens")))), ("Drive", none), ("Motor", F.array(pair("spec.current.max", limit), pair("spec.current.unit", F.lit("A")))), ("Pump", none)]
    entities = relations = None
    for i, (kind, props) in enumerate(kinds):
        one = m.select((4 * F.col("m") + i).alias("key"), F.lit(kind).alias("type"), name(kind).alias("name"), props.alias("props"))
        entities = one if entities is None else entities.unionByName(one)
    for i, (topology, kind, provenance) in enumerate((("network", "profinet", 0), ("electrical", "feeds", 0), ("mechanical", "drives", 1))):
        one = m.select((3 * F.col("m") + i).alias("idx"), (4 * F.col("m") + i).alias("src"), (4 * F.col("m") + i + 1).alias("dst"), F.lit(topology).alias("topology"), F.lit(kind).alias("rel_type"), F.lit(0).cast("bigint").alias("valid_from"), F.lit(-1).cast("bigint").alias("valid_to"), F.lit(provenance).alias("provenance"), F.lit(False).alias("dead"))
        relations = one if relations is None else relations.unionByName(one)
    owned = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(signals - 1)))).withColumn("entity", name("Motor"))
    owned = owned.withColumn("signal", F.element_at(F.array(*[F.lit(signal(j)) for j in range(signals)]), F.col("j") + 1)).withColumn("name", fn.series_name(F.col("entity"), F.col("signal"))).withColumn("sid", fn.series_id(F.col("name")))
    series = owned.select("sid", "name", "entity", "signal", (F.col("m") * signals + F.col("j")).alias("ord"))

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = (1 << 64) - 1
        for part in parts:
            for sid, machine, j in zip(part["sid"].tolist(), part["m"].tolist(), part["j"].tolist(), strict=True):
                own = seed ^ (machine * BY_MACHINE & mask) ^ ((j + 1) * BY_SIGNAL & mask)
                i = np.arange(points)
                yield pd.DataFrame({"sid": sid, "batch_id": np.zeros(points, np.int64), "seq": i, "t": START + EVERY * i, "v": values(own, j, points)})

    telemetry: DataFrame = owned.select("sid", "m", "j").mapInPandas(make, SCHEMAS["points"])
    return Twin.of(spark, entities=entities, relations=relations, series=series, points=telemetry)
