"""Order within groups of any size: neighbours and places without one task for a group.

A group is cut into buckets that follow its order. Windows run inside buckets;
of each bucket only its size and its last value go on, so a group that holds
most of the rows is as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows (or seconds) that a bucket spans, unless told otherwise.
SPAN = 1 << 16


def neighbours(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, back: bool = False) -> DataFrame:
    """df with _n, each row's place in its group (from 1), and _last, the value of the row before; with back, in descending order.

    bucket must not fall as rows ascend in order. Null keys are groups like others.
    """
    way = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    last = F.min_by if back else F.max_by
    rows = df.withColumns({"_b": bucket, "_v": value})
    inside = Window.partitionBy(*keys, "_b").orderBy(*[way(c) for c in order])
    rows = rows.withColumns({"_i": F.row_number().over(inside), "_p": F.lag("_v").over(inside)})
    parts = df.withColumns({"_b": bucket, "_v": value}).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), last(F.struct("_v"), F.struct(*order)).alias("_l"))
    over = Window.partitionBy(*keys).orderBy(way("_b"))
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_l").over(over).alias("_carried"))
    test = F.col("_b").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        test &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(parts, test).withColumns({"_n": F.col("_before") + F.col("_i"), "_last": F.when(F.col("_i") == 1, F.col("_carried._v")).otherwise(F.col("_p"))})
    return out.drop("_b", "_v", "_i", "_p", "_kb", "_before", "_carried", *[f"_k{i}" for i in range(len(keys))])


def discrete_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], cuts: int = 64) -> DataFrame:
    """key and, for each name in shares, the least value that so large a share of the key's values does not exceed; exact.

    Approximate quantiles cut a key's values into buckets, exact counts tell
    the bucket that holds a rank, and only that one's different values are put
    into order. Null values don't count.
    """
    real = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_v"))
    edges = real.groupBy("_key").agg(F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 10_000).alias("_edges"), F.count(F.lit(1)).alias("_all")).withColumnRenamed("_key", "_ek")
    placed = real.groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c")).join(edges, F.col("_key").eqNullSafe(F.col("_ek"))).drop("_ek")
    placed = placed.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_v"))))
    over = Window.partitionBy("_key").orderBy("_b")
    parts = placed.groupBy("_key", "_b", "_all").agg(F.sum("_c").alias("_n")).withColumn("_upto", F.sum("_n").over(over))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all"))).cast("long").alias("rank")) for n, p in shares.items()])
    held = parts.withColumn("_r", F.explode(ranks)).where((F.col("_r.rank") <= F.col("_upto")) & (F.col("_r.rank") > F.col("_upto") - F.col("_n")))
    held = held.groupBy(F.col("_key").alias("_hk"), F.col("_b").alias("_hb")).agg(F.collect_list("_r").alias("_rs"), F.max(F.col("_upto") - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_key", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(held, F.col("_key").eqNullSafe(F.col("_hk")) & (F.col("_b") == F.col("_hb"))).withColumn("_at", F.col("_before") + F.sum("_c").over(inside)).withColumn("_r", F.explode("_rs"))
    found = rows.where((F.col("_r.rank") <= F.col("_at")) & (F.col("_r.rank") > F.col("_at") - F.col("_c")))
    return found.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("_r.name") == n, F.col("_v"))).alias(n) for n in shares])


def places(df: DataFrame, column: str, place: str, together: int = 100_000) -> DataFrame:
    """df of different values of a column with their places (from 0) in its order, by range partitions and their sizes."""
    from twinloom.shared import written

    n = df.count()
    cut = written(df.repartitionByRange(max(1, n // together), column).withColumn("_part", F.spark_partition_id()), "places")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return cut.join(parts, F.col("_part") == F.col("_p")).withColumn(place, F.col("_before") + own).drop("_part", "_p", "_before")
