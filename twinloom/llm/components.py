"""Connected components of a table of links, without gathering a component anywhere.

Large-star and small-star steps (as published for MapReduce) as aggregations
and joins: each step replaces links by links to smallest neighbours until
nothing changes; what is left are stars around the smallest member. A step's
result is written, so lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) linked to each u's smallest neighbour (or itself): larger neighbours in a large star, smaller ones and u in a small one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node that can be reached. Roots map to themselves."""
    size = links.count()
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "links", size)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    last = None
    while (now := mark(edges)) != last:
        last = now
        edges = written(_star(written(_star(edges, True), "large", 2 * size), False), "small", 2 * size)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
