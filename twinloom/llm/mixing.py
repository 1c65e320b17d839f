"""Mixing sources to target weights by subset-sum budget fitting.

Sources, ordered by code point with null last, weigh 3, 1, 2 in turn and share
``share`` times all words; a target stops at ``cap`` times its source's words
and the excess is shared again by weight. A source's documents are counted by
exact length. All of them are taken as often as the target allows whole
rounds; what is left of the target is fitted by length counts: the same share
of each length's documents, then from the longest down until a window is left,
then a bounded-knapsack dynamic programme over the remaining counts. Which
documents of a length are taken more often is settled by a seeded hash.

Sources stay a table, however many there are: their places in the order come
from range partitions and those partitions' sizes, and each round of sharing
takes two sums to the driver. A source's lengths are fitted in one group, of a
row for each different length.

Defined cases: null and empty texts have size 0 and are taken 0 words; null
source is a source of its own, and sources of no words get target 0; repeated
rows and ids are documents of their own, of equal hash, of which the first in
any order are taken; a text of any length counts whole; an empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from twinloom.llm.common import n_words, numbered, ranked, unit, written

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, 17
WINDOW = 1 << 16
#: Sources of a range partition, where they are put into their order.
TOGETHER = 50_000


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Target words by source; sizes: words by source (None is a source)."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict = {}
    left, open_ = share * sum(sizes.values()), set(names)
    while open_:
        unit_share = left / sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and weight[s] * unit_share >= cap * sizes[s]]
        if not full:
            out.update({s: weight[s] * unit_share for s in open_})
            break
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def aims(sums: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target of every row of sums (source, source_size): targets() for any number of sources.

    A source that is full stays full when the others share what it leaves, so
    a round is settled by one number, the words for each unit of weight.
    """
    sums = written(sums, "sums")
    n = sums.count()
    placed = written(sums.repartitionByRange(max(1, n // TOGETHER), F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    placed = placed.join(parts, F.col("_part") == F.col("_p")).withColumn("_place", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    placed = written(placed.select("source", "source_size", weight.alias("_w"), (F.lit(cap) * F.col("source_size")).alias("_most")), "weights")
    left, open_ = placed.agg(F.lit(float(share)) * F.sum("source_size"), F.sum("_w")).first()
    whole, each, full, last = left, (left or 0.0) / (open_ or 1.0), 0, -1
    while full != last and open_:
        last, is_full = full, F.col("_w") * F.lit(each) >= F.col("_most")
        full, used, open_ = placed.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("_most"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_full, F.col("_w"))), F.lit(0.0))).first()
        if full != last and open_:
            each = (whole - used) / open_
    target = F.when(F.col("_w") * F.lit(each) >= F.col("_most"), F.col("_most").cast("double")).otherwise(F.col("_w") * F.lit(each))
    return written(placed.select("source", "source_size", target.alias("target")), "aims")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below the budget as can be.

    lengths are distinct and positive. Memory: window + the longest length bits
    and integers.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.floor(counts * (max(0, budget) / max(1, total))).astype(np.int64)
    left = max(0, budget) - int((take * lengths).sum())
    down = np.argsort(-lengths)
    for i in down:
        k = min(int(counts[i] - take[i]), max(0, left - window) // int(lengths[i]))
        take[i] += k
        left -= k * int(lengths[i])
    # reach holds a bit for each sum that can be made; by: the length that made it first
    reach, mask = 1, (1 << (left + 1)) - 1
    by = np.full(left + 1, -1, np.int32)
    for i in down[::-1]:
        fresh = reach
        for _ in range(int(counts[i] - take[i])):
            fresh = (fresh << int(lengths[i])) & mask & ~reach
            if not fresh:
                break
            reach |= fresh
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits)] = i
        if reach >> left:
            break
    s = reach.bit_length() - 1
    while s:
        take[by[s]] += 1
        s -= int(lengths[by[s]])
    return take


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size * copies) of every document."""
    kind = docs.schema[source_col].dataType.simpleString()
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    plan = aims(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        target, size = float(rows["target"][0]), int(rows["source_size"][0])
        whole = int(target // size)
        extra = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), round(target - whole * size))
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "source_size": size, "target": target, "whole": whole, "extra": extra, "n": rows["n"]})

    fits = counts.groupBy("source").applyInPandas(fitted, f"source {kind}, size long, source_size long, target double, whole long, extra long, n long")
    fits = written(fits, "fits").select(F.col("source").alias("_s"), F.col("size").alias("_n"), "whole", "extra", "n", "source_size", "target")
    some = sized.where("size > 0").join(fits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))).drop("_s", "_n")
    plain = some.where("extra = 0 or extra = n").withColumn("copies", F.col("whole") + (F.col("extra") > 0).cast("long"))
    chosen = ranked(some.where("extra > 0 and extra < n").withColumn("_u", unit(F.lit(seed), F.col("doc_id"))), ["source", "size"], "_u", ["doc_id"], "_rank")
    chosen = chosen.withColumn("copies", F.col("whole") + (F.col("_rank") < F.col("extra")).cast("long"))
    none = sized.where("size = 0").join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    out = plain.select(*columns).unionByName(chosen.select(*columns)).unionByName(none.select(*columns))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken, none for those that it leaves out.

    Rows are matched by id, source and size; what rows of the same share are
    taken in all is dealt out among them, to one row once more than to another
    at most.
    """
    key = ["doc_id", "source", "size"]
    found = mix(docs, **how).groupBy(*key).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0").toDF("_id", "_source", "_size", "_all", "_rows")
    found = written(found, "shares")
    even = F.pmod("_all", "_rows") == 0
    times = F.floor(F.col("_all") / F.col("_rows"))
    own, name = numbered(docs)
    rows = own.withColumns({"doc_id": F.col(name["doc_id"]), "source": F.col(name["source"]), "size": n_words(F.col(name["text"]))})

    def sharing(some: DataFrame) -> DataFrame:
        """The rows of these shares; texts are read, and their words counted, once a call."""
        both = rows.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
        return both.drop("_id", "_source", "_size").withColumn("_times", times)

    taken = sharing(found.where(even))
    uneven = found.where(~even)
    if not uneven.isEmpty():  # only repeated ids share unevenly
        dealt = written(sharing(uneven).withColumn("_u", unit(F.col(name["text"]))), "uneven")
        taken = taken.unionByName(ranked(dealt, key, "_u", [], "_rank").withColumn("_times", F.col("_times") + (F.col("_rank") < F.pmod("_all", "_rows")).cast("long")).drop("_rank", "_u"))
    taken = taken.where("_times > 0")
    return taken.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*own.columns).toDF(*docs.columns)
