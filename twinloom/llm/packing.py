"""Packing into optimal length buckets with token-budget batches.

The histogram of exact lengths over all documents (one row per distinct
length) comes to the driver, where a dynamic programme chooses at most
``buckets`` upper bounds so that padding every document to its bucket's bound
wastes fewest tokens. The cost is a convex-hull minimum in each layer, so the
programme takes time in proportion to buckets * distinct lengths. Inside a
bucket, documents are ranked in a seeded order and cut into batches of
max(1, budget // bound) documents; only the last batch of a bucket may be
short.

Defined cases: null and empty texts have length 0 and share a bucket with
others if that is cheapest (a bound of 0 counts as 1 when batches are sized);
a document longer than the budget is a batch of its own; repeated rows are
packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import n_words, ranked, unit, written

BUCKETS, BUDGET, SEED = 16, 65_536, 23


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The ascending upper bounds of at most ``buckets`` buckets of least padding; lengths are distinct.

    With lengths in order and C their cumulative counts, a bucket (j, i] pads
    to length[i] at a cost of length[i] * (C[i] - C[j]) less the constant sum
    of lengths: a line in C[j] for each i, so each layer is a lower hull of
    lines queried at growing lengths.
    """
    order = np.argsort(lengths)
    x = [int(v) for v in np.asarray(lengths)[order]]
    c = [0, *(int(v) for v in np.cumsum(np.asarray(counts)[order]))]
    n = len(x)
    if not n:
        return []
    k = min(buckets, n)
    best = [x[i - 1] * c[i] if i else 0 for i in range(n + 1)]  # one bucket
    cut = [[0] * (n + 1)]
    for layer in range(1, k):
        # best'[i] = x[i-1] * c[i] + min over j of (best[j] - x[i-1] * c[j]): lines of slope -c[j], queried at growing x
        now, back, hull, at = [0] * (n + 1), [0] * (n + 1), [], 0
        for i in range(layer, n + 1):
            j = i - 1
            if j >= layer:
                while len(hull) >= 2:
                    a, b = hull[-2], hull[-1]
                    if (best[j] - best[b]) * (c[b] - c[a]) <= (best[b] - best[a]) * (c[j] - c[b]):
                        hull.pop()
                    else:
                        break
                hull.append(j)
            at = min(at, max(0, len(hull) - 1))
            if not hull:
                now[i], back[i] = best[i], i - 1
                continue
            q = x[i - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - q * c[hull[at + 1]] <= best[hull[at]] - q * c[hull[at]]:
                at += 1
            j = hull[at]
            now[i], back[i] = best[j] + q * (c[i] - c[j]), j
        best = now
        cut.append(back)
    out, i = [], n
    for layer in range(k - 1, -1, -1):
        if not i:
            break
        out.append(x[i - 1])
        i = cut[layer][i]
    return out[::-1]


def bucket_of(length: Column, tops: list[int]) -> Column:
    """Index of the first bound that is not below the length."""
    if not tops:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in tops]), lambda t: t < length))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, batch (of the bucket), slot (in the batch) and padding of every document."""
    sized = written(docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n_tokens")), "lengths")
    found = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    tops = bounds(found["n_tokens"].to_numpy(), found["n"].to_numpy(), buckets)
    if not tops:
        tops = [0]
    put = sized.withColumn("bucket", bucket_of(F.col("n_tokens"), tops)).withColumn("padded_to", F.element_at(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("bucket") + 1))
    put = ranked(put.withColumn("_u", unit(F.lit(seed), F.col("doc_id"))), ["bucket"], "_u", ["doc_id", "n_tokens"], "_rank")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("padded_to"))))
    return put.select("doc_id", "n_tokens", "bucket", "padded_to", F.floor(F.col("_rank") / each).alias("batch"), F.pmod(F.col("_rank"), each).alias("slot"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"))
