"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and word beginnings (4, 5 and 6 letters) of a text in lower
case. A labelled sample settles the vocabulary: terms whose share among toxic
examples differs from that among the others by more than chance would among
so many terms (log-likelihood ratio G of at least 2 ln(terms) + ``MARGIN``), at
most ``TERMS`` of them. The examples' unit vectors of tf * idf over that vocabulary are
kept in an inverted index of blocks of ``BLOCK`` examples; for every term and
block it holds the block's largest weight. A text's bound for a block is the
sum of those, and blocks are visited from the highest bound down until no
bound beats the k-th best cosine, so the k nearest are exact.

Votes are weighted by cosine against a prior pseudo-vote of weight ``PRIOR``,
and a monotone map fitted on the examples themselves (each scored without
itself) turns the vote into a calibrated probability. A text without any
vocabulary term has no neighbour: its vote is the prior alone.

The fit reads at most ``EXAMPLES`` labelled texts of each label, the first in
the order of a hash of the id, and of those at most ``BYTES`` bytes (texts that
would go beyond are passed over): a bounded sample, whatever the table's size.
The index (documented bound: 2 * EXAMPLES vectors over TERMS terms, a few MB)
goes to the executors with the function; scoring reads every whole text once.

Defined cases: null and empty texts get the score of a text without terms;
null ids are scored and never learnt from; labels that are null are not
learnt; several labels of one id count each; of an id's texts the least is
learnt; texts of any length are scored whole; without examples of both labels
every score is the share of toxic ones (0 without any); repeated rows get
equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import map_batches, unit, written

EXAMPLES, BYTES = 3000, 64 << 20
TERMS = 8192
BLOCK = 64
K = 15
MARGIN = 3.0
PRIOR = 0.25
_WORD = re.compile(r"[^\W\d_]+")
_LENGTHS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """The terms of one lower-case word: itself, and its beginnings marked by '^'."""
    return [word, *("^" + word[:n] for n in _LENGTHS if len(word) >= n)]


class Index:
    """Labelled examples as unit vectors in an inverted index with block maxima."""

    def __init__(self, texts: Sequence[str], labels: Sequence[int], weights: tuple[float, float] = (1.0, 1.0)) -> None:
        """weights: how many rows an example of label 0 and 1 stands for."""
        self.weights = weights
        self.prior = float(np.mean(labels)) if len(labels) else 0.0
        labels_ = np.asarray(labels, np.int64)
        self.vocabulary: dict[str, int] = {}
        self.words: dict[str, tuple] = {}
        self._choose(texts, labels_)
        vectors = [self.vector(x) for x in texts]
        keep = [i for i in range(len(vectors)) if len(vectors[i][0])]
        # examples of like vectors share blocks, which makes block bounds tight
        keep.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), -float(vectors[i][1].max()), i))
        self.example = np.array(keep, np.int64)
        self.labels = labels_[self.example] if keep else np.zeros(0, np.int64)
        blocks = -(-len(keep) // BLOCK)
        self.top = np.zeros((len(self.vocabulary), blocks), np.float32)
        self.posts: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(blocks)]
        raw: list[dict[int, list]] = [{} for _ in range(blocks)]
        for at, i in enumerate(keep):
            b = at // BLOCK
            for t, w in zip(*(x.tolist() for x in vectors[i]), strict=True):
                raw[b].setdefault(t, []).append((at, w))
                self.top[t, b] = max(self.top[t, b], np.nextafter(np.float32(w), np.float32(2)))
        for b, lists in enumerate(raw):
            self.posts[b] = {t: (np.array([x[0] for x in p]), np.array([x[1] for x in p])) for t, p in lists.items()}
        self.steps = (np.array([0.0]), np.array([self.prior]))
        self._calibrate(vectors, keep)
        self.words.clear()

    def _choose(self, texts: Sequence[str], labels: np.ndarray) -> None:
        n1 = int((labels == 1).sum())
        n0 = len(labels) - n1
        self.idf = np.zeros(0)
        if not n0 or not n1:
            return
        df = (Counter(), Counter())
        for text, y in zip(texts, labels.tolist(), strict=True):
            df[y == 1].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)})
        found = []
        terms = df[0].keys() | df[1].keys()
        least = 2 * math.log(sum(df[0][t] + df[1][t] >= 3 for t in terms) or 1) + MARGIN
        for t in terms:
            a, b = df[1][t], df[0][t]
            e = (a + b) / (n0 + n1)
            g = sum(2 * x * math.log(x / m) for x, m in ((a, n1 * e), (b, n0 * e), (n1 - a, n1 * (1 - e)), (n0 - b, n0 * (1 - e))) if x)
            if g >= least:
                found.append((-g, t, a + b))
        found = sorted(found)[:TERMS]
        self.vocabulary = {t: i for i, (_, t, _) in enumerate(found)}
        self.idf = np.array([math.log(1 + (n0 + n1) / n) for _, _, n in found])

    def vector_of(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length: (1 + log tf) * idf."""
        t = np.array(sorted(counts), np.int64)
        w = np.array([1 + math.log(counts[x]) for x in t.tolist()]) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / (np.sqrt((w * w).sum()) or 1.0)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts: Counter = Counter()
        if text:
            own = self.words
            for w in _WORD.findall(text.lower()):
                got = own.get(w)
                if got is None:
                    if len(own) > 400_000:
                        own.clear()
                    got = own[w] = tuple(self.vocabulary[t] for t in terms_of(w) if t in self.vocabulary)
                if got:
                    counts.update(got)
        return self.vector_of(counts)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples with a positive cosine, best first, ties by place; exact."""
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms):
            return best_at, best
        bound = weights @ self.top[terms].astype(np.float64) + 1e-9
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 1e-9 or len(best) == k and bound[b] < best[-1]:
                break
            score = np.zeros(BLOCK)
            posts = self.posts[b]
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                if t in posts:
                    at, x = posts[t]
                    score[at - b * BLOCK] += w * x
            here = np.flatnonzero(score > 0)
            here = here[here + b * BLOCK != without]
            at, cos = np.concatenate((best_at, here + b * BLOCK)), np.concatenate((best, score[here]))
            order = np.lexsort((at, -cos))[:k]
            best_at, best = at[order], cos[order]
        return best_at, best

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        """Share of toxic votes, weighted by cosine, with the prior as a vote of weight PRIOR."""
        return float(((cos * self.labels[at]).sum() + PRIOR * self.prior) / (cos.sum() + PRIOR))

    def _calibrate(self, vectors: list, keep: list[int]) -> None:
        """A monotone step map from votes to probabilities, by pooling adjacent violators on the examples."""
        if not len(self.vocabulary):
            return
        place = {i: at for at, i in enumerate(keep)}
        votes = np.array([self.vote(*self.nearest(*vectors[i], without=place[i])) for i in keep])
        pools: list[list[float]] = []
        for j in np.lexsort((self.labels, votes)).tolist():
            if pools and pools[-1][0] == votes[j]:
                pools[-1][1] += self.labels[j] * self.weights[1]
                pools[-1][2] += self.weights[self.labels[j]]
            else:
                pools.append([votes[j], self.labels[j] * self.weights[1], self.weights[self.labels[j]]])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, s, n = pools.pop()
                pools[-1][1] += s
                pools[-1][2] += n
        self.steps = (np.array([p[0] for p in pools]), np.array([(p[1] + 0.1) / (p[2] + 0.2) for p in pools]))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """(probability, example numbers, cosines): the numbers are places in the sample that was fitted."""
        at, cos = self.nearest(*self.vector(text))
        if not len(at):
            return self.blank, [], []
        vote = self.vote(at, cos)
        step = float(self.steps[1][max(0, int(np.searchsorted(self.steps[0], vote, side="right")) - 1)])
        # within a step, the vote itself still orders texts
        return min(1.0, max(0.0, 0.98 * step + 0.02 * vote)), self.example[at].tolist(), np.round(cos, 6).tolist()

    blank = 0.0


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, most: int = BYTES) -> tuple[Index, list]:
    """(index, ids of the sample) from at most examples texts of each label and most bytes of texts, none of them held out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id")))
    shares = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = unit(F.lit(5), F.col("_id"))

    def some(y: int) -> DataFrame:
        # about twice the sample passes the hash filter, so that no task gathers more than that
        return known.where((F.col("_toxic") == y) & (order < min(1.0, 2.0 * examples / max(1, shares.get(y, 0))))).orderBy(order, "_id").limit(examples)

    few = written(some(1).unionByName(some(0)), "labelled", 2 * examples)
    # at most 2 * examples ids: a bounded broadcast, so only their texts are shuffled, and one text of each id is left
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few.select("_id").distinct()), "_id")
    own = written(own.groupBy("_id").agg(F.min("text").alias("text")), "examples", 2 * examples)
    chosen, left = [], most
    for r in own.select("_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(order, "_id").collect():
        if r["n"] <= left:
            chosen.append((r["_id"],))
            left -= r["n"]
    ids = docs.sparkSession.createDataFrame(chosen, own.select("_id").schema)
    rows = few.join(own.join(F.broadcast(ids), "_id", "left_semi"), "_id").select(F.col("_id").alias("doc_id"), "text", "_toxic").toPandas()
    rows = rows.sort_values(["doc_id", "_toxic", "text"], ignore_index=True)
    marks = rows["_toxic"].astype(int).tolist()
    index = Index(rows["text"].tolist(), marks, tuple(shares.get(y, 0) / max(1, marks.count(y)) for y in (0, 1)))
    index.blank = _blank(index, shares, rows)
    return index, rows["doc_id"].tolist()


def _blank(index: Index, shares: dict, rows) -> float:
    """Probability of a text without terms: the labels' shares over all known rows, by how often their examples lack terms."""
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    if not n1 or not n0:
        return float(n1 > 0)
    covered = set(index.example.tolist())
    lacking = {y: [i not in covered for i in range(len(rows)) if rows["_toxic"][i] == y] for y in (0, 1)}
    share = {y: (sum(v) + 0.5) / (len(v) + 1) for y, v in lacking.items()}
    return n1 * share[1] / (n1 * share[1] + n0 * share[0])


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids and cosines of the nearest examples) of every document."""
    index, ids = fit(docs, labels, examples)
    shared = docs.sparkSession.sparkContext.broadcast((index, ids))

    def one(batch: pa.RecordBatch) -> dict:
        own, names = shared.value
        found = [own.score(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "score": [x[0] for x in found], "evidence": [[{"example": names[i], "cosine": c} for i, c in zip(x[1], x[2], strict=True)] for x in found]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), one, f"doc_id {kind}, score double, evidence array<struct<example: {kind}, cosine: double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
