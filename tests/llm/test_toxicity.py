"""What is learnt from: bounded, one text of each id; votes and calibration against their definitions."""

import random

import numpy as np
from twinloom.llm import toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "to", "ly")]


def sample(n, seed):
    r = random.Random(seed)
    return [(" ".join([r.choice(WORDS) for _ in range(20)] + ["vilefool"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(n)]


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i, t) for i, (t, _) in enumerate(sample(300, 1))]
    hot = [(3, f"copy {i} vilefool") for i in range(3000)] + [(6, None), (9, "kara " * 40_000)]
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sample(300, 1))], "doc_id long, toxic int")
    index, ids = toxicity.fit(docs, labels, examples=50)
    assert 50 < len(ids) <= 100 and len(set(ids)) == len(ids)
    short, few = toxicity.fit(docs, labels, examples=50, most=2000)
    assert 5 < len(few) < 40 and short.vocabulary is not None
    out = toxicity.score(docs, labels, examples=50).collect()
    assert len(out) == 3302 and len({x["score"] for x in out if x["doc_id"] == 3}) <= 2


def test_votes_and_steps():
    texts = sample(400, 2)
    index = toxicity.Index([t for t, _ in texts], [y for _, y in texts])
    at, cos = np.array([0, 1, 2]), np.array([0.5, 0.25, 0.125])
    marks = index.labels[at]
    assert index.vote(at, cos) == ((cos * marks).sum() + toxicity.PRIOR * index.prior) / (cos.sum() + toxicity.PRIOR)
    assert (np.diff(index.steps[0]) > 0).all() and (np.diff(index.steps[1]) >= 0).all() and 0 <= index.steps[1][0] <= index.steps[1][-1] <= 1
    scores = [index.score(t)[0] for t, _ in texts]
    assert min(s for s, (_, y) in zip(scores, texts, strict=True) if y) > 0.5 > max(s for s, (_, y) in zip(scores, texts, strict=True) if not y)
    long_ = " ".join(t for t, y in texts if not y) * 20
    assert index.score(long_)[0] < 0.5 < index.score(long_ + " vilefool" * 200)[0]
