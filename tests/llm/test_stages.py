"""Many sources, repeated rows, and columns whose names the operators use themselves."""

import random

import pytest
from pyspark.sql import functions as F
from twinloom.llm import jaccard, langid, mixing, suffixes

CLASHES = ["_body", "_id", "_n", "_size", "_kept", "_spans", "_cut", "_doc", "_mark", "_u", "_all", "_rows", "_times", "_again", "size", "copies", "target", "c0", "c1", "_part", "sid", "root"]


@pytest.mark.parametrize("n,together", [(0, 5), (1, 5), (7, 50_000), (400, 37)])
def test_targets_of_many_sources(spark, monkeypatch, n, together):
    monkeypatch.setattr(mixing, "TOGETHER", together)
    r = random.Random(n)
    sizes = {None if i == 3 else r.choice("aZé中") + str(i): r.choice([0, 1, 5, 100, 10_000, r.randint(1, 10**6)]) for i in range(n)}
    sums = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.aims(sums).collect()}
    assert got.keys() == sizes.keys()
    for s, want in mixing.targets(sizes).items():
        assert got[s] == pytest.approx(want, rel=1e-12), s


def test_mixed_deals_copies_out_among_equal_rows(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3]), "w " * r.choice([0, 2, 3]) + r.choice("xyz"), "s" + str(r.randint(0, 2))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda df: {x["source"]: x["n"] for x in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    taken = {x["source"]: x["n"] for x in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert words(mixing.mixed(docs)) == taken


def test_clashing_columns(spark):
    r = random.Random(6)
    text = lambda: " ".join(f"w{r.randint(0, 500)}" for _ in range(60))
    base = text()
    rows = [(i, text(), "en", f"s{i % 2}", 1) for i in range(20)] + [(30, base, "en", "s1", 1), (31, base + " more", "en", "s1", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    for stage in (langid.keep_identified, jaccard.keep_one, suffixes.strip, mixing.mixed):
        for some in (docs, docs.limit(0)):
            out = stage(some)
            assert out.columns == docs.columns
            got = out.collect()
            assert all(x[c] == f"own {c}" for x in got for c in CLASHES) and bool(got) == (some is docs)
    assert {x["doc_id"] for x in jaccard.keep_one(docs).collect()} == {*range(20), 30, None}
