"""Toxicity and search against brute force, and the pipeline's decisions."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinloom.llm import search, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"
BAD = ["vilefool", "rotscum", "grimtrash"]


def texts(n, seed):
    r = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "ta", "re") for b in ("ra", "se", "to", "ly", "", "nd")]
    out = []
    for _ in range(n):
        bag = [r.choice(words) for _ in range(r.randint(10, 60))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 4)):
                bag.insert(r.randint(0, len(bag)), r.choice(BAD) + r.choice(["", "ly"]))
        out.append((" ".join(bag), int(toxic)))
    return out


def test_nearest_is_exact():
    sample = texts(500, 1)
    index = toxicity.Index([t for t, _ in sample], [y for _, y in sample])
    assert index.vocabulary and len(index.example) > 2 * toxicity.BLOCK
    full = np.zeros((len(index.example), len(index.vocabulary)))
    for row, i in enumerate(index.example.tolist()):
        t, w = index.vector(sample[i][0])
        full[row, t] = w
    assert np.allclose((full**2).sum(axis=1), 1)
    for text, _ in texts(200, 2):
        t, w = index.vector(text)
        at, cos = index.nearest(t, w)
        all_ = full[:, t] @ w if len(t) else np.zeros(len(full))
        order = [i for i in np.lexsort((np.arange(len(full)), -np.round(all_, 12))) if all_[i] > 0][: toxicity.K]
        assert np.allclose(sorted(cos), sorted(all_[order])) and len(at) == len(order)


def test_held_out_accuracy(spark):
    sample = texts(1200, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(sample)] + [(5000, None, "x"), (5001, "", "x"), (None, "vilefool", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y, "x") for i, (_, y) in enumerate(sample)] + [(3, 1, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    out = {r["doc_id"]: r for r in toxicity.score(docs, labels, examples=200).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in held) for i in range(0, 1200, 7)) and not out[None]["held_out"]
    assert np.mean([out[i]["predicted"] == sample[i][1] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert out[5000]["score"] == out[5001]["score"] and out[5000]["predicted"] == 0 and out[None]["predicted"] == 1
    assert all(e["example"] not in held for r in out.values() for e in r["evidence"])
    assert toxicity.score(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), labels).collect() == []


def bm25(rows, asked, k):
    bags = [Counter(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t in rows]
    sizes = [sum(b.values()) for b in bags]
    n, mean = len(rows), sum(sizes) / len(rows)
    df = Counter(t for b in bags for t in b)
    out = []
    for q in asked:
        found = []
        for i, b in enumerate(bags):
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for t, c in bags[q].items() if t in b)
            if s > 0:
                found.append((-round(s, 6), -math.inf if rows[i][0] is None else rows[i][0], rows[i][0]))
        out += [(rows[q][0], rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return out


@pytest.mark.parametrize("queries", [search.QUERIES, 12])
def test_search(spark, monkeypatch, queries):
    monkeypatch.setattr(search, "QUERIES", queries)  # read on the driver only
    r = random.Random(5)
    rows = [(i, t + r.choice(["", " Ünï", " 42.", " common"])) for i, (t, _) in enumerate(texts(260, 4))]
    rows += [(300, rows[20][1]), (301, rows[20][1]), (340, ""), (360, None), (380, " .,; "), (None, rows[40][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(5)
    got = sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 4)) for x in search.top_k(docs, F.col("doc_id") % 20 == 0, 7).collect())
    want = sorted((q, rank, d, round(s, 4)) for q, rank, d, s in bm25(rows, [i for i, (d, _) in enumerate(rows) if d is not None and d % 20 == 0], 7))
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and [x[2] for x in got] == [x[2] for x in want]
    assert search.top_k(docs.limit(0), F.col("doc_id") % 20 == 0).collect() == []


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    en, de = [f"w{i}and" for i in range(300)], [f"ü{i}ung" for i in range(300)]
    text = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    passage = text(en, 60)
    rows = [(i, text(en if i % 2 else de, r.randint(5, 80)), "en" if i % 2 else "de", f"s{i % 4}") for i in range(200)]
    base = text(en, 100)
    copies = [(300 + i, base + f" end{i}", "en", "s1") for i in range(6)]
    planted = [(400, text(en, 30) + " " + passage + " " + text(en, 30), "en", "s2"), (401, text(en, 30) + " " + passage + " " + text(en, 30), "en", "s3")]
    junk = [(500, "12 34 !!", "en", "s0"), (501, "", "en", "s0"), (502, None, None, None)]
    rows += copies + planted + junk
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: [x["doc_id"] for x in kept[name]]
    assert sorted(ids("language_id")) == sorted(x[0] for x in rows if x[0] < 500)
    assert sorted(ids("near_copies")) == sorted(x[0] for x in rows if x[0] <= 300 or x[0] in (400, 401))
    cut = {x["doc_id"]: x["text"] for x in kept["repeats"]}
    assert passage in cut[400] and passage[20:-20] not in cut[401] and all(cut[x[0]] == x[1] for x in rows[:200])
    assert set(ids("mixing")) <= set(ids("repeats")) and max(Counter(ids("mixing")).values()) <= 2
    assert sorted(ids("packing")) == sorted(ids("mixing"))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept["packing"]))
    assert os.path.isdir(tmp_path / "out-packing")
