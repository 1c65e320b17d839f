"""The n-gram join against all pairs, and components against a search."""

import random
import re

import numpy as np
import pytest
from twinloom.llm import jaccard
from twinloom.llm.components import components


def sets(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, similar):
    own = [sets(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and similar[1] * len(own[i] & own[j]) >= similar[0] * len(own[i] | own[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(own[i]), least.get(find(i)) if own[i] else k) for i, (k, _) in enumerate(rows) if k is not None)


def corpus(seed):
    r = random.Random(seed)
    words = [a + b for a in ("Ka", "lo", "mi", "Ñu", "ta") for b in ("ra", "sé", "to", "ly")]
    rows, k = [], 0
    for size in (4, 9, 10, 11, 20, 30, 60, 150):
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            for _ in range(r.randint(1, 12)):
                copy = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                    copy[r.randrange(len(copy))] = r.choice(words)
                if r.random() < 0.3:
                    copy = copy[: -r.randint(1, 3)]
                rows.append((k, r.choice([" ", "\n", "\t "]).join(copy)))
                k += 1
    rows += [(k, ""), (k + 1, ""), (k + 2, None), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "one two"), (k + 6, " \n "), (None, rows[4][1]), rows[7], (rows[8][0], "another text of the same id"), (k + 7, "É é"), (k + 8, "é é"), (k + 9, "a b c d"), (k + 10, "a b c d")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "similar"), [(1, 3, (90, 100)), (2, 5, (80, 100))])
def test_against_all_pairs(spark, seed, n, similar):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, sid string, n_shingles int").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, n, similar).collect() if r["doc_id"] is not None)
    assert got == brute(rows, n, similar)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text + " more"), (2, "Other words stand here on their own"), (2, "Other words stand here on their own"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4, 5]
    assert jaccard.join(docs.limit(0)).collect() == []


def test_keep_one_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (None, text("d")), (None, text("d")), (None, ""), (None, None), (3, text("c") + " more"), (7, text("e")), (7, text("f")), (7, text("g")), (7, text("g")), (9, text("f") + " more"), (8, ""), (8, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:1], r["text"] is None) for r in out.collect())
    assert kept == [(0, "", False), (0, "", True), (0, "a", False), (0, "b", False), (0, "d", False), (3, "c", False), (7, "e", False), (7, "f", False), (7, "g", False), (8, "", False), (8, "", False)]
    one = jaccard.keep_one(docs.where("doc_id is null or doc_id = 3").where("text like 'c%' or text like 'a%'"))
    assert sorted(r["text"][0] for r in one.collect()) == ["a", "c"]


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500)]
    r.shuffle(links)
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 500: 500, 501: 500}


def test_fragments_are_even():
    r = np.random.default_rng(4)
    for found in (r.integers(0, 1 << 63, 200_000, dtype=np.uint64) * 2, np.repeat(r.integers(0, 1 << 63, 2000, dtype=np.uint64) * 2, r.zipf(1.5, 2000) % 5000)):
        total = np.bincount(jaccard._counter(found, jaccard.SKETCH), minlength=jaccard.SKETCH)
        load = jaccard.levels(total)
        cuts = jaccard.pivots(load, 4)
        share = np.bincount(np.searchsorted(cuts, jaccard.places(found, load), side="right"), minlength=4) / len(found)
        assert len(cuts) == 3 and share.max() < 0.5 and share.min() > 0.05
    assert np.abs(np.bincount(np.searchsorted(jaccard.pivots(np.ones(1 << 20, np.uint8), 4), np.arange(1 << 16) >> 8 | 1 << 8, side="right")) / (1 << 16) - 0.25).max() < 0.01
    order = jaccard.levels(np.array([1, 63, 64, 80, 1000, 10**6, 10**8, 9 * 10**8])).tolist()
    assert order == sorted(order) and len(set(order)) == len(order)
