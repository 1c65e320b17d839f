"""Repeated byte strings, against a scan of all strings."""

import hashlib
import random
import zlib

import pytest
from twinloom.llm import suffixes


def brute(rows, length=suffixes.LENGTH):
    """(doc_id, text) -> (n_bytes, n_removed, n_spans, kept_sha256), by a set of all strings seen so far."""
    order = sorted({(i is not None, i or 0, zlib.crc32((t or "").encode()), i, t or "") for i, t in rows})
    seen, out = set(), {}
    for _, _, _, i, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i, t] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "Ünd", "erst", "naïve", "ting", "a", "x\x00y", "ß", "lorem", "\n"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), text(r.randint(0, 12))]
        rows.append((r.randint(0, 10**6) if r.random() < 0.8 else i, " ".join(parts)))
    base = rows[0][1] + text(200)
    for i in range(15):  # near copies
        k = r.randint(0, len(base) - 1)
        rows.append((2000 + i, base[:k] + "#" * r.randint(0, 3) + base[k:]))
    rows += [(3000, "ab" * 400), (3001, "a" * 500), (3002, "a" * 99), (3003, "a" * 100), (3004, ""), (3005, None), (None, rows[2][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[6][1] + "y"), (3006, rows[7][1]), (3007, rows[7][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(5)
    spans = suffixes.find_spans(docs, hot=hot)
    assert spans.count() > 0
    got = sorted(tuple(r) for r in suffixes.report(docs, hot=hot).collect() if r[0] is not None)
    assert got == sorted((i, *want[i, t or ""]) for i, t in rows if i is not None)


def test_long_text_in_segments(spark, monkeypatch):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ") for _ in range(6000))
    rows = [(1, long), (2, long[3000:] + "!" + long[:1500])]
    want = brute(rows)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": pa.array([1, 2], pa.int64()), "mark": pa.array([0, 0], pa.int64()), "text": [t for _, t in rows]})
    out = suffixes._rows(batch, 100)
    assert len(out["key"]) and (out["at"] >> 16).max() > 5000
    monkeypatch.undo()
    got = {x["doc_id"]: tuple(x)[1:] for x in suffixes.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i, t] for i, t in rows}


def test_empty_table_and_short_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert suffixes.report(empty).collect() == []
    assert suffixes.strip(empty).collect() == []


def test_strip_keeps_characters_and_columns(spark):
    passage = "Ünïcödé " * 20
    docs = spark.createDataFrame([(1, "first " + passage, "de", "s", 1), (2, "second ö" + passage + "tail", "de", "s", 1), (3, passage, "de", "s", 1), (4, "clean", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars int")
    out = {r["doc_id"]: r for r in suffixes.strip(docs).collect()}
    assert suffixes.strip(docs).columns == docs.columns
    assert out[1]["text"].startswith("first Ü") and out[4]["text"] == "clean" and 3 not in out
    assert out[2]["text"].startswith("second") and out[2]["text"].endswith("tail") and len(out[2]["text"]) < 40 and out[2]["n_chars"] == len(out[2]["text"])
