"""Packing, mixing, media, chat and language ID against brute force and by their properties."""

import hashlib
import io
import itertools
import json
import random
import wave
import zlib

import numpy as np
import pytest
from twinloom.llm import chat, langid, media, mixing, packing

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


# ---- packing -------------------------------------------------------------------


def waste(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_bounds_are_optimal():
    r = random.Random(1)
    for _ in range(60):
        n, k = r.randint(1, 9), r.randint(1, 5)
        lengths, counts = r.sample(range(0, 60), n), [r.randint(1, 9) for _ in range(n)]
        tops = packing.bounds(np.array(lengths), np.array(counts), k)
        best = min(waste(lengths, counts, [*c, max(lengths)]) for m in range(min(k, n)) for c in itertools.combinations(lengths, m))
        assert len(tops) <= k and tops == sorted(tops) and waste(lengths, counts, tops) == best
    assert packing.bounds(np.array([]), np.array([])) == []


def test_batches(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 10, 11, 50, 400])), "x") for i in range(800)] + [(5, None, "x"), (6, "w " * 3000, "x"), (None, "w", "x")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), buckets=4, budget=500).collect()
    assert len(out) == len(rows) and all(x["padding"] == x["padded_to"] - x["n_tokens"] >= 0 for x in out)
    batches = {}
    for x in out:
        batches.setdefault((x["bucket"], x["batch"]), []).append(x)
    for (bucket, batch), members in batches.items():
        full = max(1, 500 // max(1, members[0]["padded_to"]))
        assert sorted(m["slot"] for m in members) == list(range(len(members))) and (len(members) == full or batch == max(b for k, b in batches if k == bucket) and len(members) < full)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- mixing --------------------------------------------------------------------


def test_targets():
    sizes = {"b": 100, "a": 10, "c": 50, None: 40, "é": 0}
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(300) and all(got[s] <= 2 * sizes[s] for s in sizes)
    # order a b c é null weighs 3 1 2 3 1; a is full at 20, the rest share 280 by 1 2 . 1 with c at 100 and null at 80
    assert got["a"] == 20 and got["é"] == 0 and got["c"] == 100 and got["b"] == pytest.approx(90) and got[None] == pytest.approx(90 if 90 <= 80 else 80) or got[None] == 80


def test_fit_reaches_what_can_be_reached():
    r = random.Random(3)
    for _ in range(80):
        lengths = r.sample(range(1, 30), r.randint(1, 5))
        counts = [r.randint(1, 4) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        budget = r.randint(0, total + 3)
        take = mixing.fit(np.array(lengths), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and int((take * lengths).sum()) <= budget
        floor = np.floor(np.array(counts) * budget / total) if budget < total else np.array(counts)
        sums = {sum(a * b for a, b in zip(lengths, pick, strict=True)) for pick in itertools.product(*[range(int(f), c + 1) for f, c in zip(floor, counts, strict=True)])}
        assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_mix(spark):
    r = random.Random(4)
    sources = ["a", "b", "c", "d", None]
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "a", "a", *sources]), "x") for i in range(900)] + [(7, "same words here", "b", "x")] * 3 + [(None, "w w", "c", "x"), (8, None, "d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    key = lambda x: tuple(-1 if v is None else v for v in (x["doc_id"], x["size"], x["taken"]))
    out = mixing.mix(docs).collect()
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect())) and len(out) == len(rows)
    for s in sources:
        mine = [x for x in out if x["source"] == s]
        assert sum(x["size"] for x in mine) == mine[0]["source_size"] and abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 1
        assert all(x["taken"] <= 2 * x["size"] and x["taken"] == x["size"] * x["copies"] for x in mine)
    assert mixing.mix(docs.limit(0)).collect() == []
    full = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "c", "en", "s", 1)], DOCUMENTS)
    assert mixing.mixed(full).columns == full.columns and len(mixing.mixed(full).collect()) >= 2


def test_ranked_cuts_large_groups(spark):
    from pyspark.sql import functions as F
    from twinloom.llm.common import ranked, unit

    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), "id", unit("id").alias("u"))
    got = ranked(rows, ["g"], "u", ["id"], "rank", per=64).collect()
    for g in ("hot", None):
        mine = sorted((x["u"], x["id"]) for x in got if x["g"] == g)
        assert [x["rank"] for x in sorted((x for x in got if x["g"] == g), key=lambda x: (x["u"], x["id"]))] == list(range(len(mine)))


# ---- media ---------------------------------------------------------------------


def peaks_by_hand(samples):
    """The strongest bin of each band in each frame, by a plain discrete Fourier transform."""
    out = []
    for at in range(0, len(samples) - media.FRAME + 1, media.HOP):
        frame = [(samples[at + i] - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * i / media.FRAME)) for i in range(media.FRAME)]
        i = np.arange(media.FRAME)
        power = [round(abs((np.array(frame) * np.exp(-2j * np.pi * f * i / media.FRAME)).sum()), 3) for f in range(96)]
        out.append([lo + int(np.argmax(power[lo:hi])) for lo, hi in media.BANDS])
    return out


def test_media(spark):
    texts = ["", None, "short", "Ünïcödé " * 60, "x" * 192, "y" * 193, "line\n" * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "short", "x")], "doc_id long, text string, media string")
    out = {x["doc_id"]: x for x in media.read_media(media.encode_media(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        x = out[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        stored = media.to_wav(padded)
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, padded)
        assert (x["media_bytes"], x["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        peaks = peaks_by_hand(padded)
        pairs = sorted((a, band << 24 | peaks[a][band] << 16 | peaks[a + gap][band] << 8 | gap) for a in range(len(peaks)) for gap in (1, 2, 3) if a + gap < len(peaks) for band in (0, 1))
        assert list(zip(x["fp_times"], x["fp_codes"], strict=True)) == pairs
    assert out[0]["feature"] == out[1]["feature"] and out[2]["feature"] == out[None]["feature"] != out[3]["feature"]
    assert media.read_media(media.encode_media(docs.limit(0))).collect() == []


def test_short_payloads_have_pairs():
    r = random.Random(8)
    texts = ["", *(" ".join("".join(r.choice("aehinorst.") for _ in range(r.randint(2, 9))) for _ in range(r.randint(8, 17))) for _ in range(60))]
    prints = []
    for t in texts:
        assert len(media.payload(t)) == 192
        times, codes = media.fingerprint(media.payload(t))
        assert len(times) == len(codes) > 0
        prints.append((times.tobytes(), codes.tobytes()))
    assert len(set(prints)) == len(texts)


# ---- chat ----------------------------------------------------------------------


def test_validity_and_links(spark):
    schema = {"city": ("string", True), "days": ("integer", False), "opts": ("object", False)}
    arguments = ['{"city":"x"}', '{"city":"x","days":3,"opts":{"a":1}}', "{}", '{"city":5}', '{"city":"x","days":"3"}', '{"city":"x","zone":1}', "[1]", "nothing", None, '{"city":"x","days":1.5}', '{"city":"x","opts":[]}']
    want = ["ok", "ok", "missing city", "type of city", "type of days", "unknown zone", "not an object", "not an object", "not an object", "type of days", "type of opts"]
    calls = spark.createDataFrame([(1, i, f"c{i}", "weather", a) for i, a in enumerate(arguments)], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 100 + i, f"c{i}", "r") for i in range(11)] + [(1, 200, "c0", "again"), (1, 201, "none", "r"), (None, 1, "c0", "r")], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([(1, 0, "system", 'quote " back \\ new\n tab\t \x01 é')], "conv_id long, turn long, role string, text string")
    out = chat.link(messages, calls, results, schema).collect()
    assert [x["status"] for x in sorted((x for x in out if x["kind"] == "call"), key=lambda x: x["turn"])] == want
    status = {(x["conv_id"], x["turn"]): x["status"] for x in out if x["kind"] == "result"}
    assert status[1, 100] == "linked" and status[1, 200] == "repeated" and status[1, 201] == "no call" and status[None, 1] == "no call"
    message = next(x for x in out if x["kind"] == "message")
    assert json.loads(message["json"]) == {"content": 'quote " back \\ new\n tab\t \x01 é', "role": "system", "turn": 0, "type": "message"} and '"content"' in message["json"] and " :" not in message["json"]
    assert sorted(x["position"] for x in out if x["conv_id"] == 1) == list(range(25))


def test_dependencies_and_cycles(spark):
    calls = spark.createDataFrame([(1, 5, c, "f", "{}") for c in "abcdefg"], "conv_id long, turn long, call_id string, name string, arguments string")
    depends = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "e"), (1, "e", "d"), (1, "f", "e"), (1, "g", "unknown")], "conv_id long, call_id string, on_id string")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, call_id string, content string")
    out = {x["call_id"]: x for x in chat.link(none, calls, none, {}, depends).collect()}
    assert {k: x["depth"] for k, x in out.items()} == {"a": 0, "b": 1, "c": 2, "d": -1, "e": -1, "f": -1, "g": 0}
    assert out["d"]["status"] == "cycle" and out["a"]["position"] < out["b"]["position"] < out["c"]["position"]


def test_turns_in_blocks(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", None if t == 4 else f"t{t}") for t in range(2500)] + [(2, 0, None, "x"), (None, None, "user", "y")]
    messages, calls, results = chat.turns_as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.link(messages, calls, results, chat.REPLY).collect()
    assert [x["turn"] for x in sorted((x for x in out if x["conv_id"] == 1), key=lambda x: x["position"])] == list(range(2500)) and len(out) == len(rows)
    assert {x["status"] for x in out if x["conv_id"] == 1} == {"ok", "linked", "type of prompt"}


# ---- language ID ---------------------------------------------------------------

TEXTS = {"en": "the house and the garden of that old man with many trees", "de": "das haus und der garten von diesem alten mann mit vielen bäumen", "fr": "la maison et le jardin de ce vieil homme avec beaucoup d'arbres"}


def labelled(spark):
    r = random.Random(6)
    rows = []
    for i in range(90):
        lang = list(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(r.choice(words) for _ in range(30)), lang, f"src{i % 2}", 1))
    return rows, spark.createDataFrame(rows, DOCUMENTS)


def test_pages(spark):
    _, docs = labelled(spark)
    html = lambda lang, text: f'<html lang="{lang}"><head><script>das und der</script></head><body><nav>die das der</nav><p>{text}</p></body></html>'
    rows = [(1, "https://a.example.de/de/1", html("de", TEXTS["de"])), (2, "http://b.example.com/en/2", html("en", TEXTS["en"])), (3, None, f"<p>{TEXTS['fr']}</p>"), (4, "http://b.example.com/en/9", ""), (5, "http://a.example.de/x", None), (6, "not a url", html("fr", TEXTS["en"] * 4)), (None, None, None)] + [(100 + i, f"http://b.example.com/en/{i}", html("en", TEXTS["en"])) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {x["page_id"]: x for x in langid.identify_pages(pages, docs).collect()}
    assert len(out) == len(rows) and [out[i]["lang"] for i in (1, 2, 3, 4, 6)] == ["de", "en", "fr", "en", "en"]
    assert out[4]["n_trigrams"] == 0 and out[2]["confidence"] > 0.99 and not out[2]["rejected"]
    assert langid.identify_pages(pages.limit(0), docs).collect() == []


def test_declared_anywhere():
    assert langid.declared("<!-- " + "x " * 5000 + '-->\n<HTML class="a"\nLang = de-AT><p>text') == "de"
    assert langid.declared('<html><p lang="fr"></p>' + " " * 9000 + "<html data='1' lang='en'><html lang=it>") == "en"
    assert langid.declared("") is None and langid.declared("<html " * 100_000) is None


def test_pages_with_a_preamble(spark):
    _, docs = labelled(spark)
    pages = spark.createDataFrame([(i, None, f"{start}<html lang='de'><p>{TEXTS['de']}</p>") for i, start in enumerate(["", " " * 6000, f"<!--{'-' * 9000}-->"])], "page_id long, url string, html string")
    assert len({(x["lang"], x["confidence"]) for x in langid.identify_pages(pages, docs).collect()}) == 1


def test_sample_of_few_labelled_texts(spark):
    rows, _ = labelled(spark)
    rows = [*rows[:30], (900, "una casa con jardín", "es", "src0", 1)]
    bare = [(1000 + i, f"nothing is said of {i}", None, "src0", 1) for i in range(3000)]
    copies = [(5000 + i, TEXTS["en"], "en", "src0", 1) for i in range(400)]
    docs = spark.createDataFrame(rows + bare + copies, DOCUMENTS)
    got = [(x["lang"], x["text"]) for x in langid.sample(docs, "text", "lang", 13).collect()]
    assert len(got) == len(set(got)) == 13 and sorted(x for x, _ in got) == ["de"] * 4 + ["en"] * 4 + ["es"] + ["fr"] * 4
    assert langid.fit_text(docs, limit=13)[0] == ["de", "en", "es", "fr"]
    assert len(langid.sample(docs, "text", "lang", 1000).collect()) == len({x[1] for x in rows + copies})
    assert langid.fit_text(docs.where("lang is null"))[0] == []


def test_addresses():
    assert langid.address("https://u@m.x.example.org:80/de/1?q#f") == ("m.x.example.org", "example.org", "org/de")
    assert langid.address(None) == ("", "", "/") and langid.address("http://x.net") == ("x.net", "x.net", "net/")


def test_documents_without_letters_go(spark):
    rows, _ = labelled(spark)
    docs = spark.createDataFrame([*rows, (500, "123 456 !!", "en", "src0", 1), (501, "", "en", None, 0), (502, None, None, None, None), (503, " ".join([TEXTS["de"]] * 3), "en", "src0", 1), (504, "zq wx vv " * 50, "en", "src0", 1)], DOCUMENTS)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {x[0] for x in rows} | {504}  # 503 is of another language than it says, 504 of none
    found = {x["doc_id"]: x["lang"] for x in langid.identify_documents(docs).collect()}
    assert all(found[x[0]] == x[2] for x in rows)
