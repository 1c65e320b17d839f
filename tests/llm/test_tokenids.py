"""Exact round trips of the coder and the files, and pieces against whole texts."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from twinloom.llm import idcoder, tokenids

ODD = ["", " ", "don't STOP, it's 5.5%..", "a b c　d\x85e", "x\x1cy\x1dz \x1e", "ΟΔΥΣΣΕΥΣ Σ. İstanbul,", "é café ́x", "<|startoftext|> <|endoftext|>.", "ﬁ ǅ ß. Ünïcödé, naïve. 中文。日本", "tab\tnew\r\nline\x0b\x0c", "a.b,c . , ., x.,", "\x01 \x00 \x7f", "😀👍🏽 ok", "𝔘𝔫𝔦", "word" * 400]


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 9000])
def test_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 65536, n), np.zeros(n, np.int64), np.full(n, 65535), r.zipf(1.3, n) % 49408, np.arange(n) % 7):
        counts = np.array([n // 2, n - n // 2])
        image = idcoder.pack_file(ids.astype(np.uint16), [5, None], counts)
        got, keys, c = idcoder.unpack_file(image)
        assert got.tolist() == ids.tolist() and keys == [5, None] and c.tolist() == counts.tolist()


def test_repetition_is_short_and_damage_is_found():
    ids = np.tile(np.random.default_rng(1).integers(0, 40000, 50), 200).astype(np.uint16)
    image = idcoder.pack_file(ids, [1], np.array([len(ids)]))
    assert len(image) < len(ids)  # 16 bits an id to under 8
    for at in (30, len(image) // 2, len(image) - 1):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.unpack_file(bytes(bad))


def test_blocks_are_independent():
    r = np.random.default_rng(3)
    tables, places = idcoder.Tables.fitted(r.zipf(1.2, 3 * idcoder.BLOCK) % 5000)
    tables = idcoder.Tables.unpacked(tables.packed())
    ids, sizes = places.reshape(3, -1), np.full(3, idcoder.BLOCK)
    codes = idcoder.encode_blocks(ids, sizes, tables)
    assert codes[1] == idcoder.encode_blocks(ids[1:2], sizes[:1], tables)[0]
    assert idcoder.decode_blocks(codes[2:], sizes[:1], tables).tolist() == ids[2:].tolist()


def test_all_neighbours_are_counted():
    """Of two ids that alternate, both have a successor, however long the file is."""
    tables, _ = idcoder.Tables.fitted(np.tile([7, 9], 750_000))
    assert tables.names.tolist() == [7, 9] and tables.after.tolist() == [1, 0] and tables.level.tolist() == [3, 3]


def test_wide_ids():
    ids = np.array([0, 2**32 - 1, 70_000, 2**31, 70_000, 5] * 900 + list(range(1 << 18, (1 << 18) + 3000)), np.int64)
    image = idcoder.pack_file(ids, [7], np.array([len(ids)]))
    assert idcoder.unpack_file(image)[0].tolist() == ids.tolist()


def test_texts_take_less_than_their_frequencies():
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    texts = pq.read_table(folder, columns=["doc_id", "text"]).sort_by("doc_id")["text"].combine_chunks()
    ids, counts = tokenids.Pieces(tokenids.tokenizer_path(), 1).encode(texts)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    size = 8 * len(idcoder.pack_file(ids, [1], np.array([len(ids)])))
    assert size < -(share * np.log2(share)).sum() * len(ids) < 8 * len(zlib.compress(ids.astype("<u2").tobytes()))


def test_pieces_against_whole_texts():
    whole = tokenids.Pieces(tokenids.tokenizer_path(), 1)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("aàeéñß .,'\n\t1A!-Σ") for _ in range(200)) for _ in range(60)]
    marks = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|end", "oftext|>", "|>", " ", "Word", "é", "Σ", "\u212a", "Ünï,"]
    texts += ["say <|ENDOFTEXT|> now"] + ["".join(r.choice(marks) for _ in range(r.randint(1, 12))) for _ in range(400)]
    for _ in range(2):
        ids, counts = whole.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part in zip(texts, parts, strict=True):
            assert part.tolist() == [*whole.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


class Counted:
    """A tokenizer whose calls for single pieces are counted."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    @property
    def model(self):
        return self

    def encode(self, *args, **kinds):
        self.calls += 1
        return self.tokenizer.encode(*args, **kinds)

    def tokenize(self, word):
        self.calls += 1
        return self.tokenizer.model.tokenize(word)


@pytest.mark.parametrize("group", [4096, 7])
def test_new_words_are_learnt_together(monkeypatch, group):
    """Words of plain letters go to the library by thousands, and once whatever marks follow them."""
    monkeypatch.setattr(tokenids, "GROUP", group, raising=False)
    own = tokenids.Pieces(tokenids.tokenizer_path(), 1)
    whole = own.tokenizer
    own.tokenizer = counted = Counted(whole)
    r = random.Random(6)
    words = list({"".join(r.choice("aeinrstéñüß") for _ in range(r.randint(3, 12))) for _ in range(9000)})
    texts = [" ".join(w + r.choice(["", ",", ".", "***", "?!", "'"]) for w in words[i : i + 100] * 3) for i in range(0, len(words), 100)]
    ids, counts = own.encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all(p.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1] for t, p in zip(texts, parts, strict=True))
    assert counted.calls < 10 and len(own) < len(words) + 10


def test_letters_and_marks_at_every_edge():
    """Each character up to U+02FF between letters, at an end, and before and after each ASCII mark; slices of an array, empty texts among them."""
    own = tokenids.Pieces(tokenids.tokenizer_path(), 1)
    texts = ["", "z"]
    for c in map(chr, range(1, 0x300)):
        texts += [f"{c}", f"a{c}b {c}a b{c}", " ".join(f"x{c}{chr(m)} {chr(m)}{c} {c}{chr(m)}s" for m in range(33, 127) if not chr(m).isalnum()), "", ".", "é"]
    for some in (pa.array(texts), pa.array(texts).slice(3, 700), pa.array(texts[:1]), pa.array(texts).slice(1, 0)):
        ids, counts = own.encode(some)
        ends = np.cumsum(counts)
        for text, n, e in zip(some.to_pylist(), counts.tolist(), ends.tolist(), strict=True):
            assert ids[e - n : e].tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_files(spark):
    r = random.Random(4)
    rows = [(i * 7 % 2801 - 5, r.choice(ODD) + " more " * r.randint(0, 40), "x") for i in range(2801)] + [(None, "none", "x"), (None, None, "x"), (3, "again", "x"), (3, "again", "x"), (10**12, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    files = tokenids.write_files(docs, file_ids=500)
    assert files.count() > 1
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in tokenids.read_files(files).collect())
    tokenizer = tokenids.pieces(tokenids.tokenizer_path(), 1).tokenizer
    want, start = [], 0
    for i, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    # a null text counts as empty, and sorts with it
    assert [x[0] for x in got] == [x[0] for x in want] and sorted(x[1:] for x in got if x[1] is not None) == sorted(x[1:] for x in want if x[1] is not None)
    assert tokenids.read_files(tokenids.write_files(docs.limit(0))).collect() == []


def test_texts_of_one_id_have_one_order(spark):
    """Texts that begin alike are told apart by all they hold, however the rows came."""
    rows = [(1, "word " * 20 + " ".join(["more"] * (i * 37 % 101)) + str(i % 150)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one partition
    try:
        one, two = (sorted((x["start"], x["n_tokens"], x["ids_crc32"]) for x in tokenids.read_files(tokenids.write_files(d)).collect()) for d in (docs.repartition(7), docs.orderBy(F.length("text").desc()).coalesce(1)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert one == two and len(one) == 300
