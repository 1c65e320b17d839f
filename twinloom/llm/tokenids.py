"""Token ids of documents, written as range-coded files in ascending order of document and read back.

Documents are range-partitioned by id, so each partition holds a run of the
global order; a task tokenizes its run and writes file images of about
``FILE_IDS`` ids. The files are rows (partition, number, image) of a Parquet
table in the shared folder, which any store can hold. Reading decodes a file
at a time. Offsets come from the sums of files: one small row a file.

Texts are cut at white space before tokenizing, and a piece that was met
before takes its ids from a table of about ``CACHE`` pieces: the tokenizer
drops white space, so pieces are tokenized alone as they are in the text (a
test holds this against whole texts). Words are parted from marks after them,
as the pre-tokenizer does, and new words of plain letters go to the library's
model by thousands. A text that holds an added token's letters, in any case,
is tokenized as a whole.

Defined cases: a null or empty text has the end id only; null ids come first;
repeated ids are documents of their own, in the order of their texts' first 32
characters and then of a hash of their whole texts; a text of any length is tokenized whole, in one file; an empty table writes no file and
gives an empty table. Only the id and text columns are looked at.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinloom.llm import idcoder
from twinloom.llm.common import in_arrow, written

END_ID = 1
FILE_IDS = 8 << 20
CACHE = 600_000
#: Words that the model is given as one text.
GROUP = 4096
TOKENIZER = "word_bpe_49k.json"
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: UTF-16 of the characters that stand for bytes; a blank stands for itself, between words.
_SPELT = np.array([32 if b == 32 else ord(_LETTERS[b]) for b in range(256)], "<u2")
_MARKS = np.array([chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in range(256)])


def _letters(lead: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter from U+00C0 to U+024F (all there are letters but for two signs)."""
    return (lead >= 0xC3) & (lead <= 0xC9) & (last >= 0x80) & (last <= 0xBF) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))


def _parted(texts: pa.Array) -> pa.Array:
    """texts (in lower case) with a blank between a letter and a mark after it, where the pre-tokenizer cuts in any case."""
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    mark = _MARKS.take(own)
    at = np.flatnonzero(mark[1:] > mark[:-1]) + 1
    one, two = own.take(at - 1), own.take(at - 2, mode="wrap")
    at = at[(one >= 97) & (one <= 122) | (at > 1) & _letters(two, one)]
    moved = ends - ends[0] + np.searchsorted(at, ends - ends[0])  # a blank at a text's end or start does nothing
    if moved[-1] >= 1 << 31:
        return texts
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int32)), pa.py_buffer(np.insert(own, at, 32)))


def _plain(found: pa.Array) -> np.ndarray:
    """Of pieces in lower case that aren't empty: whether one consists of a to z and letters from U+00C0 to U+024F."""
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    own = np.frombuffer(found.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    pair = _letters(own[:-1], own[1:])
    good = (own >= 97) & (own <= 122)
    good[:-1] |= pair
    good[1:] |= pair
    return np.logical_and.reduceat(good, ends[:-1] - ends[0])


class Pieces(dict):
    """Places of the pieces met so far; a piece that is asked for and not there is noted for learn()."""

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        # the same model for words that are spelt in its letters already and parted by blanks
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)  # of each id: it ends a word
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[None], self[""] = 0, 1  # the end of a document, and nothing
        self.used = 2
        self.fresh: list[str | tuple[str]] = []
        self.ids = np.array([self.end_id], np.uint32)
        self.start, self.size = np.array([0, 0]), np.array([1, 0])

    def __missing__(self, piece: str | tuple[str]) -> int:
        self[piece] = place = self.used
        self.used += 1
        self.fresh.append(piece)
        return place

    def learn(self) -> None:
        """Finds the ids of the noted pieces, by the whole way. A whole text, in a tuple, is not kept."""
        flat: list[int] = []
        sizes = []
        for piece in self.fresh:
            if isinstance(piece, tuple):
                del self[piece]
                piece = piece[0]
            got = self.tokenizer.encode(piece, add_special_tokens=False).ids
            flat += got
            sizes.append(len(got))
        self.fresh = []
        self.add(np.array(flat, np.uint32), np.array(sizes, np.int64))

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Appends the ids of pieces, one piece after the other."""
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))

    def learn_words(self, words: pa.Array) -> None:
        """Finds the ids of words of plain letters, which the pre-tokenizer leaves whole: many at once, spelt as it would hand them over.

        A word's last id is the only one that ends a word, so the ids of many are parted by it.
        """
        got: list[np.ndarray] = []
        for i in range(0, len(words), 64 * GROUP):
            some = words.slice(i, 64 * GROUP)
            groups = pa.ListArray.from_arrays(pa.array([*range(0, len(some), GROUP), len(some)], pa.int32()), some)
            spelt = [_SPELT.take(np.frombuffer(x.encode(), np.uint8)).tobytes().decode("utf-16-le") for x in pc.binary_join(groups, " ").to_pylist()]
            got += [np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(spelt, add_special_tokens=False)]
        ids = np.concatenate(got)
        size = np.diff(np.flatnonzero(self.last.take(ids)), prepend=-1)
        if len(size) != len(words) or size.sum() != len(ids):
            raise ValueError("the tokenizer parts or joins words of letters")
        self.used += len(words)
        self.add(ids, size)

    def known(self, found: pa.Array) -> np.ndarray:
        """The place of each of these different pieces."""
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found), "\n")[0].as_py().split("\n")  # no piece has a line's end
        places = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        if len(new):
            pieces_ = found.take(pa.array(new))
            plain = _plain(pieces_) & self.last.any()
            words = new[plain]
            if len(words):
                places[words] = np.arange(self.used, self.used + len(words))
                self.update(zip(map(names.__getitem__, words.tolist()), places[words].tolist(), strict=True))
                self.learn_words(pieces_.filter(pa.array(plain)))
            for i in new[~plain].tolist():
                places[i] = self[names[i]]
        return places

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of each piece, number of pieces of each text) of texts without nulls."""
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        own = raw[ends[0] : ends[-1]]
        # below U+0300 every text is in normal form and lower case is one letter for one, but for U+0130;
        # the four separators are white space for Arrow and Python, not for the tokenizer
        odd = (own >= 0xCC) | ((own >= 0x1C) & (own <= 0x1F))
        odd[1:] |= (own[1:] == 0xB0) & (own[:-1] == 0xC4)
        if odd.any():
            strange = np.add.reduceat(np.append(odd, False), ends[:-1] - ends[0]) * (np.diff(ends) > 0) > 0
        else:
            strange = np.zeros(len(texts), bool)
        lower = pc.utf8_lower(texts)
        for mark in self.added:  # in any case: an added token counts only as it is written, and is looked for before letters change
            strange |= pc.match_substring(lower, mark).to_numpy(zero_copy_only=False)
        plain = pc.utf8_split_whitespace(_parted(lower.filter(pa.array(~strange)) if strange.any() else lower)) if not strange.all() else pa.array([], pa.list_(pa.string()))
        found = plain.flatten().dictionary_encode()
        at = self.known(found.dictionary)[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[~strange] = np.diff(plain.offsets.to_numpy()) if len(plain) else 0
        if not strange.any():
            return at, counts
        parts = np.split(at, np.cumsum(counts[~strange])[:-1]) if (~strange).any() else []
        out, next_ = [], iter(parts)
        for i, other in enumerate(strange.tolist()):
            if other:
                text = texts[i].as_py()
                pieces_ = [(text,)] if any(mark in text.lower() for mark in self.added) else self.cut(text)
                counts[i] = len(pieces_)
                out.append(np.fromiter(map(self.__getitem__, pieces_), np.int64, len(pieces_)))
            else:
                out.append(next(next_))
        return np.concatenate(out), counts

    @staticmethod
    def cut(text: str) -> list[str]:
        if unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text:
            text = text.lower()  # as the tokenizer does; those two letters depend on their neighbours
        return text.split() if not _SEPARATORS.search(text) else [w for w in re.split("[ \t\n\r]+", text) if w]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with the end id after each text, number of ids of each text); null texts are empty."""
        if len(self) > CACHE:
            self.reset()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at, counts = self.places(pc.fill_null(texts, ""))
        if self.fresh:
            self.learn()
        ends = np.cumsum(counts)
        at = np.insert(at, ends, 0)
        ends += np.arange(1, len(ends) + 1)
        size = self.size[at]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[at] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.diff(total[ends - 1], prepend=0)


_PIECES: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, end_id: int) -> Pieces:
    """This worker's table for a tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
    if (path, end_id) not in _PIECES:
        _PIECES[path, end_id] = Pieces(path, end_id)
    return _PIECES[path, end_id]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_files(docs: DataFrame, name: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """The written files of all documents: part, number, n_ids, image; in their order, ids ascend."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # one id may hold any share of the rows: its texts are parted by how they begin and by a hash of the whole, and equal rows anyhow
    whole = ["doc_id", F.substring("text", 1, 32), F.xxhash64("text")]
    rows = rows.withColumn("_row", F.pmod(F.monotonically_increasing_id(), F.lit(4096))).repartitionByRange(*whole, "_row").drop("_row").sortWithinPartitions(*whole, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = pieces(tokenizer_path(name), end_id), TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def image() -> pa.RecordBatch:
            data = idcoder.pack_file(np.concatenate(ids), keys, np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "number", "n_ids", "image"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                got, n = own.encode(some.column(1))
                keys += some.column(0).to_pylist()
                ids.append(got)
                counts.append(n)
                held += len(got)
                if held >= file_ids:
                    yield image()
                    keys, ids, counts, held, number = [], [], [], 0, number + 1
        if keys:
            yield image()

    return written(in_arrow(rows, write, "part int, number int, n_ids long, image binary"), "ids")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, keys, counts = idcoder.unpack_file(image)
                ends = np.cumsum(counts)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array([number] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["part", "number", "doc_id", "inner", "n_tokens", "ids_crc32"])

    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(F.col("part").alias("_part"), before(Window.orderBy("part")).alias("_first"))  # a row for each task that wrote
    places = files.select("part", F.col("number").alias("_n"), before(Window.partitionBy("part").orderBy("number")).alias("_inner"))
    places = places.join(parts, F.col("part") == F.col("_part")).select(F.col("part").alias("_p"), "_n", (F.col("_first") + F.col("_inner")).alias("_before"))
    found = in_arrow(files.select("part", "number", "image"), read, "part int, number int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    found = found.join(places, (F.col("part") == F.col("_p")) & (F.col("number") == F.col("_n")))
    return found.select("doc_id", (F.col("_before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
