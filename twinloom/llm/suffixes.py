"""Removal of repeated byte strings by suffix sorting in blocks with a cover sample.

Every byte covered by a string of ``length`` bytes that also starts earlier
(in a smaller document, or earlier in the same) is removed; strings are judged
on the input. Sorting all suffixes would move many times the corpus, so the
order is built as in blockwise difference-cover construction, with a cover
chosen by content instead of by residues:

1. Cover sample. Of every string of ``length`` bytes, the position with the
   smallest hash of ``GRAM`` bytes is sampled. Like a difference cover's
   positions, it lies at the same distance from the start of any two equal
   strings; unlike them, it takes in only one position in about 35. The
   strings that share a sample position are neighbours and form one block.
2. Buckets. Blocks meet in the bucket of their sample's hash. A block whose
   whole content has come earlier is settled at once; buckets of one content
   are settled too. What is left are first occurrences of different contents.
3. Sorting. A bucket's sample suffixes are ranked first (bytes from the
   sample position on), with the common prefixes of neighbours; then, one
   distance at a time, the bucket's suffixes are ordered by the few bytes
   before the sample position, and the ties, however long, by the rank.

Memory is bounded by one run of buckets: a bucket of over ``HOT`` contents is
not sorted in one task, its strings are compared by 128 bits of hash in a
distributed minimum instead, so no bucket limits the input. Equal blocks
within one batch of input are settled before anything is shuffled.

Texts are cut into segments of ``SEGMENT`` bytes that overlap, so a text of
any length takes bounded memory beside its own bytes.

Defined cases: null and empty texts, and those shorter than ``length``, lose
nothing; a null id comes before all others (it stands for the smallest long);
rows of equal id and text are one document, not copies of each other; rows of
equal id and other text are ordered by their crc32; an empty table gives an
empty table. Only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import in_arrow, map_batches, numbered, written

LENGTH = 100
GRAM = 32
SEGMENT = 1 << 18
HOT = 50_000
_RUN = 40_000
_NULL = -(1 << 63)
_MASK = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, enough for a segment."""
    if base not in _POWERS:
        out = np.full(SEGMENT + 4096, base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base]


def _inverse() -> np.ndarray:
    return _powers(pow(_ROOT, -1, 1 << 64))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; part(sums, i, j) is the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_ROOT)[: len(data)], out=out[1:])
    return out


def part(total: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (total[j] - total[i]) * _inverse()[i]


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Blocks of the pieces data[starts:ends]: (sample hash, content hash, first string, number of strings, distance of the sample)."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    n, width = len(data), length - GRAM + 1
    valid = np.zeros(max(0, n - length + 1), bool)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s >= length:
            valid[s : e - length + 1] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return empty
    total = sums(data)
    grams = (total[GRAM:] - total[:-GRAM]) * _inverse()[: n - GRAM + 1]
    low = (grams ^ (grams >> np.uint64(32))) * _MIX
    low = (low & ~_MASK) | np.arange(len(low), dtype=np.uint64)  # ties: the first
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: span - width], low[width - span :])
    sample = (low & _MASK).astype(np.int64)[at]
    fresh = np.flatnonzero(np.concatenate(([True], (np.diff(sample) != 0) | (np.diff(at) != 1))))
    first, last = at[fresh], at[np.append(fresh[1:], len(at)) - 1]
    sample = sample[fresh]
    count, before = last - first + 1, sample - first
    content = part(total, first, last + length) + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + before.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    key = (grams[sample] ^ (grams[sample] >> np.uint64(29))) * _MIX
    return key, content ^ (content >> np.uint64(31)), first, count, before


def _pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, rows, offsets in the row's text) of runs of at most SEGMENT bytes."""
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    row = 0
    while row < len(texts):
        if ends[row + 1] - ends[row] > SEGMENT:
            for at in range(int(ends[row]), int(ends[row + 1]) - length + 1, SEGMENT - length):
                some = raw[at : min(at + SEGMENT - 1, int(ends[row + 1]))]  # neighbours share length - 1 bytes
                yield some, np.array([0]), np.array([len(some)]), np.array([row]), np.array([at - int(ends[row])])
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + SEGMENT, side="right")) - 1)
        bounds = ends[row : last + 1] - ends[row]
        yield raw[ends[row] : ends[last]], bounds[:-1], bounds[1:], np.arange(row, last), np.zeros(last - row, np.int64)
        row = last


def merged(starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of [start, end) in each group as maximal runs: (group, starts, ends)."""
    if not len(starts):
        return group, starts, ends
    order = np.lexsort((ends, starts, group))
    g, s, e = group[order], starts[order], ends[order]
    # the largest end so far within the group
    lift = (g - g.min()) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + lift) - lift
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    return g[at], s[at], reach[np.append(at[1:], len(g)) - 1]


def _rows(batch: pa.RecordBatch, length: int) -> dict:
    """Blocks of a batch (doc, mark, text), one for each content; later ones of the same are spans already.

    A block has at = first string << 16 | number of strings << 8 | distance of
    the sample; a span has at = start << 16 and its end as content.
    """
    docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    found = []
    for data, starts, ends, rows, offsets in _pieces(batch.column(2), length):
        key, content, first, count, before = blocks(data, starts, ends, length)
        own = np.searchsorted(starts, first, side="right") - 1
        found.append((key, content, rows[own], first - starts[own] + offsets[own], count, before))
    key, content, row, first, count, before = (np.concatenate(x) for x in zip(*found, strict=True))
    key, content = key.view(np.int64), content.view(np.int64)
    order = np.lexsort((first, marks[row], docs[row], content, key))
    same = np.concatenate(([False], (np.diff(key[order]) == 0) & (np.diff(content[order]) == 0)))
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    lead = order[leader]
    again = (docs[row[order]] == docs[row[lead]]) & (marks[row[order]] == marks[row[lead]]) & (first[order] == first[lead])  # the same document
    keep = order[~same]
    late = order[same & ~again]
    group, s, e = merged(first[late], first[late] + count[late] - 1 + length, row[late])
    spread = ((s.astype(np.uint64) + np.uint64(1)) * np.uint64(_ROOT) ^ docs[group].astype(np.uint64) * _MIX).view(np.int64)
    return {
        "key": np.concatenate((key[keep], spread)), "content": np.concatenate((content[keep], e)),
        "doc": np.concatenate((docs[row[keep]], docs[group])), "mark": np.concatenate((marks[row[keep]], marks[group])),
        "at": np.concatenate((first[keep] << 16 | count[keep] << 8 | before[keep], s << 16)),
    }


def _settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, content, doc, mark, at): spans, and the first blocks of buckets with several contents.

    Keeps only the current content's first row and the last first row between batches.
    """
    names = ["key", "doc", "mark", "start", "end", "at"]
    head = None  # (key, content, doc, mark, at, emitted) of the latest first row
    for batch in batches:
        key, content, doc, mark, at = (batch.column(i).to_numpy() for i in range(5))
        is_span = (at & 0xFFFF) == 0
        spans = [(doc[is_span], mark[is_span], at[is_span] >> 16, content[is_span])]
        key, content, doc, mark, at = (x[~is_span] for x in (key, content, doc, mark, at))
        if len(key):
            if head is not None:
                key, content, doc, mark, at = (np.concatenate((np.array([h], x.dtype), x)) for h, x in zip(head[:5], (key, content, doc, mark, at), strict=True))
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            firsts = np.flatnonzero(first)
            lead = firsts[np.cumsum(first) - 1]
            late = ~first & ~((doc == doc[lead]) & (mark == mark[lead]) & (at == at[lead]))
            start = at[late] >> 16
            spans.append((doc[late], mark[late], start, start + (at[late] >> 8 & 0xFF) - 1 + length))
            twin = key[firsts[1:]] == key[firsts[:-1]]
            shared = np.concatenate(([False], twin)) | np.concatenate((twin, [False]))
            done = head is not None and head[5]
            fresh = shared.copy()
            if done:
                fresh[0] = False
            open_ = firsts[fresh]
            last = firsts[-1]
            head = (key[last], content[last], doc[last], mark[last], at[last], bool(shared[-1]) or (done and len(firsts) == 1))
        else:
            open_ = np.zeros(0, np.int64)
        d, m, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
        k = np.zeros(len(d), np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((k, key[open_])), pa.int64()), pa.array(np.concatenate((d, doc[open_])), pa.int64()), pa.array(np.concatenate((m, mark[open_])), pa.int64()),
            pa.array(np.concatenate((s, np.full(len(open_), -1))), pa.int64()), pa.array(np.concatenate((e, np.full(len(open_), -1))), pa.int64()), pa.array(np.concatenate((k, at[open_])), pa.int64()),
        ], names)


def ranks(strings: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts rows of bytes within buckets: (order, rank of each row, common prefix of each row in order with the one before; -1 across buckets)."""
    n, width = strings.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = strings
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], bucket))
    common = np.full(n, -1, np.int64)
    if n > 1:
        a = strings[order]
        differ = a[1:] != a[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:][bucket[order][1:] != bucket[order][:-1]] = -1
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order, rank, common


def repeated(bucket: np.ndarray, doc: np.ndarray, mark: np.ndarray, first: np.ndarray, count: np.ndarray, before: np.ndarray, contents: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every string of these blocks that also starts earlier in another block of its bucket."""
    most = length - GRAM
    n = len(bucket)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    sizes = count + length - 1
    line = np.zeros((n, most + length), np.uint8)  # the sample position of every block is column ``most``
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    line[np.repeat(np.arange(n), sizes), np.repeat(most - before, sizes) + inner] = flat
    # the sample's suffixes first, then what stands before it, read backwards
    _, right, right_common = ranks(line[:, most:], bucket)
    _, left, left_common = ranks(line[:, most - 1 :: -1] if most else line[:, :0], bucket)
    order = np.empty(n, np.int64)
    order[np.lexsort((first + before, mark, doc))] = np.arange(n)
    rows, starts = [], []
    near = before - count + 1  # smallest distance of a string's start to the sample
    for d in range(int(before.max(initial=0)) + 1):
        here = np.flatnonzero((near <= d) & (d <= before))
        if len(here) < 2:
            continue
        by_right = np.cumsum(right_common < length - d)[right[here]]
        by_left = np.cumsum(left_common < d)[left[here]]
        both = by_left * (n + 1) + by_right
        sort = np.lexsort((order[here], both))
        again = np.concatenate(([False], both[sort][1:] == both[sort][:-1]))
        # the first of a class by order stays; a document that comes twice is not its own copy
        lead = here[sort][np.maximum.accumulate(np.where(again, 0, np.arange(len(sort))))]
        got = here[sort]
        again &= ~((doc[got] == doc[lead]) & (mark[got] == mark[lead]) & (first[got] + before[got] == first[lead] + before[lead]))
        rows.append(got[again])
        starts.append((first + before - d)[got[again]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts)


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of first blocks (key, doc, mark, at, content) in order of key; whole buckets are sorted, some at a time."""
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        key, doc, mark, at = (np.concatenate([r[i] for r in rows]) for i in range(4))
        contents = [c for r in rows for c in r[4]]
        row, start = repeated(key, doc, mark, at >> 16, at >> 8 & 0xFF, at & 0xFF, contents, length)
        row, s, e = merged(start, start + length, row)
        return pa.RecordBatch.from_arrays([pa.array(doc[row], pa.int64()), pa.array(mark[row], pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc", "mark", "start", "end"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        key, doc, mark, at = (batch.column(i).to_numpy() for i in range(4))
        contents = batch.column(4).to_pylist()
        turns = np.flatnonzero(key[1:] != key[:-1]) + 1
        edge = int(turns[-1]) if len(turns) else 0  # where the batch's last bucket begins; at 0 it may have begun before
        if size + edge >= _RUN and (edge or held and held[-1][0][-1] != key[0]):
            yield settle([*held, (key[:edge], doc[:edge], mark[:edge], at[:edge], contents[:edge])])
            held, size = [], 0
            key, doc, mark, at, contents = key[edge:], doc[edge:], mark[edge:], at[edge:], contents[edge:]
        if len(key):
            held.append((key, doc, mark, at, contents))
            size += len(key)
    if held:
        yield settle(held)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), F.crc32(F.encode(text, "UTF-8")).alias("mark"), text.alias("text"))


def find_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, mark (crc32 of the text), spans (array of start << 32 | end, possibly overlapping) of documents that lose bytes."""
    rows = _prepared(docs, id_col, text_col).where(F.octet_length("text") >= length)
    found = map_batches(rows, lambda batch: _rows(batch, length), "key long, content long, doc long, mark long, at long")
    found = found.repartition("key").sortWithinPartitions("key", "content", "doc", "mark", "at")
    settled = written(in_arrow(found, lambda it: _settled(it, length), "key long, doc long, mark long, start long, end long, at long"), "settled")
    spans = settled.where("start >= 0").select("doc", "mark", "start", "end")
    first = settled.where("start < 0").select("key", "doc", "mark", "at")
    crowds = first.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("key", F.lit(True).alias("crowded"))
    listed = first.join(crowds, "key", "left").select("doc", "mark", F.struct("key", "at", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("b"))
    listed = listed.groupBy("doc", "mark").agg(F.collect_list("b").alias("list"))

    def contents(batch: pa.RecordBatch) -> dict:
        """Bytes of first blocks, or of each of their strings where the bucket is crowded."""
        out: dict = {k: [] for k in ("key", "doc", "mark", "at", "content", "crowded")}
        for doc, mark, text, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = text.encode()
            for x in items:
                at = x["at"]
                s, n, b = at >> 16, at >> 8 & 0xFF, at & 0xFF
                blocks_ = [(s + i, 1, b - i) for i in range(n)] if x["crowded"] else [(s, n, b)]
                for s_, n_, b_ in blocks_:
                    piece = raw[s_ : s_ + n_ - 1 + length]
                    out["key"].append(x["key"])
                    out["doc"].append(doc)
                    out["mark"].append(mark)
                    out["at"].append(s_ << 16 | n_ << 8 | b_ & 0xFF)
                    out["content"].append(hashlib.blake2b(piece, digest_size=16).digest() if x["crowded"] else piece)
                    out["crowded"].append(x["crowded"])
        return out

    texts = _prepared(docs, id_col, text_col).where(F.octet_length("text") >= length)
    looked = written(map_batches(texts.join(listed, ["doc", "mark"]).select("doc", "mark", "text", "list"), contents, "key long, doc long, mark long, at long, content binary, crowded boolean"), "contents")
    sorted_ = looked.where("not crowded").select("key", "doc", "mark", "at", "content").repartition("key").sortWithinPartitions("key")
    spans = spans.unionByName(in_arrow(sorted_, lambda it: _sorted_buckets(it, length), "doc long, mark long, start long, end long"))
    many = looked.where("crowded").select("content", "doc", "mark", F.shiftright("at", 16).alias("start"))
    firsts = many.groupBy("content").agg(F.min(F.struct("doc", "mark", "start")).alias("f"))
    late = many.join(firsts, "content").where(F.struct("doc", "mark", "start") > F.col("f"))
    spans = spans.unionByName(late.select("doc", "mark", "start", (F.col("start") + length).alias("end")))
    return spans.groupBy("doc", "mark").agg(F.collect_list(F.shiftleft("start", 32) + F.col("end")).alias("spans"))


def runs(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of a document's spans, in order."""
    if not spans:
        return []
    packed = np.array(spans, np.int64)
    _, s, e = merged(packed >> 32, packed & 0xFFFFFFFF, np.zeros(len(packed), np.int64))
    return list(zip(s.tolist(), e.tolist(), strict=True))


def _with_spans(docs: DataFrame, text: Column, id_col: str, text_col: str, length: int, hot: int = HOT) -> DataFrame:
    spans = find_spans(docs, length, hot, id_col, text_col).withColumnsRenamed({"doc": "_doc", "mark": "_mark", "spans": "_spans"})
    raw = F.coalesce(text, F.lit(""))
    test = (F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)) == F.col("_doc")) & (F.crc32(F.encode(raw, "UTF-8")) == F.col("_mark"))
    return docs.join(spans, test, "left").drop("_doc", "_mark")


def report(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    def measure(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            cut = runs(spans)
            kept, at = hashlib.sha256(), 0
            for s, e in cut:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            for k, v in (("n_bytes", len(raw)), ("n_removed", sum(e - s for s, e in cut)), ("n_spans", len(cut)), ("kept_sha256", kept.hexdigest())):
                out[k].append(v)
        return out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = _with_spans(rows, F.col("text"), "doc_id", "text", length, hot).select("doc_id", "text", "_spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(both, measure, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: str | None, spans: list[int] | None) -> str | None:
    """A text without its spans; where a span's end falls inside a character, that character stays."""
    if not text or not spans:
        return text
    raw = text.encode()
    whole = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
    kept, at = [], 0
    for s, e in runs(spans):
        while not whole(s):
            s += 1
        while e > s and not whole(e):
            e -= 1
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]).decode()


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with repeated strings cut out of text, n_chars counted anew; a text of which nothing but blanks is left goes."""
    own, name = numbered(docs)
    text, chars = name["text"], name["n_chars"]
    both = _with_spans(own, F.col(text), name["doc_id"], text, length)

    def cut(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        out[text] = [cut_text(t, s) for t, s in zip(out[text].to_pylist(), out["_spans"].to_pylist(), strict=True)]
        out["_cut"] = out.pop("_spans").is_valid()
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    done = map_batches(both.select(*own.columns, "_spans"), cut, f"{schema}, _cut boolean").where(~F.col("_cut") | (F.length(F.trim(text)) > 0))
    return done.withColumn(chars, F.when(F.col("_cut"), F.char_length(text).cast(own.schema[chars].dataType)).otherwise(F.col(chars))).select(*own.columns).toDF(*docs.columns)
