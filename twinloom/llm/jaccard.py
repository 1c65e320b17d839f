"""Exact n-gram Jaccard join by vertical partitioning, and its components.

A document's set holds its distinct n-word shingles (64-bit hashes). Shingles
have one global order: by how many documents hold them, as a sketch of
``SKETCH`` counters over all documents has it, then by hash. Any order gives
the same links; this one puts what few documents share first.

1. Documents of equal sets are one class; only classes are joined.
2. Two linked sets share one of the first |x| - ceil(t|x|) + 1 shingles of
   either in the global order. Those prefixes meet by shingle.
3. The global order is cut into ``FRAGMENTS`` fragments of about equally many
   (document, shingle) pairs, at a level of the sketch and a hash within it.
   For a candidate pair the overlap is counted in each fragment by itself and
   summed per pair, so no task needs more of a set than one fragment of it.

A family of near copies is not expanded into all pairs: each set is compared
with one leader first (the set that stands first among those that share its
shingles), linked sets are put together, and only pairs of sets in different
components go on, if sizes and the places of their first common shingle allow
a link; they meet by shingle and size, as sets of too different sizes can't be
linked. Every pair that is left is compared exactly, so no link between
components is lost. Keys that many rows share meet in joins of plain scans,
whose large sides adaptive execution splits, after counts on the map side; the
sketch's parts are added up for ``FAN`` tasks at a time, then for all.

Sets are told apart by 64 bits of hash and their size.

Defined cases: null and empty texts and those without words have an empty
set, which is linked with nothing; a text of fewer words than n has its whole
sequence as one shingle; a null id is a document too, which gets the smallest
id of its component or null; repeated rows are documents of equal sets; an
empty table gives an empty table. Only the named columns are looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import in_arrow, map_batches, numbered, sized, written
from twinloom.llm.components import components

N, SIMILAR = 3, (90, 100)
SKETCH = 1 << 24
_CHUNK = 1 << 16
FAN = 128
FRAGMENTS = 4
_AT_ONCE = 1 << 19
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ROOT = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, _AT_ONCE + 4096), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array, n: int = N) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each shingle, shingle) of runs of texts; shingles distinct and ascending in each row."""
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + _AT_ONCE, side="right")) - 1)
        data = raw[ends[row] : ends[last]]
        rows, found = _run(data, ends[row : last + 1] - ends[row], n)
        yield row, last, rows + row, found
        row = last


def words(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of the texts data[bounds[i]:bounds[i + 1]]; blank: which bytes are no part of words."""
    size = len(data)
    solid = np.zeros(size + 2, bool)
    solid[1:-1] = ~blank[data]
    # a word starts at a solid byte after a blank one or at a text's start, and ends likewise
    cut = np.zeros(size + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    stops = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_ROOT, size)[:size], out=total[1:])
    word = _mixed((total[stops] - total[starts]) * _powers(pow(_ROOT, -1, 1 << 64), size + 1)[starts] + (stops - starts).astype(np.uint64))
    return np.searchsorted(bounds, starts, side="right") - 1, word


def _run(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    row, word = words(data, bounds)
    if not len(row):
        return row, word
    head = len(word) - n + 1
    if head > 0:
        value = np.zeros(head, np.uint64)
        for i in range(n):
            value = value * np.uint64(0xC2B2AE3D27D4EB4F) + word[i : i + head]
        whole = row[n - 1 :] == row[:head]
        rows, found = row[:head][whole], value[whole]
    else:
        rows, found = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # texts of 1 to n - 1 words: the sequence itself, marked by its length
    count = np.bincount(row, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        value = np.full(len(few), k, np.uint64) * np.uint64(0x165667B19E3779F9)
        for i in range(k):
            value = value * np.uint64(0xC2B2AE3D27D4EB4F) + word[first[few] + i]
        rows, found = np.concatenate((rows, few)), np.concatenate((found, value))
    found = _mixed(found)
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[keep], found[keep]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: below 64 as they are, above on a scale of eighths of an octave, up to 255 (a billion)."""
    high = 64 + 8 * np.log2(np.maximum(counts, 64) / 64)
    return np.minimum(np.where(counts < 64, counts, high), 255).astype(np.uint8)


def sketch(docs: DataFrame, n: int, size: int = SKETCH) -> np.ndarray:
    """For each counter, the level of the number of (document, shingle) pairs that fall to it, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size, np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            for _, _, _, found in shingles(batch.column(0), n):
                np.add.at(total, _counter(found, size), 1)
        for i in range(0, size, _CHUNK):
            if total[i : i + _CHUNK].any():
                width, counts = _packed(total[i : i + _CHUNK])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part], pa.int64()), pa.array([width], pa.int32()), pa.array([counts], pa.binary())], ["chunk", "part", "bytes", "counts"])

    def summed(rows: pd.DataFrame) -> np.ndarray:
        total = np.zeros(_CHUNK, np.int64)
        for width, c in zip(rows["bytes"], rows["counts"], strict=True):
            part = np.frombuffer(zlib.decompress(c), f"u{width}")
            total[: len(part)] += part
        return total

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        width, counts = _packed(summed(rows))
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bytes": [width], "counts": [counts]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "levels": [zlib.compress(levels(summed(rows)).tobytes(), 1)]})

    parts = in_arrow(docs.select("text"), count, "chunk long, part long, bytes int, counts binary")
    parts = parts.groupBy("chunk", F.floor(F.col("part") / FAN)).applyInPandas(some, "chunk long, bytes int, counts binary")
    out = np.zeros(-(-size // _CHUNK) * _CHUNK, np.uint8)
    for r in parts.groupBy("chunk").applyInPandas(whole, "chunk long, levels binary").collect():
        out[r["chunk"] : r["chunk"] + _CHUNK] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out[:size]


def _packed(counts: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a number, compressed numbers) of counts."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w)
    return width, zlib.compress(counts.astype(f"u{width}").tobytes(), 1)


def _counter(found: np.ndarray, size: int) -> np.ndarray:
    return (found >> np.uint64(40)).astype(np.int64) % size


def pivots(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Places (level << 8 | first byte of the hash) at which the global order is cut so that fragments hold about equally many shingles."""
    mass = np.bincount(counts, minlength=256)
    values = np.arange(256)
    load = np.where(values < 64, values, 64 * 2.0 ** ((values - 64) / 8)) * mass
    ends = np.cumsum(load)
    if not ends[-1]:
        return np.zeros(0, np.int64)
    aim = ends[-1] * np.arange(1, fragments) / fragments
    level = np.searchsorted(ends, aim)
    inside = (aim - (ends - load)[level]) / load[level]  # hashes are spread evenly within a level
    return np.unique(level << 8 | np.minimum(inside * 256, 255).astype(np.int64))


def places(found: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Where shingles stand in the global order, to the first byte of their hash."""
    return load[_counter(found, len(load))].astype(np.int64) << 8 | (found >> np.uint64(56)).astype(np.int64)


def prefix_length(n, similar: tuple[int, int]):
    num, den = similar
    return n + num * n // -den + 1  # n - ceil(num * n / den) + 1


def _sets(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, where it begins, size, sid) of each row's set."""
    here, at, num = np.unique(rows, return_index=True, return_counts=True)
    return here, at, num, (_mixed(np.add.reduceat(_mixed(found ^ np.uint64(0x5851F42D4C957F2D)), at)) ^ _mixed(num.astype(np.uint64))).view(np.int64)


def classes(docs: DataFrame, counts, n: int, similar: tuple[int, int]) -> DataFrame:
    """doc, n_shingles, sid (class of equal sets; null for empty ones) and prefix (first shingles in global order) of every document."""
    def one(batch: pa.RecordBatch) -> dict:
        size = len(batch.column(0))
        sizes, sids = np.zeros(size, np.int64), np.zeros(size, np.int64)
        tokens, lengths = [], np.zeros(size, np.int64)
        load = counts.value
        for _, _, rows, found in shingles(batch.column(1), n):
            if not len(rows):
                continue
            here, at, num, names = _sets(rows, found)
            sizes[here], sids[here] = num, names
            often = load[_counter(found, len(load))]
            order = np.lexsort((found, often, rows))
            place = np.arange(len(rows)) - np.repeat(at, num)
            short = prefix_length(num, similar)
            tokens.append(found[order][place < np.repeat(short, num)])
            lengths[here] = short
        flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return {"doc": batch.column(0), "n_shingles": sizes, "sid": pa.array(sids, pa.int64(), mask=sizes == 0), "prefix": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))}

    kind = docs.schema["doc"].dataType.simpleString()
    return written(map_batches(docs, one, f"doc {kind}, n_shingles long, sid long, prefix array<long>"), "classes")


def fragments(texts: DataFrame, wanted: DataFrame, counts, cuts: np.ndarray, n: int) -> DataFrame:
    """node, fragment and its shingles, of the classes in wanted (node, sid, rep): their representatives are cut up again."""
    chosen = texts.join(sized(wanted), texts["doc"].eqNullSafe(wanted["rep"])).select("node", "sid", "text")

    def one(batch: pa.RecordBatch) -> dict:
        node, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: dict = {"node": [], "fragment": [], "shingles": []}
        load = counts.value
        for _, _, rows, found in shingles(batch.column(2), n):
            if not len(rows):
                continue
            here, _, _, names = _sets(rows, found)
            true = np.isin(rows, here[names == sid[here]])  # an id may come with other texts too
            rows, found = rows[true], found[true]
            where = np.searchsorted(cuts, places(found, load), side="right")
            key = rows * (len(cuts) + 1) + where
            order = np.argsort(key, kind="stable")
            values, at = np.unique(key[order], return_index=True)
            for v, part in zip(values.tolist(), np.split(found[order].view(np.int64), at[1:]) if len(at) else [], strict=True):
                out["node"].append(node[v // (len(cuts) + 1)])
                out["fragment"].append(v % (len(cuts) + 1))
                out["shingles"].append(part)
        return out

    parts = written(map_batches(chosen, one, "node long, fragment int, shingles array<long>"), "fragments")
    if parts.groupBy("node", "fragment").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return parts
    return written(parts.dropDuplicates(["node", "fragment"]), "fragments")  # rows that come twice


def links(pairs: DataFrame, parts: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, na, b, nb) whose overlaps, counted in each fragment and summed, make them similar."""
    num, den = similar
    # the second sets of pairs go to the first ones, of which there are fewer: one shuffle of either
    second = parts.withColumnRenamed("shingles", "y").join(sized(pairs), F.col("node") == F.col("b")).drop("node")
    heads = written(pairs.select(F.col("a").alias("_a")).distinct(), "heads", pairs.count())
    first = parts.join(sized(heads), F.col("node") == F.col("_a")).select("_a", F.col("fragment").alias("_f"), F.col("shingles").alias("x"))
    partial = second.join(first.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("fragment") == F.col("_f"))).select("a", "na", "b", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("o"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.lit(den) * F.col("o") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b", "o")


def possible(similar: tuple[int, int]):
    """Whether sizes na, nb and places pa, pb of the first common shingle leave room for enough overlap."""
    num, den = similar
    need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"), F.floor((F.col("na") + F.col("nb") - F.col("pa") - F.col("pb")) / 2))
    room = F.least(room, F.when(F.col("na") == F.col("nb"), F.col("na") - 1).otherwise(F.least("na", "nb")))  # they are different sets
    return (F.lit(num) * F.greatest("na", "nb") <= F.lit(den) * F.least("na", "nb")) & (room >= need)


def join(docs: DataFrame, n: int = N, similar: tuple[int, int] = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and copies (documents of the same set) of every document."""
    texts = _texts(docs, id_col, text_col)
    load = sketch(texts, n)
    cuts = pivots(load, FRAGMENTS)
    counts = docs.sparkSession.sparkContext.broadcast(load)  # SKETCH counters of a byte
    own = classes(texts, counts, n, similar)
    # a class is a node: numbered once, when the table is written
    reps = own.where("sid is not null").groupBy("sid").agg(F.min("doc").alias("rep"), F.min("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("prefix").alias("prefix"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")

    # prefixes, and the shingles that two classes share; key: place, then size, so that the least is the leader's
    rows = reps.select("node", F.col("n"), F.posexplode("prefix").alias("place", "token")).select("token", "node", (F.shiftleft(F.col("place").cast("long"), 36) + F.col("n")).alias("key"))
    lead = rows.groupBy("token").agg(F.min("key").alias("lead_key"), F.min_by("node", "key").alias("lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    lead = written(lead, "lead")
    shared = written(rows.join(lead.hint("merge"), "token"), "shared")  # the same plan at every size; adaptive execution splits a hot token's rows
    place, size = lambda c: F.shiftright(c, 36), lambda c: F.col(c).bitwiseAND(F.lit((1 << 36) - 1))

    # one leader for each class: the first of those that share a shingle with it
    named = shared.where("node <> lead").select(F.col("node").alias("b"), size("key").alias("nb"), place("key").alias("pb"), F.col("lead").alias("a"), size("lead_key").alias("na"), place("lead_key").alias("pa"), "lead_key")
    first = named.where(possible(similar)).groupBy("b", "nb").agg(F.min_by("a", "lead_key").alias("a"), F.min_by("na", "lead_key").alias("na")).select("a", "na", "b", "nb")
    first = written(first, "first")

    def parts_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return fragments(texts, written(nodes.join(reps.select("node", "sid", "rep"), "node"), "wanted", 2 * pairs.count()), counts, cuts, n)

    known = written(links(first, parts_of(first), similar), "first-links", first.count())
    placed = shared.select("token", "node", "key")
    if known.isEmpty():
        placed = placed.withColumn("root", F.col("node"))
    else:
        roots = components(known).withColumnRenamed("node", "_node")
        placed = placed.join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token"), "mixed")
    placed = placed.join(sized(mixed), "token").select("token", "node", size("key").alias("n"), place("key").alias("p"), "root")
    side = lambda s: placed.select("token", F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("p").alias(f"p{s}"), F.col("root").alias(f"r{s}"))
    # sizes of linked sets lie in the same band or in neighbouring ones
    unit = max(1e-6, math.log(similar[1] / similar[0])) * (1 + 1e-9)
    band = lambda c: F.floor(F.log(F.col(c)) / F.lit(unit))
    near = side("a").withColumn("band", F.explode(F.array(*[band("na") + i for i in (-1, 0, 1)])))
    cross = near.join(side("b").withColumn("band", band("nb")), ["token", "band"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & possible(similar)).select("a", "na", "b", "nb").distinct()
    cross = written(cross, "cross")
    rest = written(links(cross, parts_of(cross), similar), "rest-links", cross.count())
    final = components(known.select("a", "b").unionByName(rest.select("a", "b")))

    named_docs = own.select("doc", "n_shingles", "sid").join(reps.select(F.col("sid").alias("_s"), "copies", "node"), F.col("sid") == F.col("_s"), "left").select("doc", "n_shingles", "copies", F.col("node").alias("_node"))
    whole = written(named_docs.join(final, F.col("_node") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_node")).drop("node", "_node"), "roots")
    least = written(whole.where("root is not null").groupBy(F.col("root").alias("_r")).agg(F.min("doc").alias("component_id")), "least")
    out = whole.join(sized(least), F.col("root") == F.col("_r"), "left")
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def keep_one(docs: DataFrame, n: int = 5, similar: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document of each component, that of the smallest id; empty sets are components of their own.

    A document is told by its id and a 64-bit hash of its text, so rows of a
    null or repeated id with different texts are documents of their own. A
    null id comes after all others; of one id's texts the least hash is first.
    """
    own, name = numbered(docs)
    body = F.xxhash64(F.coalesce(F.col(name["text"]).cast("string"), F.lit("")))
    id_ = F.col(name["doc_id"])
    who = F.struct(id_.isNull().alias("none"), id_.alias("id"), body.alias("body"))
    found = join(own.select(who.alias("doc_id"), F.col(name["text"]).alias("text")), n, similar)
    keep = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("n_shingles").alias("_size"))
    keep = written(keep.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.body").alias("_kept"), "_n", "_size"), "kept")
    out = own.withColumn("_body", body).join(keep, id_.eqNullSafe(F.col("_id")) & (F.col("_body") == F.col("_kept")))
    if not keep.where("_n > 1 and _size > 0").isEmpty():
        out = out.where("_n = 1 or _size = 0").unionByName(out.where("_n > 1 and _size > 0").dropDuplicates([name["doc_id"], "_body"]))
    return out.select(*own.columns).toDF(*docs.columns)
