"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A file knows its ids by their place among its different ids. Predictions are
of three orders:

* order 2: the id that last followed the two ids before, in this block, with a
  confidence (how often it has been right in a row, up to 3);
* order 1: the id that most often follows the id before, with one of four
  levels of how often; the file's head has this table, counted over all
  neighbours in the file;
* order 0: the frequencies of all ids in the file, in units of 2**-bits, in its head.

An id is one of three events: the order-2 prediction holds, the order-1
prediction holds, or neither, upon which the id is coded by its order-0
frequency. The events' frequencies mix two tables that adapt within a block:
one without context, and one chosen by confidence and level. Everything goes
to one range coder with 16-bit words, whose carries are added to the words
before. A block of up to ``BLOCK`` ids starts from the file's tables and
nothing else, so it can be decoded by itself; blocks are coded side by side,
one lane of numpy arrays each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 4096
MAGIC = b"TLI2"
#: Most different ids of a file.
MOST = 1 << 21
_SLOTS = 256
_LEVELS = np.array([0.1, 0.3, 0.7])
#: What an event that came adds to its counts; sums stay below 2**24, so single precision holds them exactly.
_STEP = np.float32(24)
#: The coder's range lies in [2**40, 2**56); its low end below 2**56, and a carry is bit 56.
_FULL, _LEAST = np.uint64(1 << 56), np.uint64(1 << 40)
_W, _TOP, _UNDER = np.uint64(16), np.uint64(40), np.uint64((1 << 40) - 1)
_CARRY = np.uint64(56)


class Tables:
    """What a file's head says of its ids: names in order, order-0 units, and order-1 predictions with their levels."""

    def __init__(self, names: np.ndarray, units: np.ndarray, after: np.ndarray, level: np.ndarray) -> None:
        self.names, self.units, self.after, self.level = names, units, after, level
        self.bits = np.uint64(max(1, int(units.sum()).bit_length()) - 1)
        ends = np.cumsum(units, dtype=np.int64)
        self.wide, self.below = units.astype(np.uint64), (ends - units).astype(np.uint64)

    @classmethod
    def fitted(cls, ids: np.ndarray) -> tuple[Tables, np.ndarray]:
        """(tables, each id's place among the names)."""
        if not len(ids):
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none), none
        most = int(ids.max())
        if most < 1 << 22:  # counting is faster than sorting
            count = np.bincount(ids, minlength=most + 1)
            names = np.flatnonzero(count)
            place = np.zeros(most + 1, np.int32)
            place[names] = np.arange(len(names))
            places, count = place[ids], count[names]
        else:
            names, places, count = np.unique(ids, return_inverse=True, return_counts=True)
        d = len(names)
        if d > MOST:
            raise ValueError(f"a file may hold {MOST} different ids, not {d}")
        whole = 1 << max(18, d.bit_length() + 1)
        units = 1 + count * (whole - d) // len(ids)
        units[np.argmax(units)] += whole - int(units.sum())
        kind = np.uint32 if d <= 1 << 16 else np.int64  # the narrower is sorted faster
        pairs, n = np.unique(places[:-1].astype(kind) * kind(d) + places[1:].astype(kind), return_counts=True)
        pairs = pairs.astype(np.int64)
        order = np.lexsort((-n, pairs // d))
        first = order[np.concatenate((np.ones(min(1, len(order)), bool), np.diff(pairs[order] // d) != 0))]
        after, level = np.zeros(d, np.int64), np.zeros(d, np.int64)
        before = pairs[first] // d
        after[before] = pairs[first] % d
        level[before] = np.searchsorted(_LEVELS, n[first] / np.bincount(pairs // d, n, d)[before], side="right")
        return cls(names, units, after, level), places

    def packed(self) -> bytes:
        return zlib.compress(b"".join(x.astype(t).tobytes() for x, t in ((np.diff(self.names, prepend=0), "<u4"), (self.units, "<u4"), (self.after, "<u4"), (self.level, "u1"))))

    @classmethod
    def unpacked(cls, data: bytes) -> Tables:
        raw = zlib.decompress(data)
        d = len(raw) // 13
        steps, units, after = (np.frombuffer(raw, "<u4", d, 4 * d * i).astype(np.int64) for i in range(3))
        return cls(np.cumsum(steps), units, after, np.frombuffer(raw, "u1", d, 12 * d).astype(np.int64))


class _Model:
    """Predictions and frequencies of a number of lanes.

    ``ids`` holds each lane's order-2 slots, an id and its confidence each;
    ``counts`` the row without context of every lane and then its 16 rows by
    confidence and level, of three events each (the fourth column is blank).
    """

    def __init__(self, lanes: int, tables: Tables) -> None:
        self.lanes, self.tables = lanes, tables
        self.ids = np.full(lanes * _SLOTS, -4, np.int32)
        self.counts = np.ones((17 * lanes, 4), np.float32)
        self.lane = np.arange(lanes)
        self.slots, self.own, self.cells = self.lane * _SLOTS, lanes + 16 * self.lane, 4 * self.lane
        self.after, self.level = (np.append(x, 0) for x in (tables.after.astype(np.int32), tables.level))

    def look(self, n: int, last: np.ndarray, older: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the first n lanes: order-2 slots and their entries, order-1 predictions, rows of counts, and where the three events' shares begin and the last ends."""
        at = self.slots[:n] + ((last * 40503 + older * 30011 >> 5) & (_SLOTS - 1))
        entries, after = self.ids.take(at), self.after.take(last)
        row = self.own[:n] + ((entries & 3) << 2 | self.level.take(last))
        f = self.counts.take(row, axis=0)
        f += self.counts[:n]
        ends = np.empty((4, n), np.float32)
        ends[0], ends[1] = 0, f[:, 0]
        np.add(ends[1], f[:, 1], out=ends[2])
        np.add(ends[2], f[:, 2], out=ends[3])
        return at, entries, after, row, ends.astype(np.uint64)

    def share(self, ends: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, width) of each lane's event."""
        n = len(event)
        at = event * n
        at += self.lane[:n]
        flat = ends.reshape(-1)
        begin = flat.take(at)
        at += n
        width = flat.take(at)
        width -= begin
        return begin, width

    def learn(self, at, entries, row, ids, event, hit) -> None:
        """hit: where the order-2 entry's id came."""
        trust = entries & 3
        trust += 1
        np.minimum(trust, 3, out=trust)
        trust *= hit
        trust |= ids << 2
        self.ids[at] = trust
        flat = self.counts.reshape(-1)
        for cell in (row * 4, self.cells[: len(event)].copy()):
            cell += event
            flat[cell] = flat.take(cell) + _STEP


def _carried(words: np.ndarray, lanes: np.ndarray, used: np.ndarray) -> None:
    """Adds one to the latest word of these lanes, and to the one before where that overflows."""
    at = used[lanes] - 1
    while len(lanes):
        words[lanes, at] += np.uint16(1)
        over = words[lanes, at] == 0
        lanes, at = lanes[over], at[over] - 1


def encode_blocks(blocks: np.ndarray, sizes: np.ndarray, tables: Tables) -> list[bytes]:
    """The code of each row of blocks (places among the tables' names); sizes must not grow from row to row."""
    lanes, width = blocks.shape
    model = _Model(lanes, tables)
    wide = np.zeros((width + 2, lanes), np.int32)  # two rows before the first
    wide[2:] = blocks.T
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL - np.uint64(1), np.uint64)
    words, used = np.zeros((lanes, 3 * width + 8), np.uint16), np.zeros(lanes, np.int64)
    for t in range(int(sizes[0]) if lanes else 0):
        n = int(np.searchsorted(-sizes, -t))
        x = wide[t + 2, :n]
        at, entries, after, row, ends = model.look(n, wide[t + 1, :n], wide[t, :n])
        hit = entries >> 2 == x
        event = np.subtract(2, after == x, dtype=np.int64)
        np.putmask(event, hit, 0)
        model.learn(at, entries, row, x, event, hit)
        part = span[:n] // ends[3]
        begin, share = model.share(ends, event)
        begin *= part
        begin += low[:n]
        lo = begin
        part *= share
        rare = np.flatnonzero(event == 2)
        unit = part[rare] >> tables.bits
        lo[rare] += unit * tables.below.take(x[rare])
        part[rare] = unit * tables.wide.take(x[rare])
        over = np.flatnonzero(lo >> _CARRY)
        if len(over):
            lo[over] -= _FULL
            _carried(words, over, used)
        go = np.flatnonzero(part < _LEAST)
        while len(go):
            out = lo[go]
            words[go, used[go]] = out >> _TOP
            used[go] += 1
            lo[go] = (out & _UNDER) << _W
            part[go] <<= _W
            go = go[part[go] < _LEAST]
        low[:n], span[:n] = lo, part
    for _ in range(4):
        words[model.lane, used] = low >> _TOP
        used += 1
        low = (low & _UNDER) << _W
    return [words[i, : used[i]].astype("<u2").tobytes() for i in range(lanes)]


def decode_blocks(codes: list[bytes], sizes: np.ndarray, tables: Tables) -> np.ndarray:
    """The places of each code as a row (zeros beyond its size); sizes must not grow from code to code."""
    lanes, width = len(codes), int(sizes[0]) if len(codes) else 0
    lengths = np.array([len(c) // 2 for c in codes], np.int64)
    stride = int(lengths.max(initial=0)) + 4
    words = np.zeros((lanes, stride), np.uint16)
    for i, c in enumerate(codes):
        words[i, : lengths[i]] = np.frombuffer(c, "<u2")
    model = _Model(lanes, tables)
    flat, next_ = words.reshape(-1), model.lane * stride
    who = np.repeat(np.arange(len(tables.units), dtype=np.int32), tables.units)  # whose each unit of order 0 is
    out = np.zeros((width + 2, lanes), np.int32)  # two rows before the first
    span, code = np.full(lanes, _FULL - np.uint64(1), np.uint64), np.zeros(lanes, np.uint64)
    for i in range(4):  # 56 bits: the last word gives its upper half, as the coder's low end has it
        code = code << _W | flat[next_ + i].astype(np.uint64)
    code, spare = code >> np.uint64(8), code & np.uint64(0xFF)
    next_ = next_ + 4
    for t in range(width):
        n = int(np.searchsorted(-sizes, -t))
        at, entries, after, row, ends = model.look(n, out[t + 1, :n], out[t, :n])
        part = span[:n] // ends[3]
        value = code[:n] // part
        event = (ends[1] <= value).astype(np.int64)
        event += ends[2] <= value
        begin, share = model.share(ends, event)
        begin *= part
        rest = code[:n] - begin
        part *= share
        guess = entries >> 2
        x = after.copy()
        np.copyto(x, guess, where=event == 0)
        rare = np.flatnonzero(event == 2)
        unit = part[rare] >> tables.bits
        got = who.take((rest[rare] // unit).astype(np.int64), mode="clip")
        x[rare] = got
        rest[rare] -= unit * tables.below.take(got)
        part[rare] = unit * tables.wide.take(got)
        model.learn(at, entries, row, x, event, guess == x)
        out[t + 2, :n] = x
        go = np.flatnonzero(part < _LEAST)
        while len(go):
            fresh = spare[go] << _W | flat.take(next_[go], mode="clip")
            next_[go] += 1
            rest[go] = rest[go] << _W | (fresh >> np.uint64(8))
            spare[go] = fresh & np.uint64(0xFF)
            part[go] <<= _W
            go = go[part[go] < _LEAST]
        code[:n], span[:n] = rest, part
    return out[2:].T


def pack_file(ids: np.ndarray, keys: list, counts: np.ndarray) -> bytes:
    """A file image: the ids of documents one after the other, with each document's key (int or None) and number of ids.

    ids are below 2**32, of at most ``MOST`` different values. Layout,
    little-endian: magic, number of documents, blocks and ids, size of the
    tables; keys as 64-bit integers after a byte each that is 1 for null;
    counts as 64-bit integers; the tables; each block's bytes and crc32 of its
    ids (as 32-bit integers); the blocks; crc32 of all before.
    """
    ids = np.asarray(ids)
    tables, places = Tables.fitted(ids)
    n = -(-len(ids) // BLOCK)
    codes: list[bytes] = []
    for i in range(0, n, LANES):
        part = places[i * BLOCK : (i + LANES) * BLOCK]
        rows = -(-len(part) // BLOCK)
        sizes = np.minimum(BLOCK, len(part) - np.arange(rows) * BLOCK)
        codes += encode_blocks(np.pad(part, (0, rows * BLOCK - len(part))).reshape(rows, BLOCK), sizes, tables)
    wide = ids.astype("<u4")
    index = b"".join(struct.pack("<II", len(c), zlib.crc32(wide[i * BLOCK : (i + 1) * BLOCK].tobytes())) for i, c in enumerate(codes))
    nulls, head = bytes(k is None for k in keys), tables.packed()
    body = b"".join((MAGIC, struct.pack("<QQQQ", len(keys), n, len(ids), len(head)), nulls, np.array([k or 0 for k in keys], "<i8").tobytes(), np.asarray(counts, "<i8").tobytes(), head, index, *codes))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_file(image: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids, keys, counts) of a file image; ValueError if anything in it has changed."""
    if image[:4] != MAGIC or zlib.crc32(image[:-4]) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("not a file of ids, or damaged")
    docs, n, total, head = struct.unpack_from("<QQQQ", image, 4)
    at = 36
    nulls = image[at : at + docs]
    at += docs
    keys = [None if gone else int(k) for gone, k in zip(nulls, np.frombuffer(image, "<i8", docs, at), strict=True)]
    counts = np.frombuffer(image, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    tables = Tables.unpacked(image[at : at + head])
    at += head
    index = np.frombuffer(image, "<u4", 2 * n, at).reshape(n, 2)
    at += 8 * n
    out = np.zeros(n * BLOCK, np.uint32)
    for i in range(0, n, LANES):
        part = index[i : i + LANES]
        sizes = np.minimum(BLOCK, total - np.arange(i, i + len(part)) * BLOCK)
        ends = at + np.cumsum(part[:, 0].astype(np.int64))
        codes = [image[e - s : e] for e, s in zip(ends.tolist(), part[:, 0].tolist(), strict=True)]
        places = decode_blocks(codes, sizes, tables)
        flat = np.zeros((len(part), BLOCK), np.uint32)
        flat[:, : places.shape[1]] = tables.names.astype(np.uint32).take(places)
        out[i * BLOCK : (i + len(part)) * BLOCK] = flat.reshape(-1)
        at = int(ends[-1])
        for j in range(len(part)):
            if zlib.crc32(flat[j, : sizes[j]].astype("<u4").tobytes()) != part[j, 1]:
                raise ValueError(f"block {i + j} is damaged")
    return out[:total], keys, counts
