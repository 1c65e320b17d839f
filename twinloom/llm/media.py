"""Media columns: texts kept losslessly as 8-bit WAV, read back by the wave module, fingerprinted by spectral peaks.

The payload of a text is its UTF-8 bytes (null: none), padded with bytes 32 to
a positive multiple of ``UNIT``; a payload byte is one unsigned 8-bit sample.
A fingerprint is two aligned arrays: the frame of the earlier peak of a pair
(time code) and the pair's code (band, both frequencies, frames between them).
Short-time Fourier transforms are taken over Hann windows of ``FRAME`` samples
every ``HOP``, a bounded number of frames at a time, so a text of any length
needs bounded memory beside its own bytes. A unit holds many frames, so that
the shortest payload has pairs too. Peaks are not the bytes: a run of one
letter, or a few bytes under the rising edge of the first window, have those
of blanks.

A row's feature tells equal fingerprints (by a digest) and compares others: it
has the ``MARKS`` smallest hashes of the pairs that start in one frame, a
bottom-k sketch, of which likeness() makes the estimated share of common
frames. Frames lie on a grid of ``HOP`` samples, so passages that stand at
another place of the grid do not meet.

The query writes the media column to the shared folder and reads it again
before anything is taken from it.

Defined cases: null and empty texts are one unit of bytes 32; repeated rows
give repeated equal results; a null id stays null; an empty table gives an
empty table. A text of any length is stored and read whole. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import map_batches

UNIT = 192
FRAME, HOP = 32, 8
BANDS = ((2, 9), (9, 17))
FAN = 3
RATE = 8000
MARKS = 12
_FRAMES_AT_ONCE = 8192
_NO_PAIR = 1 << 40
_WINDOW = np.hanning(FRAME + 1)[:-1]


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text, padded with bytes 32 to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media)) as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest frequency of each band in each frame, as an int array (frames, bands).

    Magnitudes are rounded, so equal ones tie alike everywhere; the lowest
    frequency of a tie wins.
    """
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)), constant_values=128)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), _FRAMES_AT_ONCE):
        part = (frames[i : i + _FRAMES_AT_ONCE].astype(np.float64) - 128.0) * _WINDOW
        power = np.round(np.abs(np.fft.rfft(part, axis=1)), 3)
        for b, (lo, hi) in enumerate(BANDS):
            out[i : i + len(part), b] = power[:, lo:hi].argmax(axis=1) + lo
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time codes, pair codes): each peak paired with its band's peak 1 to FAN frames later, in time order."""
    at = peaks(samples)
    codes = np.full((len(at), FAN * len(BANDS)), _NO_PAIR, np.int64)
    for gap in range(1, FAN + 1):
        a, b = at[:-gap], at[gap:]
        for band in range(len(BANDS)):
            codes[: len(a), (gap - 1) * len(BANDS) + band] = band << 24 | a[:, band] << 16 | b[:, band] << 8 | gap
    codes.sort(axis=1)
    real = codes < _NO_PAIR
    return np.repeat(np.arange(len(at), dtype=np.int32), real.sum(axis=1)), codes[real].astype(np.int32)


def feature(times: np.ndarray, codes: np.ndarray) -> str:
    """Number of pairs, a digest of both arrays (as little-endian 32-bit integers), and the smallest hashes of frames, in order."""
    digest = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()[:16]
    if not len(times):
        return f"0:{digest}:"
    first = np.flatnonzero(np.diff(times, prepend=-1))
    # of the frames with equally many pairs only those have equal sums; the order within a frame is fixed
    inner = np.arange(len(times)) - np.repeat(first, np.diff(np.append(first, len(times))))
    odd = (codes.astype(np.uint64) + np.uint64(1)) * (inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(0xD6E8FEB86659FD93))
    total = np.add.reduceat(odd ^ (odd >> np.uint64(29)), first)
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(32)
    return f"{len(times)}:{digest}:" + ",".join(f"{x:08x}" for x in np.unique(total)[:MARKS].tolist())


def likeness(a: str, b: str) -> float:
    """The estimated share of common frames among those of two fingerprints, from their features: 1 for equal ones."""
    x, y = ({int(h, 16) for h in f.rpartition(":")[2].split(",") if h} for f in (a, b))
    least = sorted(x | y)[:MARKS]
    return sum(h in x and h in y for h in least) / len(least) if least else float(a == b)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the WAV file as binary)."""
    def encode(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "n_bytes": [len((t or "").encode()) for t in texts], "media": [to_wav(payload(t), rate) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), encode, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame, arrays: bool = True) -> DataFrame:
    """What the stored WAV files hold, next to their columns.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 16 samples),
    media_bytes, media_sha256 and feature(). With arrays also fp_times and
    fp_codes themselves, which take about six times 8 bytes for every HOP
    samples.
    """
    def read(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {k: [] for k in names}
        for stored in batch.column(2).to_pylist():
            samples = from_wav(stored)
            t, c = fingerprint(samples)
            row = {
                "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]),
                "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
                "feature": feature(t, c),
                "fp_times": t, "fp_codes": c,
            }
            for k in names:
                out[k].append(row[k])
        return out

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["fp_times", "fp_codes"] * arrays
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", fp_times array<int>, fp_codes array<int>" * arrays
    return map_batches(media.select("doc_id", "n_bytes", "media"), read, schema)
