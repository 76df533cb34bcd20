"""Media columns: 8-bit WAV, short-time Fourier transforms and fingerprints of spectral-peak pairs.

A text's bytes are padded with spaces to a positive multiple of 192 and stored as the samples of a mono 8-bit WAV file,
which the wave module writes and reads; that is lossless. Of the spectrum, each frame's strongest local peaks are taken,
and each peak is paired with the next ones in time: (frequency, later frequency, distance) is a code, stored with the
frame where it starts. The last frame has none after it: its strongest frequencies come with
their phases at distance 0, and its mean level and energy as codes of their own, so that texts of one frame and even ones
have a fingerprint too.

The files are written to the shared folder as a column, and what is analysed is what is read back from there.

Defined cases: null text counts as empty, whose payload is 192 spaces; each input row gives one row, repeated rows and
null ids included; equal texts give equal values; an empty table gives no rows. Long texts are transformed in blocks of
frames. A text's file has to stay under the 2 GB of a binary column. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardframe.llm.common import texts, written

UNIT, RATE = 192, 8000
HOP = UNIT // 2
#: Frames transformed at a time; peaks of a frame; later peaks that each is paired with, and how many frames they may be away.
BLOCK, PEAKS, FAN_OUT, REACH = 4096, 2, 3, 8
#: Files that are analysed at a time.
FILES = 256
#: Peaks of the last frame.
LAST_PEAKS = 8
WINDOW = np.hanning(UNIT).astype(np.float64)


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def levels(frames: np.ndarray) -> np.ndarray:
    """Of each frame the strength by frequency (less 3) where it is a local peak, else -1."""
    power = np.abs(np.fft.rfft((frames.astype(np.float64) - 128.0) * WINDOW, axis=1))[:, 2:]  # not the mean level
    level = np.round(np.log2(power + 1.0) * 64).astype(np.int32)
    inner = level[:, 1:-1]
    return np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]), inner, -1)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency of the spectral peaks, by frame and then strength."""
    frames = (len(samples) - UNIT) // HOP + 1
    when, where = [], []
    for first in range(0, frames, BLOCK):
        n = min(BLOCK, frames - first)
        own = samples[first * HOP : (first + n - 1) * HOP + UNIT]
        top = levels(np.lib.stride_tricks.sliding_window_view(own, UNIT)[::HOP])
        for k in range(PEAKS):
            best = top.argmax(axis=1)  # the lowest frequency of equals
            rows = np.arange(n)
            good = top[rows, best] > 0
            when.append(np.stack([(first + rows[good]), np.full(good.sum(), k)]))
            where.append(best[good] + 3)
            top[rows, best] = -1
    t, f = np.concatenate(when, axis=1), np.concatenate(where)
    order = np.lexsort((t[1], t[0]))
    return t[0][order], f[order]


def last_codes(samples: np.ndarray) -> list[int]:
    """The last frame's codes: its mean level at frequency 0, its energy above the highest one, and the phases of its
    strongest frequencies, the lowest first of equals. The frame is taken as it is, without a window, to its edges."""
    own = samples[-UNIT:].astype(np.float64)
    spectrum = np.fft.rfft(own - own.mean())[1:]
    strength = np.round(np.abs(spectrum), 6)
    energy = int(np.log2(1 + ((own - own.mean()) ** 2).sum()) * 128)
    strong = [int(k) for k in np.argsort(-strength, kind="stable")[:LAST_PEAKS] if strength[k] > 0]
    phase = ((np.angle(spectrum) / np.pi + 1) * 127.5).round().astype(int)
    return [int(own.mean()) << 4, (len(spectrum) + 1) << 12 | energy, *((k + 1) << 12 | int(phase[k]) << 4 for k in strong)]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded arrays: the frame at which each pair starts, and its code (frequency, later frequency, distance)."""
    samples = np.frombuffer(payload, np.uint8)
    t, f = peaks(samples)
    codes = [np.array(last_codes(samples))]
    starts = [np.full(len(codes[0]), (len(samples) - UNIT) // HOP)]
    for k in range(1, FAN_OUT + 1):
        ahead = k + PEAKS - 1  # beyond the frame's own peaks
        if len(t) <= ahead:
            break
        gap = t[ahead:] - t[:-ahead]
        good = (gap > 0) & (gap <= REACH)
        starts.append(t[:-ahead][good])
        codes.append(((f[:-ahead] << 12) | (f[ahead:] << 4) | gap)[good])
    t, c = np.concatenate(starts), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the WAV file."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [t.encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([to_wav(pad(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(store, "doc_id long, n_bytes long, media binary")


#: analyse's columns after doc_id and n_bytes.
FOUND = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("fp_time", pa.list_(pa.int32())), ("fp_code", pa.list_(pa.int32()))]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_code array<int>"


def analyse(media: DataFrame) -> DataFrame:
    """From encode's columns: what the stored files hold, their fingerprints (fp_time, fp_code arrays) and the digest of
    those as feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, FILES):
                own = b.slice(first, FILES)
                found = [described(m.as_buffer().to_pybytes()) for m in own.column("media")]
                columns = [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(FOUND)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *columns], ["doc_id", "n_bytes", *(n for n, _ in FOUND)])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def described(media: bytes) -> tuple:
    payload = from_wav(media)
    t, c = fingerprint(payload)
    feature = hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, t, c


def media_report(docs: DataFrame) -> DataFrame:
    """Stores the files of docs as a column in the shared folder, and analyses what it reads back."""
    return analyse(written(encode(docs), "media"))
