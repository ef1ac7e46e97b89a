"""Media columns: payloads stored as WAV, read back, and described by spectral-peak pairs.

A payload is stored as 8-bit mono samples and read back with the wave module. Features come from short-time Fourier transforms: the strongest bin of each
band of a frame is a peak if it isn't weaker than the same bin of the frames before and after; a peak and each of the next FAN peaks within REACH frames make a
pair (bin, bin, distance), stored as two arrays: time codes (frame numbers) and pair codes. Frames are transformed in blocks,
so memory doesn't grow with a payload's length beyond its own bytes and pairs. No shuffle.

Defined results: null and empty texts are a payload of one 64-byte unit of zeros, without peaks; equal texts give equal values, so repeated rows give repeated results; very long texts are one payload, whole; null ids stay null; of equal
magnitudes in a band the lowest bin counts, and peaks as strong as their neighbours in time are peaks. Columns but the id and the text are left out, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._common import utf8_column

UNIT, RATE = 64, 8000
FRAME, HOP, BANDS, FAN, REACH, BLOCK = 256, 128, 4, 3, 63, 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(data: bytes) -> bytes:
    """The bytes, zero-filled to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and bins of all peaks, in order of time and then frequency."""
    if not samples.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    frames = -(-max(len(samples) - FRAME, 0) // HOP) + 1
    padded = np.full((frames - 1) * HOP + FRAME, 128, np.uint8)  # silence in 8-bit samples
    padded[: len(samples)] = samples
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    times, bins = [], []
    for first in range(0, frames, BLOCK):
        low, high = max(first - 1, 0), min(first + BLOCK + 1, frames)
        power = np.abs(np.fft.rfft((view[low:high].astype(np.float32) - np.float32(128)) * _WINDOW, axis=1))[:, 1:].astype(np.float32)
        banded = power.reshape(len(power), BANDS, -1)
        best = banded.argmax(2) + np.arange(BANDS) * banded.shape[2]
        height = np.take_along_axis(power, best, 1)
        before, after = np.zeros_like(height), np.zeros_like(height)
        before[1:] = np.take_along_axis(power[:-1], best[1:], 1)
        after[:-1] = np.take_along_axis(power[1:], best[:-1], 1)
        is_peak = (height > 0) & (height >= before) & (height >= after)
        t, band = np.nonzero(is_peak[first - low : first - low + min(BLOCK, frames - first)])
        times.append(t + first)
        bins.append(best[t + first - low, band])
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and pair codes of a payload's peaks."""
    t, code = [], []
    for k in range(1, FAN + 1):
        gap = times[k:] - times[:-k]
        near = gap <= REACH
        t.append(times[:-k][near])
        code.append((bins[:-k][near] << 13 | bins[k:][near] << 6 | gap[near]))
    at, codes = np.concatenate(t).astype("<i4"), np.concatenate(code).astype("<i4")
    order = np.lexsort((codes, at))
    return at[order], codes[order]


def describe(data: bytes) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """The stored form, the payload read back from it, and its time codes and pair codes."""
    stored = to_wav(payload(data))
    back = from_wav(stored)
    return stored, back, *pairs(*peaks(np.frombuffer(back, np.uint8)))


_FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pair_times", pa.list_(pa.int32())), ("pair_codes", pa.list_(pa.int32()))]


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Per row: id, digests of payload and stored form, feature (frames:pairs:digest of the arrays) and the arrays; the WAV itself if asked for."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pair_times array<int>, pair_codes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                data, offsets = utf8_column(batch, text)
                rows = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    stored, back, at, codes = describe(data[a:b].tobytes())
                    feature = f"{-(-max(len(back) - FRAME, 0) // HOP) + 1}:{len(at)}:{hashlib.sha256(at.tobytes() + codes.tobytes()).hexdigest()[:32]}"
                    rows.append((int(b - a), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, at, codes) + ((stored,) if keep_media else ()))
                fields = _FIELDS + [("media", pa.binary())] * keep_media
                columns = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", *[n for n, _ in fields]])

    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(run, schema + ", media binary" * keep_media)
