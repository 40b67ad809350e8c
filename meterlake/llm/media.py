"""Media columns: payloads stored as 8-bit WAV, read back, with spectral-peak pair fingerprints.

Frames of the sound go through a short-time Fourier transform; a frame's peaks are the strongest of
the bins that are larger than those beside them, and pairs of peaks of near frames are landmarks (frequency, frequency, gap) with the
frame they start at, stored as time-coded arrays.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import id_and_text

RATE = 8000
FRAME = 576
HOP = 288
#: Peaks of a frame at most, later frames that a peak is paired with.
PEAKS = 2
REACH = 2


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes, block: int = FRAME, fill: int = 255) -> bytes:
    """data with fill appended up to a positive multiple of block."""
    return data + bytes([fill]) * (block - len(data) % block if len(data) % block or not data else 0)


def landmarks(samples: bytes, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(frame number, code) of each peak pair, by frame; code = first bin * 2**12 + second bin * 2**3 + gap.

    Frames are transformed in blocks of `rows`, so memory doesn't grow with the length. A peak is
    larger than the bin below and not smaller than the one above, bin 0 aside; of equal peaks the
    lower counts first. Where no two frames in reach have peaks, the codes are those of single
    peaks with gap 0, and 0 alone if there are none either.
    """
    wave_ = np.frombuffer(samples, np.uint8)
    if len(wave_) < FRAME:
        wave_ = np.concatenate([wave_, np.full(FRAME - len(wave_), 128, np.uint8)])
    count = 1 + (len(wave_) - FRAME) // HOP
    view = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    peaks = np.empty((count, PEAKS), np.int64)
    for at in range(0, count, rows):
        block = view[at : at + rows].astype(np.float32)
        block = (block - block.mean(axis=1, keepdims=True)) * window
        power = np.round(np.abs(np.fft.rfft(block, axis=1)).astype(np.float32), 2)
        power[:, 0] = 0
        beside = np.pad(power, ((0, 0), (0, 1)), constant_values=-1)
        peak = np.zeros(power.shape, bool)
        peak[:, 1:] = (power[:, 1:] > power[:, :-1]) & (power[:, 1:] >= beside[:, 2:])
        power[~peak] = -1
        for p in range(PEAKS):
            best = power.argmax(axis=1)
            found = power[np.arange(len(best)), best] > 0
            peaks[at : at + rows, p] = np.where(found, best, -1)
            power[np.arange(len(best)), best] = -1
    times, codes = [], []
    for gap in range(1, min(REACH, count - 1) + 1):
        for a in range(PEAKS):
            for b in range(PEAKS):
                both = np.flatnonzero((peaks[:-gap, a] >= 0) & (peaks[gap:, b] >= 0))
                times.append(both)
                codes.append(peaks[both, a] << 12 | peaks[both + gap, b] << 3 | gap)
    if not sum(map(len, times)):
        t, p = np.nonzero(peaks >= 0)
        return (t, peaks[t, p] << 12) if len(t) else (np.zeros(1, np.int64), np.zeros(1, np.int64))
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def media_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV), payload (read back), times and codes (arrays of equal length).

    A null or empty text is one frame of padding. Equal texts give equal values. Repeated rows
    stay; other columns are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):  # small results: a batch may hold very long texts
                part = batch.iloc[at : at + 500]
                raw = [t.encode() for t in part["text"]]
                media = [to_wav(padded(x)) for x in raw]
                back = [from_wav(x) for x in media]
                marks = [landmarks(x) for x in back]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_bytes": [len(x) for x in raw], "media": media, "payload": back, "times": [t.astype("int32") for t, _ in marks], "codes": [c.astype("int32") for _, c in marks]})

    return id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")
