"""Media columns: payloads stored as WAV bytes, read back, and fingerprinted by pairs of spectral peaks.

A payload becomes 8-bit mono samples of a WAV file, written and read by the ``wave`` module. The fingerprint takes a
short-time Fourier transform, keeps the strongest local maxima of each frame and pairs each with the next ones in time;
a pair is coded as both frequencies and their distance in frames and is stored beside the frame number, in two arrays.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes that a payload's length is a multiple of, and the byte that fills it up.
UNIT, FILL = 576, 255
#: Samples of a frame and between frames; both divide UNIT.
FRAME, HOP = 288, 144
#: Peaks kept of a frame, later peaks that each is paired with, and the largest distance of a pair in frames.
PEAKS, FAN, REACH = 2, 3, 63
#: Frames that are transformed at once.
BLOCK = 2048
RATE = 8000


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


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of the PEAKS strongest local maxima of each frame, in order; BLOCK frames at a time, each block with a frame more on both sides."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for start in range(0, n, BLOCK):
        stop, lo = min(start + BLOCK, n), max(start - 1, 0)
        x = frames[lo : min(stop + 1, n)].astype(np.float32)
        x -= 128
        x *= window
        power = np.abs(np.fft.rfft(x, axis=1)).astype(np.float32)
        padded = np.pad(power, 1, constant_values=-1)
        here = padded[1:-1, 1:-1]
        top = (here >= padded[:-2, 1:-1]) & (here >= padded[2:, 1:-1]) & (here > padded[1:-1, :-2]) & (here >= padded[1:-1, 2:]) & (here > 0)
        strength = np.where(top, here, 0)[start - lo : start - lo + stop - start]
        best = np.argsort(-strength, axis=1, kind="stable")[:, :PEAKS]
        best.sort(axis=1)
        kept = np.take_along_axis(strength, best, 1) > 0
        t, k = np.nonzero(kept)
        times.append(t + start)
        bins.append(best[t, k])
    return np.concatenate(times).astype(np.int32), np.concatenate(bins).astype(np.int32)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frame numbers) and pair codes (first bin, second bin, distance in frames) of a payload's peak pairs."""
    t, f = spectral_peaks(np.frombuffer(payload, np.uint8))
    at, code = [], []
    for step in range(1, FAN + 1):
        dt = t[step:] - t[:-step]
        ok = dt <= REACH
        at.append(t[:-step][ok])
        code.append((f[:-step][ok] << 16) | (f[step:][ok] << 6) | dt[ok])
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order], code[order]


def _write(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        out = []
        for text in s:
            raw = (text or "").encode("utf-8", "surrogatepass")
            units = max(1, -(-len(raw) // UNIT))
            out.append(to_wav(raw + bytes([FILL]) * (units * UNIT - len(raw))))
        yield pd.Series(out)


def _read(media: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in media:
        yield pd.Series([None if m is None else from_wav(m) for m in s])


def _fingerprints(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in payloads:
        made = [fingerprint(p or b"") for p in s]
        yield pd.DataFrame({"times": [m[0] for m in made], "codes": [m[1] for m in made]})


def write_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with each text's UTF-8 bytes, filled up to a positive multiple of UNIT, as WAV bytes in ``media``. A null text counts as empty; other columns stay, one named as ``media`` is replaced."""
    small_batches(df.sparkSession)
    return df.withColumn(media, F.pandas_udf(_write, "binary").asNondeterministic()(F.col(f"`{text}`")))


def read_media(df: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """``df`` with the samples of its WAV bytes in ``payload``; null stays null."""
    small_batches(df.sparkSession)
    return df.withColumn(payload, F.pandas_udf(_read, "binary").asNondeterministic()(F.col(f"`{media}`")))


def fingerprint_media(df: DataFrame, payload: str = "payload", fingerprint: str = "fingerprint") -> DataFrame:
    """``df`` with the peak pairs of its payloads: a struct of the equally long arrays ``times`` and ``codes``, empty for null, empty or silent payloads."""
    small_batches(df.sparkSession)
    return df.withColumn(fingerprint, F.pandas_udf(_fingerprints, "times array<int>, codes array<int>").asNondeterministic()(F.col(f"`{payload}`")))


def op8_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digests of every document's stored and reread payload; ``feature`` is the number of peak pairs and a hash over their times and codes."""
    stored = write_media(docs.select("doc_id", "text"))
    out = fingerprint_media(read_media(stored))
    return out.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint.codes"), F.lower(F.hex(F.xxhash64("fingerprint.times", "fingerprint.codes")))).alias("feature"),
    )
