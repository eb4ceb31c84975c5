"""Recordings as files: WAV bytes to samples and back, any number of channels, to one channel at one rate."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 16_000


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, by lines between their neighbours; as they are at the same rate."""
    if rate == to or not len(samples):
        return samples
    n = max(1, round(len(samples) * to / rate))
    return np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples)


def decoded(content: bytes | None) -> np.ndarray | None:
    """The samples of 16-bit WAV bytes, the mean of their channels, in [-1, 1], at RATE; null for what isn't such a file."""
    try:
        with wave.open(io.BytesIO(content or b"")) as f:
            if f.getsampwidth() != 2:
                return None
            raw, channels, rate = f.readframes(f.getnframes()), f.getnchannels(), f.getframerate()
    except (wave.Error, EOFError):
        return None
    whole = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
    return resampled(whole.mean(axis=1) / 32767, rate)


def encoded(samples: np.ndarray, channels: int = 1, rate: int = RATE) -> bytes:
    """16-bit WAV bytes of samples, the same in each channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat(np.trunc(np.clip(samples, -1, 1) * 32767).astype("<i2"), channels).tobytes())
    return out.getvalue()


def load(files: DataFrame) -> DataFrame:
    """files (path, content: WAV bytes, as of the binaryFile source) as (path, samples); a file at a time is in memory. Other bytes give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                samples = decoded(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([samples], pa.list_(pa.float64()))], ["path", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, samples array<double>")


def save(recordings: DataFrame, folder: str, channels: int = 1, rate: int = RATE) -> DataFrame:
    """recordings (path, samples) written as rows (path, content) of a table in a shared folder, and read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [encoded(np.array(s or [], np.float64), channels, rate) for s in b.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(content, pa.binary())], ["path", "content"])

    recordings.select("path", "samples").mapInArrow(run, "path string, content binary").write.parquet(folder)
    return recordings.sparkSession.read.parquet(folder)
