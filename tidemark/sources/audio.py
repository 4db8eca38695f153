"""PCM WAV files as mono samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wav(content: bytes, rate: int = 16_000) -> np.ndarray:
    """Mono float32 at the rate, by linear interpolation; samples of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    kinds = {1: (np.uint8, 128, 128), 2: (np.int16, 0, 32768), 4: (np.int32, 0, 1 << 31)}
    if width == 3:  # as the upper bytes of 32 bits
        raw = np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).tobytes()
    kind, zero, scale = kinds[4 if width == 3 else width]
    x = ((np.frombuffer(raw, kind).astype(np.float64) - zero) / scale).reshape(-1, channels).mean(axis=1)
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)
    return x.astype(np.float32)


def read(spark: SparkSession, paths: str, rate: int = 16_000, chunk: int = 1 << 20) -> DataFrame:
    """path, chunk_idx, sample_rate, samples: files in chunks, so that no row is a whole recording."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                x = decode_wav(content, rate)
                for k in range(0, max(len(x), 1), chunk):
                    yield pd.DataFrame({"path": [path], "chunk_idx": [k // chunk], "sample_rate": [rate], "samples": [x[k : k + chunk]]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, chunk_idx int, sample_rate int, samples array<float>")


def duration_ms(samples, rate):  # noqa: ANN001, ANN201
    return F.when(rate <= 0, 0).otherwise(F.floor(samples * 1000 / rate))
