"""Samples: peaks, voice activity, log-mel features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """doc_id, bucket, low, high of samples (doc_id, i, v): bucket b holds [total*b/buckets, total*(b+1)/buckets), an empty one its first sample."""
    total = samples.groupBy("doc_id").agg((F.max("i") + 1).alias("total"))
    bounds = total.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "total").withColumn("a", F.expr(f"total * bucket div {buckets}")).withColumn("b", F.greatest(F.expr(f"total * (bucket + 1) div {buckets}"), F.col("a") + 1))
    # the bucket of a sample can be computed, so this is an equi-join; a bucket without samples of its own takes the one at its begin
    own = samples.join(total, "doc_id").select("doc_id", F.expr(f"((i + 1) * {buckets} - 1) div total").cast("int").alias("bucket"), "v").groupBy("doc_id", "bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    out = bounds.join(own, ["doc_id", "bucket"], "left")
    first = samples.select("doc_id", F.col("i").alias("a"), F.col("v").alias("f"))
    return out.join(first, ["doc_id", "a"], "left").select("doc_id", "bucket", F.coalesce("low", "f").alias("low"), F.coalesce("high", "f").alias("high"))


def energy(samples: DataFrame, rate: int = 16_000, frame_ms: int = 10) -> DataFrame:
    """doc_id, frame, rms of whole frames."""
    n = rate * frame_ms // 1000
    return samples.groupBy("doc_id", F.expr(f"i div {n}").alias("frame")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n).drop("n")


def voice_activity(frames: DataFrame, db: float = -40.0) -> DataFrame:
    """frames with speech: louder than the document's peak by more than db."""
    peak = frames.groupBy("doc_id").agg(F.max("rms").alias("peak"))
    return frames.join(peak, "doc_id").select("doc_id", "frame", (F.col("rms") > F.col("peak") * 10 ** (db / 20)).alias("speech"))


def candidate_windows(activity: DataFrame, samples_total: DataFrame, rate: int = 16_000, window_ms: int = 1500, hop_ms: int = 250, frame_ms: int = 10) -> DataFrame:
    """doc_id, window_idx, center_ms, frames, speech of the windows inside the samples (doc_id, total) that are speech by half at least.

    A running count of speech frames makes each window a difference of two lookups."""
    n, hop, size = window_ms // frame_ms, hop_ms // frame_ms, rate * window_ms // 1000
    windows = samples_total.where(F.col("total") >= size).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(total - {size}) div {rate * hop_ms // 1000}"))).alias("window_idx"))
    spread = activity.select("doc_id", F.col("speech").cast("int").alias("s"), F.explode(F.expr(f"sequence(greatest(0, (frame - {n}) div {hop}), frame div {hop})")).alias("window_idx"), "frame")
    inside = spread.where((F.col("frame") >= F.col("window_idx") * hop) & (F.col("frame") < F.col("window_idx") * hop + n)).groupBy("doc_id", "window_idx").agg(F.count(F.lit(1)).alias("frames"), F.sum("s").cast("bigint").alias("speech"))
    return windows.join(inside, ["doc_id", "window_idx"]).where(F.col("speech") * 2 >= F.col("frames")).select("doc_id", "window_idx", (F.col("window_idx") * hop_ms + window_ms // 2).alias("center_ms"), "frames", "speech")


def log_mel(samples: np.ndarray, rate: int = 16_000, bins: int = 80, low: float = 20.0) -> np.ndarray:
    """frames x bins log-mel energies of one chunk, each bin at mean 0: 25 ms frames every 10 ms, Povey window, pre-emphasis 0.97."""
    x = np.asarray(samples, np.float32) * 32768
    size, hop = rate * 25 // 1000, rate // 100
    if len(x) < size:
        return np.zeros((0, bins), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop].astype(np.float64)
    frames = frames - frames.mean(axis=1, keepdims=True)
    frames = np.concatenate([frames[:, :1] * (1 - 0.97), frames[:, 1:] - 0.97 * frames[:, :-1]], axis=1)
    frames *= np.hanning(size) ** 0.85
    width = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames, width)) ** 2
    mel = lambda f: 1127 * np.log1p(np.asarray(f, float) / 700)
    edges = np.linspace(mel(low), mel(rate / 2), bins + 2)
    at = mel(np.arange(width // 2 + 1) * rate / width)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    weights = np.maximum(0, np.minimum((at - left) / (mid - left), (right - at) / (right - mid)))
    energies = np.log(np.maximum(power @ weights.T, np.finfo(np.float32).eps))
    return (energies - energies.mean(axis=0)).astype(np.float32)


def features(chunks: DataFrame, **options: float) -> DataFrame:
    """chunks (samples array<float>) with features array<array<float>> in place of the samples."""

    @F.pandas_udf("array<array<float>>")
    def run(part):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([log_mel(np.asarray(s), **options).tolist() for s in part])

    run_ = run
    return chunks.withColumn("features", run_("samples")).drop("samples")
