"""Feature normalisation and signal kernels over arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled_statistics(df: DataFrame, group: list[str], vec: str = "v") -> DataFrame:
    """Per dimension i of each group: mean, sd (sqrt of the sample variance + 1e-7)."""
    long = df.select(*group, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    return long.groupBy(*group, "i").agg(F.avg("x").alias("mean"), F.sqrt(F.var_samp("x") + 1e-7).alias("sd"))


def cmvn(df: DataFrame, group: list[str], key: str, vec: str = "v", variance: bool = True) -> DataFrame:
    """Key, v with the group's mean taken away and, with variance, divided by its deviation."""
    s = pooled_statistics(df, group, vec)
    s = s.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("i", "mean", "sd"))).alias("_s"))
    each = F.zip_with(F.col(vec).cast("array<double>"), F.col("_s"), lambda x, t: (x - t["mean"]) / t["sd"] if variance else x - t["mean"])
    return df.join(s, group).select(*group, key, each.alias("v"))


def mel_filters(n_fft: int, rate: int, bins: int, low: float = 20.0, high: float | None = None) -> np.ndarray:
    """Triangles, even on the scale 1127 ln(1 + f / 700), a row per bin."""
    high = high or rate / 2
    scale = lambda f: 1127.0 * np.log1p(np.asarray(f) / 700.0)
    edges = np.linspace(scale(low), scale(high), bins + 2)
    m = scale(np.arange(n_fft // 2) * rate / n_fft)
    up = (m[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - m[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int, bins: int = 80, frame_ms: float = 25, hop_ms: float = 10) -> np.ndarray:
    """Log mel energies of frames with mean removal, pre-emphasis 0.97 and a Hamming window."""
    size, hop = int(rate * frame_ms / 1000), int(rate * hop_ms / 1000)
    if len(x) < size:
        return np.zeros((0, bins), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float) * 32768, size)[::hop]
    frames = frames - frames.mean(axis=1, keepdims=True)
    frames = frames - 0.97 * np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    n_fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * np.hamming(size), n_fft))[:, : n_fft // 2] ** 2
    return np.log(np.maximum(power @ mel_filters(n_fft, rate, bins).T, np.finfo(np.float32).eps)).astype(np.float32)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate."""
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32)


def mix_at_snr(x: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """D3: x plus noise (repeated to its length) at the signal-to-noise ratio."""
    noise = np.resize(noise, len(x)).astype(float)
    power = lambda a: float(np.mean(np.square(a))) + 1e-10
    return (x + noise * np.sqrt(power(x) / power(noise) / 10 ** (snr_db / 10))).astype(np.float32)


def envelope(x: np.ndarray, rate: int, window_ms: float = 50, hop_ms: float = 25) -> np.ndarray:
    """Root mean square of each window."""
    size, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    if len(x) < size:
        return np.zeros(0, np.float32)
    return np.sqrt(np.square(np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size)[::hop]).mean(axis=1)).astype(np.float32)


def mask_spectrum(feat: np.ndarray, seed: int, max_t: int = 10, max_f: int = 8) -> np.ndarray:
    """One run of frames and one of bins set to 0, drawn from the seed."""
    rng = np.random.default_rng(seed)
    out = np.array(feat)
    t, f = rng.integers(0, max_t + 1), rng.integers(0, max_f + 1)
    t0, f0 = rng.integers(0, max(1, len(out) - t + 1)), rng.integers(0, max(1, out.shape[1] - f + 1))
    out[t0 : t0 + t] = 0
    out[:, f0 : f0 + f] = 0
    return out


def map_wave(df: DataFrame, kernel, schema: str, key: str = "key") -> DataFrame:
    """Apply kernel(wave, sample_rate) -> value to every row of (key, sample_rate, wav)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            values = [np.asarray(kernel(np.asarray(w, np.float32), r)).tolist() for w, r in zip(b["wav"], b["sample_rate"], strict=True)]
            yield pd.DataFrame({key: b[key], "value": values})

    return df.select(key, "sample_rate", "wav").mapInPandas(run, schema)
