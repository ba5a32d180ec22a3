"""Constant-Q magnitudes: bins evenly spaced in log frequency, each with a window as long as a fixed number of periods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions.fourier import through_bank
from tidewave.operators.spectrograms import by_band, padded
from tidewave.sources.signals import frames


def constant_q_banks(sample_rate: int, f_min: float, n_bins: int, bins_per_octave: int) -> tuple[list[list[float]], list[list[float]]]:
    """Cosine and sine rows over one frame, as long as the lowest bin's window, in whose middle all windows stand.

    A bin of frequency f has ceil(q * sample_rate / f) samples under a periodic Hann window, q being the frequency over the
    distance to the next bin. Rows are divided by the window's sum and multiplied by the root of its length.
    """
    if not 0 < f_min or n_bins < 1 or bins_per_octave < 1:
        raise ValueError("f_min, n_bins and bins_per_octave must be positive")
    q = 1 / (2 ** (1 / bins_per_octave) - 1)
    freq = [f_min * 2 ** (k / bins_per_octave) for k in range(n_bins)]
    if freq[-1] > sample_rate / 2:
        raise ValueError("the highest bin lies above half the sample rate")
    length = [math.ceil(q * sample_rate / f) for f in freq]
    size = length[0] + length[0] % 2
    rows: tuple[list[list[float]], list[list[float]]] = ([], [])
    for f, n in zip(freq, length, strict=True):
        window = [0.5 * (1 - math.cos(2 * math.pi * i / n)) for i in range(n)]
        scale, before = math.sqrt(n) / sum(window), size // 2 - n // 2
        for out, wave in zip(rows, (math.cos, math.sin), strict=True):
            out.append([0.0] * before + [scale * w * wave(2 * math.pi * f / sample_rate * i) for i, w in enumerate(window)] + [0.0] * (size - before - n))
    return rows


def cqt_frames(signals: DataFrame, sample_rate: int, hop: int = 512, f_min: float = 32.7, n_bins: int = 84, bins_per_octave: int = 12) -> DataFrame:
    """Frames centred on multiples of `hop`, zeros beyond the ends: signal_id, frame_idx, mag (array). Narrow: no shuffle."""
    cos, sin = constant_q_banks(sample_rate, f_min, n_bins, bins_per_octave)
    size = len(cos[0])
    rows = frames(signals.withColumn("samples", padded("samples", size // 2, "constant")), size, hop, pad=False)
    length: Column = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
    both = rows.select("signal_id", "frame_idx", through_bank(F.col("frame"), cos).alias("re"), through_bank(F.col("frame"), sin).alias("im"))
    return both.select("signal_id", "frame_idx", length.alias("mag"))


def cqt(signals: DataFrame, sample_rate: int, hop: int = 512, f_min: float = 32.7, n_bins: int = 84, bins_per_octave: int = 12) -> DataFrame:
    """`cqt_frames` as rows: signal_id, frame_idx, bin, value."""
    return by_band(cqt_frames(signals, sample_rate, hop, f_min, n_bins, bins_per_octave), "mag", "bin")
