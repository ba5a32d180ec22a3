"""Spectral features: Column functions over a magnitude array (bins 0 to n/2) and relational operators over bins.

All of them read one magnitude array per frame or signal, so a spectrum is computed once however many features use it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import argmax, c, diff, folded, head, indexed, mean, numbered, ratio, tail, total, total_of
from tidewave.functions.fourier import magnitude, whole_magnitude
from tidewave.sources.signals import frames


def frame_spectrum(signals: DataFrame, n: int, hop: int) -> DataFrame:
    """Magnitudes of rectangular frames: signal_id, sample_rate, frame_idx, mag."""
    return frames(signals, n, hop).select("signal_id", "sample_rate", "frame_idx", magnitude(F.col("frame"), n).alias("mag"))


def _under_hann(samples: str) -> Column:
    """The samples under a symmetric Hann window of their own length."""
    size = F.size(samples)
    return F.transform(samples, lambda v, i: v * (0.5 * (1 - F.cos(2 * F.pi() * i / F.greatest(size - 1, F.lit(1))))))


def whole_spectrum(signals: DataFrame, n_fft: int) -> DataFrame:
    """Magnitudes of whole signals under a symmetric Hann window of their own length, then cut or zero-padded to n_fft."""
    return signals.select("signal_id", "sample_rate", magnitude(_under_hann("samples"), n_fft).alias("mag"))


def uncut_spectrum(signals: DataFrame) -> DataFrame:
    """As whole_spectrum, with the next power of two of each signal's length as transform size; bin_hz is the width of a bin."""
    spectra = signals.select("signal_id", "sample_rate", whole_magnitude(_under_hann("samples")).alias("mag"))
    return spectra.withColumn("bin_hz", F.col("sample_rate") / (2.0 * (F.size("mag") - 1)))


def bins(spectra: DataFrame) -> DataFrame:
    """One row per bin: the other columns of `spectra`, k, m."""
    keep = [x for x in spectra.columns if x != "mag"]
    return spectra.select(*keep, F.posexplode("mag").alias("k", "m")).withColumn("k", F.col("k").cast("long"))


def power(mag: str | Column) -> Column:
    return F.transform(c(mag), lambda m: m * m)


def centroid(mag: str | Column, bin_hz: float) -> Column:
    return ratio(total(indexed(mag, lambda m, k: k * bin_hz * m)), total(mag))


def flatness(mag: str | Column) -> Column:
    return ratio(F.exp(mean(F.transform(c(mag), lambda m: F.log(m + 1e-8)))), mean(mag))


def rolloff_of(mag: str | Column, bin_hz: float | Column, share: float = 0.85) -> Column:
    """First bin where the running power reaches a share of the total (last bin if none), in Hz: one pass with the total known."""
    p = power(mag)
    start = F.struct((share * total(p)).alias("goal"), F.lit(0.0).alias("run"), F.lit(0).alias("k"), F.lit(-1).alias("at"))

    def step(acc: Column, v: Column) -> Column:
        run = acc["run"] + v
        at = F.when(acc["at"] >= 0, acc["at"]).when(F.round(run + 1e-8 - acc["goal"], 9) >= 0, acc["k"]).otherwise(-1)
        return F.struct(acc["goal"].alias("goal"), run.alias("run"), (acc["k"] + 1).alias("k"), at.alias("at"))

    return F.aggregate(p, start, step, lambda acc: F.when(acc["at"] >= 0, acc["at"]).otherwise(acc["k"] - 1)) * bin_hz


def rolloff(spectra: DataFrame, bin_hz: float, share: float = 0.85) -> DataFrame:
    """`rolloff_of` every frame: signal_id, frame_idx, rolloff."""
    return spectra.select("signal_id", "frame_idx", rolloff_of("mag", bin_hz, share).alias("rolloff"))


def distance(mag: str | Column, before: str | Column) -> Column:
    """Euclidean distance of two spectra; null if either is."""
    return F.sqrt(F.aggregate(F.zip_with(c(mag), c(before), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def flux(spectra: DataFrame) -> DataFrame:
    """Distance of each frame's magnitudes from those of the frame before."""
    order = Window.partitionBy("signal_id").orderBy("frame_idx")
    rows = spectra.withColumn("before", F.lag("mag").over(order)).where("before is not null")
    return rows.select("signal_id", "frame_idx", distance("mag", "before").alias("flux"))


def entropy(mag: str | Column) -> Column:
    p = power(mag)
    return F.when(total(p) > 0, -folded(p, total(p), lambda v, all_: v / all_ * F.log2(v / all_ + 1e-12))).otherwise(0.0)


def _moment(mag: str | Column, order: int) -> Column:
    """Central moment of the power over bin numbers."""
    p = power(mag)
    centre = total(indexed(p, lambda v, k: k * v)) / total(p)
    return folded(numbered(p), centre, lambda x, m: F.pow(x["k"] - m, F.lit(order)) * x["v"]) / total(p)


def skewness(mag: str | Column) -> Column:
    return F.when(total(power(mag)) > 0, ratio(_moment(mag, 3), F.pow(_moment(mag, 2), F.lit(1.5))))


def kurtosis(mag: str | Column) -> Column:
    return F.when(total(power(mag)) > 0, ratio(_moment(mag, 4), F.pow(_moment(mag, 2), F.lit(2.0))) - 3)


def spread(mag: str | Column, bin_hz: float) -> Column:
    return F.when(total(power(mag)) > 0, F.sqrt(_moment(mag, 2)) * bin_hz).otherwise(0.0)


def slope(mag: str | Column) -> Column:
    """Least-squares slope of log magnitude on the bin number."""
    n = F.size(c(mag)).cast("double")
    y = F.transform(c(mag), lambda m: F.log(m + 1e-8))
    k_mean = (n - 1) / 2
    given = F.struct(mean(y).alias("y"), k_mean.alias("k"))
    return folded(numbered(y), given, lambda x, m: (x["k"] - m["k"]) * (x["v"] - m["y"])) / (n * (n * n - 1) / 12)


def crest_factor(mag: str | Column) -> Column:
    return ratio(F.array_max(power(mag)), total(power(mag)))


def deviation(mag: str | Column) -> Column:
    p = power(mag)
    return ratio(total_of(diff(p), F.abs), total(p))


def irregularity(mag: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total_of(diff(mag), F.abs) / total(F.zip_with(head(mag), tail(mag), lambda a, b: a + b + 1e-12))))


def band_power(mag: str | Column, bin_hz: float, low: float | None, high: float | None, closed: str = "left") -> Column:
    """Sum of power of bins with low <= f < high (either end may be open)."""
    inside = lambda k: (F.lit(True) if low is None else (k * bin_hz >= low if closed == "left" else k * bin_hz > low)) & (F.lit(True) if high is None else k * bin_hz < high)
    return total(indexed(mag, lambda m, k: F.when(inside(k), m * m).otherwise(0.0)))


def low_high_energy_ratio(mag: str | Column, bin_hz: float, low: float = 1000.0, high: float = 3000.0) -> Column:
    below, above = band_power(mag, bin_hz, None, low), band_power(mag, bin_hz, high, None, closed="open")
    return F.when(below > 0, 10 * F.log10(below / (above + 1e-8)))


def alpha_ratio(mag: str | Column, bin_hz: float, bounds: tuple[float, float, float] = (50.0, 1000.0, 5000.0)) -> Column:
    low = band_power(mag, bin_hz, bounds[0], bounds[1])
    return F.when(low > 0, 10 * F.log10(low / (band_power(mag, bin_hz, bounds[1], bounds[2]) + 1e-8)))


def hammarberg_index(mag: str | Column, bin_hz: float, cut: float = 2000.0, top: float = 5000.0) -> Column:
    best = lambda low, high: F.array_max(indexed(mag, lambda m, k: F.when((k * bin_hz >= low) & (k * bin_hz < high), m * m)))
    return F.when(best(0.0, cut) > 0, 10 * F.log10(best(0.0, cut) / (best(cut, top) + 1e-8)))


def band_peak_frequency(mag: str | Column, bin_hz: float, low: float, high: float) -> Column:
    """Frequency of the strongest bin in [low, high], 0 for an empty band."""
    p = indexed(mag, lambda m, k: F.when((k * bin_hz >= low) & (k * bin_hz <= high), m * m))
    return F.when(F.array_max(p).isNotNull(), argmax(p) * bin_hz).otherwise(0.0)


def tonality(mag: str | Column, top_db: float = 60.0) -> Column:
    """How far the largest of the loud bins stands above their mean, from 0 to 1."""
    kept = F.filter(c(mag), lambda m: 20 * F.log10(F.greatest(m, F.lit(1e-300)) / F.greatest(F.array_max(c(mag)), F.lit(1e-300))) >= -top_db)
    n = F.size(kept).cast("double")
    return F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.array_max(kept) / mean(kept) - 1) / (n - 1)))).otherwise(F.when(F.array_max(c(mag)) > 0, 1.0).otherwise(0.0))


def harmonic_richness(mag: str | Column) -> Column:
    m0 = F.get(c(mag), F.lit(0))
    return F.when(F.size(c(mag)) >= 2, 10 * F.log10(total_of(tail(mag), lambda m: m * m) / (m0 * m0 + 1e-8))).otherwise(0.0)


def inharmonicity(peaks: str | Column, f0: Column) -> Column:
    return mean(indexed(peaks, lambda p, k: F.abs(p / ((k + 1) * f0) - 1)))


def phase_coherence(phases: str | Column) -> Column:
    x, y = mean(F.transform(c(phases), F.cos)), mean(F.transform(c(phases), F.sin))
    return F.sqrt(x * x + y * y)


def roughness(spectra: DataFrame, bin_hz: float | Column, top_db: float = 60.0) -> DataFrame:
    """Sensory roughness of the pairs of loud bins of a spectrum: signal_id, roughness.

    A helper sums the pairs of one spectrum as a matrix, a block of bins against all at a time; no row per pair is made. The
    pairs' weight falls off exponentially with their distance.
    """

    @F.pandas_udf("double")
    def run(mags: pd.Series, widths: pd.Series) -> pd.Series:
        import numpy as np

        def one(mag, hz):
            m = np.asarray(mag, float)
            if not len(m) or m.max() <= 0:
                return 0.0
            a = m / m.max()
            k = np.flatnonzero(20 * np.log10(np.maximum(a, 1e-300)) >= -top_db)
            a, f, out = a[k], k * hz, 0.0
            for at in range(0, len(k), 512):
                x, y = a[at : at + 512, None], a[None, :]
                pair = np.arange(len(k))[None, :] > np.arange(at, at + len(x))[:, None]
                z = 0.24 / (0.021 * f[at : at + 512, None] + 19.0) * (f[None, :] - f[at : at + 512, None])
                z = np.where(pair, z, 0.0)
                out += float((np.where(pair, (x * y) ** 0.1 * (2 * np.minimum(x, y) / (x + y)) ** 3.11, 0.0) * (np.exp(-3.5 * z) - np.exp(-5.75 * z))).sum())
            return out

        return pd.Series([one(m, w) for m, w in zip(mags, widths, strict=True)], dtype=float)

    width = bin_hz if isinstance(bin_hz, Column) else F.lit(float(bin_hz))
    return spectra.select("signal_id", run(F.col("mag"), width).alias("roughness"))


#: Edges of the 24 critical bands in Hz.
BARK_EDGES = [0, 100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500]


def sharpness(spectra: DataFrame, bin_hz: float | Column) -> DataFrame:
    """Mean place of the power on the critical-band scale, high bands weighted up; 0 without power. Narrow: the bands are slices."""
    hz = bin_hz if isinstance(bin_hz, Column) else F.lit(float(bin_hz))
    at = lambda f: F.ceil(F.lit(float(f)) / hz).cast("int")
    weighted, plain = [], []
    for z, (low, high) in enumerate(zip(BARK_EDGES, BARK_EDGES[1:], strict=False), 1):
        p = F.coalesce(mean(power(F.slice("mag", at(low) + 1, at(high) - at(low)))), F.lit(0.0))
        weighted.append(p * ((1.0 if z <= 16 else 0.066 * math.exp(0.171 * (z - 16))) * z))
        plain.append(p)
    sums = spectra.select("signal_id", F.array(*weighted).alias("w"), F.array(*plain).alias("p"))
    return sums.select("signal_id", ratio(total("w"), total("p")).alias("sharpness"))


def nasality(nasal: DataFrame, oral: DataFrame, bin_hz: float, low: float = 300.0, high: float = 800.0) -> DataFrame:
    """Power ratio in dB of two microphones' spectra (signal_id, mag) in [low, high]: a join of two signals."""
    level = lambda df, name: df.select("signal_id", total(indexed("mag", lambda m, k: F.when((k * bin_hz >= low) & (k * bin_hz <= high), m * m).otherwise(0.0))).alias(name))
    both = level(nasal, "n").join(level(oral, "o"), "signal_id")
    return both.select("signal_id", (10 * F.log10((F.col("n") + 1e-8) / (F.col("o") + 1e-8))).alias("nasality"))
