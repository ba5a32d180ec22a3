"""Pitch by autocorrelation and YIN, and cepstral peak prominence: one transform helper, the rest in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import argmax, c, ratio, total
from tidewave.functions.fourier import autocorrelation, real_cepstrum
from tidewave.functions.windows import hann_symmetric, literal
from tidewave.sources.signals import frames


def lag_range(sample_rate: int, f_min: float, f_max: float) -> tuple[int, int]:
    """First lag and the one after the last."""
    if not 0 < f_min < f_max:
        raise ValueError("expected 0 < f_min < f_max")
    low, high = int(sample_rate / f_max), int(sample_rate / f_min)
    if high <= low:
        raise ValueError("empty lag range")
    return low, high


def frame_autocorrelation(signals: DataFrame, n: int, hop: int) -> DataFrame:
    """signal_id, frame_idx, ac: autocorrelation of Hann frames at lags 0 to 2n - 1."""
    windowed = F.zip_with("frame", literal(hann_symmetric(n)), lambda a, b: a * b)
    return frames(signals, n, hop).select("signal_id", "sample_rate", "frame_idx", autocorrelation(windowed, n).alias("ac"))


def autocorrelation_pitch(ac: str | Column, n: int, sample_rate: int, f_min: float, f_max: float) -> Column:
    low, high = lag_range(sample_rate, f_min, f_max)
    part = F.transform(F.slice(c(ac), low + 1, min(high, n) - low), lambda v: F.round(v, 9))
    return F.lit(float(sample_rate)) / (argmax(part) + low)


def pitch_strength(ac: str | Column, n: int, sample_rate: int, f_min: float, f_max: float) -> Column:
    """Largest autocorrelation in the lag range over that at lag 0."""
    low, high = lag_range(sample_rate, f_min, f_max)
    if high >= 2 * n:
        return F.lit(0.0)
    return ratio(F.array_max(F.slice(c(ac), low + 1, high - low)), F.get(c(ac), F.lit(0)))


def yin_of(ac: str | Column, n: int, sample_rate: int, f_min: float, f_max: float, threshold: float = 0.1) -> Column:
    """Pitch at the first lag whose normalised difference is under the threshold, else at the least one.

    One pass over the lags: the running sum of differences, the first lag under the threshold and the least so far.
    """
    low, high = lag_range(sample_rate, f_min, f_max)
    start = F.struct(F.get(c(ac), F.lit(0)).alias("e"), F.lit(0.0).alias("run"), F.lit(1).alias("lag"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(float("inf")).alias("least"))

    def step(acc: Column, r: Column) -> Column:
        d = 2 * acc["e"] - 2 * r
        run, lag = acc["run"] + d, acc["lag"]
        cm = F.round(d * lag / (run + 1e-8), 9)
        inside = (lag >= low) & (lag < min(high, n))
        less = inside & ((cm < acc["least"]) | (acc["at"] == 0))
        return F.struct(
            acc["e"].alias("e"), run.alias("run"), (lag + 1).alias("lag"), F.when((acc["first"] == 0) & inside & (cm < threshold), lag).otherwise(acc["first"]).alias("first"),
            F.when(less, lag).otherwise(acc["at"]).alias("at"), F.when(less, cm).otherwise(acc["least"]).alias("least"),
        )

    best = F.aggregate(F.slice(c(ac), 2, n - 1), start, step, lambda acc: F.when(acc["first"] > 0, acc["first"]).otherwise(acc["at"]))
    return F.lit(float(sample_rate)) / F.greatest(best, F.lit(1))


def yin(rows: DataFrame, n: int, sample_rate: int, f_min: float, f_max: float, threshold: float = 0.1) -> DataFrame:
    """`yin_of` every frame: signal_id, frame_idx, f0."""
    return rows.select("signal_id", "frame_idx", yin_of("ac", n, sample_rate, f_min, f_max, threshold).alias("f0"))


def cepstral_peak_prominence(signals: DataFrame, sample_rate: int, n: int, hop: int, f0_min: float = 60.0, f0_max: float = 333.3) -> DataFrame:
    """Height of the cepstral peak over the regression line on quefrency, in dB: signal_id, frame_idx, cpp."""
    n_fft = 1 << (2 * n - 1).bit_length()
    half = n_fft // 2
    low, high = max(int(sample_rate / f0_max), 1), min(int(sample_rate / f0_min), half - 1)
    windowed = F.zip_with("frame", literal(hann_symmetric(n)), lambda a, b: a * b)
    rows = frames(signals, n, hop).select("signal_id", "frame_idx", F.slice(real_cepstrum(windowed, n_fft, 1e-9), 1, half).alias("c"))
    begin, end = int(sample_rate * 0.001), half - 1
    size = end - begin
    q_mean, q_var = begin + (size - 1) / 2, size * (size * size - 1) / 12
    y = F.slice("c", begin + 1, size)
    y_mean = total(y) / size
    tilt = total(F.transform(y, lambda v, i: (i + (begin - q_mean)) * (v - y_mean))) / q_var
    part = F.slice("c", low + 1, high - low)
    line = y_mean + tilt * (argmax(F.transform(part, lambda v: F.round(v, 9))) + low - q_mean)
    return rows.select("signal_id", "frame_idx", (F.when(F.lit(high > low), (F.array_max(part) - line) * 8.685889).otherwise(0.0)).alias("cpp"))


def series_delta(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 9) -> DataFrame:
    """Regression delta over `width` steps (an even width counts as the next odd one), the ends repeated: a window per key."""
    half = width // 2
    if half == 0:
        return rows.withColumn("delta", F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(everything), F.last(value).over(everything)
    terms = [k * (F.coalesce(F.lead(value, k).over(w), last) - F.coalesce(F.lag(value, k).over(w), first)) for k in range(1, half + 1)]
    return rows.withColumn("delta", sum(terms[1:], terms[0]) / (2 * sum(k * k for k in range(1, half + 1))))
