"""Loudness, median-filter separation and spectral gating of signals of any length, and the tristimulus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.blocks import filtered, resynthesised
from tidewave.sources.signals import blocks_of_points


def harmonic_percussive(points: DataFrame, n_fft: int, hop: int, margin_h: float = 3.0, margin_p: float = 3.0) -> DataFrame:
    """signal_id, i, harmonic, percussive: masks from medians along frequency and along time (kernels of int(2 margin + 1) bins and frames).

    `points` are samples with their places, see `sources.signals`."""
    size_h, size_p = int(2 * margin_h + 1), int(2 * margin_p + 1)

    def masks(z, first: bool, last: bool):
        import numpy as np

        def median(m, size, axis, ends=(True, True)):
            before, after = (size // 2 if ends[0] else 0), (size - 1 - size // 2 if ends[1] else 0)
            wide = np.pad(m, [(before, after) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
            out = np.median(np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis), axis=-1)
            missing = size // 2 if not ends[0] else 0
            return np.pad(out, [(missing, m.shape[axis] - missing - out.shape[axis]) if a == axis else (0, 0) for a in (0, 1)])

        m = np.abs(z)
        h, p = median(m, size_h, 1), median(m, size_p, 0, (first, last))
        return [z * (part / (h + p + 1e-8)) ** 2 for part in (h, p)]

    return resynthesised(points, n_fft, hop, masks, ["harmonic", "percussive"], halo=size_p // 2)


def noise_reduction(points: DataFrame, threshold: float = 0.01, n_fft: int = 1024, hop: int = 512) -> DataFrame:
    """signal_id, i, x: spectral subtraction on the power spectrum with zero phase."""

    def subtract(z, first: bool, last: bool):
        import numpy as np

        return [np.maximum(np.abs(z) ** 2 - threshold, 0.0).astype(complex)]

    return resynthesised(points, n_fft, hop, subtract, ["x"])


def _shelf_and_highpass(rate: int):
    """The two second-order sections of K weighting for a sample rate: (b, a) each."""
    import math

    # Gain, quality and centre frequency of the high shelf; quality and cutoff of the high pass.
    gain, q1, f1, q2, f2 = 4.0, 1 / math.sqrt(2), 1500.0, 0.5, 38.0
    big, w = 10 ** (gain / 40), 2 * math.pi * f1 / rate
    al, co = math.sin(w) / (2 * q1), math.cos(w)
    root = 2 * math.sqrt(big) * al
    b = [big * ((big + 1) + (big - 1) * co + root), -2 * big * ((big - 1) + (big + 1) * co), big * ((big + 1) + (big - 1) * co - root)]
    a = [(big + 1) - (big - 1) * co + root, 2 * ((big - 1) - (big + 1) * co), (big + 1) - (big - 1) * co - root]
    w = 2 * math.pi * f2 / rate
    al, co = math.sin(w) / (2 * q2), math.cos(w)
    return (b, a), ([(1 + co) / 2, -(1 + co), (1 + co) / 2], [1 + al, -2 * co, 1 - al])


def block_powers(points: DataFrame, sample_rate: int, length: int = 1024) -> DataFrame:
    """Mean squares of K-weighted windows of 0.4 s every 0.1 s: signal_id, block, power. Samples are filtered in runs of `length`; each adds
    its share to the windows it meets."""
    n, hop = round(0.4 * sample_rate), round(0.1 * sample_rate)
    runs = filtered(blocks_of_points(points, length), _shelf_and_highpass(sample_rate), length)
    begin, end = F.col("block") * length, F.col("block") * length + F.size("samples")
    first, last = F.greatest(F.floor((begin - n) / hop) + 1, F.lit(0)), F.floor((end - 1) / hop)
    met = runs.select("signal_id", "samples", begin.alias("b"), end.alias("e"), F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest(F.col("block") * hop - F.col("b"), F.lit(0)), F.least(F.col("block") * hop + n, "e") - F.col("b")
    part = F.aggregate(F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit(0.0), lambda s, v: s + v * v)
    sums = met.select("signal_id", "block", part.alias("s"), (hi - lo).alias("k")).groupBy("signal_id", "block").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    return sums.where(F.col("k") == n).select("signal_id", "block", (F.col("s") / n).alias("power"))


def loudness(points: DataFrame, sample_rate: int, length: int = 1024) -> DataFrame:
    """Integrated loudness: blocks over -70, then over the mean less 10, gated by two aggregations: signal_id, lufs (null without any)."""
    level = lambda p: -0.691 + 10 * F.log10(p)
    loud = block_powers(points, sample_rate, length).where("power > 0").where(level(F.col("power")) > -70)
    bar = loud.groupBy("signal_id").agg((level(F.avg("power")) - 10).alias("bar"))
    kept = loud.join(bar, "signal_id").where(level(F.col("power")) > F.col("bar"))
    return points.select("signal_id").distinct().join(kept.groupBy("signal_id").agg(level(F.avg("power")).alias("lufs")), "signal_id", "left")


def tristimulus(signals: DataFrame, sample_rate: int, n_fft: int, hop: int, harmonics: int = 10, f_min: float = 60.0, f_max: float = 1000.0) -> DataFrame:
    """Mean shares of the first partial, partials 2 to 4 and the rest: signal_id, t1, t2, t3.

    The pitch comes from the autocorrelation of the whole signal; partials are the strongest bins within 30 Hz of its
    multiples, by a range join of bins with partials per signal. A third each without pitch or energy.
    """
    from tidewave.functions.arrays import argmax
    from tidewave.operators.spectral import bins
    from tidewave.operators.spectrograms import stft
    from tidewave.sources.signals import centered

    if harmonics < 5:
        raise ValueError("at least 5 harmonics")

    @F.pandas_udf("array<double>")
    def whole(batch: pd.Series) -> pd.Series:
        import numpy as np

        def one(x):
            size = 1 << max(1, (2 * len(x) - 1).bit_length())
            return np.fft.irfft(np.abs(np.fft.rfft(np.asarray(x, float), size)) ** 2, size)[: len(x)]

        return batch.map(one)

    low = max(1, int(sample_rate / f_max))
    # Not deterministic only by name: filters on what is read off the transform must not be pushed below it.
    ac = centered(signals).select("signal_id", F.size("samples").alias("n"), whole.asNondeterministic()("samples").alias("ac"))
    high = F.least(F.col("n") - 1, F.lit(int(sample_rate / f_min)))
    part = F.transform(F.slice("ac", F.lit(low + 1), F.greatest(high - low + 1, F.lit(1))), lambda v: F.round(v, 9))
    pitch = ac.where((F.col("n") >= 4) & (high > low)).select("signal_id", (F.lit(float(sample_rate)) / (argmax(part) + low)).alias("f0")).where("f0 >= 20")
    bin_hz = sample_rate / n_fft
    reach = max(1, round(30.0 / bin_hz))
    partial = pitch.select("signal_id", F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("h"), "f0").withColumn("centre", F.rint(F.col("f0") * F.col("h") / bin_hz))
    near = bins(stft(signals, n_fft, hop)).join(partial, "signal_id").where(F.abs(F.col("k") - F.col("centre")) <= reach)
    amp = near.groupBy("signal_id", "frame_idx", "h").agg(F.max("m").alias("a"))
    share = amp.groupBy("signal_id", "frame_idx").agg(F.sum("a").alias("all"), *[F.sum(F.when(c, F.col("a")).otherwise(0.0)).alias(n) for n, c in (("t1", F.col("h") == 1), ("t2", F.col("h").between(2, 4)), ("t3", F.col("h") >= 5))]).where("all > 1e-8")
    mean = share.groupBy("signal_id").agg(*[F.avg(F.col(t) / F.col("all")).alias(t) for t in ("t1", "t2", "t3")])
    return signals.select("signal_id").join(mean, "signal_id", "left").select("signal_id", *[F.coalesce(t, F.lit(1 / 3)).alias(t) for t in ("t1", "t2", "t3")])
