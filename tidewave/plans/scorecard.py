"""The scorecard: operators against signals whose features are known, as a table of checks with points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import formants, periodicity, pitch, probabilistic_pitch, spectral, temporal
from tidewave.sources.signals import frames, points_of

KIND = "name string, max_points double, measured double, expected double, error double, tolerance double, passed boolean, earned_points double"


def known_signals(spark: SparkSession, sample_rate: int, n: int) -> tuple[DataFrame, float]:
    """Signals constant, tone and vowel of over a second (signal_id 0, 1, 2), and the tone's frequency: ten periods a frame."""
    import numpy as np

    freq = 10.0 * sample_rate / n
    t = np.arange(int(1.5 * sample_rate)) / sample_rate
    source = sum(np.sin(2 * np.pi * 120.0 * k * t) / k for k in range(1, 15))
    vowel = np.zeros_like(source)
    for centre, width in ((600.0, 90.0), (1500.0, 120.0), (2500.0, 160.0)):  # resonators side by side
        r = math.exp(-math.pi * width / sample_rate)
        a, b, y1, y2 = 2 * r * math.cos(2 * math.pi * centre / sample_rate), -r * r, 0.0, 0.0
        for i, x in enumerate(source.tolist()):
            y1, y2 = x + a * y1 + b * y2, y1
            vowel[i] += (1 - r) * y1
    rows = [(0, np.ones(sample_rate)), (1, 0.8 * np.sin(2 * np.pi * freq * t)), (2, vowel)]
    return spark.createDataFrame([(k, sample_rate, x.tolist()) for k, x in rows], "signal_id long, sample_rate int, samples array<double>"), freq


def checks(spark: SparkSession, sample_rate: int = 22050, n: int = 1024, hop: int = 256, optional: bool = False) -> DataFrame:
    """One row per check: what was measured and expected, the error, its tolerance, whether it passed and the points earned. `optional` adds those of the
    pitch trackers: probabilistic YIN and the paths through auto- and cross-correlations."""
    if sample_rate <= 0 or n <= 0 or hop <= 0:
        raise ValueError("sample_rate, n and hop must be positive")
    signals, freq = known_signals(spark, sample_rate, n)
    only = lambda k: signals.where(F.col("signal_id") == k)
    tone, spectra = only(1), spectral.frame_spectrum(only(1), n, hop)
    bin_hz = sample_rate / n
    ac = pitch.frame_autocorrelation(tone, n, hop)

    def check(name: str, points: float, rows: DataFrame, measured, expected: float, tolerance: float, relative: bool = False) -> DataFrame:
        m = rows.agg(measured.cast("double").alias("m")).select(F.lit(name).alias("name"), F.lit(float(points)).alias("max_points"), F.col("m").alias("measured"), F.lit(float(expected)).alias("expected"))
        error = m.withColumn("error", F.abs(F.col("measured") - F.col("expected")) / (F.lit(max(abs(expected), 1e-8)) if relative else F.lit(1.0)))
        done = error.withColumn("tolerance", F.lit(float(tolerance))).withColumn("passed", F.coalesce(F.col("error") <= tolerance, F.lit(False)))
        return done.withColumn("earned_points", F.when(F.col("passed"), F.col("max_points")).otherwise(0.0))

    found = [
        check("rms", 10, frames(only(0), n, hop).select(temporal.rms("frame", n).alias("v")), F.avg("v"), 1.0, 0.01, relative=True),
        check("zero_crossing_rate", 10, frames(tone, n, hop).select(temporal.zero_crossing_rate("frame").alias("v")), F.avg("v"), 20.0 / n, 0.005),
        check("spectral_centroid", 8, spectra.select(spectral.centroid("mag", bin_hz).alias("v")), F.avg("v"), freq, 30.0),
        check("spectral_rolloff", 7, spectral.rolloff(spectra, bin_hz), F.avg("rolloff"), freq, 90.0),
        check("pitch_autocorrelation", 10, ac.select(pitch.autocorrelation_pitch("ac", n, sample_rate, 80.0, 500.0).alias("v")), F.avg("v"), freq, 0.05, relative=True),
        check("pitch_yin", 10, pitch.yin(ac, n, sample_rate, 80.0, 500.0), F.avg("f0"), freq, 0.05, relative=True),
    ]
    medians = formants.frequencies(formants.contours(formants.candidates(only(2), sample_rate, 12, n, hop, 5500.0), 3, 5500.0))
    f = {k: F.max(F.when(F.col("formant") == k, F.col("freq"))) for k in (1, 2, 3)}
    inside = f[1].between(150.0, 1200.0) & f[2].between(500.0, 3200.0) & (f[1] < f[2]) & (f[2] < f[3])
    found.append(check("formants", 10, medians, F.coalesce(inside, F.lit(False)).cast("int"), 1.0, 0.0))
    if optional:
        points = points_of(tone)
        tracks = {"pitch_pyin": (10, probabilistic_pitch.pyin(points, sample_rate, n, hop, max(50.0, freq / 2), max(200.0, 2 * freq))), "pitch_correlation_path": (12, periodicity.pitch(points, sample_rate)), "pitch_cross_correlation_path": (13, periodicity.pitch(points, sample_rate, method="cc"))}
        found += [check(name, worth, f0.where("f0 > 0"), F.median("f0"), freq, 0.05, relative=True) for name, (worth, f0) in tracks.items()]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def summary(found: DataFrame) -> DataFrame:
    """score (of 100), passed, available_points, earned_points, total_checks and failed_checks in one row."""
    return found.agg(
        (100 * F.sum("earned_points") / F.sum("max_points")).alias("score"), F.bool_and("passed").alias("passed"), F.sum("max_points").alias("available_points"), F.sum("earned_points").alias("earned_points"),
        F.count("*").alias("total_checks"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed_checks"),
    )
