"""One flat feature row per signal: seven series and the pitch share one row per frame and one aggregation; the centred spectra
of the bandwidth and the cepstra have frames of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.fourier import autocorrelation, magnitude
from tidewave.functions.windows import hann_symmetric, literal
from tidewave.operators import pitch, spectral, spectrograms, stats, temporal
from tidewave.sources.signals import frame_array


def effective_mfcc(samples: int, n_fft: int, hop: int, n_mels: int, n_mfcc: int) -> tuple[int, int, int, int]:
    """Transform size, hop, bands and coefficients for signals of at least `samples` samples."""
    n = min(n_fft, max(16, samples))
    mels = min(n_mels, max(8, n // 2))
    return n, min(hop, max(1, n // 2)), mels, min(n_mfcc, mels)


def extract_core(signals: DataFrame, sample_rate: int, n: int = 2048, hop: int = 512, f_min: float = 50.0, f_max: float = 600.0, n_mels: int = 128, n_mfcc: int = 40) -> DataFrame:
    """sample_rate, num_samples, duration_sec; six functionals of eight series; pitch summary; mean and deviation of MFCCs.

    Signals shorter than a frame have nulls for bandwidth, flux and flatness, and for MFCCs.
    """
    keys, bin_hz = ["signal_id"], sample_rate / n
    sized = signals.withColumn("num_samples", F.size("samples").cast("long"))
    facts = ["signal_id", "num_samples"]
    windowed = F.zip_with("frame", literal(hann_symmetric(n)), lambda a, b: a * b)
    # One row per frame with its spectrum and autocorrelation; everything else is read off these.
    base = sized.select(*facts, F.posexplode(frame_array(F.col("samples"), n, hop)).alias("frame_idx", "frame"))
    base = base.select(*facts, "frame_idx", "frame", magnitude(F.col("frame"), n).alias("mag"), autocorrelation(windowed, n).alias("ac"))
    before = F.lag("mag").over(Window.partitionBy("signal_id").orderBy("frame_idx"))
    series = base.withColumn("before", before).select(
        *facts, temporal.rms("frame", n).alias("rms"), temporal.zero_crossing_rate("frame").alias("zcr"), spectral.centroid("mag", bin_hz).alias("spectral_centroid"),
        spectral.rolloff_of("mag", bin_hz).alias("spectral_rolloff"), spectral.distance("mag", "before").alias("spectral_flux"),
        F.when(F.col("num_samples") >= n, spectral.flatness("mag")).alias("spectral_flatness"), pitch.pitch_strength("ac", n, sample_rate, f_min, f_max).alias("pitch_strength"),
        pitch.yin_of("ac", n, sample_rate, f_min, f_max).alias("f0"),
    )
    width = spectrograms.stft(signals, n, hop).select("signal_id", spectrograms.bandwidth("mag", bin_hz).alias("spectral_bandwidth"))
    names = ["rms", "zcr", "spectral_centroid", "spectral_rolloff", "spectral_flux", "spectral_flatness", "pitch_strength"]
    stats_ = [col.alias(f"{v}_{s}") for v in names for s, col in stats.moments(F.col(v)).items()]
    voiced = F.when(F.col("f0") > 0, F.col("f0"))
    tones = [F.avg((F.col("f0") > 0).cast("double")).alias("f0_voiced_ratio"), F.avg(voiced).alias("f0_mean_hz"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN f0 > 0 THEN f0 END)").alias("f0_median_hz")]
    n_fft, step, mels, coeffs = effective_mfcc(n, n, hop, n_mels, n_mfcc)
    cepstra = spectrograms.mfcc_frames(signals, sample_rate, coeffs, n_fft, step, mels)
    at = lambda i: F.get("mfcc", F.lit(i))
    cepstra = cepstra.groupBy(*keys).agg(*[F.avg(at(i)).alias(f"mfcc_mean_{i}") for i in range(coeffs)], *[F.stddev_pop(at(i)).alias(f"mfcc_std_{i}") for i in range(coeffs)])
    out = sized.select("signal_id", F.lit(sample_rate).alias("sample_rate"), "num_samples", (F.col("num_samples") / F.lit(float(max(sample_rate, 1)))).alias("duration_sec"))
    for rows in (series.groupBy(*keys).agg(*stats_, *tones), stats.functionals(width, keys, ["spectral_bandwidth"]), cepstra):
        out = out.join(rows, "signal_id", "left")
    order = [f"{v}_{s}" for v in (*names[:4], "spectral_bandwidth", *names[4:]) for s in stats.STATS]
    return out.select("signal_id", "sample_rate", "num_samples", "duration_sec", *order, "f0_voiced_ratio", "f0_mean_hz", "f0_median_hz", *[f"mfcc_{k}_{i}" for k in ("mean", "std") for i in range(coeffs)])
