"""Time-domain features: Column functions over a frame or a whole signal (array<double>), and relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import argmax, c, diff, dot, first_from, indexed, let, mean, ratio, total, total_of
from tidewave.functions.fourier import circular_autocorrelation
from tidewave.functions.windows import hann_periodic, hann_symmetric, literal
from tidewave.sources.signals import frame_array, samples_long


def rms(frame: str | Column, n: int) -> Column:
    """Root of the Hann-weighted energy over the window's own energy."""
    w = hann_symmetric(n)
    return F.sqrt(total_of(F.zip_with(c(frame), literal(w), lambda x, y: x * y), lambda v: v * v) / sum(v * v for v in w))


def short_time_energy(frame: str | Column) -> Column:
    return dot(frame, frame)


def zero_crossing_count(frame: str | Column) -> Column:
    """Half the sum of sign changes; an exact zero counts half on either side."""
    return total_of(diff(F.transform(c(frame), F.signum)), F.abs) / 2


def zero_crossing_rate(frame: str | Column) -> Column:
    return zero_crossing_count(frame) / F.size(c(frame))


def windowed_energy(frame: str | Column, n: int) -> Column:
    """Energy under a periodic Hann window."""
    return total_of(F.zip_with(c(frame), literal(hann_periodic(n)), lambda x, y: x * y), lambda v: v * v)


def entropy_of_energy(frame: str | Column, n: int, sub_frames: int = 10) -> Column:
    """Entropy of the energy over sub-frames, 0 for silence."""
    width = max(1, n // sub_frames)
    parts = F.transform(frame_array(c(frame), width, width), lambda s: F.aggregate(s, F.lit(0.0), lambda a, v: a + v * v))
    shares = lambda p: let(total(p), lambda t: F.when(t > 0, -total_of(p, lambda e: e / t * F.log2(e / t + 1e-8))).otherwise(0.0))
    return let(parts, shares)


def frame_temporal_centroid(frame: str | Column) -> Column:
    """Energy-weighted mean place in the frame, in samples."""
    return ratio(total(indexed(frame, lambda v, i: i * v * v)), short_time_energy(frame))


def temporal_centroid(samples: str | Column) -> Column:
    """Amplitude-weighted mean place in the signal, in samples."""
    return ratio(total(indexed(samples, lambda v, i: i * F.abs(v))), total_of(samples, F.abs))


def teager_energy(samples: str | Column) -> Column:
    """Mean of x[n]^2 - x[n-1] x[n+1], 0 under three samples."""
    def of(x: Column) -> Column:
        n = F.size(x)
        terms = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.get(x, i) * F.get(x, i) - F.get(x, i - 1) * F.get(x, i + 1))
        return F.when(n >= 3, total(terms) / (n - 2)).otherwise(0.0)

    return let(samples, of)


def amplitude_modulation_depth(envelope: str | Column, window: int) -> Column:
    """Mean of (max - min) / (max + min) over disjoint windows, 0 for shorter signals."""
    parts = F.transform(frame_array(c(envelope), window, window, pad=False), lambda f: (F.array_max(f) - F.array_min(f)) / (F.array_max(f) + F.array_min(f) + 1e-8))
    return F.when(F.size(parts) > 0, mean(parts)).otherwise(0.0)


def smoothed_envelope(samples: str | Column, sample_rate: int, window_ms: float = 5.0) -> Column:
    """Moving average of |x| over an odd window with reflection at both ends; empty for signals within half a window."""
    width = max(1, int(sample_rate * window_ms / 1000.0))
    half = (width + 1 - width % 2) // 2
    x = F.transform(c(samples), F.abs)
    n = F.size(x)
    left = F.reverse(F.slice(x, 2, half)) if half else F.array().cast("array<double>")
    right = F.reverse(F.slice(x, n - half, half)) if half else F.array().cast("array<double>")
    smooth = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2 * half), lambda i: total(F.slice(p, i, 2 * half + 1)) / (2 * half + 1))
    return F.when(n > half, let(F.concat(left, x, right), smooth)).otherwise(F.array().cast("array<double>"))


def log_attack_time(envelope: str | Column, sample_rate: int, low: float = 0.1, high: float = 0.9) -> Column:
    """log10 of the seconds from the first `low` to the next `high` share of the peak; -8 where there is no rise."""
    def of(e: Column, peak: Column) -> Column:
        rise = lambda start: let(first_from(e, start, lambda v: v >= high * peak), lambda stop: F.when(stop > start, F.log10(F.greatest((stop - start) / F.lit(float(sample_rate)), F.lit(1e-8)))))
        return F.when(peak >= 1e-12, let(first_from(e, F.lit(0), lambda v: v >= low * peak), rise))

    return F.coalesce(let(envelope, lambda e: let(F.array_max(e), lambda peak: of(e, peak))), F.lit(-8.0))


def decay_time(samples: str | Column, sample_rate: int, threshold_db: float = -20.0) -> Column:
    """Seconds from the loudest sample to the first later one under the threshold; 0 if there is none."""
    def of(a: Column, peak: Column) -> Column:
        fall = lambda top: let(first_from(a, top, lambda v: v < peak * 10 ** (threshold_db / 20)), lambda below: (below - top) / F.lit(float(sample_rate)))
        return F.when(peak > 0, let(F.array_position(a, peak) - 1, fall))

    return F.coalesce(let(F.transform(c(samples), F.abs), lambda a: let(F.array_max(a), lambda peak: of(a, peak))), F.lit(0.0))


def breath_groups(signals: DataFrame, sample_rate: int) -> DataFrame:
    """Durations between starts of long gaps: samples under a quarter of the mean, neighbours over 0.25 s apart mark a start.

    One row per duration: signal_id, group_idx, duration. Gaps and islands by window functions over the quiet samples.
    """
    places = F.transform("samples", lambda v, i: F.struct(i.alias("n"), v.alias("x")))
    quiet = let(mean("samples") * 0.25, lambda m: F.filter(places, lambda s: s["x"] < m))
    rows = samples_long(signals.withColumn("samples", F.transform(quiet, lambda s: s["n"].cast("double"))))
    order = Window.partitionBy("signal_id").orderBy("x")
    starts = rows.withColumn("after", F.lead("x").over(order)).where(F.col("after") - F.col("x") > int(0.25 * sample_rate))
    return starts.withColumn("duration", (F.lead("x").over(order) - F.col("x")) / sample_rate).withColumn("group_idx", (F.row_number().over(order) - 1).cast("long")).where("duration is not null").select("signal_id", "group_idx", "duration")


def speech_rate(signals: DataFrame, sample_rate: int, threshold_ratio: float = 0.3, min_gap: float = 0.1) -> DataFrame:
    """Peaks of the smoothed envelope per second: strict local maxima over a share of the mean, some time after the peak before."""
    width = max(1, int(0.02 * sample_rate))
    half = width // 2
    padded = F.concat(F.array_repeat(F.lit(0.0), half), F.transform("samples", F.abs), F.array_repeat(F.lit(0.0), half))
    smooth = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - width + 1), lambda i: total(F.slice(p, i, width)) / width)
    env = signals.withColumn("env", let(padded, smooth)).select("signal_id", F.size("samples").alias("size"), mean("env").alias("level"), F.posexplode("env").alias("n", "e"))
    order = Window.partitionBy("signal_id").orderBy("n")
    peaks = env.withColumn("b", F.lag("e").over(order)).withColumn("a", F.lead("e").over(order))
    is_peak = F.coalesce((F.col("e") > F.col("b")) & (F.col("e") > F.col("a")) & (F.col("e") > F.col("level") * threshold_ratio), F.lit(False))
    marked = peaks.withColumn("last", F.max(F.when(is_peak, F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    kept = F.sum(F.when(is_peak & (F.col("last").isNull() | (F.col("n") - F.col("last") > int(min_gap * sample_rate))), 1).otherwise(0))
    return marked.groupBy("signal_id", "size").agg(kept.alias("peaks")).select("signal_id", (F.col("peaks") / (F.col("size") / sample_rate)).alias("rate"))


def beat_lags(signals: DataFrame, sample_rate: int, hop: int, tempo_min: float = 60.0, tempo_max: float = 240.0) -> DataFrame:
    """Tempo of each signal by the autocorrelation of its pooled rises: signal_id, tempo, lag, frames (0 on short input).

    Rises and pooling are native; the circular autocorrelation is the transform helper, whose even number of lags makes odd
    lengths count as one shorter.
    """
    low, high = max(1, round(60.0 / tempo_max * sample_rate / hop)), round(60.0 / tempo_min * sample_rate / hop)
    order = Window.partitionBy("signal_id").orderBy("n")
    rises = samples_long(signals).withColumn("before", F.lag("x").over(order)).where("before is not null")
    pooled = rises.groupBy("signal_id", F.floor((F.col("n") - 1) / hop).alias("k")).agg(F.avg(F.greatest(F.col("x") - F.col("before"), F.lit(0.0))).alias("r"), F.count("*").alias("size")).where(F.col("size") == hop)
    level = pooled.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy("signal_id")))
    series = level.groupBy("signal_id").agg(F.count("*").alias("frames"), F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda s: s["r"]).alias("pools")).where("frames >= 4")
    spectrum = series.select("signal_id", "frames", circular_autocorrelation(F.col("pools")).alias("ac"))
    most = F.least(F.lit(high), F.size("ac") - 1)
    part = F.transform(F.slice("ac", F.lit(low + 1), F.greatest(most - low, F.lit(0))), lambda v: F.round(v, 9))
    best = spectrum.where(most > low).select("signal_id", "frames", (argmax(part) + low).alias("lag"))
    found = best.select("signal_id", (60.0 * sample_rate / (hop * F.col("lag"))).alias("tempo"), "lag", "frames")
    return signals.select("signal_id").join(found, "signal_id", "left").select("signal_id", F.coalesce("tempo", F.lit(0.0)).alias("tempo"), "lag", "frames")


def beat_frames(tempo: DataFrame) -> DataFrame:
    """Beats of `beat_lags` rows: signal_id, beat_idx, frame."""
    return tempo.where("lag is not null").select("signal_id", F.posexplode(F.sequence(F.lit(0), (F.col("frames") - 1).cast("int"), F.col("lag").cast("int"))).alias("beat_idx", "frame")).select("signal_id", F.col("beat_idx").cast("long"), F.col("frame").cast("long"))


def beat_detection(signals: DataFrame, sample_rate: int, hop: int) -> DataFrame:
    """signal_id, tempo and confidence: 1 - spread / mean of the intervals between beats, within 0 and 1; 0 under two beats."""
    tempo = beat_lags(signals, sample_rate, hop)
    order = Window.partitionBy("signal_id").orderBy("beat_idx")
    gaps = beat_frames(tempo).withColumn("gap", (F.col("frame") - F.lag("frame").over(order)) * F.lit(hop / sample_rate))
    spread = gaps.groupBy("signal_id").agg((F.lit(1.0) - F.stddev_pop("gap") / (F.avg("gap") + 1e-8)).alias("confidence"))
    return tempo.join(spread, "signal_id", "left").select("signal_id", "tempo", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")), F.lit(0.0)).alias("confidence"))


def silence_islands(signals: DataFrame, sample_rate: int, window: int, hop: int, threshold: float) -> DataFrame:
    """Runs of frames over an energy threshold: signal_id, first_frame, last_frame, start and end sample. Gaps and islands."""
    from tidewave.sources.signals import frames

    loud = frames(signals, window, hop, pad=False).where(windowed_energy("frame", window) > threshold).select("signal_id", "frame_idx")
    order = Window.partitionBy("signal_id").orderBy("frame_idx")
    runs = loud.withColumn("island", F.col("frame_idx") - F.row_number().over(order)).groupBy("signal_id", "island").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    return runs.select("signal_id", "first_frame", "last_frame", (F.col("first_frame") * hop).alias("start_sample"), (F.col("last_frame") * hop + window).alias("end_sample"))


def silence_removal(signals: DataFrame, sample_rate: int, window: int, hop: int, threshold: float) -> DataFrame:
    """Each signal cut to its loud runs, one after the other (their overlaps stay); empty where nothing is loud."""
    runs = silence_islands(signals, sample_rate, window, hop, threshold)
    cuts = runs.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("start_sample", "end_sample"))).alias("cuts"))
    kept = F.flatten(F.transform("cuts", lambda r: F.slice("samples", r["start_sample"].cast("int") + 1, (r["end_sample"] - r["start_sample"]).cast("int"))))
    return signals.join(cuts, "signal_id", "left").select("signal_id", "sample_rate", F.coalesce(kept, F.array().cast("array<double>")).alias("samples"))




def voice_onset_time(signals: DataFrame, sample_rate: int, n: int, hop: int) -> DataFrame:
    """Seconds from the first loud frame (over a tenth of the loudest) to the first frame from there on whose largest sample
    between 2 and 15 ms is over 0.3 of its first sample; 0 if there is none: signal_id, onset."""
    from tidewave.sources.signals import frames

    low, high = int(0.002 * sample_rate), int(0.015 * sample_rate)
    rows = frames(signals, n, hop).select("signal_id", "frame_idx", short_time_energy("frame").alias("e"), ratio(F.array_max(F.slice("frame", low + 1, high - low)), F.get("frame", F.lit(0)), None).alias("r"))
    loud = rows.withColumn("top", F.max("e").over(Window.partitionBy("signal_id")))
    burst = loud.withColumn("burst", F.min(F.when(F.col("e") > F.col("top") * 0.1, F.col("frame_idx"))).over(Window.partitionBy("signal_id")))
    found = burst.groupBy("signal_id").agg(F.min(F.when((F.col("frame_idx") >= F.col("burst")) & (F.col("r") > 0.3), F.col("frame_idx") - F.col("burst"))).alias("d"))
    return found.select("signal_id", F.coalesce(F.col("d") * hop / F.lit(float(sample_rate)), F.lit(0.0)).alias("onset"))
