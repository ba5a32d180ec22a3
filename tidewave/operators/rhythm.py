"""Onsets by adaptive peak picking with a walk back to the last minimum, and beats by dynamic programming over the onset strength.

Strengths are rows (signal_id, frame_idx, strength); peaks and minima are window functions over them. Tempo comes from autocorrelations that blocks of frames
sum apart, and the recurrence over beats runs in blocks (`chains`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import let
from tidewave.functions.fourier import magnitude, through_bank
from tidewave.functions.windows import hann_periodic, literal
from tidewave.operators.blocks import mirrored
from tidewave.operators.chains import tracked
from tidewave.operators.filterbanks import mel_bank
from tidewave.sources.signals import frames_of_points, halo_blocks, scattered


def onset_strength(points: DataFrame, sample_rate: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, top_db: float = 80.0) -> DataFrame:
    """signal_id, frame_idx, strength: median over mel bands of the rise in dB from the frame before, moved to where the frame begins; 0 at first.

    `points` are samples with their places (`sources.signals`); frames are centred, the signal is mirrored at its ends."""
    rows = frames_of_points(mirrored(points, n_fft // 2), n_fft, hop, pad=False)
    mag = magnitude(F.zip_with("frame", literal(hann_periodic(n_fft)), lambda a, b: a * b), n_fft)
    mel = rows.select("signal_id", "frame_idx", through_bank(mag, mel_bank(sample_rate, n_fft, n_mels), squared=True).alias("mel"))
    db = mel.select("signal_id", "frame_idx", F.transform("mel", lambda v: 10 * F.log10(F.greatest(v, F.lit(1e-10)))).alias("db"))
    tops = db.groupBy("signal_id").agg((F.max(F.array_max("db")) - top_db).alias("low"), F.max("frame_idx").alias("last"))
    held = db.join(tops, "signal_id").select("signal_id", "frame_idx", "last", let(F.col("low"), lambda low: F.transform("db", lambda v: F.greatest(v, low))).alias("v"))
    before = F.lag("v").over(Window.partitionBy("signal_id").orderBy("frame_idx"))
    rise = held.withColumn("before", before).where("before is not null").select("signal_id", "last", "frame_idx", F.array_sort(F.zip_with("v", "before", lambda a, b: F.greatest(a - b, F.lit(0.0)))).alias("r"))
    middle = (F.get("r", F.lit((n_mels - 1) // 2)) + F.get("r", F.lit(n_mels // 2))) / 2
    # A rise is seen half a window after it starts.
    moved = rise.select("signal_id", (F.col("frame_idx") + n_fft // (2 * hop)).alias("frame_idx"), middle.alias("strength"), "last").where("frame_idx <= last").drop("last")
    every = tops.select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame_idx"))
    return every.join(moved, ["signal_id", "frame_idx"], "left").select("signal_id", "frame_idx", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _kept(frames: Column, wait: int) -> Column:
    """Of ascending frames, those over `wait` after the last one kept."""
    start = F.array().cast("array<long>")
    return F.aggregate(frames, start, lambda kept, f: F.when((F.size(kept) == 0) | (f - F.element_at(kept, -1) > wait), F.concat(kept, F.array(f))).otherwise(kept))


def pick_onsets(strength: DataFrame, sample_rate: int, hop: int, backtrack: bool = True, delta: float = 0.07) -> DataFrame:
    """signal_id, frame_idx, time of the onsets in strengths (signal_id, frame_idx, strength).

    Strengths are scaled to 0 .. 1. An onset is the largest of the 30 ms before it, `delta` over the mean of the 100 ms around it, and over 30 ms after the
    onset before. With `backtrack` it moves to the last local minimum of strength at or before it, if there is one."""
    frames = lambda seconds: int(seconds * sample_rate // hop)
    order = Window.partitionBy("signal_id").orderBy("frame_idx")
    ends = strength.groupBy("signal_id").agg(F.min("strength").alias("lo"), F.max("strength").alias("hi"))
    scaled = strength.join(ends, "signal_id").where("hi > lo").withColumn("s", (F.col("strength") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    largest, around = F.max("s").over(order.rowsBetween(-frames(0.03), 0)), F.avg("s").over(order.rowsBetween(-frames(0.1), frames(0.1)))
    low = (F.col("s") <= F.lag("s").over(order)) & (F.col("s") < F.lead("s").over(order))
    marked = scaled.select("signal_id", "frame_idx", ((F.col("s") >= largest) & (F.round(F.col("s") - around - delta, 9) >= 0)).alias("peak"), F.when(low, F.col("frame_idx")).alias("minimum"))
    back = F.last("minimum", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    peaks = marked.withColumn("back", back).where("peak")
    # Only peaks within the waiting time of one another compete: runs of them are short.
    wait = frames(0.03)
    run = F.sum(F.when(F.col("frame_idx") - F.lag("frame_idx").over(order) > wait, 1).otherwise(0)).over(order)
    runs = peaks.withColumn("run", run).groupBy("signal_id", "run").agg(F.array_sort(F.collect_list("frame_idx")).alias("f"), F.map_from_entries(F.collect_list(F.struct("frame_idx", F.coalesce("back", "frame_idx").alias("b")))).alias("b"))
    kept = runs.select("signal_id", "b", F.explode(_kept(F.col("f"), wait)).alias("frame_idx"))
    place = F.element_at("b", F.col("frame_idx")) if backtrack else F.col("frame_idx")
    return kept.select("signal_id", place.alias("frame_idx")).withColumn("time", F.col("frame_idx") * hop / F.lit(float(sample_rate)))


def onset_times(points: DataFrame, sample_rate: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, backtrack: bool = True) -> DataFrame:
    """`pick_onsets` of `onset_strength`."""
    return pick_onsets(onset_strength(points, sample_rate, n_fft, hop, n_mels), sample_rate, hop, backtrack)


def tempo(strength: DataFrame, sample_rate: int, hop: int, start_bpm: float = 120.0, spread: float = 1.0, longest: float = 8.0, most_bpm: float = 320.0, per: int = 4096) -> DataFrame:
    """signal_id, lag (frames to a beat) and bpm: the lag of largest log autocorrelation of the strengths with a log-normal prior about `start_bpm`.

    Blocks of frames sum their products with what follows within `longest` seconds; signals without strength or shorter than two lags have none."""
    lags = max(2, int(longest * sample_rate / hop))
    points = strength.join(strength.groupBy("signal_id").agg(F.count("*").alias("size")), "signal_id").select("signal_id", "size", F.col("frame_idx").alias("i"), F.col("strength").alias("x"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                x = scattered(batch.column("at")[row], batch.column("x")[row], per + lags)
                size = 1 << (2 * len(x) - 1).bit_length()
                r = np.fft.irfft(np.conj(np.fft.rfft(x[:per], size)) * np.fft.rfft(x, size), size)[:lags]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(lags, batch.column("signal_id")[row].as_py(), np.int64)), pa.array(np.arange(lags)), pa.array(r)], ["signal_id", "lag", "r"])

    sums = halo_blocks(points, per, 0, lags).mapInArrow(run, "signal_id long, lag long, r double").groupBy("signal_id", "lag").agg(F.sum("r").alias("r"))
    whole = sums.withColumn("r0", F.max(F.when(F.col("lag") == 0, F.col("r"))).over(Window.partitionBy("signal_id"))).where("r0 > 1e-12 and lag > 0")
    bpm = F.lit(60.0 * sample_rate / hop) / F.col("lag")
    score = F.log1p(1e6 * F.greatest(F.col("r") / F.col("r0"), F.lit(0.0))) - 0.5 * F.pow((F.log2(bpm) - math.log2(start_bpm)) / spread, 2)
    best = whole.withColumn("bpm", bpm).where(F.col("bpm") <= most_bpm).groupBy("signal_id").agg(F.max_by(F.struct("lag", "bpm"), F.struct(F.round(score, 9).alias("s"), (-F.col("lag")).alias("l"))).alias("x"))
    return best.select("signal_id", "x.lag", "x.bpm")


class BeatSearch:
    """Beats whose strengths are large and whose distances are near the period: every frame takes the best frame two to half a period before it, less
    tightness times the squared logarithm of the change. The state between blocks is the scores of the last two periods and whether beats have begun."""

    def __init__(self, tightness: float = 100.0):
        self.tightness = tightness

    def _scan(self, frames, entry):
        import numpy as np

        period = frames[0]["period"]
        window = np.arange(-2 * period, -int(np.round(period / 2)) + 1)
        cost = -self.tightness * np.log(-window / period) ** 2
        reach, n = 2 * period, len(frames)
        score, begun = np.zeros(reach + n), False
        if entry is not None and len(entry):
            score[:reach], begun = entry[:reach], bool(entry[reach])
        back = np.full(n, -(1 << 30))
        for t, f in enumerate(frames):
            options = score[reach + t + window] + cost
            best = int(options.argmax())
            score[reach + t] = f["local"] + options[best]
            if begun or f["local"] >= 0.01 * f["top"]:
                back[t], begun = t + window[best], True
        return score, back, begun, reach

    def run(self, frames, entry):
        import numpy as np

        if frames is None:
            return np.zeros(0)
        score, _, begun, reach = self._scan(frames, entry)
        last = score[-reach:]
        return np.append(last - last.max(), float(begun))

    def same(self, a, b) -> bool:
        import numpy as np

        if len(a) != len(b) or a[-1] != b[-1]:
            return False
        d = a[:-1] - b[:-1]
        return bool(np.abs(d - d[0]).max() < 1e-9)

    def origins(self, frames, entry):
        """State (place among the last two periods) before the block for each state after it; the best is that of most score."""
        import numpy as np

        score, back, _, reach = self._scan(frames, entry)
        n = len(frames)
        came = np.full(n, -1)
        for t in range(n):
            came[t] = came[back[t]] if back[t] >= 0 else reach + back[t] if back[t] >= -reach and entry is not None else -1
        places = np.arange(n - reach, n)
        origin = np.where(places >= 0, came[np.maximum(places, 0)], reach + places if entry is not None else -1)
        return origin, int(score[-reach:].argmax())

    def path(self, frames, entry, last: int | None):
        """1 at beats, else 0, and the local score; without `last`, on the best path."""
        import numpy as np

        score, back, _, reach = self._scan(frames, entry)
        last = int(score[-reach:].argmax()) if last is None else last
        beat, t = np.zeros(len(frames)), len(frames) - reach + last if last >= 0 else -1
        while t >= 0:
            beat[t] = 1.0
            t = back[t]
        return beat, np.array([f["local"] for f in frames])


def beats(strength: DataFrame, sample_rate: int, hop: int, tempo_min: float = 60.0, tempo_max: float = 240.0, tightness: float = 100.0, per: int = 4096) -> DataFrame:
    """signal_id, bpm, beat_idx, frame_idx, time of the beats in strengths (signal_id, frame_idx, strength).

    The tempo is sought about the middle of the limits. Local scores are strengths over their deviation, smoothed by a Gaussian of a 32nd of a period. Beats at
    either end whose smoothed scores are under half their root mean square are left out. Signals without strength have no beats."""
    if not 0 < tempo_min < tempo_max:
        raise ValueError("expected 0 < tempo_min < tempo_max")
    known = tempo(strength, sample_rate, hop, min(300.0, max(40.0, (tempo_min + tempo_max) / 2)))
    spread = strength.groupBy("signal_id").agg(F.stddev_samp("strength").alias("sd")).where("sd > 0")
    rows = strength.join(known, "signal_id").join(spread, "signal_id").withColumn("s", F.col("strength") / F.col("sd"))
    # Each frame gives its share to those within a period: as many rows as a period has frames.
    offset = F.explode(F.sequence(-F.col("lag"), F.col("lag"))).alias("o")
    shares = rows.where("s > 0").select("signal_id", "frame_idx", "lag", "s", offset)
    shares = shares.select("signal_id", (F.col("frame_idx") + F.col("o")).alias("frame_idx"), (F.col("s") * F.exp(-0.5 * F.pow(F.col("o") * 32.0 / F.col("lag"), 2))).alias("v"))
    local = rows.select("signal_id", "frame_idx", F.col("lag").alias("period")).join(shares.groupBy("signal_id", "frame_idx").agg(F.sum("v").alias("v")), ["signal_id", "frame_idx"], "left").withColumn("local", F.coalesce("v", F.lit(0.0)))
    seen = local.join(local.groupBy("signal_id").agg(F.max("local").alias("top")), "signal_id").select("signal_id", "frame_idx", F.col("period").cast("int").alias("period"), "local", "top")
    found = tracked(seen, BeatSearch(tightness), ["period", "local", "top"], ["beat", "score"], per).where("beat > 0")
    order = Window.partitionBy("signal_id").orderBy("frame_idx")
    side = lambda k: F.coalesce(F.lag("score", k).over(order), F.lit(0.0)) + F.coalesce(F.lead("score", k).over(order), F.lit(0.0))
    smooth = found.withColumn("smooth", F.col("score") + 0.5 * side(1))  # a Hann window of five values
    level = smooth.groupBy("signal_id").agg((0.5 * F.sqrt(F.avg(F.col("smooth") * F.col("smooth")))).alias("level"))
    strong = smooth.join(level, "signal_id")
    ends = strong.where("smooth > level").groupBy("signal_id").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    kept = strong.join(ends, "signal_id").where("frame_idx >= lo and frame_idx <= hi").join(known.select("signal_id", "bpm"), "signal_id")
    return kept.select("signal_id", "bpm", (F.row_number().over(order) - 1).cast("long").alias("beat_idx"), "frame_idx", (F.col("frame_idx") * hop / F.lit(float(sample_rate))).alias("time"))


def beat_track(points: DataFrame, sample_rate: int, n_fft: int = 2048, hop: int = 512, tempo_min: float = 60.0, tempo_max: float = 240.0, n_mels: int = 128) -> DataFrame:
    """`beats` of `onset_strength`."""
    return beats(onset_strength(points, sample_rate, n_fft, hop, n_mels), sample_rate, hop, tempo_min, tempo_max)
