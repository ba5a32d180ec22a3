"""Formants: Burg prediction per frame (a batched kernel), tracking along the frames of a signal in blocks, robust medians by aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.functions.windows import gaussian, literal
from tidewave.operators.chains import blocks_of_frames, settle
from tidewave.sources.files import resample
from tidewave.sources.signals import frames
from tidewave.storage import written

#: Search ranges of the first five formants in Hz.
RANGES = [(150.0, 1200.0), (400.0, 3500.0), (1200.0, 5000.0), (2000.0, 6500.0), (2500.0, 8000.0)]


def burg(rows, order: int):
    """Prediction polynomials 1, a_1.. of all rows of a matrix; each step minimises forward and backward error together."""
    import numpy as np

    ahead, behind = rows[:, 1:].copy(), rows[:, :-1].copy()
    poly = np.ones((len(rows), 1))
    for _ in range(order):
        power = (ahead**2 + behind**2).sum(axis=1)
        k = np.clip(-2 * (ahead * behind).sum(axis=1) / (power + 1e-10), -0.9999, 0.9999)[:, None]
        longer = np.pad(poly, ((0, 0), (0, 1)))
        poly = longer + k * longer[:, ::-1]
        ahead, behind = (ahead + k * behind)[:, 1:], (behind + k * ahead)[:, :-1]
    return poly


def resonances(poly, sample_rate: int, low: float, high: float, widest: float):
    """(frequency, bandwidth) of the stable roots in the upper half plane within the limits, by frequency."""
    import numpy as np

    roots = np.roots(poly)
    roots = roots[(np.abs(roots) < 1) & (roots.imag >= 0) & (np.abs(roots) > 0)]
    freq, width = np.angle(roots) * sample_rate / (2 * np.pi), -sample_rate * np.log(np.abs(roots)) / np.pi
    good = (freq >= low) & (freq <= high) & (width > 0) & (width <= widest)
    order = np.argsort(freq[good])
    return freq[good][order], width[good][order]


def search_ranges(count: int, top: float) -> list[tuple[float, float]]:
    step = top / (count + 1)
    wide = [RANGES[i] if i < len(RANGES) else (100 + i * step / 2, 100 + (i + 2) * step) for i in range(count)]
    return [(max(50.0, lo), min(top, hi)) for lo, hi in wide]


def candidates(signals: DataFrame, sample_rate: int, order: int, n: int, hop: int, top: float, pre_emphasis: float = 50.0, widest: float = 700.0) -> DataFrame:
    """signal_id, frame_idx, freqs, widths of the resonances of each Gaussian-windowed, pre-emphasised frame."""
    coef = pre_emphasis if 0 < pre_emphasis < 1 else math.exp(-2 * math.pi * pre_emphasis / sample_rate) if pre_emphasis > 0 else 0.0
    flat = F.transform("samples", lambda v, i: v - coef * F.coalesce(F.get("samples", i - 1), F.lit(0.0)))

    @F.pandas_udf("freqs array<double>, widths array<double>")
    def run(batch: pd.Series) -> pd.DataFrame:
        import numpy as np

        if not len(batch):
            return pd.DataFrame({"freqs": [], "widths": []})
        return pd.DataFrame([resonances(p, sample_rate, 50.0, top, widest) for p in burg(np.stack(batch.to_numpy()), order)], columns=["freqs", "widths"])

    windowed = F.zip_with("frame", literal(gaussian(n)), lambda a, b: a * b)
    return frames(signals.withColumn("samples", flat), n, hop).select("signal_id", "frame_idx", run(windowed).alias("r")).select("signal_id", "frame_idx", "r.freqs", "r.widths")


def at_formant_rate(signals: DataFrame, sample_rate: int, top: float) -> tuple[DataFrame, int]:
    """The signals at twice the highest formant, and that rate; signals of a lower rate stay as they are."""
    target = int(2 * top)
    if sample_rate <= target:
        return signals, sample_rate
    return signals.withColumn("samples", resample(F.col("samples"), sample_rate, target)).withColumn("sample_rate", F.lit(target)), target


def follow(frames: list, last: dict, ranges: list, top: float) -> tuple[list, dict]:
    """Formants (frame_idx, formant from 0, freq, width) along frames of resonances, and the last values; `last` are those before."""
    out = []
    for f in frames:
        if not f["freqs"]:
            continue
        free, now, below = dict(enumerate(f["freqs"])), {}, None
        for j, (low, high) in enumerate(ranges):
            floor = low if below is None else max(low, below + 20.0)
            options = [k for k, v in free.items() if floor <= v <= high] or [k for k, v in free.items() if floor <= v <= top]
            below = None
            if options:
                best = min(options, key=lambda k: abs(free[k] - last[j]) if j in last else free[k])
                now[j] = below = free.pop(best)
                out.append((f["frame_idx"], j, below, f["widths"][best]))
        last = now
    return out, last


def contours(found: DataFrame, count: int, top: float, per: int = 512) -> DataFrame:
    """Formant tracks: signal_id, frame_idx, formant (from 1), freq, width. Frames of a signal are followed in order, in blocks of `per` frames whose
    starting values `settle` brings to agreement.

    A formant takes, of the free resonances in its range and 20 Hz over the formant below, the one nearest to its last value,
    or the lowest if it had none in the frame before; without any in range, those up to the highest formant count.
    """
    ranges = search_ranges(count, top)

    def known(state) -> dict:
        return {j: v for j, v in enumerate(state) if v > 0} if state is not None else {}

    def run(frames, entry):
        import numpy as np

        last = follow(frames, known(entry), ranges, top)[1] if frames is not None else {}
        return np.array([last.get(j, 0.0) for j in range(count)])

    def tracks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                entry, signal = batch.column("entry")[at], batch.column("signal_id")[at].as_py()
                rows, _ = follow(batch.column("frames")[at].as_py(), known(np.asarray(entry.values)) if entry.is_valid else {}, ranges, top)
                t, j, freq, width = zip(*rows, strict=True) if rows else ([], [], [], [])
                columns = [pa.array([signal] * len(t), pa.int64()), pa.array(t, pa.int64()), pa.array([v + 1 for v in j], pa.int32()), pa.array(freq, pa.float64()), pa.array(width, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["signal_id", "frame_idx", "formant", "freq", "width"])

    blocks = written(blocks_of_frames(found, per, "freqs", "widths"), "resonances")
    entries = settle(blocks, run, lambda a, b: bool((a == b).all()))
    return entries.select("signal_id", "frames", "entry").mapInArrow(tracks, "signal_id long, frame_idx long, formant int, freq double, width double")


def frequencies(tracks: DataFrame) -> DataFrame:
    """Median of each track without values over 3.5 deviations (1.4826 median absolute deviations) away: signal_id, formant, freq."""
    keys = ["signal_id", "formant"]
    middle = tracks.groupBy(*keys).agg(F.median("freq").alias("med"))
    away = tracks.join(middle, keys)
    spread = away.groupBy(*keys).agg(F.median(F.abs(F.col("freq") - F.col("med"))).alias("mad"))
    kept = away.join(spread, keys).where((F.col("mad") <= 0) | (F.abs(F.col("freq") - F.col("med")) <= 3.5 * 1.4826 * F.col("mad")))
    return kept.groupBy(*keys).agg(F.when(F.max("mad") > 0, F.median("freq")).otherwise(F.max("med")).alias("freq"))


def dispersion(medians: DataFrame) -> DataFrame:
    """Mean distance of neighbouring formants per signal, 0 under two: signal_id, dispersion."""
    n, span = F.count("*"), F.max("freq") - F.min("freq")
    return medians.groupBy("signal_id").agg(F.when(n >= 2, F.abs(F.max_by("freq", "formant") - F.min_by("freq", "formant")) / (n - 1)).otherwise(span * 0).alias("dispersion"))


def formant_column(name: str, formant: int) -> Column:
    return F.max(F.when(F.col("formant") == formant, F.col("freq"))).alias(name)
