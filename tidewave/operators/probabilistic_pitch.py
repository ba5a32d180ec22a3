"""Probabilistic YIN: pitch candidates per frame with their probabilities, and the likeliest path through them per signal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.chains import tracked
from tidewave.operators.pitch import lag_range
from tidewave.sources.signals import points_of
from tidewave.storage import written

STEPS = 10  # pitch states to the semitone


@cache
def _threshold_weights(n: int = 100):
    """Beta(2, 18) weights of the thresholds k / n, k = 1 .. n."""
    import numpy as np

    # The distribution function of Beta(2, 18) is 1 - (1 - x)^19 - 19 x (1 - x)^18.
    x = np.arange(n + 1) / n
    return np.diff(1 - (1 - x) ** 19 - 19 * x * (1 - x) ** 18)


def candidates(frame, sample_rate: int, f_min: float, f_max: float):
    """Frequencies and probabilities of the pitch candidates of a frame.

    For each threshold the first trough of the normalised difference under it counts (the lowest one with a probability of
    0.01 where none is); a trough's probability is the weight of the thresholds that choose it. Parabolas refine the lags.
    """
    import numpy as np

    n = len(frame)
    low, high = lag_range(sample_rate, f_min, f_max)
    half = n // 2
    high = min(high, half - 1)
    energy = np.concatenate([[0.0], np.cumsum(frame**2)])
    lags = np.arange(half)
    cross = np.fft.irfft(np.fft.rfft(frame, 2 * n) * np.conj(np.fft.rfft(frame[:half], 2 * n)))[:half]
    d = energy[half] + energy[lags + half] - energy[lags] - 2 * cross
    norm = np.ones(half)
    norm[1:] = d[1:] * lags[1:] / np.maximum(np.cumsum(d[1:]), 1e-12)
    inner = norm[low : high + 1]
    if len(inner) < 3 or energy[-1] < 1e-12:
        return np.zeros(0), np.zeros(0)
    trough = np.flatnonzero((inner[1:-1] < inner[:-2]) & (inner[1:-1] <= inner[2:])) + 1
    if inner[0] < inner[1]:
        trough = np.concatenate([[0], trough])
    if not len(trough):
        return np.zeros(0), np.zeros(0)
    weight, threshold = _threshold_weights(), np.arange(1, 101) / 100
    under = inner[trough][None, :] < threshold[:, None]
    prob = np.zeros(len(trough))
    some = under.any(axis=1)
    np.add.at(prob, under[some].argmax(axis=1), weight[some])
    prob[int(np.argmin(inner[trough]))] += 0.01 * weight[~some].sum()
    at = trough + low
    before, here, after = norm[np.maximum(at - 1, 0)], norm[at], norm[np.minimum(at + 1, half - 1)]
    bend = before - 2 * here + after
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (before - after) / np.where(bend == 0, 1.0, bend), 0.0)
    return sample_rate / (at + np.clip(shift, -1, 1)), prob


class PathSearch:
    """Viterbi search over pitches a tenth of a semitone apart, voiced or not. The pitch moves by at most `widest` octaves a second, near ones likelier
    (a triangle); voicing changes with probability `switch`. Scores are the state between blocks of frames."""

    def __init__(self, f_min: float, f_max: float, seconds: float, widest: float = 35.92, switch: float = 0.01):
        import numpy as np

        self.f_min, self.n = f_min, int(np.floor(12 * STEPS * np.log2(f_max / f_min))) + 1
        reach = max(1, int(round(widest * 12 * STEPS * seconds)))
        reach = min(reach, self.n - 1) if self.n > 1 else 0
        step = np.arange(-reach, reach + 1)
        self.reach, self.moves = reach, np.log((reach + 1 - np.abs(step)) / ((reach + 1.0) ** 2))
        self.stay, self.change = np.log(1 - switch), np.log(switch)

    def seen(self, freq, prob):
        import numpy as np

        log, n = lambda p: np.log(np.maximum(p, 1e-300)), self.n
        voiced = np.zeros(n)
        if len(freq):
            place = np.rint(12 * STEPS * np.log2(np.asarray(freq) / self.f_min)).astype(np.int64)
            inside = (place >= 0) & (place < n)
            np.add.at(voiced, place[inside], np.asarray(prob)[inside])
        return np.stack([log(voiced), np.full(n, log(max(1 - voiced.sum(), 0.0) / n))])

    def step(self, score, freq, prob):
        """Scores after a frame and, for each state, the one it came from; `score` is None before the first frame."""
        import numpy as np

        n, seen = self.n, self.seen(freq, prob)
        if score is None:
            return seen - np.log(2 * n), np.full((2, n), -1)
        # All moves to a state side by side, from the highest origin to the lowest.
        wide = np.pad(score, ((0, 0), (self.reach, self.reach)), constant_values=-np.inf)
        moved = np.lib.stride_tricks.sliding_window_view(wide, 2 * self.reach + 1, axis=1)[:, :, ::-1] + self.moves
        move = moved.argmax(axis=2)
        best, where = np.take_along_axis(moved, move[:, :, None], axis=2)[:, :, 0], np.arange(n) + self.reach - move
        options = np.stack([np.stack([best[0] + self.stay, best[1] + self.change]), np.stack([best[0] + self.change, best[1] + self.stay])])
        pick = options.argmax(axis=1)
        came = pick * n + np.take_along_axis(where[None].repeat(2, axis=0), pick[:, None], axis=1)[:, 0]
        return np.take_along_axis(options, pick[:, None], axis=1)[:, 0] + seen, came

    def run(self, frames, entry):
        """Scores after a block, the largest being 0; without frames, scores that prefer no state."""
        import numpy as np

        if frames is None:
            return np.zeros(2 * self.n)
        score = None if entry is None else entry.reshape(2, self.n)
        for f in frames:
            score, _ = self.step(score, f["freq"], f["prob"])
        return (score - score.max()).ravel()

    def origins(self, frames, entry):
        """For each state after a block, the state before it that its likeliest path came from (-1 before the first frame), and the best state."""
        import numpy as np

        score, origin = None if entry is None else entry.reshape(2, self.n), np.arange(2 * self.n)
        for f in frames:
            score, came = self.step(score, f["freq"], f["prob"])
            came = came.ravel()
            origin = np.where(came >= 0, origin[came], -1)
        return origin, int(score.ravel().argmax())

    def path(self, frames, entry, last: int | None):
        """Pitch of every frame of a block (0: unvoiced) on the path that ends in state `last` (None: the best one), as the only column."""
        import numpy as np

        score, back, out = None if entry is None else entry.reshape(2, self.n), [], np.zeros(len(frames))
        for f in frames:
            score, came = self.step(score, f["freq"], f["prob"])
            back.append(came.ravel().astype(np.int32))
        last = int(score.ravel().argmax()) if last is None else last
        for t in range(len(frames) - 1, -1, -1):
            if last < self.n:
                out[t] = self.f_min * 2 ** (last / (12 * STEPS))
            last = int(back[t][last])
        return (out,)

    def same(self, a, b) -> bool:
        import numpy as np

        d = a - b
        return bool(np.abs(d - d[0]).max() < 1e-9)


def pitch_candidates(points: DataFrame, sample_rate: int, n: int, hop: int, f_min: float, f_max: float) -> DataFrame:
    """signal_id, frame_idx, freq, prob of frames centred on multiples of `hop`, from samples with their places (zeros on both sides)."""
    wide = points.withColumn("size", F.col("size") + 2 * (n // 2)).withColumn("i", F.col("i") + n // 2)

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for at, size, x in zip(batch.column("at"), batch.column("size").to_pylist(), batch.column("frame"), strict=True):
                frame = np.zeros(n)
                frame[np.asarray(at.values)] = np.asarray(x.values)
                found.append(candidates(frame, sample_rate, f_min, f_max))
            yield pa.RecordBatch.from_arrays(
                [batch.column("signal_id"), batch.column("frame_idx"), pa.array([f.tolist() for f, _ in found], pa.list_(pa.float64())), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64()))],
                ["signal_id", "frame_idx", "freq", "prob"],
            )

    last = F.floor((F.col("size") - n) / hop)
    first, until = F.greatest(F.ceil((F.col("i") - n + 1) / hop), F.lit(0)), F.least(F.floor(F.col("i") / hop), last)
    spread = wide.where(first <= until).select("signal_id", "size", F.explode(F.sequence(first, until)).alias("frame_idx"), "i", "x")
    held = spread.groupBy("signal_id", "frame_idx", "size").agg(F.collect_list(F.struct((F.col("i") - F.col("frame_idx") * hop).cast("int").alias("at"), "x")).alias("s"))
    # Frames that reach no sample lie within the added zeros; they have no candidates.
    sizes = points.groupBy("signal_id").agg((F.floor((F.max("size") + 2 * (n // 2) - n) / hop)).alias("last"))
    every = sizes.where("last >= 0").select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame_idx"))
    seen = held.select("signal_id", "frame_idx", "size", F.transform("s", lambda v: v["at"]).alias("at"), F.transform("s", lambda v: v["x"]).alias("frame"))
    seen = seen.mapInArrow(find, "signal_id long, frame_idx long, freq array<double>, prob array<double>")
    none = F.array().cast("array<double>")
    return every.join(seen, ["signal_id", "frame_idx"], "left").select("signal_id", "frame_idx", F.coalesce("freq", none).alias("freq"), F.coalesce("prob", none).alias("prob"))


def pyin(signals: DataFrame, sample_rate: int, n: int = 2048, hop: int = 512, f_min: float = 50.0, f_max: float = 600.0, unvoiced: float = 0.0, per: int = 512) -> DataFrame:
    """Pitch of frames centred on multiples of `hop`: signal_id, frame_idx, f0 (`unvoiced` where there is none).

    `signals` are arrays, or samples with their places (`points_of_rows`) for signals of any length. Frames are analysed apart and the
    path is searched in blocks of `per` frames. A signal without samples has no frames.
    """
    lag_range(sample_rate, f_min, f_max)
    points = points_of(signals) if "samples" in signals.columns else written(signals, "points")  # read by the frames and the sizes
    seen = pitch_candidates(points, sample_rate, n, hop, f_min, f_max)
    found = tracked(seen, PathSearch(f_min, f_max, hop / sample_rate), ["freq", "prob"], ["f0"], per)
    return found.withColumn("f0", F.when(F.col("f0") > 0, F.col("f0")).otherwise(F.lit(float(unvoiced))))
