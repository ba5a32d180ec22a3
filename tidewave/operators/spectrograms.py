"""Short-time spectra and what filterbanks make of them: mel, MFCC, gammatone cepstra, chroma, tonnetz, key, chords, contrast."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import c, folded, indexed, mean, numbered, total
from tidewave.functions.fourier import magnitude, through_bank
from tidewave.functions.windows import hann_periodic, hann_symmetric, literal
from tidewave.operators.filterbanks import chroma_bank, dct_bank, gammatone_bank, mel_bank, tonnetz_bank
from tidewave.operators.spectral import bins
from tidewave.sources.signals import frames

#: Key profiles of major and minor from C, and the pitch classes of the chord templates.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
CHORDS = {"C": [0, 4, 7], "G": [3, 6, 10]}


def padded(samples: str | Column, half: int, mode: str) -> Column:
    """`half` samples added on both sides: zeros ('constant') or the reflected signal ('reflect')."""
    x = c(samples)
    if mode == "constant":
        zeros = F.array_repeat(F.lit(0.0), half)
        return F.concat(zeros, x, zeros)
    n = F.size(x)
    left = F.transform(F.sequence(F.lit(half), F.lit(1), F.lit(-1)), lambda i: F.get(x, i))
    right = F.transform(F.sequence(F.lit(1), F.lit(half)), lambda i: F.get(x, n - 1 - i))
    return F.concat(left, x, right)


def stft(signals: DataFrame, n_fft: int, hop: int, mode: str | None = "reflect", window: list[float] | None = None) -> DataFrame:
    """Magnitudes of windowed frames, centred with padding `mode` (None: not centred): signal_id, sample_rate, frame_idx, mag."""
    if mode == "reflect":
        signals = signals.where(F.size("samples") > n_fft // 2)
    x = signals.withColumn("samples", padded("samples", n_fft // 2, mode)) if mode else signals
    w = literal(window or hann_periodic(n_fft))
    rows = frames(x, n_fft, hop, pad=False)
    return rows.select("signal_id", "sample_rate", "frame_idx", magnitude(F.zip_with("frame", w, lambda a, b: a * b), n_fft).alias("mag"))


def linear_spectrogram(signals: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """Magnitudes under a symmetric Hann window, centred by reflection."""
    return stft(signals, n_fft, hop, "reflect", hann_symmetric(n_fft))


def bandwidth(mag: str | Column, bin_hz: float) -> Column:
    """Magnitude-weighted deviation about the centroid."""
    centre = total(indexed(mag, lambda m, k: k * bin_hz * m)) / (total(mag) + 1e-8)
    return F.sqrt(folded(numbered(mag), centre, lambda x, c_: (x["k"] * bin_hz - c_) * (x["k"] * bin_hz - c_) * x["v"]) / (total(mag) + 1e-8))


def power_bins(spectra: DataFrame) -> DataFrame:
    return bins(spectra).select("signal_id", "frame_idx", "k", (F.col("m") * F.col("m")).alias("p"))


def by_band(frames_: DataFrame, values: str, index: str) -> DataFrame:
    """One row per band of an array column: signal_id, frame_idx, the band's number, value."""
    rows = frames_.select("signal_id", "frame_idx", F.posexplode(values).alias(index, "value"))
    return rows.withColumn(index, F.col(index).cast("long"))


def mel_frames(signals: DataFrame, sample_rate: int, n_fft: int, hop: int, n_mels: int, mode: str | None = "reflect", squared: bool = True) -> DataFrame:
    """Power (or magnitude) per mel band: signal_id, frame_idx, mel (array)."""
    bank = mel_bank(sample_rate, n_fft, n_mels)
    return stft(signals, n_fft, hop, mode).select("signal_id", "frame_idx", through_bank(F.col("mag"), bank, squared).alias("mel"))


def mel_spectrogram(signals: DataFrame, sample_rate: int, n_fft: int, hop: int, n_mels: int, mode: str | None = "reflect") -> DataFrame:
    """Power per mel band: signal_id, frame_idx, band, value."""
    return by_band(mel_frames(signals, sample_rate, n_fft, hop, n_mels, mode), "mel", "band")


def log_mel_spectrogram(signals: DataFrame, sample_rate: int, n_fft: int, hop: int, n_mels: int) -> DataFrame:
    return mel_spectrogram(signals, sample_rate, n_fft, hop, n_mels).withColumn("value", F.log(F.col("value") + 1e-6))


def mfcc_frames(signals: DataFrame, sample_rate: int, n_mfcc: int, n_fft: int, hop: int, n_mels: int, top_db: float = 80.0) -> DataFrame:
    """Cepstra of the mel spectrogram in dB, held within `top_db` of the signal's loudest value: signal_id, frame_idx, mfcc (array)."""
    mel = mel_frames(signals, sample_rate, n_fft, hop, n_mels, mode=None)
    db = mel.select("signal_id", "frame_idx", F.transform("mel", lambda v: 10 * F.log10(F.greatest(v, F.lit(1e-10)))).alias("db"))
    held = db.withColumn("floor", F.max(F.array_max("db")).over(Window.partitionBy("signal_id")) - top_db)
    held = held.select("signal_id", "frame_idx", F.transform("db", lambda v: F.greatest(v, F.col("floor"))).alias("db"))
    return held.select("signal_id", "frame_idx", through_bank(F.col("db"), dct_bank(n_mfcc, n_mels)).alias("mfcc"))


def mfcc(signals: DataFrame, sample_rate: int, n_mfcc: int, n_fft: int, hop: int, n_mels: int, top_db: float = 80.0) -> DataFrame:
    """`mfcc_frames` as rows: signal_id, frame_idx, coeff, value."""
    return by_band(mfcc_frames(signals, sample_rate, n_mfcc, n_fft, hop, n_mels, top_db), "mfcc", "coeff")


def erb_cepstra(signals: DataFrame, sample_rate: int, n_coeffs: int, n_fft: int, hop: int, n_bands: int, f_min: float = 50.0, f_max: float | None = None) -> DataFrame:
    """Cepstra of log energies in gammatone bands (GTCC and GFCC): signal_id, frame_idx, coeff, value."""
    bands = through_bank(F.col("mag"), gammatone_bank(sample_rate, n_fft, n_bands, f_min, f_max), squared=True)
    logs = stft(signals, n_fft, hop).select("signal_id", "frame_idx", F.transform(bands, lambda v: F.log(v + 1e-10)).alias("logs"))
    cepstra = logs.select("signal_id", "frame_idx", through_bank(F.col("logs"), dct_bank(min(n_coeffs, n_bands), n_bands)).alias("c"))
    return by_band(cepstra, "c", "coeff")


def chroma_frames(signals: DataFrame, sample_rate: int, n_fft: int, hop: int) -> DataFrame:
    """Energy per pitch class, the largest of a frame being 1: signal_id, frame_idx, chroma (array)."""
    raw = stft(signals, n_fft, hop, "constant").select("signal_id", "frame_idx", through_bank(F.col("mag"), chroma_bank(sample_rate, n_fft), squared=True).alias("raw"))
    most = F.array_max(F.transform("raw", F.abs)) + 1e-12
    return raw.select("signal_id", "frame_idx", F.transform("raw", lambda v: v / most).alias("chroma"))


def chroma(signals: DataFrame, sample_rate: int, n_fft: int, hop: int) -> DataFrame:
    """`chroma_frames` as rows: signal_id, frame_idx, pitch_class, value."""
    return by_band(chroma_frames(signals, sample_rate, n_fft, hop), "chroma", "pitch_class")


def tonnetz(chroma_: DataFrame) -> DataFrame:
    """Tonal centroids of chroma frames of sum 1: signal_id, frame_idx, dim, value."""
    whole = F.greatest(total(F.transform("chroma", F.abs)), F.lit(1e-12))
    unit = chroma_.select("signal_id", "frame_idx", F.transform("chroma", lambda v: v / whole).alias("unit"))
    return by_band(unit.select("signal_id", "frame_idx", through_bank(F.col("unit"), tonnetz_bank()).alias("t")), "t", "dim")


def key_templates() -> list[tuple[str, int, int, float]]:
    """(name, rank, pitch class, standardised weight) of the 24 keys, in order C major, C minor, C# major..."""
    out = []
    for root in range(12):
        for t, (kind, profile) in enumerate((("major", MAJOR), ("minor", MINOR))):
            centre = sum(profile) / 12
            spread = math.sqrt(sum((p - centre) ** 2 for p in profile) / 12) + 1e-12
            out += [(f"{KEYS[root]} {kind}", 2 * root + t, (root + i) % 12, (p - centre) / spread) for i, p in enumerate(profile)]
    return out


def key_detect(chroma_: DataFrame) -> DataFrame:
    """The key whose profile fits the mean chroma best, the first on ties: signal_id, key."""
    averages = [F.avg(F.get("chroma", F.lit(p))).alias(f"c{p}") for p in range(12)]
    level = chroma_.groupBy("signal_id").agg(*averages).select("signal_id", F.array(*[f"c{p}" for p in range(12)]).alias("v"))
    away = F.transform("v", lambda x: x - mean("v"))
    spread = F.sqrt(mean(F.transform(away, lambda x: x * x))) + 1e-12
    rows = level.select("signal_id", away.alias("z"), spread.alias("spread"))
    weights: dict[tuple[str, int], list[float]] = {}
    for key, rank, pitch_class, w in key_templates():
        weights.setdefault((key, rank), [0.0] * 12)[pitch_class] = w
    fits = [F.struct(F.round(total(F.zip_with("z", F.array(*map(F.lit, w)), lambda x, y: x * y)) / F.col("spread") / 12, 9).alias("fit"), F.lit(-rank).alias("rank"), F.lit(key).alias("key")) for (key, rank), w in weights.items()]
    return rows.select("signal_id", F.array_max(F.array(*fits))["key"].alias("key"))


def chords(signals: DataFrame, sample_rate: int, n_fft: int, hop: int) -> DataFrame:
    """Chord template with the largest sum of magnitudes per frame, the first on ties: signal_id, frame_idx, time, chord."""
    n = n_fft // 2 + 1
    classes = [0] + [int(round(12 * math.log2(sample_rate / 2 * k / (n - 1) / 440.0) + 69)) % 12 for k in range(1, n)]
    bank = [[float(k > 0 and classes[k] == p) for k in range(n)] for p in range(12)]
    level = stft(signals, n_fft, hop).select("signal_id", "frame_idx", through_bank(F.transform("mag", lambda m: F.sqrt(m * m + 1e-9)), bank).alias("level"))
    fit = lambda ps: F.round(sum((F.get("level", F.lit(p)) for p in ps[1:]), F.get("level", F.lit(ps[0]))), 9)
    best = F.array_max(F.array(*[F.struct(fit(ps).alias("fit"), F.lit(-r).alias("rank"), F.lit(name).alias("chord")) for r, (name, ps) in enumerate(CHORDS.items())]))["chord"]
    return level.select("signal_id", "frame_idx", (F.col("frame_idx") * hop / F.lit(float(sample_rate))).alias("time"), best.alias("chord"))


def contrast_bands(sample_rate: int, n_fft: int, n_bands: int, f_min: float, quantile: float) -> list[tuple[int, int, int, int]]:
    """(band, first bin, last bin, values averaged) of octave bands that overlap by one bin below."""
    n = n_fft // 2 + 1
    freq = [k * sample_rate / n_fft for k in range(n)]
    edge = [0.0] + [f_min * 2.0**i for i in range(n_bands + 1)]
    out = []
    for b in range(n_bands + 1):
        inside = [k for k in range(n) if edge[b] <= freq[k] <= edge[b + 1]]
        if inside:
            first, last = inside[0] - (1 if b > 0 and inside[0] > 0 else 0), (n - 1 if b == n_bands else inside[-1])
            count = max(1, round(quantile * (last - first + 1)))
            out.append((b, first, last - (1 if b < n_bands and last > first else 0), count))
    return out


def spectral_contrast(signals: DataFrame, sample_rate: int, n_fft: int, hop: int, n_bands: int = 6, f_min: float = 200.0, quantile: float = 0.02) -> DataFrame:
    """Peak less valley in dB per octave band, each held within 80 dB of the signal's largest: signal_id, frame_idx, band, value."""
    bands = contrast_bands(sample_rate, n_fft, n_bands, f_min, quantile)
    db = lambda x: 10 * F.log10(F.greatest(x, F.lit(1e-10)))
    ends = []
    for band, first, last, q in bands:
        size = last - first + 1
        ordered = F.array_sort(F.slice("mag", first + 1, size))
        low, high = mean(F.slice(ordered, 1, min(q, size))), mean(F.slice(ordered, max(size - q + 1, 1), q))
        ends.append(F.struct(F.lit(band).cast("long").alias("band"), db(low).alias("low"), db(high).alias("high")))
    picked = stft(signals, n_fft, hop, "constant").select("signal_id", "frame_idx", F.array(*ends).alias("ends"))
    whole, missing = Window.partitionBy("signal_id"), 10 * math.log10(1e-10)
    full = len(bands) == n_bands + 1
    most = lambda x: F.max(F.array_max(F.transform("ends", lambda e: e[x]))).over(whole)
    top = lambda x: most(x) if full else F.greatest(most(x), F.lit(missing))
    rows = picked.withColumns({"top_low": top("low") - 80, "top_high": top("high") - 80}).select("signal_id", "frame_idx", "top_low", "top_high", F.explode("ends").alias("e"))
    return rows.select("signal_id", "frame_idx", "e.band", (F.greatest("e.high", "top_high") - F.greatest("e.low", "top_low")).alias("value"))


def thumbnail(chroma_: DataFrame, length: int, exclude_diagonal: bool = False, block: int = 512, cells: int = 8) -> DataFrame:
    """Start frame of the stretch of `length` frames most similar to some stretch: signal_id, start_frame.

    The frames of a signal are cut into blocks that reach `length` - 1 frames into the next one. A task has a pair of blocks,
    the similarities of their frames as a matrix, and sums them along diagonals; one row per pair of blocks goes on. The main
    diagonal counts unless it is excluded; the first place wins ties.
    """
    at = F.floor(F.col("frame_idx") / block)
    first = F.floor(F.greatest(F.col("frame_idx") - length + 1, F.lit(0)) / block)
    rows = chroma_.select("signal_id", "frame_idx", "chroma", F.explode(F.sequence(first, at)).alias("b"))
    frames_ = F.array_sort(F.collect_list(F.struct("frame_idx", "chroma")))
    blocks = rows.groupBy("signal_id", "b").agg(F.transform(frames_, lambda r: r["chroma"]).alias("v"))
    # Pairs meet in the cells of a triangle over runs of blocks, so that one long signal is spread over all tasks.
    cell = F.floor(F.col("b") / cells)
    sized = blocks.join(blocks.groupBy("signal_id").agg(F.floor(F.max("b") / cells).alias("last")), "signal_id")
    left = sized.select("signal_id", F.col("b").alias("bi"), F.col("v").alias("vi"), cell.alias("ci"), F.explode(F.sequence(cell, "last")).alias("cj"))
    right = sized.select("signal_id", F.col("b").alias("bj"), F.col("v").alias("vj"), cell.alias("cj"), F.explode(F.sequence(F.lit(0).cast("long"), cell)).alias("ci"))
    pairs = left.join(right, ["signal_id", "ci", "cj"]).where("bi <= bj").select("signal_id", "bi", "vi", "bj", "vj")  # (i, j) and (j, i) are alike, and the lesser i wins

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                out = []
                for signal, bi, vi, bj, vj in zip(*(batch.column(c).slice(at, 16).to_pylist() for c in ("signal_id", "bi", "vi", "bj", "vj")), strict=True):
                    a, b = np.array(vi), np.array(vj)
                    norm = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
                    s = np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm != 0)
                    n, m = len(a) - length + 1, len(b) - length + 1
                    if n < 1 or m < 1:
                        continue
                    summed = np.round(sum(s[k : k + n, k : k + m] for k in range(length)), 9)[:block, :block]
                    if exclude_diagonal and bi == bj:
                        np.fill_diagonal(summed, -np.inf)
                    i, j = np.unravel_index(int(np.argmax(summed)), summed.shape)  # the least i, then the least j
                    if np.isfinite(summed[i, j]):
                        out.append((signal, float(summed[i, j]), int(bi) * block + int(i), int(bj) * block + int(j)))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["signal_id", "sum", "i", "j"])

    found = pairs.mapInArrow(best, "signal_id long, sum double, i long, j long")
    return found.groupBy("signal_id").agg(F.max_by("i", F.struct("sum", -F.col("i"), -F.col("j"))).alias("start_frame"))


def onsets(signals: DataFrame, sample_rate: int, n_fft: int, hop: int, n_mels: int) -> DataFrame:
    """Onset times from the rise of log-mel magnitudes: peaks over median + 1.5 median deviations: signal_id, frame_idx, time."""
    mel = mel_frames(signals, sample_rate, n_fft, hop, n_mels, squared=False)
    level = mel.select("signal_id", "frame_idx", F.transform("mel", lambda m: F.log(m + 1e-8)).alias("v"))
    before = F.lag("v").over(Window.partitionBy("signal_id").orderBy("frame_idx"))
    up = F.zip_with("v", "before", lambda now, then: F.greatest(now - then, F.lit(0.0)))
    rise = level.withColumn("before", before).select("signal_id", "frame_idx", F.coalesce(total(up) / n_mels, F.lit(0.0)).alias("flux"))
    middle = rise.groupBy("signal_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY flux)").alias("med"))
    away = rise.join(middle, "signal_id")
    spread = away.groupBy("signal_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(flux - med))").alias("mad"))
    order = Window.partitionBy("signal_id").orderBy("frame_idx")
    marked = away.join(spread, "signal_id").withColumn("before", F.lag("flux").over(order)).withColumn("after", F.lead("flux").over(order))
    peak = (F.round(F.col("flux") - F.col("med") - 1.5 * F.col("mad"), 9) > 0) & (F.col("flux") >= F.col("before")) & (F.col("flux") > F.col("after"))
    return marked.where(peak).select("signal_id", "frame_idx", (F.col("frame_idx") * hop / F.lit(float(sample_rate))).alias("time"))
