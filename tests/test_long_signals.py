"""Signals in blocks: equal to one run from end to end, for any cut; own pitch and pulse measures on analytic signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def points(spark, x, signal=1):
    return spark.createDataFrame([(signal, len(x), i, float(v)) for i, v in enumerate(x)], "signal_id long, size long, i long, x double").repartition(3)


def signals(spark, *arrays, rate=1000):
    return spark.createDataFrame([(k, rate, [float(v) for v in x]) for k, x in enumerate(arrays)], "signal_id long, sample_rate int, samples array<double>")


def test_whole_array_measures_are_linear(spark):
    from tidewave.operators import temporal
    from tidewave.sources.signals import centered

    n = 400_000
    x = np.concatenate([np.linspace(0, 1, n // 2), np.linspace(1, 0.01, n // 2)])
    df = signals(spark, x)
    r = df.select(temporal.log_attack_time("samples", 1000).alias("a"), temporal.decay_time("samples", 1000).alias("d"), temporal.entropy_of_energy("samples", n).alias("e")).first()
    assert math.isclose(r.a, math.log10(0.8 * n / 2 / 1000), rel_tol=1e-3) and math.isclose(r.d, 0.909 * n / 2 / 1000, rel_tol=1e-2) and 0 < r.e < math.log2(11)
    smooth = centered(df).select(F.size(temporal.smoothed_envelope("samples", 1000)).alias("n"), temporal.teager_energy("samples").alias("t")).first()
    assert smooth.n == n and abs(smooth.t) < 1e-3
    odd = signals(spark, [], [0.0], [0.0, 0.0], [1.0], [2.0, 1.0, 0.1])
    got = {r.signal_id: (r.a, r.d) for r in odd.select("signal_id", temporal.log_attack_time("samples", 1000).alias("a"), temporal.decay_time("samples", 1000).alias("d")).collect()}
    assert got == {0: (-8.0, 0.0), 1: (-8.0, 0.0), 2: (-8.0, 0.0), 3: (-8.0, 0.0), 4: (-8.0, 0.002)}


def direct_filter(x, sections):
    for b, a in sections:
        y, z1, z2 = [], 0.0, 0.0
        for v in x:
            o = (b[0] * v + z1) / a[0] if not y else b[0] / a[0] * v + z1
            z1, z2 = b[1] / a[0] * v - a[1] / a[0] * o + z2, b[2] / a[0] * v - a[2] / a[0] * o
            y.append(o)
        x = y
    return np.array(x)


@pytest.mark.parametrize("length", [1, 7, 64, 5000])
def test_filter_in_blocks(spark, length):
    from tidewave.operators import blocks, kernels
    from tidewave.sources.signals import blocks_of_points

    x = np.random.default_rng(1).normal(size=700)
    sections = kernels._shelf_and_highpass(8000)
    df = points(spark, x).union(points(spark, x[:13], 2))
    got = {(r.signal_id, r.block): r.samples for r in blocks.filtered(blocks_of_points(df, length), sections, length).collect()}
    for signal, part in ((1, x), (2, x[:13])):
        y = np.concatenate([got[k] for k in sorted(got) if k[0] == signal])
        assert np.allclose(y, direct_filter(part, sections), atol=1e-9)


def test_loudness_of_a_tone(spark):
    from tidewave.operators import kernels

    rate = 8000
    x = 0.1 * np.sin(2 * np.pi * 1000 * np.arange(2 * rate) / rate)
    rows = {r.signal_id: r.lufs for r in kernels.loudness(points(spark, x).union(points(spark, x[:100], 2)), rate).collect()}
    assert rows[2] is None and rows == pytest.approx({r.signal_id: r.lufs for r in kernels.loudness(points(spark, x).union(points(spark, x[:100], 2)), rate, 333).collect()}, abs=1e-9)
    filtered = direct_filter(x, kernels._shelf_and_highpass(rate))
    powers = [np.mean(filtered[i : i + 3200] ** 2) for i in range(0, len(x) - 3199, 800)]
    assert math.isclose(rows[1], -0.691 + 10 * math.log10(np.mean(powers)), abs_tol=1e-9)


def whole_resynthesis(x, n, hop, change):
    """The same on the whole signal at once."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, n // 2, mode="reflect"), n)[::hop]
    out = []
    for z in change(np.fft.rfft(frames * w, axis=1)):
        y, norm = np.zeros(len(x) + n), np.zeros(len(x) + n)
        for i, f in enumerate(np.fft.irfft(z, n, axis=1) * w):
            y[i * hop : i * hop + n] += f
            norm[i * hop : i * hop + n] += w * w
        out.append((y / np.where(norm > 1e-11, norm, 1.0))[n // 2 : n // 2 + len(x)])
    return out


@pytest.mark.parametrize("size", [1, 3, 40, 900])
def test_resynthesis_in_blocks(spark, size, monkeypatch):
    from tidewave.operators import blocks, kernels

    n, hop = 32, 8
    x = np.random.default_rng(size).normal(size=size)

    def masks(z):
        median = lambda m, axis: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, [(3, 3) if a == axis else (0, 0) for a in (0, 1)], mode="reflect"), 7, axis=axis), axis=-1)
        h, p = median(np.abs(z), 1), median(np.abs(z), 0)
        return [z * (part / (h + p + 1e-8)) ** 2 for part in (h, p)]

    whole = whole_resynthesis(x, n, hop, masks)
    for per in (5, 64):
        monkeypatch.setattr(blocks.resynthesised, "__defaults__", (0, per))
        rows = sorted(kernels.harmonic_percussive(points(spark, x), n, hop).collect(), key=lambda r: r.i)
        assert [r.i for r in rows] == list(range(size))
        assert np.allclose([r.harmonic for r in rows], whole[0]) and np.allclose([r.percussive for r in rows], whole[1])
    clean = sorted(kernels.noise_reduction(points(spark, x), 0.5, n, hop).collect(), key=lambda r: r.i)
    assert np.allclose([r.x for r in clean], whole_resynthesis(x, n, hop, lambda z: [np.maximum(np.abs(z) ** 2 - 0.5, 0).astype(complex)])[0])


def test_paths_in_blocks(spark):
    """Pitch by pYIN and formant tracks do not depend on where frames are cut into blocks."""
    from tidewave.operators import formants, probabilistic_pitch

    fs = 4000
    rng = np.random.default_rng(3)
    t = np.arange(fs) / fs
    x = np.concatenate([np.sin(2 * np.pi * 180 * t[:1500]), 0.3 * rng.normal(size=900), np.sin(2 * np.pi * (200 + 40 * t) * t)])
    found = {per: {r.frame_idx: r.f0 for r in probabilistic_pitch.pyin(points(spark, x), fs, 256, 64, 80.0, 500.0, per=per).collect()} for per in (1000, 3, 11)}
    assert found[3] == pytest.approx(found[1000]) and found[11] == pytest.approx(found[1000]) and len(found[3]) == len(x) // 64 + 1
    assert any(v == 0 for v in found[3].values()) and any(v > 0 for v in found[3].values())
    seen = [(s, i, sorted(rng.uniform(150, 3000, int(rng.integers(0, 6))).tolist())) for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame([(s, i, f, [50.0] * len(f)) for s, i, f in seen], "signal_id long, frame_idx long, freqs array<double>, widths array<double>")
    tracks = {per: sorted(map(tuple, formants.contours(df, 3, 3000.0, per).collect())) for per in (1000, 1, 7)}
    assert tracks[1] == tracks[1000] == tracks[7] and len(tracks[1]) > 60


def pulse_train(periods, amplitudes, rate):
    """Decaying pulses at the given periods (seconds)."""
    at = np.cumsum(periods)
    t = np.arange(int((at[-1] + 0.02) * rate)) / rate
    x = np.zeros(len(t))
    for p, a in zip(at, amplitudes, strict=True):
        x += a * np.exp(-(((t - p) * 2500) ** 2))
    return x


@pytest.mark.parametrize("method", ["ac", "cc"])
def test_pitch_of_tones(spark, method):
    from tidewave.operators import periodicity

    rate = 8000
    t = np.arange(rate // 2) / rate
    voice = lambda f: sum(np.sin(2 * np.pi * k * f * t) / k for k in (1, 2, 3))
    x = np.concatenate([voice(120.0), np.zeros(rate // 4), voice(211.3)])
    rows = sorted(periodicity.pitch(points(spark, x), rate, method=method).collect(), key=lambda r: r.frame_idx)
    first, last = [r for r in rows if 0.1 < r.time < 0.4], [r for r in rows if 0.9 < r.time < 1.15]
    assert first and last and all(abs(r.f0 - 120.0) < 0.1 and r.strength > 0.99 for r in first) and all(abs(r.f0 - 211.3) < 0.2 for r in last)
    assert all(r.f0 == 0 and r.strength == 0 for r in rows if 0.56 < r.time < 0.69)
    cut = periodicity.pitch(points(spark, x), rate, method=method, per=4).collect()
    assert {r.frame_idx: r.f0 for r in cut} == pytest.approx({r.frame_idx: r.f0 for r in rows})
    assert periodicity.pitch(points(spark, x[:50]), rate, method=method).count() == 0
    with pytest.raises(ValueError):
        periodicity.pitch(points(spark, x), rate, 600.0, 75.0)


def test_harmonicity_of_noise(spark):
    from tidewave.operators import periodicity

    rate = 8000
    rng = np.random.default_rng(0)
    t = np.arange(rate) / rate
    tone = np.sin(2 * np.pi * 150 * t)
    levels = []
    for share in (0.03, 0.1, 0.3):
        (r,) = periodicity.harmonicity(points(spark, tone + share * rng.normal(size=rate)), rate).collect()
        levels.append(r.hnr)
        assert abs(r.hnr - 10 * math.log10(0.5 / share**2)) < 2.0
    assert levels == sorted(levels, reverse=True)
    assert periodicity.harmonicity(points(spark, np.zeros(2000)), rate).first().hnr is None


def test_pulses_of_a_train(spark):
    """Alternating periods and amplitudes come back as the jitter and shimmer they were made with."""
    from tidewave.operators import periodicity

    rate, n = 16000, 90
    periods = np.where(np.arange(n) % 2 == 0, 0.0080, 0.0082)
    amplitudes = np.where(np.arange(n) % 2 == 0, 1.0, 0.9)
    (r,) = periodicity.jitter_shimmer(points(spark, pulse_train(periods, amplitudes, rate)), rate).collect()
    assert abs(r.jitter_local_percent - 100 * 0.0002 / 0.0081) < 0.25 and abs(r.shimmer_local_percent - 100 * 0.1 / 0.95) < 1.5
    assert abs(r.jitter_ddp_percent - 3 * r.jitter_rap_percent) < 1e-9 and n - 12 <= r.num_periods <= n and abs(r.shimmer_local_db - 20 * math.log10(1 / 0.9)) < 0.2
    (steady,) = periodicity.jitter_shimmer(points(spark, pulse_train(np.full(n, 0.008), np.ones(n), rate)), rate).collect()
    assert steady.jitter_local_percent < 0.05 and steady.shimmer_local_percent < 0.5
    (silent,) = periodicity.jitter_shimmer(points(spark, np.zeros(4000)), rate).collect()
    assert silent.num_periods == 0 and silent.jitter_local_percent is None


def test_resampling_by_rows(spark):
    """Equal to resampling whole arrays, whatever the cut."""
    from tidewave.sources import files

    x = np.random.default_rng(2).normal(size=501)
    for source, target in ((8000, 3000), (3000, 8000), (44100, 16000)):
        (whole,) = signals(spark, x).select(files.resample(F.col("samples"), source, target).alias("x")).collect()
        for per in (1, 100, 4096):
            rows = sorted(files.resample_points(points(spark, x), source, target, per=per).collect(), key=lambda r: r.i)
            assert [r.i for r in rows] == list(range(len(whole.x))) and np.allclose([r.x for r in rows], whole.x)
    assert files.resample_points(points(spark, x[:1]), 8000, 4000).count() == 1


def clicks(rate, seconds, bpm, start=0.5):
    x = np.zeros(int(rate * seconds))
    rng = np.random.default_rng(0)
    at = np.arange(start, seconds - 0.1, 60.0 / bpm)
    for t in at:
        k = int(t * rate)
        x[k : k + 200] += np.exp(-np.arange(200) / 40) * np.sin(2 * np.pi * 1000 * np.arange(200) / rate)
    return x + 1e-4 * rng.normal(size=len(x)), at


@pytest.mark.parametrize("bpm", [120.0, 150.0])
def test_beats_and_onsets_of_clicks(spark, bpm):
    from tidewave.operators import rhythm

    rate, hop = 8000, 128
    x, at = clicks(rate, 10.0, bpm)
    strength = rhythm.onset_strength(points(spark, x), rate, 512, hop, 40).cache()
    rows = sorted(rhythm.beats(strength, rate, hop).collect(), key=lambda r: r.beat_idx)
    assert abs(rows[0].bpm - bpm) < 6 and len(rows) == len(at)
    assert np.abs(np.array([r.time for r in rows]) - at).max() < 0.06 and abs(60 / np.mean(np.diff([r.time for r in rows])) - bpm) < 1
    cut = sorted(rhythm.beats(strength, rate, hop, per=70).collect(), key=lambda r: r.beat_idx)
    assert [r.frame_idx for r in cut] == [r.frame_idx for r in rows]
    peaks = sorted(r.time for r in rhythm.pick_onsets(strength, rate, hop, backtrack=False).collect())
    assert len(peaks) == len(at) and np.abs(np.array(peaks) - at).max() < 0.05
    back = sorted(r.time for r in rhythm.pick_onsets(strength, rate, hop).collect())
    assert len(back) == len(at) and all(0 <= p - b < 0.2 for p, b in zip(peaks, back, strict=True)) and sum(b < p for p, b in zip(peaks, back, strict=True)) > len(at) / 2
    silent = rhythm.onset_strength(points(spark, np.zeros(4000)), rate, 512, hop, 40)
    assert silent.count() == 32 and rhythm.beats(silent, rate, hop).count() == 0 and rhythm.pick_onsets(silent, rate, hop).count() == 0


def test_thumbnail_spreads_one_signal(spark):
    """Pairs of blocks of one signal are dealt out by cells, and the result does not depend on blocks or cells."""
    from tidewave.operators import spectrograms

    rng = np.random.default_rng(4)
    chroma = rng.random((160, 12))
    chroma[100:108] = chroma[20:28]
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(chroma)], "signal_id long, frame_idx long, chroma array<double>")
    for block, cells in ((512, 8), (16, 1), (16, 3), (7, 2)):
        assert [r.start_frame for r in spectrograms.thumbnail(df, 8, True, block, cells).collect()] == [20]
    plan = spectrograms.thumbnail(df, 8, True, 16, 2)._jdf.queryExecution().toString()
    assert "hashpartitioning(signal_id#" not in plan or "ci#" in plan


def test_optional_checks(spark):
    from tidewave.plans import scorecard

    total = scorecard.summary(scorecard.checks(spark, optional=True)).first()
    assert total.score == 100 and total.available_points == 100 and total.total_checks == 10


def test_reference_files_and_outputs(spark, tmp_path):
    """A reference may stand within a block of its own; the catalogue and the checks can be written to files."""
    import json

    from tidewave import cli
    from tidewave.plans import report

    inner = {"pitch": {"mean_hz": 120.5, "note": "x"}, "formants": {"f1": 663.5}}
    for name, data in (("flat", inner), ("nested", {"praat": inner, "other": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        assert {r.metric: r.value for r in report.load_reference(spark, str(tmp_path / f"{name}.json")).collect()} == {"pitch_mean": 120.5, "formant_f1": 663.5}
    assert cli.main(["list-features", "--format", "json", "--output", str(tmp_path / "out" / "c.json")]) == 0
    rows = json.loads((tmp_path / "out" / "c.json").read_text())
    assert {"beat_track", "jitter_shimmer", "harmonicity", "resample_points"} <= {r["name"] for r in rows} and not any(r["error"] for r in rows)


def test_peaks_of_many_frames_at_once(spark):
    """A matrix of correlations gives for each row what it gives by itself; signals of one block are searched once, without rounds."""
    from tidewave.operators import chains, periodicity

    rng = np.random.default_rng(5)
    r = periodicity.forward_correlation(rng.normal(size=(400, 60)), 30)
    row, lag, height = periodicity.lag_peaks(r, 3.0, 25.0, 4, held=64)
    for k in range(len(r)):
        _, own, top = periodicity.lag_peaks(r[k : k + 1], 3.0, 25.0, 4)
        assert own.tolist() == lag[row == k].tolist() and top.tolist() == height[row == k].tolist() and len(own) <= 4
    assert len(row) > 800 and (np.diff(row) >= 0).all()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chains, "settle", None)
        short = periodicity.pitch(points(spark, np.sin(np.arange(900) * 2 * np.pi / 40)), 4000).collect()
    assert short and all(abs(v.f0 - 100) < 1 for v in short)
