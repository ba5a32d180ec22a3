"""Operators on analytic signals, files, streams and reports."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import linear, pitch, spectral, spectrograms, stats, temporal, voice
from tidewave.operators.filterbanks import chroma_bank, dct_bank, gammatone_bank, mel_bank
from tidewave.plans import catalog, extract, report
from tidewave.sources import files
from tidewave.sources.signals import centered, frames, to_mono


def signal(spark, x, fs=16000):
    return spark.createDataFrame([(1, fs, [float(v) for v in x])], "signal_id long, sample_rate int, samples array<double>")


def tone(f, fs=16000, seconds=0.25, a=0.8):
    return a * np.sin(2 * math.pi * f * np.arange(int(fs * seconds)) / fs)


def one(df):
    return df.collect()[0]


def test_constant_has_unit_rms(spark):
    rows = frames(signal(spark, np.ones(4000)), 256, 128).select(temporal.rms("frame", 256).alias("v")).collect()
    assert all(abs(r.v - 1) < 0.01 for r in rows)


def test_tone_features(spark):
    f, fs = 1000, 16000
    s = signal(spark, tone(f), fs)
    spectra = spectral.frame_spectrum(s, 1024, 256)
    assert all(abs(r.v - f) < 60 for r in spectra.select(spectral.centroid("mag", fs / 1024).alias("v")).collect())
    assert all(abs(r.rolloff - f) < 90 for r in spectral.rolloff(spectra, fs / 1024).collect())
    ac = pitch.frame_autocorrelation(s, 1024, 256)
    assert all(abs(r.v / f - 1) < 0.05 for r in ac.select(pitch.autocorrelation_pitch("ac", 1024, fs, 600, 1500).alias("v")).collect())
    low = pitch.frame_autocorrelation(signal(spark, tone(220), fs), 1024, 256)
    assert all(abs(r.f0 / 220 - 1) < 0.12 for r in pitch.yin(low, 1024, fs, 50, 600).collect())
    zcr = frames(s, 1024, 256).select(temporal.zero_crossing_rate("frame").alias("v")).collect()
    assert all(abs(r.v - 2 * f / fs) < 0.005 for r in zcr)


def test_attack_and_silence(spark):
    fs = 2000
    ramp = np.concatenate([np.linspace(0, 1, fs // 10), np.ones(fs // 4)])
    attack = lambda x: one(signal(spark, x, fs).withColumn("e", temporal.smoothed_envelope("samples", fs)).select(temporal.log_attack_time("e", fs).alias("v"))).v
    assert abs(attack(ramp) - math.log10(0.08)) < 0.15 and attack(np.zeros(500)) == -8.0
    quiet = signal(spark, np.zeros(200), fs)
    assert one(quiet.select(temporal.temporal_centroid("samples").alias("v"))).v == 0.0
    assert temporal.silence_removal(quiet, fs, 16, 8, 0.1).collect()[0].samples == []


def test_short_signal_is_padded(spark):
    rows = frames(signal(spark, range(100)), 256, 128).collect()
    assert len(rows) == 1 and len(rows[0].frame) == 256 and rows[0].frame[100:] == [0.0] * 156
    with pytest.raises(ValueError):
        frames(signal(spark, [1.0]), 0, 1)


def test_cycles(spark):
    df = spark.createDataFrame([([0.010, 0.011, 0.0105, 0.0098, 0.0102, 0.0101], [1.0]), ([1.0] * 3, [])], "p array<double>, q array<double>")
    r = df.select(voice.local_perturbation("p").alias("a"), voice.local_perturbation("q").alias("b"), voice.smoothed_perturbation("p", 5).alias("c")).collect()
    p = np.array([0.010, 0.011, 0.0105, 0.0098, 0.0102, 0.0101])
    assert math.isclose(r[0].a, np.abs(np.diff(p)).mean() / p.mean() * 100) and r[0].b == 0 and r[1].a == 0 and r[1].b == 0
    want = np.mean([abs(p[i] - p[i - 2 : i + 3].mean()) for i in (2, 3)]) / p.mean() * 100
    assert math.isclose(r[0].c, want)


def test_scalar_expressions(spark):
    r = one(spark.range(1).select(
        voice.harmonic_to_noise_ratio(F.lit(10.0), F.lit(1.0)).alias("hnr"), voice.vocal_tract_length(F.lit(500.0), F.lit(1500.0)).alias("vtl"), voice.closed_quotient(F.lit(1.0), F.lit(3.0), F.lit(4.0)).alias("cq"),
        voice.normalized_amplitude_quotient(F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("naq"), spectral.phase_coherence(F.array(F.lit(0.3), F.lit(0.3))).alias("pc"), voice.delta_series(F.array(F.lit(1.0), F.lit(4.0))).alias("d"),
    ))
    assert abs(r.hnr - 10) < 1e-6 and math.isclose(r.vtl, 8600 * (1 / 500 + 1 / 1000)) and r.cq == 0.5 and r.naq == 1.0 and math.isclose(r.pc, 1.0) and r.d == [0.0, 3.0]


def test_banks():
    assert np.allclose(np.array(dct_bank(8, 8)) @ np.array(dct_bank(8, 8)).T, np.eye(8))
    assert np.allclose(np.array(gammatone_bank(16000, 256, 10)).sum(axis=1), 1)
    mel = np.array(mel_bank(16000, 512, 20))
    assert mel.shape == (20, 257) and mel.min() >= 0 and (mel.max(axis=1) > 0).all()
    a440 = round(440 * 4096 / 22050)
    assert np.argmax(np.array(chroma_bank(22050, 4096))[:, a440]) == 9


def test_triad_key(spark):
    fs = 4000
    x = sum(tone(f, fs, 1.0, a) for f, a in ((261.63, 0.8), (329.63, 0.5), (392.0, 0.7)))
    key = one(spectrograms.key_detect(spectrograms.chroma_frames(signal(spark, x, fs), fs, 1024, 512))).key
    assert key == "C major"


def test_functionals(spark):
    rows = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 3.0, 10.0)] + [(2, 1.0)] * 3, "k long, x double")
    got = {r.k: r for r in stats.functionals(rows, ["k"], ["x"]).collect()}
    x = np.array([1.0, 2, 3, 10])
    sd = x.std()
    assert math.isclose(got[1].x_std, sd) and math.isclose(got[1].x_skewness, ((x - 4) ** 3).mean() / (sd**3 + 1e-8), rel_tol=1e-9)
    assert math.isclose(got[1].x_kurtosis, ((x - 4) ** 4).mean() / (sd**4 + 1e-8) - 3, rel_tol=1e-9)
    assert got[2].x_std == 0 and got[2].x_min == got[2].x_max == 1 and got[2].x_skewness == 0


def test_lpc_predicts(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(400)
    for i in range(2, 400):
        x[i] = 1.3 * x[i - 1] - 0.6 * x[i - 2] + rng.normal()
    a = one(signal(spark, x).select(linear.lpc(F.col("samples"), 400, 2).alias("a"))).a
    assert abs(a[0] + 1.3) < 0.1 and abs(a[1] - 0.6) < 0.1
    with pytest.raises(ValueError):
        linear.lpcc(F.lit(None), 6, 4)


def test_extract_core(spark):
    s = centered(signal(spark, tone(220, 8000, 0.2), 8000))
    row = one(extract.extract_core(s, 8000, 512, 256, 50.0, 600.0, 16, 8))
    assert row.num_samples == 1600 and abs(row.f0_mean_hz / 220 - 1) < 0.05 and row.f0_voiced_ratio == 1.0
    short = one(extract.extract_core(signal(spark, tone(220, 8000, 0.03), 8000), 8000, 512, 256, 50.0, 600.0, 16, 8))
    assert short.spectral_flatness_mean is None and short.rms_mean is not None


def wav_bytes(x, fs, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(fs)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.WAV").write_bytes(wav_bytes(tone(440, 8000), 8000))
    (tmp_path / "deep" / "b.wav").write_bytes(wav_bytes(np.repeat(tone(440, 8000), 2), 8000, 2))
    (tmp_path / "bad.wav").write_text("404: Not Found")
    (tmp_path / "note.txt").write_text("no audio")
    got = {r.path.rpartition("/")[2]: r for r in files.load_audio(files.audio_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.WAV", "b.wav", "bad.wav"}
    assert got["a.WAV"].sample_rate == 8000 and len(got["b.wav"].channels) == 2 and "placeholder" in got["bad.wav"].error
    good = files.load_audio(files.audio_files(spark, str(tmp_path))).where("error is null")
    mono = to_mono(good.withColumn("signal_id", F.monotonically_increasing_id()).select("signal_id", "sample_rate", "channels"))
    assert all(np.allclose(r.samples, tone(440, 8000), atol=1e-3) for r in mono.collect())
    down = one(mono.limit(1).select(files.resample(F.col("samples"), 8000, 4000).alias("x"))).x
    assert len(down) == 1000 and np.allclose(down[50:-50], tone(440, 4000)[50:-50], atol=0.01)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2.0)], "b int, a double, c double")
    files.write_csv(df, str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).columns == ["a", "b", "c"]
    files.write_json(df, str(tmp_path / "y"))
    assert '"a":null' in "".join(p.read_text() for p in (tmp_path / "y").glob("part*"))
    with pytest.raises(ValueError):
        files.write_csv(df.where("false"), str(tmp_path / "z"))


def test_report(spark):
    a = spark.createDataFrame([(1, "pitch_mean", 110.0), (1, "formant_f1", None), (1, "pitch_median", 100.0)], "id long, metric string, value double")
    b = spark.createDataFrame([(1, "pitch_mean", 100.0), (1, "formant_f1", None), (1, "formant_f2", 5.0)], "id long, metric string, value double")
    checks = report.evaluate(report.compare(a, b, ["id"]), report.tolerances(spark), ["id"])
    got = {r.metric: (r.skipped, r.passed) for r in checks.collect()}
    assert got == {"pitch_mean": (False, True), "formant_f1": (True, True), "pitch_median": (False, False), "formant_f2": (False, False)}
    v = one(report.verdict(checks, ["id"]))
    assert not v.passed and v.score == round(100 / 3, 4)
    with pytest.raises(ValueError):
        report.tolerances(spark, "robot")


def test_catalog(spark):
    c = catalog.build_catalog(spark, ("operators.temporal", "operators.absent"))
    assert c.where("name = 'rms'").count() == 1 and c.where("error is not null").count() == 1
    assert {r.component: r.errors for r in catalog.summarize(c).collect()}[None] == 1
    assert "| operators.temporal | rms |" in catalog.to_markdown(c)


def test_formants(spark):
    from tidewave.operators import formants

    fs, f0 = 10000, 120
    x = sum(np.sin(2 * math.pi * k * f0 * np.arange(4000) / fs) / k for k in range(1, 15))
    for f, bw in ((500, 80), (1500, 100)):
        r, w = math.exp(-math.pi * bw / fs), 2 * math.pi * f / fs
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = x[i] + (2 * r * math.cos(w) * y[i - 1] if i else 0) - (r * r * y[i - 2] if i > 1 else 0)
        x = y
    tracks = formants.contours(formants.candidates(signal(spark, x, fs), fs, 11, 500, 125, 4500.0), 5, 4500.0)
    got = {r.formant: r.freq for r in formants.frequencies(tracks).collect()}
    assert 150 <= got[1] <= 1200 and 500 <= got[2] <= 3200 and got[1] < got[2]


def test_burg_matches_signal():
    from tidewave.operators.formants import burg

    rng = np.random.default_rng(1)
    x = np.zeros(3000)
    for i in range(2, 3000):
        x[i] = 1.3 * x[i - 1] - 0.6 * x[i - 2] + rng.normal()
    assert np.allclose(burg(x[None, :], 2)[0], [1, -1.3, 0.6], atol=0.05)


def test_uncut_spectra(spark):
    """Noise in the second half of long signals only, which a transform of the first 64 samples does not see."""
    rng = np.random.default_rng(5)
    signals = {n: np.concatenate([np.zeros(n // 2), rng.normal(size=n - n // 2)]) for n in (1, 40, 64, 99, 300, 1000)}
    df = spark.createDataFrame([(n, 1000, [float(v) for v in x]) for n, x in signals.items()], "signal_id long, sample_rate int, samples array<double>")
    rows = spectral.uncut_spectrum(df).select("*", spectral.entropy("mag").alias("entropy"), spectral.spread("mag", F.col("bin_hz")).alias("spread")).collect()
    assert len(rows) == len(signals)
    for r in rows:
        n = r.signal_id
        size = max(2, 2 ** math.ceil(math.log2(n)))
        j, k = np.arange(n), np.arange(size // 2 + 1)
        x = signals[n] * 0.5 * (1 - np.cos(2 * np.pi * j / max(n - 1, 1)))
        mag = np.abs((x * np.exp(-2j * np.pi * np.outer(k, j) / size)).sum(axis=1))
        assert np.allclose(r.mag, mag, atol=1e-9) and math.isclose(r.bin_hz, 1000 / size)
        p = mag**2
        if p.sum() > 0:
            q = p / p.sum()
            assert math.isclose(r.entropy, -(q * np.log2(q + 1e-12)).sum(), abs_tol=1e-7)
            assert math.isclose(r.spread, math.sqrt((q * (k - (q * k).sum()) ** 2).sum()) * 1000 / size, abs_tol=1e-5)


def test_constant_q(spark):
    from tidewave.operators.constant_q import constant_q_banks, cqt

    fs, f_min, n_bins, per_octave = 4000, 110.0, 24, 12
    for k in (3, 12, 20):
        f = f_min * 2 ** (k / per_octave)
        rows = cqt(signal(spark, tone(f, fs, 0.5), fs), fs, 256, f_min, n_bins, per_octave).where("frame_idx = 4").orderBy("bin").collect()
        assert len(rows) == n_bins and max(range(n_bins), key=lambda i: rows[i].value) == k
    cos, sin = constant_q_banks(fs, f_min, n_bins, per_octave)
    assert len(cos) == len(sin) == n_bins and all(len(r) == len(cos[0]) for r in cos)
    with pytest.raises(ValueError):
        constant_q_banks(fs, 1500.0, 24, 12)


def test_pyin(spark):
    from tidewave.operators.probabilistic_pitch import pyin

    fs = 4000
    x = np.concatenate([tone(200, fs, 0.5), tone(251, fs, 0.5), np.zeros(2000)])
    rows = pyin(signal(spark, x, fs), fs, 256, 64, 80.0, 500.0).orderBy("frame_idx").collect()
    f0 = np.array([r.f0 for r in rows])
    assert np.allclose(f0[5:25], 200, rtol=0.01) and np.allclose(f0[38:58], 251, rtol=0.01) and (f0[-25:] == 0).all()
    assert pyin(signal(spark, x, fs).where("false"), fs, 256, 64, 80.0, 500.0).count() == 0
    with pytest.raises(ValueError):
        pyin(signal(spark, x, fs), fs, 256, 64, 500.0, 80.0)


def test_kmeans(spark):
    from tidewave.operators.clusters import kmeans

    rng = np.random.default_rng(3)
    points = {s: np.round(np.concatenate([rng.normal(m, 0.3, (25, 2)) for m in ((0, 0), (4, 0), (0, 5))])[rng.permutation(75)], 6) for s in (1, 2)} | {3: np.ones((2, 2)), 4: np.round(rng.normal(size=(9, 2)), 6)}
    df = spark.createDataFrame([(s, i, v.tolist()) for s, x in points.items() for i, v in enumerate(x)] + [(5, 0, None)], "signal_id long, frame_idx long, v array<double>").repartition(3)
    got = {(r.signal_id, r.frame_idx): r.label for r in kmeans(df, 3).collect()}
    want = {}
    for s, x in points.items():
        seeds = x[[i * len(x) // 3 for i in range(3)]]
        centroids = seeds
        for _ in range(100):
            label = np.round(((x[:, None] - centroids[None]) ** 2).sum(axis=2), 9).argmin(axis=1)
            new = np.array([x[label == c].mean(axis=0) if (label == c).any() else seeds[c] for c in range(3)])
            if np.allclose(new, centroids, atol=1e-8, rtol=0):
                break
            centroids = new
        want |= {(s, i): int(v) for i, v in enumerate(label)}
    assert got == want
    assert len({got[1, i] for i in range(75)}) == 3 and kmeans(df.where("false"), 3).count() == 0


def test_scorecard(spark):
    from tidewave.plans import scorecard

    found = scorecard.checks(spark)
    assert {r.name for r in found.where("not passed").collect()} == set()
    total = scorecard.summary(found).first()
    assert total.score == 100 and total.available_points == 65 and total.total_checks == 7 and total.passed and total.failed_checks == []
    for bad in ({"sample_rate": 0}, {"n": 0}, {"hop": -1}):
        with pytest.raises(ValueError):
            scorecard.checks(spark, **bad)


def test_reference_comparison(spark, tmp_path):
    from tidewave.plans import report, scorecard

    signals, freq = scorecard.known_signals(spark, 22050, 1024)
    (tmp_path / "r.json").write_text('{"pitch": {"mean_hz": 120.0, "median_hz": 120.5, "note": "x"}, "formants": {"f1": 600, "f2": 1500}}')
    known = report.load_reference(spark, str(tmp_path / "r.json"))
    assert {(r.metric, r.value) for r in known.collect()} == {("pitch_mean", 120.0), ("pitch_median", 120.5), ("formant_f1", 600.0), ("formant_f2", 1500.0)}
    checks = {r.metric: r for r in report.compare_with_reference(signals.where("signal_id = 2"), known, 22050, 1024, 256).collect()}
    assert set(checks) == set(report.METRICS) and checks["pitch_mean"].passed and checks["pitch_median"].passed
    assert report.profile("male")["max_formant"] == 5000.0


def test_roughness_by_pairs(spark):
    rng = np.random.default_rng(9)
    mags = [np.abs(rng.normal(size=700)), np.zeros(5), np.array([1.0])]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(mags)], "signal_id long, mag array<double>")
    got = {r.signal_id: r.roughness for r in spectral.roughness(df, 5.0).collect()}
    a = mags[0] / mags[0].max()
    loud = [k for k in range(700) if 20 * math.log10(a[k]) >= -60]
    want = 0.0
    for n, i in enumerate(loud):
        for j in loud[n + 1 :]:
            z = 0.24 / (0.021 * i * 5.0 + 19.0) * (j - i) * 5.0
            want += (a[i] * a[j]) ** 0.1 * (2 * min(a[i], a[j]) / (a[i] + a[j])) ** 3.11 * (math.exp(-3.5 * z) - math.exp(-5.75 * z))
    assert math.isclose(got[0], want, rel_tol=1e-9) and got[1] == got[2] == 0


def test_command_line(spark, tmp_path, capsys):
    import wave

    from tidewave import cli

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((20000 * tone(200, 8000, 1.0)).astype("<i2").tobytes())
    rate = ["--sample-rate", "8000", "--frame-length", "512", "--hop-length", "256"]
    assert cli.main(["extract", str(tmp_path / "a.wav"), *rate]) == 0
    assert '"num_samples":8000' in capsys.readouterr().out
    assert cli.main(["gold-scorecard", "--min-score", "95"]) == 0
    (tmp_path / "r.json").write_text('{"pitch": {"mean": 200.0, "median": 200.0}}')
    assert cli.main(["validate", str(tmp_path / "a.wav"), str(tmp_path / "r.json"), *rate]) in (0, 1)
    assert "pitch_mean: passed" in capsys.readouterr().out
    (tmp_path / "b.flac").write_bytes(b"fLaC....")
    assert cli.main(["extract", str(tmp_path / "b.flac"), *rate]) == 1


def test_frames_of_rows(spark):
    from tidewave.sources.signals import frames_of_rows

    rng = np.random.default_rng(2)
    sizes = {1: 3000, 2: 5, 3: 32, 4: 33, 5: 48}  # one key holds nearly all rows
    rows = [(k, int(t), float(rng.normal())) for k, n in sizes.items() for t in rng.permutation(n)]
    df = spark.createDataFrame(rows, "k long, t int, x double").repartition(4)
    got = {(r.signal_id, r.frame_idx): r.frame for r in frames_of_rows(df, "k", "x", ["t"], F.floor(F.col("t") / 100), 32, 16).collect()}
    want = {}
    for k, n in sizes.items():
        x = [v for _, _, v in sorted(r for r in rows if r[0] == k)]
        x += [0.0] * (32 - n)
        want |= {(k, i): x[16 * i : 16 * i + 32] for i in range((len(x) - 32) // 16 + 1)}
    assert got == want and frames_of_rows(df.where("false"), "k", "x", ["t"], F.lit(0), 32, 16).count() == 0
