"""Queries of framewise, whole-signal and cycle-series operators, each a Column function over one array, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.arrays import rounded
from tidewave.functions.fourier import magnitude
from tidewave.operators import spectral, temporal, voice
from tidewave.plans.twins import FRAMES, FS, HOP, N, USER, mp, over_frames, over_magnitudes, over_signals, over_whole, query, rnd, sm
from tidewave.sources.signals import centered, centered_rows, frames, frames_of_points, points_of_rows, user_signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BIN = FS / N


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centered(user_signals(spark, sf_dir, FS))


def event_points(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user less their mean, as samples with places, straight from rows: no task holds a user's events."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "value")
    rows = centered_rows(rows, "user_id", "value", ["ts", "event_id"])
    return points_of_rows(rows, "user_id", "value", ["ts", "event_id"], F.date_trunc("day", "ts"))


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames_of_points(event_points(spark, d), N, HOP, FS)


#: Framewise queries of signals that are arrays; each has a twin by name that takes its frames from rows, as all others do.
OF_ARRAYS = ("rms", "zero_crossing_rate", "spectral_centroid")


def frame_query(name: str, f: Callable[[str], Column], sql: str) -> None:
    of = (lambda spark, d: frames(signals(spark, d), N, HOP)) if name in OF_ARRAYS else event_frames
    QUERIES[name] = lambda spark, d: of(spark, d).select("signal_id", "frame_idx", rounded(f("frame")).alias("value"))
    SQL[name] = over_frames(sql)


def signal_query(name: str, f: Callable[[str], Column], sql: str, raw: bool = False) -> None:
    QUERIES[name] = lambda spark, d: (user_signals(spark, d, FS) if raw else signals(spark, d)).select("signal_id", rounded(f("samples")).alias("value"))
    SQL[name] = over_signals(sql, "raw" if raw else "sig")


def event_spectra(spark: SparkSession, d: str) -> DataFrame:
    return event_frames(spark, d).select("signal_id", "sample_rate", "frame_idx", magnitude(F.col("frame"), N).alias("mag"))


def magnitude_query(name: str, f: Callable[[str], Column], sql: str) -> None:
    of = (lambda spark, d: spectral.frame_spectrum(signals(spark, d), N, HOP)) if name in OF_ARRAYS else event_spectra
    QUERIES[name] = lambda spark, d: of(spark, d).select("signal_id", "frame_idx", rounded(f("mag")).alias("value"))
    SQL[name] = over_magnitudes(sql)


def whole_query(name: str, f: Callable[[str], Column], sql: str) -> None:
    """A feature of whole-signal spectra; `bin_hz` (in SQL: hz) is the width of a bin."""
    QUERIES[name] = lambda spark, d: spectral.uncut_spectrum(signals(spark, d)).select("signal_id", rounded(f("mag")).alias("value"))
    SQL[name] = over_whole(sql)


HS = f"(0.5*(1-cos(2*pi()*(i-1)/{N - 1})))"
HP = f"(0.5*(1-cos(2*pi()*(i-1)/{N})))"

# temporal, per frame
frame_query("rms", lambda x: temporal.rms(x, N), f"sqrt({sm(mp('f', f'pow(v*{HS},2)'))}/{sm(mp(f'range(0,{N})', f'pow({HS},2)'))})")
frame_query("short_time_energy", temporal.short_time_energy, sm(mp("f", "v*v")))
frame_query("zero_crossing_count", temporal.zero_crossing_count, f"{sm(mp(f'f[2:{N}]', 'abs(sign(v)-sign(f[i]))'))}/2")
frame_query("zero_crossing_rate", temporal.zero_crossing_rate, f"{sm(mp(f'f[2:{N}]', 'abs(sign(v)-sign(f[i]))'))}/2/{N}")
frame_query("windowed_energy", lambda x: temporal.windowed_energy(x, N), sm(mp("f", f"pow(v*{HP},2)")))
_SUB = f"list_transform(range(0, ({N} - {N // 10}) // {N // 10} + 1), lambda q: list_sum(list_transform(f[q*{N // 10}+1 : q*{N // 10}+{N // 10}], lambda w: w*w)))"
frame_query("entropy_of_energy", lambda x: temporal.entropy_of_energy(x, N), f"CASE WHEN {sm(_SUB)} > 0 THEN -{sm(f'list_transform({_SUB}, lambda e: e/{sm(_SUB)}*log2(e/{sm(_SUB)}+1e-8))')} ELSE 0 END")
frame_query("frame_temporal_centroid", temporal.frame_temporal_centroid, f"CASE WHEN {sm(mp('f', 'v*v'))} = 0 THEN 0 ELSE {sm(mp('f', '(i-1)*v*v'))}/{sm(mp('f', 'v*v'))} END")

# temporal, per signal
signal_query("temporal_centroid", temporal.temporal_centroid, f"CASE WHEN {sm(mp('x', 'abs(v)'))} = 0 THEN 0 ELSE {sm(mp('x', '(i-1)*abs(v)'))}/{sm(mp('x', 'abs(v)'))} END")
signal_query("teager_energy", temporal.teager_energy, "CASE WHEN len(x) < 3 THEN 0 ELSE list_sum(list_transform(range(2, len(x)), lambda j: x[j]*x[j]-x[j-1]*x[j+1]))/(len(x)-2) END")
_AM = "list_transform(range(0, len(x)//16), lambda q: (list_max(x[q*16+1:q*16+16])-list_min(x[q*16+1:q*16+16]))/(list_max(x[q*16+1:q*16+16])+list_min(x[q*16+1:q*16+16])+1e-8))"
signal_query("amplitude_modulation_depth", lambda x: temporal.amplitude_modulation_depth(x, 16), f"CASE WHEN len(x) < 16 THEN 0 ELSE list_avg({_AM}) END", raw=True)
QUERIES["log_attack_time"] = lambda spark, d: signals(spark, d).withColumn("e", temporal.smoothed_envelope("samples", FS)).select("signal_id", rounded(temporal.log_attack_time("e", FS)).alias("value"))
SQL["log_attack_time"] = query([USER, """a AS (SELECT signal_id, list_transform(x, lambda v: abs(v)) AS a FROM sig),
p AS (SELECT signal_id, len(a) AS n, list_concat([a[3], a[2]], a, [a[len(a)-1], a[len(a)-2]]) AS p FROM a),
e AS (SELECT signal_id, list_transform(range(1, n+1), lambda j: list_sum(p[j:j+4])/5) AS e FROM p),
r AS (SELECT signal_id, unnest(e) AS v, unnest(range(0, len(e))) AS j, list_max(e) AS peak FROM e),
lo AS (SELECT signal_id, peak, min(j) FILTER (v >= 0.1*peak) AS s FROM r GROUP BY ALL),
hi AS (SELECT lo.signal_id, lo.peak, lo.s, min(j) FILTER (v >= 0.9*lo.peak AND j >= lo.s) AS t FROM r JOIN lo USING (signal_id) GROUP BY ALL)"""],
    f"SELECT signal_id, CASE WHEN peak >= 1e-12 AND t > s THEN {rnd(f'log10(greatest((t-s)/{FS}.0, 1e-8))')} ELSE -8.0 END AS value FROM hi")
signal_query("decay_time", lambda x: temporal.decay_time(x, FS), f"coalesce((SELECT min(j) - min(p) FROM (SELECT unnest(range(0, len(x))) AS j, unnest(list_transform(x, lambda v: abs(v))) AS a, list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))) - 1 AS p, list_max(list_transform(x, lambda v: abs(v))) AS top) WHERE j >= p AND a < top*0.1)/{FS}.0, 0.0)")

# spectra of frames
magnitude_query("spectral_centroid", lambda m: spectral.centroid(m, BIN), f"CASE WHEN {sm('m')} = 0 THEN 0 ELSE {sm(mp('m', f'(i-1)*{BIN}*v'))}/{sm('m')} END")
magnitude_query("spectral_flatness", spectral.flatness, f"exp(list_avg({mp('m', 'ln(v+1e-8)')}))/list_avg(m)")
magnitude_query("harmonic_richness", spectral.harmonic_richness, f"10*log10({sm(mp('m[2:]', 'v*v'))}/(m[1]*m[1]+1e-8))")
QUERIES["spectral_rolloff"] = lambda spark, d: spectral.rolloff(event_spectra(spark, d), BIN).select("signal_id", "frame_idx", rounded("rolloff").alias("value"))
QUERIES["spectral_flux"] = lambda spark, d: spectral.flux(event_spectra(spark, d)).select("signal_id", "frame_idx", rounded("flux").alias("value"))
from tidewave.plans.twins import BINS  # noqa: E402

SQL["spectral_rolloff"] = query([USER, FRAMES, BINS, "r AS (SELECT signal_id, frame_idx, k, sum(m*m) OVER (PARTITION BY signal_id, frame_idx ORDER BY k) AS run, sum(m*m) OVER (PARTITION BY signal_id, frame_idx) AS t FROM bins)"],
    f"SELECT signal_id, frame_idx, {rnd(f'coalesce(min(k) FILTER (round(run + 1e-8 - 0.85*t, 9) >= 0), max(k))*{BIN}')} AS value FROM r GROUP BY signal_id, frame_idx")
SQL["spectral_flux"] = query([USER, FRAMES, BINS, "r AS (SELECT signal_id, frame_idx, m - lag(m) OVER (PARTITION BY signal_id, k ORDER BY frame_idx) AS d FROM bins)"],
    f"SELECT signal_id, frame_idx, {rnd('sqrt(sum(d*d))')} AS value FROM r WHERE d IS NOT NULL GROUP BY signal_id, frame_idx")

# spectra of whole signals
P, SP = mp("m", "v*v"), sm(mp("m", "v*v"))
CEN = f"({sm(mp('m', '(i-1)*v*v'))}/{SP})"
MOM = lambda k: f"({sm(mp('m', f'pow(i-1-{CEN}, {k})*v*v'))}/{SP})"
whole_query("spectral_entropy", spectral.entropy, f"-{sm(mp('m', f'v*v/{SP}*log2(v*v/{SP}+1e-12)'))}")
whole_query("spectral_skewness", spectral.skewness, f"{MOM(3)}/pow({MOM(2)}, 1.5)")
whole_query("spectral_kurtosis", spectral.kurtosis, f"{MOM(4)}/pow({MOM(2)}, 2)-3")
whole_query("spectral_spread", lambda m: spectral.spread(m, F.col("bin_hz")), f"sqrt({MOM(2)})*hz")
whole_query("spectral_slope", spectral.slope, f"{sm(mp('m', '(i-1-(len(m)-1)/2.0)*ln(v+1e-8)'))}/(len(m)*(len(m)*len(m)-1)/12.0)")
whole_query("spectral_crest", spectral.crest_factor, f"list_max({P})/{SP}")
whole_query("spectral_deviation", spectral.deviation, f"{sm(mp('m[2:]', 'abs(v*v-m[i]*m[i])'))}/{SP}")
whole_query("spectral_irregularity", spectral.irregularity, f"least(1, {sm(mp('m[2:]', 'abs(v-m[i])'))}/{sm(mp('m[2:]', 'v+m[i]+1e-12'))})")
_BAND = lambda lo, hi, op=">=": sm(mp("m", f"CASE WHEN {'true' if lo is None else f'(i-1)*hz {op} {lo}'} AND {'true' if hi is None else f'(i-1)*hz < {hi}'} THEN v*v ELSE 0 END"))
_TOP = lambda lo, hi, op="<": f"list_max({mp('m', f'CASE WHEN (i-1)*hz >= {lo} AND (i-1)*hz {op} {hi} THEN v*v END')})"
whole_query("low_high_energy_ratio", lambda m: spectral.low_high_energy_ratio(m, F.col("bin_hz"), 100.0, 300.0), f"10*log10({_BAND(None, 100)}/({_BAND(300, None, '>')}+1e-8))")
whole_query("alpha_ratio", lambda m: spectral.alpha_ratio(m, F.col("bin_hz"), (50.0, 150.0, 400.0)), f"10*log10({_BAND(50, 150)}/({_BAND(150, 400)}+1e-8))")
whole_query("hammarberg_index", lambda m: spectral.hammarberg_index(m, F.col("bin_hz"), 200.0, 450.0), f"10*log10({_TOP(0, 200)}/({_TOP(200, 450)}+1e-8))")
whole_query("sibilant_peak_frequency", lambda m: spectral.band_peak_frequency(m, F.col("bin_hz"), 100.0, 450.0), f"(list_position({mp('m', f'CASE WHEN (i-1)*hz >= 100 AND (i-1)*hz <= 450 THEN v*v END')}, {_TOP(100, 450, '<=')})-1)*hz")
_LOUD = "list_filter(m, lambda q: 20*log10(greatest(q, 1e-300)/list_max(m)) >= -60)"
whole_query("spectral_tonality", spectral.tonality, f"CASE WHEN len({_LOUD}) > 1 THEN greatest(0, least(1, (list_max(m)/list_avg({_LOUD})-1)/(len({_LOUD})-1))) ELSE 1 END")
QUERIES["spectral_roughness"] = lambda spark, d: spectral.roughness(spectral.uncut_spectrum(signals(spark, d)), F.col("bin_hz")).select("signal_id", rounded("roughness").alias("value"))
from tidewave.plans.twins import WHOLE  # noqa: E402

SQL["spectral_roughness"] = query([USER, WHOLE, f"""l AS (SELECT signal_id, k, m/max(m) OVER (PARTITION BY signal_id) AS a, k*hz AS f FROM wbins),
q AS (SELECT * FROM l WHERE 20*log10(greatest(a, 1e-300)) >= -60),
pr AS (SELECT q.signal_id, pow(q.a*r.a, 0.1)*pow(2*least(q.a, r.a)/(q.a+r.a), 3.11) AS w, 0.24/(0.021*q.f+19.0)*(r.f-q.f) AS z FROM q JOIN q r ON q.signal_id = r.signal_id AND q.k < r.k),
t AS (SELECT signal_id, sum(w*(exp(-3.5*z)-exp(-5.75*z))) AS v FROM pr GROUP BY signal_id)"""], f"SELECT sig.signal_id, {rnd('coalesce(v, 0.0)')} AS value FROM sig LEFT JOIN t USING (signal_id)")  # fmt: skip

# cycle series: the raw user signals plus 1 serve as periods and amplitudes
plus = lambda x: F.transform(F.col(x), lambda v: v + 1.0)
Y = mp("x", "v+1.0")
DY = mp("x[2:]", "abs(v-x[i])")
signal_query("jitter", lambda x: voice.relative_perturbation(plus(x)), f"list_avg({DY})/list_avg({Y})", raw=True)
signal_query("jitter_local", lambda x: voice.local_perturbation(plus(x)), f"list_avg({DY})/list_avg({Y})*100", raw=True)
_PPQ = lambda w: f"list_avg(list_transform(range({w // 2 + 1}, len(x)-{w // 2}+1), lambda j: abs(x[j]-list_avg(x[j-{w // 2}:j+{w // 2}]))))/list_avg({Y})*100"
signal_query("jitter_ppq5", lambda x: voice.smoothed_perturbation(plus(x), 5), _PPQ(5), raw=True)
signal_query("shimmer_apq3", lambda x: voice.smoothed_perturbation(plus(x), 3), _PPQ(3), raw=True)
signal_query("jitter_ddp", lambda x: voice.second_difference_perturbation(plus(x)), f"list_avg(list_transform(range(3, len(x)+1), lambda j: abs(x[j]-2*x[j-1]+x[j-2])))/list_avg({Y})*100", raw=True)
signal_query("shimmer_local_db", lambda x: voice.shimmer_local_db(plus(x)), f"list_avg({mp('x[2:]', 'abs(20*log10((v+1.0+1e-9)/(x[i]+1.0+1e-9)))')})", raw=True)
signal_query("vocal_fry_index", voice.vocal_fry_index, "CASE WHEN len(list_filter(x, lambda v: v > 0)) < 2 THEN 0 ELSE list_sum(list_transform(range(1, len(list_filter(x, lambda v: v > 0))), lambda j: CASE WHEN list_filter(x, lambda v: v > 0)[j] < 70 AND abs(1/list_filter(x, lambda v: v > 0)[j+1]-1/list_filter(x, lambda v: v > 0)[j])*list_filter(x, lambda v: v > 0)[j] > 0.2 THEN 1.0 ELSE 0.0 END))/(len(list_filter(x, lambda v: v > 0))-1+1e-8) END", raw=True)
signal_query("maximum_flow_declination_rate", lambda x: voice.maximum_flow_declination_rate(x, FS), f"list_max({mp('x[2:]', f'(x[i]-v)*{FS}')})")
_TN = "list_transform(list_filter(x, lambda v: v > 0), lambda v: 12*log2(v/list_avg(list_filter(x, lambda u: u > 0))))"
signal_query("semitone_sd", voice.semitone_sd, f"list_stddev_samp({_TN})", raw=True)
SQL.pop("semitone_sd")
SQL["semitone_sd"] = query([USER, "v AS (SELECT signal_id, unnest(x) AS v FROM raw), w AS (SELECT signal_id, v, avg(v) OVER (PARTITION BY signal_id) AS mu FROM v WHERE v > 0)"], f"SELECT signal_id, {rnd('stddev_samp(12*log2(v/mu))')} AS value FROM w GROUP BY signal_id")

QUERIES["spectral_sharpness"] = lambda spark, d: spectral.sharpness(spectral.uncut_spectrum(signals(spark, d)), F.col("bin_hz")).select("signal_id", rounded("sharpness").alias("value"))
_EDGES = spectral.BARK_EDGES
SQL["spectral_sharpness"] = query([USER, WHOLE, f"ed AS (SELECT z, [{', '.join(map(str, _EDGES))}][z] AS lo, [{', '.join(map(str, _EDGES))}][z+1] AS hi, CASE WHEN z <= 16 THEN 1.0 ELSE 0.066*exp(0.171*(z-16)) END AS g FROM (SELECT unnest(range(1, 25)) AS z)), bp AS (SELECT signal_id, z, g, avg(m*m) AS p FROM wbins JOIN ed ON k*hz >= lo AND k*hz < hi GROUP BY ALL)"], f"SELECT signal_id, {rnd('sum(p*g*z)/sum(p)')} AS value FROM bp GROUP BY signal_id")
QUERIES["voice_onset_time"] = lambda spark, d: temporal.voice_onset_time(signals(spark, d), FS, N, HOP).select("signal_id", rounded("onset").alias("value"))
SQL["voice_onset_time"] = query([USER, FRAMES, "vr AS (SELECT signal_id, frame_idx, list_sum(list_transform(f, lambda v: v*v)) AS e, list_max(f[3:15])/f[1] AS r FROM fr), vt AS (SELECT *, max(e) OVER (PARTITION BY signal_id) AS t FROM vr), vb AS (SELECT *, min(frame_idx) FILTER (e > t*0.1) OVER (PARTITION BY signal_id) AS b FROM vt)"], f"SELECT signal_id, {rnd(f'coalesce(min(frame_idx - b) FILTER (frame_idx >= b AND r > 0.3)*{HOP}/{FS}.0, 0.0)')} AS value FROM vb GROUP BY signal_id")
QUERIES["nasality_index"] = lambda spark, d: spectral.nasality(spectral.uncut_spectrum(signals(spark, d)), spectral.uncut_spectrum(user_signals(spark, d, FS)), F.col("bin_hz"), 100.0, 300.0).select("signal_id", rounded("nasality").alias("value"))
_RAW = WHOLE.replace("FROM sig)", "FROM raw)").replace("wsz", "osz").replace("wsm", "osm").replace("wks", "oks").replace("wbins", "obins").replace("wm AS", "om AS")
SQL["nasality_index"] = query([USER, WHOLE, _RAW, f"nn AS (SELECT signal_id, sum(m*m) AS n FROM wbins WHERE k*hz >= 100 AND k*hz <= 300 GROUP BY ALL), oo AS (SELECT signal_id, sum(m*m) AS o FROM obins WHERE k*hz >= 100 AND k*hz <= 300 GROUP BY ALL)"], f"SELECT signal_id, {rnd('10*log10((n+1e-8)/(o+1e-8))')} AS value FROM nn JOIN oo USING (signal_id)")
_STEP = "CAST(floor(120.0/(1000.0/len(m))) AS INTEGER)"
whole_query("harmonic_differences", lambda m: F.get(voice.harmonic_differences(m, 120.0, FS, F.size(m)), F.lit(0)), f"20*log10(coalesce(m[{_STEP}+1], 1e-8)+1e-8)-20*log10(coalesce(m[2*{_STEP}+1], 1e-8)+1e-8)")
# The fundamental is at 62.5 Hz: a sixteenth of the transform size, in bins.
_AT = lambda shift: "+".join(f"pow(m[{k}*((len(m)-1)//8){shift}+1], 2)" for k in (1, 2, 3))
whole_query("subharmonic_to_harmonic_ratio", lambda m: voice.subharmonic_to_harmonic_ratio(m, F.floor((F.size(m) - 1) / 8).cast("int"), 3), f"10*log10(({_AT('+(len(m)-1)//8//2')})/({_AT('')}+1e-8))")
whole_query("inharmonicity", lambda m: spectral.inharmonicity(F.slice(F.col(m), 2, 5), F.lit(2.0)), "list_avg(list_transform(m[2:6], lambda v, i: abs(v/(i*2.0)-1)))")
