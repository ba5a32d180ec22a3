"""Queries of constant-Q spectra, probabilistic pitch, clusters of frames, formant bandwidths' dispersion and voice measures of cycles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.arrays import argmax, let, rounded
from tidewave.operators import clusters, constant_q, formants, probabilistic_pitch, spectral, temporal, voice
from tidewave.plans.basic_queries import event_frames, event_points, signals
from tidewave.plans.kernel_queries import formant_frequencies
from tidewave.plans.twins import FRAMES, FS, HOP, N, USER, WHOLE, query, rnd
from tidewave.sources.signals import frames_of_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _signals(name: str, f: Callable[[], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, d: signals(spark, d).select("signal_id", rounded(f()).alias("value"))
    SQL[name] = query([USER], f"SELECT signal_id, {rnd(sql)} AS value FROM sig")


def _frames(name: str, f: Callable[[], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, d: event_frames(spark, d).select("signal_id", "frame_idx", rounded(f()).alias("value"))
    SQL[name] = query([USER, FRAMES], f"SELECT signal_id, frame_idx, {rnd(sql)} AS value FROM fr")


def _whole(name: str, f: Callable[[], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, d: spectral.uncut_spectrum(signals(spark, d)).select("signal_id", rounded(f()).alias("value"))
    SQL[name] = query([USER, WHOLE], f"SELECT signal_id, {rnd(sql)} AS value FROM wm")


# constant-Q: 8 bins, 4 to the octave, from 62.5 Hz
CQT = (62.5, 8, 4)
QUERIES["cqt"] = lambda spark, d: constant_q.cqt(signals(spark, d), FS, HOP, *CQT).select("signal_id", "frame_idx", "bin", rounded("value").alias("value"))
_Q = 1 / (2 ** (1 / CQT[2]) - 1)
_SIZE = math.ceil(_Q * FS / CQT[0])
_HALF = (_SIZE + _SIZE % 2) // 2
SQL["cqt"] = query([USER, f"""cb AS (SELECT k, {CQT[0]}*pow(2, k/{CQT[2]}.0) AS f, CAST(ceil({_Q!r}::DOUBLE*{FS}/({CQT[0]}*pow(2, k/{CQT[2]}.0))) AS BIGINT) AS n FROM (SELECT unnest(range(0, {CQT[1]})) AS k)),
cw AS (SELECT k, f, n, i, 0.5*(1-cos(2*pi()*i/n)) AS w FROM (SELECT k, f, n, unnest(range(0, n)) AS i FROM cb)),
cs AS (SELECT *, sqrt(n)/sum(w) OVER (PARTITION BY k) AS s FROM cw),
cx AS (SELECT signal_id, unnest(x) AS v, unnest(range(0, len(x))) AS p FROM sig),
ct AS (SELECT signal_id, unnest(range(0, len(x)//{HOP}+1)) AS t FROM sig),
cg AS (SELECT ct.signal_id, t, k, f, i, s*w AS w, t*{HOP}-n//2+i AS p FROM ct CROSS JOIN cs),
cr AS (SELECT cg.signal_id, t, k, sum(coalesce(v, 0)*w*cos(2*pi()*f/{FS}*i)) AS re, sum(coalesce(v, 0)*w*sin(2*pi()*f/{FS}*i)) AS im FROM cg LEFT JOIN cx ON cx.signal_id = cg.signal_id AND cx.p = cg.p GROUP BY ALL)"""],
    f"SELECT signal_id, CAST(t AS BIGINT) AS frame_idx, CAST(k AS BIGINT) AS bin, {rnd('sqrt(re*re+im*im)')} AS value FROM cr")

QUERIES["f0_pyin"] = lambda spark, d: probabilistic_pitch.pyin(event_points(spark, d), FS, 64, HOP, 50.0, 333.0).select("signal_id", "frame_idx", rounded("f0", 3).alias("f0"))

# clusters of (root mean square, zero crossing rate in tens) of frames
K, ITERATIONS = 3, 4


def _points(spark: SparkSession, d: str) -> DataFrame:
    return event_frames(spark, d).select("signal_id", "frame_idx", F.array(F.round(temporal.short_time_energy("frame") / 10000, 6), F.round(10 * temporal.zero_crossing_rate("frame"), 6)).alias("v"))


QUERIES["kmeans"] = lambda spark, d: clusters.kmeans(_points(spark, d), K, ITERATIONS)
QUERIES["speaker_diarization"] = lambda spark, d: clusters.speaker_labels(signals(spark, d), FS, 2, N, HOP, 8, 5, 20)

# measures of cycles: what they take is derived from the samples of a user
X = "samples"
_seconds = lambda c: c / F.lit(float(FS))
_signals("normalized_amplitude_quotient", lambda: voice.normalized_amplitude_quotient(F.array_max(X), voice.maximum_flow_declination_rate(X, FS), _seconds(F.size(X))),
    f"list_max(x)/(list_max(list_transform(x[2:], lambda v, i: (x[i]-v)*{FS}))*(len(x)/{FS}.0))")
_signals("closed_quotient", lambda: voice.closed_quotient(_seconds(argmax(X)), _seconds(F.array_position(X, F.array_min(X)) - 1), _seconds(F.size(X))),
    f"((list_position(x, list_min(x))-1)/{FS}.0-(list_position(x, list_max(x))-1)/{FS}.0)/(len(x)/{FS}.0)")
_signals("glottal_closure_time", lambda: voice.glottal_closure_time(F.transform(X, lambda v: v * 0.25), X, F.transform(X, lambda v: F.abs(v) + 1.0)),
    "list_avg(list_transform(x, lambda v: (v-v*0.25)/(abs(v)+1.0)))")
_signals("speed_quotient", lambda: voice.speed_quotient(F.filter(X, lambda v: v > 0), F.transform(F.filter(X, lambda v: v <= 0), lambda v: -v)),
    "list_avg(list_filter(x, lambda v: v > 0))/(list_avg(list_transform(list_filter(x, lambda v: v <= 0), lambda v: -v))+1e-8)")
_frames("phase_coherence", lambda: spectral.phase_coherence("frame"),
    "sqrt(pow(list_avg(list_transform(f, lambda v: cos(v))), 2)+pow(list_avg(list_transform(f, lambda v: sin(v))), 2))")
# Six bands of six values of frames of 36 samples, scaled to energy 1.
GNE = 36
QUERIES["glottal_to_noise_excitation"] = lambda spark, d: frames_of_points(event_points(spark, d), GNE, HOP).select("signal_id", "frame_idx", rounded(voice.glottal_to_noise_excitation(let(F.aggregate("frame", F.lit(0.0), lambda s, u: s + u * u), lambda e: F.transform("frame", lambda v: v / F.sqrt(e + 1e-8))), GNE), 4).alias("value"))
SQL["glottal_to_noise_excitation"] = query([USER, FRAMES.replace(f"+{N}]", f"+{GNE}]").replace(f"- {N}", f"- {GNE}").replace(f"< {N}", f"< {GNE}"),
    "gu AS (SELECT signal_id, frame_idx, list_transform(f, lambda v: v/sqrt(list_sum(list_transform(f, lambda u: u*u))+1e-8)) AS u FROM fr)",
    f"gb AS (SELECT signal_id, frame_idx, b, u[b*{GNE // 6}+1 : (b+1)*{GNE // 6}] AS x FROM gu CROSS JOIN (SELECT unnest(range(0, 6)) AS b))",
    "gg AS (SELECT signal_id, frame_idx, max(list_dot_product(p.x, q.x)) AS g FROM gb p JOIN gb q USING (signal_id, frame_idx) GROUP BY ALL)"],
    f"SELECT signal_id, frame_idx, CASE WHEN g/(1-g+1e-8) > 0 THEN {rnd('10*log10(g/(1-g+1e-8))', 4)} END AS value FROM gg")
_hz = lambda: F.col("bin_hz")
_power = lambda low, high: f"list_sum(list_transform(m, lambda v, i: CASE WHEN (i-1)*hz >= {low} AND (i-1)*hz < {high} THEN v*v ELSE 0.0 END))"
_whole("harmonic_to_noise_ratio", lambda: voice.harmonic_to_noise_ratio(spectral.band_power("mag", _hz(), 50.0, 200.0), spectral.band_power("mag", _hz(), 200.0, 500.0)),
    f"10*log10({_power(50, 200)}/({_power(200, 500)}+1e-8))")
_whole("soft_phonation_index", lambda: voice.soft_phonation_index(spectral.band_power("mag", _hz(), 50.0, 200.0), spectral.band_power("mag", _hz(), 200.0, 500.0)),
    f"10*log10({_power(200, 500)}/({_power(50, 200)}+1e-8))")
_peak = lambda low, high: f"((list_position(list_transform(m, lambda v, i: CASE WHEN (i-1)*hz >= {low} AND (i-1)*hz <= {high} THEN v*v END), list_max(list_transform(m, lambda v, i: CASE WHEN (i-1)*hz >= {low} AND (i-1)*hz <= {high} THEN v*v END)))-1)*hz)"
_whole("vocal_tract_length", lambda: voice.vocal_tract_length(spectral.band_peak_frequency("mag", _hz(), 100.0, 200.0), spectral.band_peak_frequency("mag", _hz(), 300.0, 450.0)),
    f"34400.0/4*(1/{_peak(100, 200)}+1/({_peak(300, 450)}-{_peak(100, 200)}))")

QUERIES["formant_dispersion"] = lambda spark, d: formants.dispersion(formant_frequencies(spark, d)).select("signal_id", rounded("dispersion", 2).alias("dispersion"))

_KM = [USER, FRAMES, f"""pt AS (SELECT signal_id, frame_idx, e AS a, z AS b FROM (SELECT signal_id, frame_idx,
  round({{energy}}/10000, 6) AS e, round(10*{{crossings}}, 6) AS z FROM fr)),
rk AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM pt),
sd AS (SELECT signal_id, c, a, b FROM rk JOIN (SELECT unnest(range(0, {K})) AS c) ON i = c*n//{K})"""]


def _labels(m: str) -> str:
    return f"""SELECT signal_id, frame_idx, a, b, arg_min(c, struct_pack(d := round((a-ma)*(a-ma)+(b-mb)*(b-mb), 9), c := c)) AS c
  FROM (SELECT pt.*, m.c, m.a AS ma, m.b AS mb FROM pt JOIN {m} m USING (signal_id)) GROUP BY ALL"""


_ENERGY = "list_sum(list_transform(f, lambda v: v*v))"
_CROSSINGS = f"list_sum(list_transform(f[2:{N}], lambda v, i: abs(sign(v)-sign(f[i]))))/2/{N}"


def _kmeans_sql() -> str:
    ctes = [*_KM[:2], _KM[2].format(energy=_ENERGY, crossings=_CROSSINGS)]
    last = "sd"
    for i in range(ITERATIONS):
        ctes += [f"l{i} AS ({_labels(last)})", f"m{i} AS (SELECT sd.signal_id, sd.c, coalesce(g.a, sd.a) AS a, coalesce(g.b, sd.b) AS b FROM sd LEFT JOIN (SELECT signal_id, c, avg(a) AS a, avg(b) AS b FROM l{i} GROUP BY ALL) g USING (signal_id, c))"]
        last = f"m{i}"
    return query(ctes, f"SELECT signal_id, frame_idx, CAST(c AS INTEGER) AS label FROM ({_labels(last)})")


SQL["kmeans"] = _kmeans_sql()
