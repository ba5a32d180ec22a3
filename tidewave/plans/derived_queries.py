"""Queries of relational operators: short-time spectra, filterbanks, pitch, rhythm, segments, functionals and the feature row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.arrays import rounded
from tidewave.operators import pitch, spectral, spectrograms, stats, temporal, voice
from tidewave.plans.basic_queries import signals
from tidewave.plans.extract import extract_core
from tidewave.plans.twins import BINS, FRAMES, FS, HOP, N, USER, chroma_sql, dct_sql, gammatone_sql, mel_sql, query, rnd, tonnetz_sql
from tidewave.sources.signals import user_signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MELS, COEFFS, F_LOW, F_HIGH = 8, 5, 50.0, 333.0


def values_query(name: str, f: Callable[[DataFrame], DataFrame], column: str, sql: str | None, by: tuple[str, ...] = ("signal_id", "frame_idx"), raw: bool = False, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, d: f(user_signals(spark, d, FS) if raw else signals(spark, d)).select(*by, rounded(column, digits).alias("value"))
    if sql:
        SQL[name] = sql


def stft_ctes(mode: str | None, window: str = "periodic") -> list[str]:
    half = N // 2
    zeros = f"list_transform(range(0, {half}), lambda z: 0.0::DOUBLE)"
    x = {"reflect": f"list_concat(list_reverse(x[2:{half + 1}]), x, list_reverse(x[len(x)-{half}:len(x)-1]))", "constant": f"list_concat({zeros}, x, {zeros})", None: "x"}[mode]
    den = N if window == "periodic" else N - 1
    return [USER, f"""pad AS (SELECT signal_id, {x} AS xp FROM sig),
sf AS (SELECT signal_id, CAST(i AS BIGINT) AS frame_idx, xp[i*{HOP}+1 : i*{HOP}+{N}] AS f FROM (SELECT signal_id, xp, unnest(range(0, (len(xp)-{N})//{HOP}+1)) AS i FROM pad)),
ss AS (SELECT signal_id, frame_idx, unnest(f) AS v, unnest(range(0, {N})) AS j FROM sf),
sb AS (SELECT signal_id, frame_idx, k, sqrt(re*re+im*im) AS m FROM (
  SELECT signal_id, frame_idx, k, sum(v*0.5*(1-cos(2*pi()*j/{den}))*cos(2*pi()*k*j/{N})) AS re, sum(v*0.5*(1-cos(2*pi()*j/{den}))*sin(2*pi()*k*j/{N})) AS im
  FROM ss CROSS JOIN (SELECT unnest(range(0, {N // 2 + 1})) AS k) GROUP BY ALL))"""]  # fmt: skip


def banked(mode: str | None, bank: str, value: str = "m*m", out: str = "b") -> list[str]:
    return [*stft_ctes(mode), bank, f"{out} AS (SELECT signal_id, frame_idx, band, sum(w*{value}) AS v FROM sb JOIN fb USING (k) GROUP BY ALL)"]


# short-time spectra
values_query("linear_spectrogram", lambda s: spectral.bins(spectrograms.linear_spectrogram(s, N, HOP)), "m", query(stft_ctes("reflect", "symmetric"), f"SELECT signal_id, frame_idx, CAST(k AS BIGINT) AS k, {rnd('m')} AS value FROM sb"), ("signal_id", "frame_idx", "k"))
QUERIES["spectral_bandwidth"] = lambda spark, d: spectrograms.stft(signals(spark, d), N, HOP).select("signal_id", "frame_idx", rounded(spectrograms.bandwidth("mag", FS / N)).alias("value"))
SQL["spectral_bandwidth"] = query([*stft_ctes("reflect"), f"c AS (SELECT *, sum(k*{FS / N}*m) OVER w / (sum(m) OVER w + 1e-8) AS c FROM sb WINDOW w AS (PARTITION BY signal_id, frame_idx))"], f"SELECT signal_id, frame_idx, {rnd(f'sqrt(sum(pow(k*{FS / N}-c, 2)*m)/(sum(m)+1e-8))')} AS value FROM c GROUP BY signal_id, frame_idx")
BAND = ("signal_id", "frame_idx", "band")
MEL = mel_sql(MELS)
values_query("mel_spectrogram", lambda s: spectrograms.mel_spectrogram(s, FS, N, HOP, MELS), "value", query(banked("reflect", MEL), f"SELECT signal_id, frame_idx, band, {rnd('v', 2)} AS value FROM b"), BAND, digits=2)
values_query("log_mel_spectrogram", lambda s: spectrograms.log_mel_spectrogram(s, FS, N, HOP, MELS), "value", query(banked("reflect", MEL), f"SELECT signal_id, frame_idx, band, {rnd('ln(v+1e-6)')} AS value FROM b"), BAND)
_MFCC = [*banked(None, MEL), "d AS (SELECT signal_id, frame_idx, band, greatest(10*log10(greatest(v, 1e-10)), max(10*log10(greatest(v, 1e-10))) OVER (PARTITION BY signal_id) - 80) AS db FROM b)", dct_sql(COEFFS, MELS)]
values_query("mfcc", lambda s: spectrograms.mfcc(s, FS, COEFFS, N, HOP, MELS), "value", query(_MFCC, f"SELECT signal_id, frame_idx, coeff, {rnd('sum(w*db)')} AS value FROM d JOIN dc USING (band) GROUP BY ALL"), ("signal_id", "frame_idx", "coeff"))
for _name, _coeffs in (("gtcc", 4), ("gfcc", 8)):
    _ctes = [*banked("reflect", gammatone_sql(MELS, 50.0)), dct_sql(_coeffs, MELS)]
    values_query(_name, lambda s, c=_coeffs: spectrograms.erb_cepstra(s, FS, c, N, HOP, MELS, 50.0), "value", query(_ctes, f"SELECT signal_id, frame_idx, coeff, {rnd('sum(w*ln(v+1e-10))')} AS value FROM b JOIN dc USING (band) GROUP BY ALL"), ("signal_id", "frame_idx", "coeff"))

# tonal
_CH = [*banked("constant", chroma_sql()), "ch AS (SELECT signal_id, frame_idx, band AS pitch_class, v/(max(abs(v)) OVER (PARTITION BY signal_id, frame_idx) + 1e-12) AS v FROM b)"]
chroma = lambda s: spectrograms.chroma(s, FS, N, HOP)
chroma_frames = lambda s: spectrograms.chroma_frames(s, FS, N, HOP)
values_query("chroma", chroma, "value", query(_CH, f"SELECT signal_id, frame_idx, pitch_class, {rnd('v')} AS value FROM ch"), ("signal_id", "frame_idx", "pitch_class"))
values_query("tonnetz", lambda s: spectrograms.tonnetz(chroma_frames(s)), "value", query([*_CH, tonnetz_sql(), "u AS (SELECT signal_id, frame_idx, pitch_class, v/greatest(sum(abs(v)) OVER (PARTITION BY signal_id, frame_idx), 1e-12) AS v FROM ch)"], f"SELECT signal_id, frame_idx, dim, {rnd('sum(w*v)')} AS value FROM u JOIN tn USING (pitch_class) GROUP BY ALL"), ("signal_id", "frame_idx", "dim"))
QUERIES["key_detect"] = lambda spark, d: spectrograms.key_detect(chroma_frames(signals(spark, d)))
_KEYS = "kt(key, rank, pitch_class, w) AS (VALUES " + ", ".join(f"('{n}', {r}, {p}::BIGINT, {w!r}::DOUBLE)" for n, r, p, w in spectrograms.key_templates()) + ")"
SQL["key_detect"] = query([*_CH, _KEYS, """l AS (SELECT signal_id, pitch_class, avg(v) AS v FROM ch GROUP BY ALL),
z AS (SELECT signal_id, pitch_class, (v - avg(v) OVER w)/(stddev_pop(v) OVER w + 1e-12) AS z FROM l WINDOW w AS (PARTITION BY signal_id)),
t AS (SELECT signal_id, key, rank, round(sum(z*w)/12, 9) AS fit FROM z JOIN kt USING (pitch_class) GROUP BY ALL)"""], "SELECT signal_id, key FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY fit DESC, rank) AS r FROM t) WHERE r = 1")  # fmt: skip
QUERIES["chords"] = lambda spark, d: spectrograms.chords(signals(spark, d), FS, N, HOP).select("signal_id", "frame_idx", rounded("time").alias("time"), "chord")
SQL["chords"] = query([*stft_ctes("reflect"), f"""pc AS (SELECT signal_id, frame_idx, CAST(round(12*log2({FS / 2}*k/{N // 2}/440.0)+69) AS BIGINT) % 12 AS p, sqrt(m*m+1e-9) AS v FROM sb WHERE k > 0),
q AS (SELECT signal_id, frame_idx, round(sum(v) FILTER (p IN (0, 4, 7)), 9) AS c, round(sum(v) FILTER (p IN (3, 6, 10)), 9) AS g FROM pc GROUP BY ALL)"""], f"SELECT signal_id, frame_idx, {rnd(f'frame_idx*{HOP}/{FS}.0')} AS time, CASE WHEN g > coalesce(c, -1) THEN 'G' ELSE 'C' END AS chord FROM q")  # fmt: skip
_CB = spectrograms.contrast_bands(FS, N, 3, 60.0, 0.2)
_EDGE = "ed(band, k, q) AS (VALUES " + ", ".join(f"({b}::BIGINT, {k}, {q})" for b, lo, hi, q in _CB for k in range(lo, hi + 1)) + ")"
values_query("spectral_contrast", lambda s: spectrograms.spectral_contrast(s, FS, N, HOP, 3, 60.0, 0.2), "value", query([*stft_ctes("constant"), _EDGE, """g AS (SELECT signal_id, frame_idx, band, q, list(m ORDER BY m) AS m FROM sb JOIN ed USING (k) GROUP BY ALL),
h AS (SELECT signal_id, frame_idx, band, 10*log10(greatest(list_avg(m[1:q]), 1e-10)) AS lo, 10*log10(greatest(list_avg(m[greatest(len(m)-q+1, 1):]), 1e-10)) AS hi FROM g)"""],
    f"SELECT signal_id, frame_idx, band, {rnd('greatest(hi, max(hi) OVER (PARTITION BY signal_id) - 80) - greatest(lo, max(lo) OVER (PARTITION BY signal_id) - 80)')} AS value FROM h"), BAND)
QUERIES["music_thumbnailing"] = lambda spark, d: spectrograms.thumbnail(chroma_frames(signals(spark, d)), 2)
QUERIES["music_thumbnailing_off_diagonal"] = lambda spark, d: spectrograms.thumbnail(chroma_frames(signals(spark, d)), 2, exclude_diagonal=True)
for _name, _where in (("music_thumbnailing", ""), ("music_thumbnailing_off_diagonal", " AND i <> j")):
    SQL[_name] = query([*_CH, """nv AS (SELECT *, sqrt(sum(v*v) OVER (PARTITION BY signal_id, frame_idx)) AS n FROM ch),
si AS (SELECT a.signal_id, a.frame_idx AS i, b.frame_idx AS j, CASE WHEN max(a.n*b.n) = 0 THEN 0 ELSE sum(a.v*b.v)/max(a.n*b.n) END AS s FROM nv a JOIN nv b USING (signal_id, pitch_class) GROUP BY ALL),
su AS (SELECT a.signal_id, a.i, a.j, round(a.s + b.s, 9) AS t FROM si a JOIN si b ON a.signal_id = b.signal_id AND b.i = a.i + 1 AND b.j = a.j + 1)"""], f"SELECT signal_id, i AS start_frame FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY t DESC, i, j) AS r FROM su WHERE true{_where}) WHERE r = 1")  # fmt: skip
QUERIES["onset_detect"] = lambda spark, d: spectrograms.onsets(signals(spark, d), FS, N, HOP, MELS).select("signal_id", "frame_idx", rounded("time").alias("time"))
SQL["onset_detect"] = query([*banked("reflect", MEL, "m"), f"""r AS (SELECT signal_id, frame_idx, greatest(ln(v+1e-8) - lag(ln(v+1e-8)) OVER (PARTITION BY signal_id, band ORDER BY frame_idx), 0) AS r FROM b),
x AS (SELECT signal_id, frame_idx, coalesce(sum(r)/{MELS}, 0.0) AS flux FROM r GROUP BY ALL),
md AS (SELECT signal_id, quantile_disc(flux, 0.5) AS med FROM x GROUP BY ALL),
ma AS (SELECT x.signal_id, med, quantile_disc(abs(flux-med), 0.5) AS mad FROM x JOIN md USING (signal_id) GROUP BY ALL),
o AS (SELECT x.*, med, mad, lag(flux) OVER w AS p, lead(flux) OVER w AS n FROM x JOIN ma USING (signal_id) WINDOW w AS (PARTITION BY x.signal_id ORDER BY frame_idx))"""], f"SELECT signal_id, frame_idx, {rnd(f'frame_idx*{HOP}/{FS}.0')} AS time FROM o WHERE round(flux-med-1.5*mad, 9) > 0 AND flux >= p AND flux > n")  # fmt: skip

# pitch
AC = [USER, FRAMES, f"""hw AS (SELECT signal_id, frame_idx, unnest(f) AS v, unnest(range(0, {N})) AS j FROM fr),
hx AS (SELECT signal_id, frame_idx, j, v*0.5*(1-cos(2*pi()*j/{N - 1})) AS v FROM hw),
ac AS (SELECT a.signal_id, a.frame_idx, b.j - a.j AS lag, sum(a.v*b.v) AS r FROM hx a JOIN hx b ON a.signal_id = b.signal_id AND a.frame_idx = b.frame_idx AND b.j >= a.j GROUP BY ALL)"""]  # fmt: skip
LO, HI = pitch.lag_range(FS, F_LOW, F_HIGH)
ac_rows = lambda s: pitch.frame_autocorrelation(s, N, HOP)
values_query("f0_autocorr", lambda s: ac_rows(s).withColumn("f", pitch.autocorrelation_pitch("ac", N, FS, F_LOW, F_HIGH)), "f", query(AC, f"SELECT signal_id, frame_idx, {rnd(f'{FS}.0/arg_max(lag, struct_pack(a := round(r, 9), b := -lag))')} AS value FROM ac WHERE lag >= {LO} AND lag < {HI} GROUP BY ALL"))
values_query("pitch_strength", lambda s: ac_rows(s).withColumn("f", pitch.pitch_strength("ac", N, FS, F_LOW, F_HIGH)), "f", query(AC, f"SELECT signal_id, frame_idx, {rnd(f'CASE WHEN max(r) FILTER (lag = 0) = 0 THEN 0 ELSE max(r) FILTER (lag >= {LO} AND lag < {HI})/max(r) FILTER (lag = 0) END')} AS value FROM ac GROUP BY ALL"))
YIN = [*AC, f"""yd AS (SELECT signal_id, frame_idx, lag, 2*max(r) FILTER (lag = 0) OVER (PARTITION BY signal_id, frame_idx) - 2*r AS d FROM ac),
yc AS (SELECT signal_id, frame_idx, lag, round(d*lag/(sum(d) OVER (PARTITION BY signal_id, frame_idx ORDER BY lag) + 1e-8), 9) AS cm FROM yd WHERE lag > 0),
yf AS (SELECT signal_id, frame_idx, {FS}.0/greatest(coalesce(min(lag) FILTER (cm < 0.1), arg_min(lag, struct_pack(a := cm, b := lag))), 1) AS f0 FROM yc WHERE lag >= {LO} AND lag < {HI} GROUP BY ALL)"""]  # fmt: skip
yin_rows = lambda s: pitch.yin(ac_rows(s), N, FS, F_LOW, F_HIGH)
values_query("f0_yin", yin_rows, "f0", query(YIN, f"SELECT signal_id, frame_idx, {rnd('f0')} AS value FROM yf"))
CPP_FFT = 1 << (2 * N - 1).bit_length()
CPP_HALF, Q_LO, Q_HI = CPP_FFT // 2, max(int(FS / F_HIGH), 1), min(int(FS / 60.0), CPP_FFT // 2 - 1)
CPP = [USER, FRAMES, f"""hw AS (SELECT signal_id, frame_idx, unnest(f) AS v, unnest(range(0, {N})) AS j FROM fr),
hx AS (SELECT signal_id, frame_idx, j, v*0.5*(1-cos(2*pi()*j/{N - 1})) AS v FROM hw),
lm AS (SELECT signal_id, frame_idx, k, ln(sqrt(re*re+im*im)+1e-9) AS l FROM (SELECT signal_id, frame_idx, k, sum(v*cos(2*pi()*k*j/{CPP_FFT})) AS re, sum(v*sin(2*pi()*k*j/{CPP_FFT})) AS im FROM hx CROSS JOIN (SELECT unnest(range(0, {CPP_HALF + 1})) AS k) GROUP BY ALL)),
cp AS (SELECT signal_id, frame_idx, q, sum(CASE WHEN k = 0 OR k = {CPP_HALF} THEN 1 ELSE 2 END*l*cos(2*pi()*k*q/{CPP_FFT}))/{CPP_FFT} AS c FROM lm CROSS JOIN (SELECT unnest(range(0, {CPP_HALF})) AS q) GROUP BY ALL),
rg AS (SELECT signal_id, frame_idx, regr_slope(c, q) FILTER (q >= {int(FS * 0.001)} AND q < {CPP_HALF - 1}) AS b, regr_intercept(c, q) FILTER (q >= {int(FS * 0.001)} AND q < {CPP_HALF - 1}) AS a,
 max(c) FILTER (q >= {Q_LO} AND q < {Q_HI}) AS top, arg_max(q, struct_pack(a := round(c, 9), b := -q)) FILTER (q >= {Q_LO} AND q < {Q_HI}) AS pk FROM cp GROUP BY ALL)"""]  # fmt: skip
cpp_rows = lambda s: pitch.cepstral_peak_prominence(s, FS, N, HOP, 60.0, F_HIGH)
values_query("cepstral_peak_prominence", cpp_rows, "cpp", query(CPP, f"SELECT signal_id, frame_idx, {rnd('(top-(a+b*pk))*8.685889')} AS value FROM rg"))
QUERIES["delta_cpp"] = lambda spark, d: cpp_rows(signals(spark, d)).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "cpp"))), lambda s: s["cpp"]).alias("x")).select("signal_id", F.posexplode(voice.delta_series("x")).alias("frame_idx", "v")).select("signal_id", F.col("frame_idx").cast("long").alias("frame_idx"), rounded("v").alias("value"))
SQL["delta_cpp"] = query([*CPP, "cv AS (SELECT signal_id, frame_idx, (top-(a+b*pk))*8.685889 AS c FROM rg)"], f"SELECT signal_id, frame_idx, {rnd('coalesce(c - lag(c) OVER (PARTITION BY signal_id ORDER BY frame_idx), 0.0)')} AS value FROM cv")
QUERIES["delta"] = lambda spark, d: pitch.series_delta(_samples(user_signals(spark, d, FS)), ["signal_id"], "n", "x").select("signal_id", "n", rounded("delta").alias("value"))
QUERIES["delta_delta"] = lambda spark, d: pitch.series_delta(pitch.series_delta(_samples(user_signals(spark, d, FS)), ["signal_id"], "n", "x").select("signal_id", "n", F.col("delta").alias("x")), ["signal_id"], "n", "x").select("signal_id", "n", rounded("delta").alias("value"))


def _samples(s: DataFrame) -> DataFrame:
    from tidewave.sources.signals import samples_long

    return samples_long(s)


def _delta_sql(source: str, out: str) -> str:
    terms = " + ".join(f"{k}*(coalesce(lead(x, {k}) OVER w, last_value(x) OVER e) - coalesce(lag(x, {k}) OVER w, first_value(x) OVER e))" for k in range(1, 5))
    return f"{out} AS (SELECT signal_id, n, ({terms})/60.0 AS x FROM {source} WINDOW w AS (PARTITION BY signal_id ORDER BY n), e AS (PARTITION BY signal_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


_LONG = "lg AS (SELECT signal_id, unnest(x) AS x, CAST(unnest(range(0, len(x))) AS BIGINT) AS n FROM raw)"
SQL["delta"] = query([USER, _LONG, _delta_sql("lg", "d1")], f"SELECT signal_id, n, {rnd('x')} AS value FROM d1")
SQL["delta_delta"] = query([USER, _LONG, _delta_sql("lg", "d1"), _delta_sql("d1", "d2")], f"SELECT signal_id, n, {rnd('x')} AS value FROM d2")

# rhythm and segments
values_query("speech_rate", lambda s: temporal.speech_rate(s, FS), "rate", query([USER, f"""e0 AS (SELECT signal_id, len(x) AS size, list_concat(list_transform(range(0, 10), lambda z: 0.0::DOUBLE), list_transform(x, lambda v: abs(v)), list_transform(range(0, 10), lambda z: 0.0::DOUBLE)) AS p FROM sig),
e1 AS (SELECT signal_id, size, list_transform(range(1, size+2), lambda j: list_sum(p[j:j+19])/20) AS e FROM e0),
e2 AS (SELECT signal_id, size, list_avg(e) AS mu, unnest(e) AS e, unnest(range(0, len(e))) AS n FROM e1),
e3 AS (SELECT *, lag(e) OVER w AS b, lead(e) OVER w AS a FROM e2 WINDOW w AS (PARTITION BY signal_id ORDER BY n)),
e4 AS (SELECT signal_id, n, lag(n) OVER (PARTITION BY signal_id ORDER BY n) AS l FROM e3 WHERE e > b AND e > a AND e > mu*0.3),
e5 AS (SELECT signal_id, count(*) AS c FROM e4 WHERE l IS NULL OR n - l > {int(0.1 * FS)} GROUP BY ALL)"""], f"SELECT sig.signal_id, {rnd(f'coalesce(c, 0)/(len(x)/{FS}.0)')} AS value FROM sig LEFT JOIN e5 USING (signal_id)"), ("signal_id",))  # fmt: skip
BFS = 20  # rate at which gaps of a quarter second are several samples
values_query("breath_group_duration", lambda s: temporal.breath_groups(s, BFS), "duration", query([USER, f"""q AS (SELECT signal_id, unnest(x) AS v, unnest(range(0, len(x))) AS n, list_avg(x) AS mu FROM raw),
b AS (SELECT signal_id, n, lead(n) OVER (PARTITION BY signal_id ORDER BY n) AS a FROM q WHERE v < mu*0.25),
s2 AS (SELECT signal_id, n FROM b WHERE a - n > {int(0.25 * BFS)}),
t AS (SELECT signal_id, n, lead(n) OVER w AS a, row_number() OVER w - 1 AS group_idx FROM s2 WINDOW w AS (PARTITION BY signal_id ORDER BY n))"""], f"SELECT signal_id, group_idx, {rnd(f'(a-n)/{BFS}.0')} AS value FROM t WHERE a IS NOT NULL"), ("signal_id", "group_idx"), raw=True)  # fmt: skip
TEMPO_FS, TEMPO_HOP = 8, 2
_T_LO, _T_HI = max(1, round(60.0 / 240 * TEMPO_FS / TEMPO_HOP)), round(60.0 / 60 * TEMPO_FS / TEMPO_HOP)
BEAT = [USER, f"""bl AS (SELECT signal_id, unnest(x) AS v, unnest(range(0, len(x))) AS n FROM sig),
bd AS (SELECT signal_id, n, greatest(v - lag(v) OVER (PARTITION BY signal_id ORDER BY n), 0) AS r FROM bl),
bp AS (SELECT signal_id, (n-1)//{TEMPO_HOP} AS k, avg(r) AS r, count(*) AS c FROM bd WHERE n > 0 GROUP BY ALL HAVING count(*) = {TEMPO_HOP}),
bc AS (SELECT signal_id, k, r - avg(r) OVER w AS r, count(*) OVER w AS f FROM bp WINDOW w AS (PARTITION BY signal_id)),
bk AS (SELECT signal_id, f, q, pow(sum(r*cos(2*pi()*q*k/f)), 2) + pow(sum(r*sin(2*pi()*q*k/f)), 2) AS p FROM bc CROSS JOIN (SELECT unnest(range(0, 200)) AS q) WHERE q <= f//2 GROUP BY signal_id, f, q),
bs AS (SELECT signal_id, f AS frames, lag, round(sum(CASE WHEN q = 0 OR q = f//2 THEN 1 ELSE 2 END*p*cos(2*pi()*q*lag/(2*(f//2))))/(2*(f//2)), 9) AS s FROM bk CROSS JOIN (SELECT unnest(range({_T_LO}, {_T_HI})) AS lag) WHERE lag < least({_T_HI}, 2*(f//2)-1) AND f >= 4 GROUP BY signal_id, f, lag),
bb AS (SELECT signal_id, frames, arg_max(lag, struct_pack(a := s, b := -lag)) AS lag FROM bs GROUP BY ALL),
bt AS (SELECT signal_id, frames, lag, 60.0*{TEMPO_FS}/({TEMPO_HOP}*lag) AS tempo FROM bb)"""]  # fmt: skip
beats = lambda s: temporal.beat_lags(s, TEMPO_FS, TEMPO_HOP)
values_query("tempo", beats, "tempo", query(BEAT, f"SELECT sig.signal_id, {rnd('coalesce(tempo, 0.0)')} AS value FROM sig LEFT JOIN bt USING (signal_id)"), ("signal_id",))
QUERIES["beat_track"] = lambda spark, d: temporal.beat_frames(beats(signals(spark, d))).withColumn("time", rounded(F.col("frame") * TEMPO_HOP / F.lit(float(TEMPO_FS))))
SQL["beat_track"] = query(BEAT, f"SELECT signal_id, CAST(unnest(range(0, (frames-1)//lag+1)) AS BIGINT) AS beat_idx, CAST(unnest(range(0, frames, lag)) AS BIGINT) AS frame, {rnd(f'unnest(range(0, frames, lag))*{TEMPO_HOP}/{TEMPO_FS}.0')} AS time FROM bt")
values_query("beat_detection", lambda s: temporal.beat_detection(s, TEMPO_FS, TEMPO_HOP), "confidence", query([*BEAT, f"bg AS (SELECT signal_id, unnest(list_transform(range(1, (frames-1)//lag+1), lambda z: lag*{TEMPO_HOP}/{TEMPO_FS}.0)) AS g FROM bt), cf AS (SELECT signal_id, greatest(0, least(1, 1-stddev_pop(g)/(avg(g)+1e-8))) AS c FROM bg GROUP BY ALL)"], f"SELECT sig.signal_id, {rnd('coalesce(c, 0.0)')} AS value FROM sig LEFT JOIN cf USING (signal_id)"), ("signal_id",))
_ISL = [USER, f"""ef AS (SELECT signal_id, CAST(i AS BIGINT) AS frame_idx, list_sum(list_transform(x[i*8+1:i*8+16], lambda v, q: pow(v*0.5*(1-cos(2*pi()*(q-1)/16)), 2))) AS e FROM (SELECT signal_id, x, unnest(range(0, (len(x)-16)//8+1)) AS i FROM sig)),
lf AS (SELECT signal_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY signal_id ORDER BY frame_idx) AS g FROM ef WHERE e > 3000),
isl AS (SELECT signal_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM lf GROUP BY signal_id, g)"""]  # fmt: skip
QUERIES["silence_islands"] = lambda spark, d: temporal.silence_islands(signals(spark, d), FS, 16, 8, 3000.0)
SQL["silence_islands"] = query(_ISL, "SELECT signal_id, first_frame, last_frame, first_frame*8 AS start_sample, last_frame*8+16 AS end_sample FROM isl")
QUERIES["silence_removal"] = lambda spark, d: temporal.silence_removal(signals(spark, d), FS, 16, 8, 3000.0).select("signal_id", F.size("samples").cast("long").alias("kept"), rounded(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v), 4).alias("energy"))
SQL["silence_removal"] = query([*_ISL, "cut AS (SELECT isl.signal_id, unnest(x[first_frame*8+1:last_frame*8+16]) AS v FROM isl JOIN sig USING (signal_id)), ag AS (SELECT signal_id, count(*) AS kept, sum(v*v) AS e FROM cut GROUP BY ALL)"], f"SELECT sig.signal_id, coalesce(kept, 0) AS kept, {rnd('coalesce(e, 0.0)', 4)} AS energy FROM sig LEFT JOIN ag USING (signal_id)")

# functionals, grouped summaries and the feature row
QUERIES["functionals"] = lambda spark, d: stats.functionals(_samples(user_signals(spark, d, FS)), ["signal_id"], ["x"]).select("signal_id", *[rounded(f"x_{s}", 9 if s == "mean" else 6).alias(s) for s in stats.STATS])  # means of up to 128 cents have no tie there
_FN = [USER, _LONG, "mm AS (SELECT signal_id, x, avg(x) OVER w AS mu FROM lg WINDOW w AS (PARTITION BY signal_id)), ms AS (SELECT signal_id, min(mu) AS mean, sqrt(avg(pow(x-mu, 2))) AS std, min(x) AS mn, max(x) AS mx, avg(pow(x-mu, 3)) AS m3, avg(pow(x-mu, 4)) AS m4 FROM mm GROUP BY ALL)"]
SQL["functionals"] = query(_FN, f"SELECT signal_id, {rnd('mean', 9)} AS mean, {rnd('std')} AS std, {rnd('mn')} AS min, {rnd('mx')} AS max, {rnd('m3/(pow(std,3)+1e-8)')} AS skewness, {rnd('m4/(pow(std,4)+1e-8)-3')} AS kurtosis FROM ms")
QUERIES["region_rollup"] = lambda spark, d: _regions(spark, d)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Price statistics of suppliers' line items, rolled up by region and nation; line items are summed before the joins."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))
    supplier, nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation", "region"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    joined = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.sum("n").alias("items"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_price"), F.max("top").alias("max_price"))


SQL["region_rollup"] = """SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS items, round(avg(l_extendedprice), 4) AS mean_price, max(l_extendedprice) AS max_price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""


def core_user(spark: SparkSession, d: str) -> DataFrame:
    return extract_core(signals(spark, d), FS, N, HOP, F_LOW, F_HIGH, MELS, COEFFS)


def _rounded_row(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c, 3).alias(c) if t == "double" else c for c, t in df.dtypes])


QUERIES["extract_core_user"] = lambda spark, d: _rounded_row(core_user(spark, d))


def _core_sql() -> str:
    """The feature row by plain sums: every series of the twins above, unrounded, then its moments."""
    from tidewave.operators.stats import STATS

    hs, bin_hz = f"(0.5*(1-cos(2*pi()*(i-1)/{N - 1})))", FS / N
    inner = lambda ctes, select: "WITH " + ",\n".join(x for x in ctes if x != USER) + " " + select
    squares, norm, total = f"list_sum(list_transform(f, lambda v, i: pow(v*{hs}, 2)))", f"list_sum(list_transform(range(0, {N}), lambda v, i: pow({hs}, 2)))", "list_sum(m)"
    series = {
        "rms": f"SELECT signal_id, sqrt({squares}/{norm}) AS v FROM fr",
        "zcr": f"SELECT signal_id, list_sum(list_transform(f[2:{N}], lambda v, i: abs(sign(v)-sign(f[i]))))/2/{N} AS v FROM fr",
        "spectral_centroid": f"SELECT signal_id, CASE WHEN {total} = 0 THEN 0 ELSE list_sum(list_transform(m, lambda v, i: (i-1)*{bin_hz}*v))/{total} END AS v FROM mg",
        "spectral_rolloff": f"SELECT signal_id, coalesce(min(k) FILTER (round(run+1e-8-0.85*t, 9) >= 0), max(k))*{bin_hz} AS v FROM rr GROUP BY signal_id, frame_idx",
        "spectral_bandwidth": f"SELECT signal_id, v FROM ({inner([*stft_ctes('reflect'), f'c AS (SELECT *, sum(k*{bin_hz}*m) OVER w / (sum(m) OVER w + 1e-8) AS c FROM sb WINDOW w AS (PARTITION BY signal_id, frame_idx))'], f'SELECT signal_id, sqrt(sum(pow(k*{bin_hz}-c, 2)*m)/(sum(m)+1e-8)) AS v FROM c GROUP BY signal_id, frame_idx')})",
        "spectral_flux": "SELECT signal_id, sqrt(sum(d*d)) AS v FROM rd WHERE d IS NOT NULL GROUP BY signal_id, frame_idx",
        "spectral_flatness": f"SELECT signal_id, exp(list_avg(list_transform(m, lambda v: ln(v+1e-8))))/list_avg(m) AS v FROM mg JOIN sig USING (signal_id) WHERE len(x) >= {N}",
        "pitch_strength": f"SELECT signal_id, CASE WHEN max(r) FILTER (lag = 0) = 0 THEN 0 ELSE max(r) FILTER (lag >= {LO} AND lag < {HI})/max(r) FILTER (lag = 0) END AS v FROM ac GROUP BY signal_id, frame_idx",
    }
    cepstra = inner([*_MFCC], "SELECT signal_id, frame_idx, coeff, sum(w*db) AS v FROM d JOIN dc USING (band) GROUP BY ALL")
    ctes = [
        *YIN, BINS, "rr AS (SELECT signal_id, frame_idx, k, sum(m*m) OVER (PARTITION BY signal_id, frame_idx ORDER BY k) AS run, sum(m*m) OVER (PARTITION BY signal_id, frame_idx) AS t FROM bins)",
        "rd AS (SELECT signal_id, frame_idx, m - lag(m) OVER (PARTITION BY signal_id, k ORDER BY frame_idx) AS d FROM bins)",
        "sa AS (" + " UNION ALL ".join(f"SELECT signal_id, '{name}' AS name, v FROM ({q})" for name, q in series.items()) + ")",
        "su AS (SELECT signal_id, name, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM sa GROUP BY ALL)",
        "sc AS (SELECT signal_id, name, any_value(mu) AS mu, any_value(sd) AS sd, any_value(lo) AS lo, any_value(hi) AS hi, avg(pow(v-mu, 3)) AS m3, avg(pow(v-mu, 4)) AS m4 FROM sa JOIN su USING (signal_id, name) GROUP BY signal_id, name)",
        "st AS (SELECT signal_id, name, mu AS mean, sd AS std, lo AS min, hi AS max, m3/(pow(sd, 3)+1e-8) AS skewness, m4/(pow(sd, 4)+1e-8)-3 AS kurtosis FROM sc)",
        "sp AS (SELECT signal_id, " + ", ".join(f"max({s}) FILTER (name = '{name}') AS {name}_{s}" for name in series for s in STATS) + " FROM st GROUP BY ALL)",
        "sy AS (SELECT signal_id, avg(CAST(f0 > 0 AS INTEGER)) AS f0_voiced_ratio, avg(f0) FILTER (f0 > 0) AS f0_mean_hz, quantile_disc(f0, 0.5) FILTER (f0 > 0) AS f0_median_hz FROM yf GROUP BY ALL)",
        f"sq AS (SELECT signal_id, {', '.join(f'avg(v) FILTER (coeff = {i}) AS mfcc_mean_{i}, stddev_pop(v) FILTER (coeff = {i}) AS mfcc_std_{i}' for i in range(COEFFS))} FROM ({cepstra}) GROUP BY ALL)",
    ]
    values = [f"{name}_{s}" for name in series for s in STATS] + ["f0_voiced_ratio", "f0_mean_hz", "f0_median_hz"] + [f"mfcc_{k}_{i}" for k in ("mean", "std") for i in range(COEFFS)]
    return query(ctes, f"SELECT signal_id, {FS} AS sample_rate, CAST(len(x) AS BIGINT) AS num_samples, {rnd(f'len(x)/{FS}.0', 3)} AS duration_sec, " + ", ".join(f"{rnd(c, 3)} AS {c}" for c in values) + " FROM sig LEFT JOIN sp USING (signal_id) LEFT JOIN sy USING (signal_id) LEFT JOIN sq USING (signal_id)")


SQL["extract_core_user"] = _core_sql()
