"""Queries of the normalised-correlation pitch measures, of pulses, onsets and beats, and of resampling; what SQL can sum directly has a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import rounded
from tidewave.operators import periodicity, rhythm
from tidewave.plans.basic_queries import event_points
from tidewave.plans.derived_queries import MELS
from tidewave.plans.kernel_queries import _SZ
from tidewave.plans.twins import FS, HOP, N, USER, mel_sql, query, rnd
from tidewave.sources.files import resample_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLOOR, CEILING = 100.0, 400.0  # three periods of the floor are 30 samples


def _pitch(spark: SparkSession, d: str, method: str) -> DataFrame:
    return periodicity.pitch(event_points(spark, d), FS, FLOOR, CEILING, method, step=0.008)


QUERIES["f0_correlation_path"] = lambda spark, d: _pitch(spark, d, "ac").select("signal_id", "frame_idx", rounded("f0", 2).alias("f0"))
QUERIES["pitch_strength_path"] = lambda spark, d: _pitch(spark, d, "ac").select("signal_id", "frame_idx", rounded("strength", 4).alias("strength"))
QUERIES["f0_cross_correlation_path"] = lambda spark, d: _pitch(spark, d, "cc").select("signal_id", "frame_idx", rounded("f0", 2).alias("f0"))
QUERIES["harmonicity"] = lambda spark, d: periodicity.harmonicity(event_points(spark, d), FS, FLOOR).select("signal_id", rounded("hnr", 3).alias("hnr"))
QUERIES["jitter_shimmer"] = lambda spark, d: periodicity.jitter_shimmer(event_points(spark, d), FS, FLOOR, CEILING).select("signal_id", "num_periods", *[rounded(c, 3).alias(c) for c in ("jitter_local_percent", "shimmer_local_percent", "hnr_db")])


def _lags(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: periodicity.correlations(event_points(spark, d), FS, FLOOR, method, step=0.008).select("signal_id", "frame_idx", F.posexplode("r").alias("lag", "r")).select("signal_id", "frame_idx", F.col("lag").cast("long").alias("lag"), rounded("r").alias("value"))


QUERIES["windowed_autocorrelation"], QUERIES["forward_cross_correlation"] = _lags("ac"), _lags("cc")


def _frames_sql(n: int, hop: int) -> list[str]:
    return [USER, f"""pf AS (SELECT signal_id, CAST(i AS BIGINT) AS frame_idx, x[i*{hop}+1 : i*{hop}+{n}] AS f FROM (SELECT signal_id, x, unnest(range(0, (len(x)-{n})//{hop}+1)) AS i FROM sig WHERE len(x) >= {n})),
ps AS (SELECT signal_id, frame_idx, v - avg(v) OVER (PARTITION BY signal_id, frame_idx) AS v, j FROM (SELECT signal_id, frame_idx, unnest(f) AS v, unnest(range(0, {n})) AS j FROM pf))"""]


_N, _, _HOP = periodicity.frame_layout(FS, FLOOR, "ac", None, 0.008)
_W = f"(0.5-0.5*cos(2*pi()*(j+0.5)/{_N}))"
SQL["windowed_autocorrelation"] = query([*_frames_sql(_N, _HOP), f"pw AS (SELECT signal_id, frame_idx, j, v*{_W} AS v, {_W} AS w FROM ps)",
    f"pr AS (SELECT a.signal_id, a.frame_idx, b.j-a.j AS lag, sum(a.v*b.v) AS r, sum(a.w*b.w) AS w FROM pw a JOIN pw b ON a.signal_id = b.signal_id AND a.frame_idx = b.frame_idx AND b.j-a.j BETWEEN 0 AND {_N // 2} GROUP BY ALL)"],
    f"SELECT signal_id, frame_idx, CAST(lag AS BIGINT) AS lag, {rnd('CASE WHEN r0 > 0 THEN r/r0/(w/w0) ELSE 0 END')} AS value FROM (SELECT *, first_value(r) OVER o AS r0, first_value(w) OVER o AS w0 FROM pr WINDOW o AS (PARTITION BY signal_id, frame_idx ORDER BY lag))")
_N, _WIDTH, _HOP = periodicity.frame_layout(FS, FLOOR, "cc", None, 0.008)
SQL["forward_cross_correlation"] = query([*_frames_sql(_N, _HOP), f"""pr AS (SELECT a.signal_id, a.frame_idx, b.j-a.j AS lag, sum(a.v*b.v) AS r, sum(a.v*a.v) AS e, sum(b.v*b.v) AS g
  FROM ps a JOIN ps b ON a.signal_id = b.signal_id AND a.frame_idx = b.frame_idx AND a.j < {_WIDTH} AND b.j-a.j BETWEEN 0 AND {_N - _WIDTH} GROUP BY ALL)"""],
    f"SELECT signal_id, frame_idx, CAST(lag AS BIGINT) AS lag, {rnd('CASE WHEN sqrt(e*g) > 1e-12 THEN r/sqrt(e*g) ELSE 0 END')} AS value FROM pr")


# perturbations of marks made of events: a pulse a minute, more or less, by the value; amplitudes are one more than the size of the value
def _marks(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("signal_id"), "ts", "event_id", "value")
    order = Window.partitionBy("signal_id").orderBy("ts", "event_id")
    gap = 5 + F.pmod(F.floor(F.abs(F.col("value")) * 7), F.lit(4))
    return rows.select("signal_id", F.lit(0).cast("long").alias("stretch"), F.sum(gap).over(order).cast("double").alias("place"), (F.lit(1.0) + F.abs(F.col("value"))).alias("amplitude"))


_MEASURES = ["jitter_local_percent", "jitter_local_abs_sec", "jitter_rap_percent", "jitter_ppq5_percent", "jitter_ddp_percent", "shimmer_local_percent", "shimmer_local_db", "shimmer_apq3_percent", "shimmer_apq5_percent", "shimmer_apq11_percent"]
QUERIES["pulse_perturbations"] = lambda spark, d: periodicity.perturbations(_marks(spark, d), FS).select("signal_id", "num_periods", *[rounded(c).alias(c) for c in _MEASURES])


def _centred(name: str, v: str, table: str, width: int) -> str:
    """name: mean distance of v from the mean of `width` around it, in the runs of `table` where all pairs count together."""
    h = width // 2
    return f"""{name} AS (SELECT signal_id, avg(abs(c-m)) AS d FROM (SELECT a.signal_id, a.p, any_value(a.{v}) AS c, avg(b.{v}) AS m FROM {table} a JOIN {table} b ON a.signal_id = b.signal_id AND b.p BETWEEN a.p-{h} AND a.p+{h}
  WHERE a.{v} IS NOT NULL GROUP BY a.signal_id, a.p HAVING count(b.{v}) = {width} AND count(*) FILTER (b.p > a.p-{h} AND b.ok) = {width - 1}) GROUP BY ALL)"""


SQL["pulse_perturbations"] = query(["""mk AS (SELECT CAST(user_id AS BIGINT) AS signal_id, row_number() OVER w AS p, sum(5+(floor(abs(value)*7) % 4)) OVER w AS place, 1.0+abs(value) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    f"tt AS (SELECT *, CASE WHEN t BETWEEN 0.0001 AND 0.02 THEN t END AS u FROM (SELECT *, (lead(place) OVER (PARTITION BY signal_id ORDER BY p) - place)/{FS}.0 AS t FROM mk))",
    "pp AS (SELECT x.signal_id, x.p, x.u, x.a, y.u AS u1, y.a AS a1 FROM tt x LEFT JOIN tt y ON y.signal_id = x.signal_id AND y.p = x.p-1)",
    "tp AS (SELECT signal_id, p, u, u1, coalesce(greatest(u, u1) <= 1.3*least(u, u1), false) AND u IS NOT NULL AND u1 IS NOT NULL AS ok FROM pp)",
    "ap AS (SELECT signal_id, p, a, a1, u1, a1 IS NOT NULL AND u1 IS NOT NULL AND greatest(a, a1) <= 1.6*least(a, a1) AS ok FROM pp)",
    _centred("r3", "u", "tp", 3), _centred("r5", "u", "tp", 5), _centred("s3", "a", "ap", 3), _centred("s5", "a", "ap", 5), _centred("s11", "a", "ap", 11),
    "tm AS (SELECT signal_id, avg(u) AS u, count(u) AS n, avg(abs(u-u1)) FILTER (ok) AS d FROM tp GROUP BY ALL)",
    "am AS (SELECT signal_id, avg(a) AS a, avg(abs(a-a1)) FILTER (ok) AS d, avg(abs(20*log10(a/a1))) FILTER (ok) AS b FROM ap GROUP BY ALL)"],
    "SELECT tm.signal_id, tm.n AS num_periods, " + ", ".join(f"{rnd(e)} AS {c}" for c, e in zip(_MEASURES, ["100*tm.d/tm.u", "tm.d", "100*r3.d/tm.u", "100*r5.d/tm.u", "300*r3.d/tm.u", "100*am.d/am.a", "am.b", "100*s3.d/am.a", "100*s5.d/am.a", "100*s11.d/am.a"], strict=True))
    + " FROM tm JOIN am USING (signal_id)" + "".join(f" LEFT JOIN {t} ON {t}.signal_id = tm.signal_id" for t in ("r3", "r5", "s3", "s5", "s11")))


QUERIES["onset_times"] = lambda spark, d: rhythm.onset_times(event_points(spark, d), FS, N, HOP, MELS).select("signal_id", "frame_idx", rounded("time").alias("time"))
_DB = "10*log10(greatest(v, 1e-10))"
_BY = "PARTITION BY signal_id ORDER BY t"
SQL["onset_times"] = query([USER, *_SZ, mel_sql(MELS), "ob AS (SELECT signal_id, t, band, sum(w*(c*c+s*s)) AS v FROM sz JOIN fb USING (k) GROUP BY ALL)",
    f"od AS (SELECT signal_id, t, band, greatest({_DB}, max({_DB}) OVER (PARTITION BY signal_id) - 80) AS d FROM ob)",
    "orr AS (SELECT signal_id, t, d - lag(d) OVER (PARTITION BY signal_id, band ORDER BY t) AS r FROM od)",
    f"os AS (SELECT signal_id, t + {N // (2 * HOP)} AS t, median(greatest(r, 0)) AS s FROM orr WHERE r IS NOT NULL GROUP BY ALL)",
    "oe AS (SELECT a.signal_id, a.t, coalesce(s, 0) AS s FROM (SELECT DISTINCT signal_id, t FROM ob) a LEFT JOIN os USING (signal_id, t))",
    "onn AS (SELECT signal_id, t, (s-lo)/(hi-lo) AS s FROM (SELECT *, min(s) OVER (PARTITION BY signal_id) AS lo, max(s) OVER (PARTITION BY signal_id) AS hi FROM oe) WHERE hi > lo)",
    f"""om AS (SELECT signal_id, t, s >= max(s) OVER ({_BY} ROWS BETWEEN {int(0.03 * FS // HOP)} PRECEDING AND CURRENT ROW)
  AND round(s - avg(s) OVER ({_BY} ROWS BETWEEN {int(0.1 * FS // HOP)} PRECEDING AND {int(0.1 * FS // HOP)} FOLLOWING) - 0.07, 9) >= 0 AS peak,
  CASE WHEN s <= lag(s) OVER ({_BY}) AND s < lead(s) OVER ({_BY}) THEN t END AS low FROM onn)""",
    f"ok AS (SELECT signal_id, t, peak, last_value(low IGNORE NULLS) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM om)",
    f"op AS (SELECT *, t - row_number() OVER ({_BY}) AS run FROM ok WHERE peak)",
    "oq AS (SELECT *, row_number() OVER (PARTITION BY signal_id, run ORDER BY t) AS place FROM op)"],
    f"SELECT signal_id, CAST(coalesce(back, t) AS BIGINT) AS frame_idx, {rnd(f'coalesce(back, t)*{HOP}/{FS}.0')} AS time FROM oq WHERE place % 2 = 1")
assert int(0.03 * FS // HOP) == 1  # the twin keeps every other one of neighbouring peaks
QUERIES["beat_times"] = lambda spark, d: rhythm.beat_track(event_points(spark, d), FS, N, HOP, 240.0, 1200.0, MELS).select("signal_id", "beat_idx", "frame_idx", rounded("bpm", 3).alias("bpm"))

QUERIES["resample"] = lambda spark, d: resample_points(event_points(spark, d), FS, 400, per=20).select("signal_id", F.col("i").alias("n"), rounded("x").alias("value"))
SQL["resample"] = query([USER, "rx AS (SELECT signal_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM sig)", "rm AS (SELECT signal_id, unnest(range(0, CAST(ceil(len(x)*2/5.0) AS BIGINT))) AS m FROM sig)",
    "rt AS (SELECT rm.signal_id, m, v, (i/5.0-m/2.0)*1.98 AS t FROM rm JOIN rx ON rx.signal_id = rm.signal_id AND abs(i/5.0-m/2.0)*1.98 < 6)"],
    f"SELECT signal_id, CAST(m AS BIGINT) AS n, {rnd('sum(v*CASE WHEN t = 0 THEN 1 ELSE sin(pi()*t)/(pi()*t) END*pow(cos(t*pi()/12), 2))*1.98/5')} AS value FROM rt GROUP BY ALL")
