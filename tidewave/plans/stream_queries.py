"""Queries of streams, event-time windows, linear prediction and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.arrays import rounded
from tidewave.functions.fourier import magnitude
from tidewave.functions.windows import hann_symmetric, literal
from tidewave.operators import linear, spectral, temporal
from tidewave.plans import basic_queries, report
from tidewave.plans import derived_queries as dq
from tidewave.plans.basic_queries import signals
from tidewave.plans.twins import FS, HOP, N, query, rnd
from tidewave.sources.signals import frames
from tidewave.storage import fresh_dir
from tidewave.streaming import framing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def streaming_frames(spark: SparkSession, d: str) -> DataFrame:
    """Mean of every frame of 8 events, every 4, per user, by keyed state over the stream of events."""
    rows = framing.events_stream(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "ts", "value")
    out = framing.frame_stream(rows, "user_id", "ts", "value", 8, 4, lambda x: float(x.mean()))
    return framing.run_to_end(out, fresh_dir(spark, "stream")).select("user_id", "frame_idx", rounded("value").alias("value"))


QUERIES["streaming_frames"] = streaming_frames
SQL["streaming_frames"] = f"""WITH s AS (SELECT user_id, list(value ORDER BY ts) AS x FROM events GROUP BY user_id)
SELECT user_id, CAST(i AS BIGINT) AS frame_idx, {rnd('list_avg(x[i*4+1:i*4+8])')} AS value FROM (SELECT user_id, x, unnest(range(0, (len(x)-8)//4+1)) AS i FROM s)"""
QUERIES["event_windows"] = lambda spark, d: framing.window_functionals(spark.read.parquet(f"{d}/events.parquet"), "ts", "value", ["event_type"], "1 day").select("window_start", "event_type", "n", *[rounded(c, 9 if c == "mean" else 6).alias(c) for c in ("mean", "std", "min", "max")])  # means of cents have fewer ties there
SQL["event_windows"] = f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, {rnd('avg(value)', 9)} AS mean, {rnd('stddev_pop(value)')} AS std, {rnd('min(value)')} AS min, {rnd('max(value)')} AS max FROM events GROUP BY 1, 2"""
QUERIES["event_sessions"] = lambda spark, d: framing.sessions(spark.read.parquet(f"{d}/events.parquet"), "ts", "user_id", "6 hours")
SQL["event_sessions"] = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s"""


def hann_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames(signals(spark, d), N, HOP).withColumn("frame", F.zip_with("frame", literal(hann_symmetric(N)), lambda a, b: a * b))


def lpc_rows(spark: SparkSession, d: str) -> DataFrame:
    return hann_frames(spark, d).select("signal_id", "frame_idx", linear.lpc(F.col("frame"), N, 4).alias("a"))


long_form = lambda df, c: df.select("signal_id", "frame_idx", F.posexplode(c).alias("coeff", "v")).select("signal_id", "frame_idx", F.col("coeff").cast("long").alias("coeff"), rounded("v", 5).alias("value"))
QUERIES["lpc"] = lambda spark, d: long_form(lpc_rows(spark, d), "a")
QUERIES["lpcc"] = lambda spark, d: long_form(lpc_rows(spark, d).withColumn("c", linear.lpcc(F.col("a"), 4, 4)), "c")
QUERIES["line_spectral_pairs"] = lambda spark, d: long_form(lpc_rows(spark, d).withColumn("c", linear.line_spectral_pairs(F.col("a"), 4)), "c")
QUERIES["formant_bandwidths"] = lambda spark, d: long_form(lpc_rows(spark, d).withColumn("c", linear.formant_bandwidths(F.col("a"), FS)), "c")
_LEV = [*dq.AC, f"""r AS (SELECT signal_id, frame_idx, list(r ORDER BY lag) AS r FROM ac WHERE lag <= 4 GROUP BY ALL),
l0 AS (SELECT *, r[1]+1e-12 AS e0 FROM r), l1 AS (SELECT *, -r[2]/e0 AS k1 FROM l0), m1 AS (SELECT *, [k1] AS a1, e0*(1-k1*k1) AS e1 FROM l1),
l2 AS (SELECT *, -(r[3]+a1[1]*r[2])/e1 AS k2 FROM m1), m2 AS (SELECT *, [a1[1]+k2*a1[1], k2] AS a2, e1*(1-k2*k2) AS e2 FROM l2),
l3 AS (SELECT *, -(r[4]+a2[1]*r[3]+a2[2]*r[2])/e2 AS k3 FROM m2), m3 AS (SELECT *, [a2[1]+k3*a2[2], a2[2]+k3*a2[1], k3] AS a3, e2*(1-k3*k3) AS e3 FROM l3),
l4 AS (SELECT *, -(r[5]+a3[1]*r[4]+a3[2]*r[3]+a3[3]*r[2])/e3 AS k4 FROM m3), lp AS (SELECT signal_id, frame_idx, [a3[1]+k4*a3[3], a3[2]+k4*a3[2], a3[3]+k4*a3[1], k4] AS a FROM l4)"""]  # fmt: skip
SQL["lpc"] = query(_LEV, f"SELECT signal_id, frame_idx, CAST(unnest(range(0, 4)) AS BIGINT) AS coeff, {rnd('unnest(a)', 5)} AS value FROM lp")
_CC = """c1 AS (SELECT *, a[1] AS c1 FROM lp), c2 AS (SELECT *, a[2]+0.5*c1*a[1] AS c2 FROM c1), c3 AS (SELECT *, a[3]+c1*a[2]/3.0+2*c2*a[1]/3.0 AS c3 FROM c2), c4 AS (SELECT *, a[4]+c1*a[3]/4.0+2*c2*a[2]/4.0+3*c3*a[1]/4.0 AS c4 FROM c3)"""
SQL["lpcc"] = query([*_LEV, _CC], f"SELECT signal_id, frame_idx, CAST(unnest(range(0, 4)) AS BIGINT) AS coeff, {rnd('unnest([c1, c2, c3, c4])', 5)} AS value FROM c4")


def pitch_report(spark: SparkSession, d: str) -> DataFrame:
    """YIN against autocorrelation pitch: mean and median per signal, relative errors, tolerances."""
    s = signals(spark, d)

    def side(rows: DataFrame, col: str) -> DataFrame:
        # Means are summed in order of frames: some errors are the very tolerance or end in half a digit, and sums in another order tip them.
        ordered = F.array_sort(F.collect_list(F.struct("frame_idx", col)))
        added = F.aggregate(ordered, F.lit(0.0), lambda s, r: s + r[col])
        return rows.groupBy("signal_id").agg((added / F.count("*")).alias("pitch_mean"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col})").alias("pitch_median")).unpivot("signal_id", ["pitch_mean", "pitch_median"], "metric", "value")

    a = side(dq.yin_rows(s), "f0")
    b = side(dq.ac_rows(s).withColumn("f", dq.pitch.autocorrelation_pitch("ac", N, FS, dq.F_LOW, dq.F_HIGH)), "f")
    checks = report.evaluate(report.compare(a, b, ["signal_id"]), report.tolerances(spark), ["signal_id"])
    return checks.select("signal_id", "metric", rounded("error").alias("error"), "tolerance", "passed")


QUERIES["pitch_report"] = pitch_report
SQL["pitch_report"] = query([*dq.YIN, f"""fa AS (SELECT signal_id, frame_idx, {FS}.0/arg_max(lag, struct_pack(a := round(r, 9), b := -lag)) AS f FROM ac WHERE lag >= {dq.LO} AND lag < {dq.HI} GROUP BY ALL),
ya AS (SELECT signal_id, avg(f0) AS a, quantile_disc(f0, 0.5) AS b FROM yf GROUP BY ALL), fb AS (SELECT signal_id, avg(f) AS a, quantile_disc(f, 0.5) AS b FROM fa GROUP BY ALL),
e AS (SELECT signal_id, abs(ya.a-fb.a)/greatest(abs(fb.a), 1e-8) AS a, abs(ya.b-fb.b)/greatest(abs(fb.b), 1e-8) AS b FROM ya JOIN fb USING (signal_id)),
u AS (SELECT signal_id, 'pitch_mean' AS metric, a AS v FROM e UNION ALL SELECT signal_id, 'pitch_median', b FROM e)"""], f"SELECT signal_id, metric, {rnd('v')} AS error, 0.15::DOUBLE AS tolerance, v <= 0.15 AS passed FROM u")  # fmt: skip


def by_rows(name: str, f) -> None:
    QUERIES[f"{name}_by_rows"] = lambda spark, d: f(basic_queries.event_frames(spark, d)).select("signal_id", "frame_idx", rounded("v").alias("value"))
    SQL[f"{name}_by_rows"] = basic_queries.SQL[name]


by_rows("rms", lambda df: df.withColumn("v", temporal.rms("frame", N)))
by_rows("zero_crossing_rate", lambda df: df.withColumn("v", temporal.zero_crossing_rate("frame")))
by_rows("spectral_centroid", lambda df: df.withColumn("v", spectral.centroid(magnitude(F.col("frame"), N), FS / N)))
