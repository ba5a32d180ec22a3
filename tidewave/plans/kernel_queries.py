"""Queries of whole-signal kernels and of the tristimulus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions.arrays import rounded
from tidewave.operators import kernels
from tidewave.plans.basic_queries import event_points, signals
from tidewave.plans.derived_queries import stft_ctes
from tidewave.plans.twins import FS, HOP, N, USER, query, rnd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOW_RATE = 100  # makes a loudness block 40 samples, which every signal has


def _energies(made: DataFrame, **names: str) -> DataFrame:
    return made.groupBy("signal_id").agg(*[rounded(F.sum(F.col(c) * F.col(c)), 3).alias(name) for name, c in names.items()])


QUERIES["harmonic_percussive"] = lambda spark, d: _energies(kernels.harmonic_percussive(event_points(spark, d), N, HOP), harmonic="harmonic", percussive="percussive")
QUERIES["noise_reduction"] = lambda spark, d: _energies(kernels.noise_reduction(event_points(spark, d), 0.01, N, HOP), energy="x")
QUERIES["loudness"] = lambda spark, d: kernels.loudness(event_points(spark, d), LOW_RATE, 16).select("signal_id", rounded("lufs", 4).alias("lufs"))

_K = N // 2
#: sz: spectra (c: cosine sums, s: sine sums) of centred frames; back(t): frames t(signal_id, frame_idx, k, c, s) overlapped again.
_SZ = ["""cp AS (SELECT signal_id, x, len(x) AS n, greatest(2*(len(x)-1), 1) AS p FROM sig)""",
    f"""cq AS (SELECT signal_id, x, n, p, unnest(range(0, n+{N})) AS i FROM cp)""",
    f"""ca AS (SELECT signal_id, n, i, x[1+CASE WHEN r > n-1 THEN p-r ELSE r END] AS v FROM (SELECT *, (((i-{_K})%p)+p)%p AS r FROM cq))""",
    f"""ct AS (SELECT signal_id, n, unnest(range(0, n//{HOP}+1)) AS t FROM cp)""",
    f"""cf AS (SELECT ct.signal_id, t, i-t*{HOP} AS j, v*0.5*(1-cos(2*pi()*(i-t*{HOP})/{N})) AS v FROM ct JOIN ca ON ca.signal_id = ct.signal_id AND i >= t*{HOP} AND i < t*{HOP}+{N})""",
    f"""sz AS (SELECT signal_id, t, k, sum(v*cos(2*pi()*k*j/{N})) AS c, sum(v*sin(2*pi()*k*j/{N})) AS s FROM cf CROSS JOIN (SELECT unnest(range(0, {_K + 1})) AS k) GROUP BY ALL)"""]


def _back(name: str, table: str) -> str:
    """Energy of each signal after inverse transform and overlap of `table` (signal_id, t, k, c, s)."""
    wave = f"CASE WHEN k = 0 OR k = {_K} THEN 1 ELSE 2 END*(c*cos(2*pi()*k*j/{N})+s*sin(2*pi()*k*j/{N}))/{N}"
    return f"""{name} AS (SELECT o.signal_id, sum(pow(o.v/CASE WHEN o.w > 1e-11 THEN o.w ELSE 1 END, 2)) AS e FROM (
  SELECT signal_id, t*{HOP}+j AS i, sum(v*0.5*(1-cos(2*pi()*j/{N}))) AS v, sum(pow(0.5*(1-cos(2*pi()*j/{N})), 2)) AS w FROM (
    SELECT signal_id, t, j, sum({wave}) AS v FROM {table} CROSS JOIN (SELECT unnest(range(0, {N})) AS j) GROUP BY ALL) GROUP BY ALL) o
  JOIN cp ON cp.signal_id = o.signal_id AND o.i >= {_K} AND o.i < {_K}+cp.n GROUP BY ALL)"""


SQL["noise_reduction"] = query([USER, *_SZ, "nz AS (SELECT signal_id, t, k, greatest(c*c+s*s-0.01, 0) AS c, 0.0 AS s FROM sz)", _back("ne", "nz")], f"SELECT signal_id, {rnd('e', 3)} AS energy FROM ne")
_OFF = "(SELECT unnest(range(-3, 4)) AS o)"
SQL["harmonic_percussive"] = query([USER, *_SZ, "sm AS (SELECT *, sqrt(c*c+s*s) AS m, max(t) OVER (PARTITION BY signal_id) AS tt FROM sz)",
    f"mh AS (SELECT a.signal_id, a.t, a.k, median(b.m) AS h FROM (SELECT signal_id, t, k, CASE WHEN abs(k+o) > {_K} THEN {2 * _K}-abs(k+o) ELSE abs(k+o) END AS kk FROM sm CROSS JOIN {_OFF}) a JOIN sm b ON b.signal_id = a.signal_id AND b.t = a.t AND b.k = a.kk GROUP BY ALL)",
    f"mp AS (SELECT a.signal_id, a.t, a.k, median(b.m) AS p FROM (SELECT signal_id, t, k, CASE WHEN r > tt THEN q-r ELSE r END AS z FROM (SELECT *, ((t+o)%q+q)%q AS r FROM (SELECT *, greatest(2*tt, 1) AS q FROM sm) CROSS JOIN {_OFF})) a JOIN sm b ON b.signal_id = a.signal_id AND b.t = a.z AND b.k = a.k GROUP BY ALL)",
    "hp AS (SELECT signal_id, t, k, c, s, pow(h/(h+p+1e-8), 2) AS gh, pow(p/(h+p+1e-8), 2) AS gp FROM sm JOIN mh USING (signal_id, t, k) JOIN mp USING (signal_id, t, k))",
    "h1 AS (SELECT signal_id, t, k, c*gh AS c, s*gh AS s FROM hp)", "p1 AS (SELECT signal_id, t, k, c*gp AS c, s*gp AS s FROM hp)", _back("he", "h1"), _back("pe", "p1")],
    f"SELECT signal_id, {rnd('he.e', 3)} AS harmonic, {rnd('pe.e', 3)} AS percussive FROM he JOIN pe USING (signal_id)")


def _loudness_sql(rate: int) -> str:
    """The filters sample by sample, as a recursion over places."""
    section = lambda x, b, a, z1, z2: (f"({b[0] / a[0]!r}::DOUBLE*{x}+{z1})", [b[1] / a[0], a[1] / a[0], b[2] / a[0], a[2] / a[0]], z2)
    (b1, a1), (b2, a2) = kernels._shelf_and_highpass(rate)
    y1, c1, _ = section("x.v", b1, a1, "r.z1", "r.z2")
    y2, c2, _ = section("y1", b2, a2, "z3", "z4")
    f = lambda v: f"({v!r})::DOUBLE"
    n, hop = round(0.4 * rate), round(0.1 * rate)
    return query([USER, "lx AS MATERIALIZED (SELECT signal_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM sig)", f"""lf AS (WITH RECURSIVE r(signal_id, i, y, z1, z2, z3, z4) AS (
  SELECT signal_id, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM sig
  UNION ALL SELECT signal_id, i, {y2}, {f(c1[0])}*v-{f(c1[1])}*y1+z2, {f(c1[2])}*v-{f(c1[3])}*y1, {f(c2[0])}*y1-{f(c2[1])}*{y2}+z4, {f(c2[2])}*y1-{f(c2[3])}*{y2}
  FROM (SELECT x.signal_id, x.i, x.v, {y1} AS y1, r.z2, r.z3, r.z4 FROM r JOIN lx x ON x.signal_id = r.signal_id AND x.i = r.i + 1)) SELECT * FROM r WHERE i >= 0)""",
    f"lw AS (SELECT signal_id, w, sum(y*y)/{n} AS p FROM (SELECT signal_id, i, y, unnest(range(0, i//{hop}+1)) AS w FROM lf) WHERE i < w*{hop}+{n} GROUP BY ALL HAVING count(*) = {n})",
    "ll AS (SELECT * FROM lw WHERE p > 0 AND -0.691+10*log10(p) > -70)",
    "lk AS (SELECT * FROM ll JOIN (SELECT signal_id, -0.691+10*log10(avg(p))-10 AS bar FROM ll GROUP BY ALL) USING (signal_id) WHERE -0.691+10*log10(p) > bar)"],
    f"SELECT sig.signal_id, {rnd('-0.691+10*log10(avg(p))', 4)} AS lufs FROM sig LEFT JOIN lk USING (signal_id) GROUP BY ALL")


SQL["loudness"] = _loudness_sql(LOW_RATE)
QUERIES["tristimulus"] = lambda spark, d: kernels.tristimulus(signals(spark, d), FS, N, HOP).select("signal_id", *[rounded(t).alias(t) for t in ("t1", "t2", "t3")])
_BIN = FS / N
SQL["tristimulus"] = query([*stft_ctes("reflect"), f"""tl AS (SELECT signal_id, unnest(x) AS v, unnest(range(0, len(x))) AS j, len(x) AS n FROM sig),
ta AS (SELECT a.signal_id, b.j - a.j AS lag, round(sum(a.v*b.v), 9) AS r FROM tl a JOIN tl b ON a.signal_id = b.signal_id AND b.j - a.j BETWEEN {max(1, FS // 1000)} AND {FS // 60} GROUP BY ALL),
tp AS (SELECT signal_id, {FS}.0/arg_max(lag, struct_pack(a := r, b := -lag)) AS f0 FROM ta GROUP BY ALL),
th AS (SELECT signal_id, h, round_even(f0*h/{_BIN}, 0) AS c FROM tp CROSS JOIN (SELECT unnest(range(1, 11)) AS h)),
tm AS (SELECT sb.signal_id, frame_idx, h, max(m) AS a FROM sb JOIN th ON sb.signal_id = th.signal_id AND abs(k - c) <= {max(1, round(30.0 / _BIN))} GROUP BY ALL),
ts AS (SELECT signal_id, frame_idx, sum(a) AS s, coalesce(sum(a) FILTER (h = 1), 0) AS t1, coalesce(sum(a) FILTER (h BETWEEN 2 AND 4), 0) AS t2, coalesce(sum(a) FILTER (h >= 5), 0) AS t3 FROM tm GROUP BY ALL HAVING sum(a) > 1e-8)"""],
    "SELECT sig.signal_id, " + ", ".join(f"{rnd(f'coalesce(avg({t}/s), 1.0/3)')} AS {t}" for t in ("t1", "t2", "t3")) + " FROM sig LEFT JOIN ts USING (signal_id) GROUP BY sig.signal_id")


def formant_tracks(spark: SparkSession, d: str) -> DataFrame:
    from tidewave.operators import formants

    return formants.contours(formants.candidates(signals(spark, d), FS, 8, N, HOP, 450.0), 3, 450.0)


def formant_frequencies(spark: SparkSession, d: str) -> DataFrame:
    from tidewave.operators import formants

    return formants.frequencies(formant_tracks(spark, d)).select("signal_id", "formant", rounded("freq", 3).alias("freq"))


QUERIES["formant_contours"] = lambda spark, d: formant_tracks(spark, d).select("signal_id", "frame_idx", "formant", rounded("freq", 3).alias("freq"), rounded("width", 3).alias("width"))
QUERIES["formant_frequencies"] = formant_frequencies
