"""Building blocks of the SQL twins: the same signals, frames and spectra as common table expressions."""

from __future__ import annotations

N, HOP, FS = 32, 16, 1000  # framing of the registered queries

USER = """s0 AS (SELECT user_id AS signal_id, list(value ORDER BY ts, event_id) AS x0 FROM events GROUP BY user_id),
sig AS (SELECT CAST(signal_id AS BIGINT) AS signal_id, list_transform(x0, lambda v: v - list_sum(x0) / len(x0)) AS x FROM s0),
raw AS (SELECT CAST(signal_id AS BIGINT) AS signal_id, x0 AS x FROM s0)"""
FRAMES = f"""fr AS (SELECT signal_id, CAST(i AS BIGINT) AS frame_idx, xp[i*{HOP}+1 : i*{HOP}+{N}] AS f
FROM (SELECT signal_id, xp, unnest(range(0, (len(xp) - {N}) // {HOP} + 1)) AS i
      FROM (SELECT signal_id, CASE WHEN len(x) < {N} THEN list_concat(x, list_transform(range(0, {N} - len(x)), lambda z: 0.0::DOUBLE)) ELSE x END AS xp FROM sig)))"""
BINS = f"""smp AS (SELECT signal_id, frame_idx, unnest(f) AS v, unnest(range(0, {N})) AS j FROM fr),
bins AS (SELECT signal_id, frame_idx, k, sqrt(re*re + im*im) AS m FROM (
  SELECT signal_id, frame_idx, k, sum(v*cos(2*pi()*k*j/{N})) AS re, sum(v*sin(2*pi()*k*j/{N})) AS im
  FROM smp CROSS JOIN (SELECT unnest(range(0, {N // 2 + 1})) AS k) GROUP BY ALL)),
mg AS (SELECT signal_id, frame_idx, list(m ORDER BY k) AS m FROM bins GROUP BY ALL)"""
#: Whole-signal spectra: the transform size nf is the next power of two of the signal's length, hz the width of a bin.
WHOLE = f"""wsz AS (SELECT signal_id, x, len(x) AS n, CAST(pow(2, greatest(1, ceil(log2(len(x))))) AS BIGINT) AS nf FROM sig),
wsm AS (SELECT signal_id, nf, v*0.5*(1-cos(2*pi()*j/greatest(n-1, 1))) AS v, j FROM (SELECT signal_id, n, nf, unnest(x) AS v, unnest(range(0, n)) AS j FROM wsz)),
wks AS (SELECT signal_id, unnest(range(0, nf // 2 + 1)) AS k FROM wsz),
wbins AS (SELECT signal_id, k, {FS}.0/nf AS hz, sqrt(re*re + im*im) AS m FROM (
  SELECT signal_id, k, nf, sum(v*cos(2*pi()*k*j/nf)) AS re, sum(v*sin(2*pi()*k*j/nf)) AS im
  FROM wsm JOIN wks USING (signal_id) GROUP BY ALL)),
wm AS (SELECT signal_id, hz, list(m ORDER BY k) AS m FROM wbins GROUP BY ALL)"""


def rnd(e: str, digits: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE), {digits}) + 0.0"


def mp(lst: str, e: str) -> str:
    """list_transform with v and the 1-based place i."""
    return f"list_transform({lst}, lambda v, i: {e})"


def sm(lst: str) -> str:
    return f"coalesce(list_sum({lst}), 0.0)"


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def over_frames(e: str) -> str:
    return query([USER, FRAMES], f"SELECT signal_id, frame_idx, {rnd(e)} AS value FROM fr")


def over_signals(e: str, source: str = "sig") -> str:
    return query([USER], f"SELECT signal_id, {rnd(e)} AS value FROM {source}")


def over_magnitudes(e: str) -> str:
    return query([USER, FRAMES, BINS], f"SELECT signal_id, frame_idx, {rnd(e)} AS value FROM mg")


def over_whole(e: str) -> str:
    return query([USER, WHOLE], f"SELECT signal_id, {rnd(e)} AS value FROM wm")


def _range(name: str, n: int) -> str:
    return f"(SELECT unnest(range(0, {n})) AS {name})"


def mel_sql(bands: int) -> str:
    """fb(band, k, w): triangles with edges evenly spaced on 2595 log10(1 + f / 700)."""
    f = f"k*{FS / N}"
    return f"""me AS (SELECT i, 700*(pow(10, i*log10(1+{FS / 2}/700)/{bands + 1})-1) AS hz FROM {_range('i', bands + 2)}),
fb AS (SELECT CAST(a.i AS BIGINT) AS band, k, greatest(0.0, least(({f}-a.hz)/(b.hz-a.hz), (c.hz-{f})/(c.hz-b.hz))) AS w
  FROM me a JOIN me b ON b.i = a.i+1 JOIN me c ON c.i = a.i+2 CROSS JOIN {_range('k', N // 2 + 1)})"""


def gammatone_sql(bands: int, f_min: float) -> str:
    """fb(band, k, w): gammatone power responses of order 4 at centres evenly spaced in ERB rate, each with area 1."""
    erb = lambda f: f"21.4*log10(4.37e-3*{f}+1)"
    return f"""gc AS (SELECT b, (pow(10, ({erb(f_min)}+({erb(FS / 2)}-{erb(f_min)})*b/{bands - 1})/21.4)-1)/4.37e-3 AS hz FROM {_range('b', bands)}),
gw AS (SELECT b, k, pow(1+pow((k*{FS / N}-hz)/(1.019*24.7*(4.37*hz/1000+1)), 2), -4) AS r FROM gc CROSS JOIN {_range('k', N // 2 + 1)}),
fb AS (SELECT CAST(b AS BIGINT) AS band, k, r/(sum(r) OVER (PARTITION BY b)+1e-12) AS w FROM gw)"""


def chroma_sql() -> str:
    """fb(band, k, w): pitch classes from C; see the operator's docstring."""
    return f"""cp AS (SELECT k, 12*log2(greatest(k, 1)*{FS / N}/27.5)-CASE WHEN k = 0 THEN 18 ELSE 0 END AS a, CASE WHEN k = 0 THEN 18.0 ELSE greatest(1.0, 12*log2(1+1.0/greatest(k, 1))) END AS wd FROM {_range('k', N // 2 + 1)}),
cw AS (SELECT k, p, a, exp(-2*pow((a-3-p-12*round((a-3-p)/12))/wd, 2)) AS x FROM cp CROSS JOIN {_range('p', 12)}),
fb AS (SELECT CAST(p AS BIGINT) AS band, k, x/sqrt(sum(x*x) OVER (PARTITION BY k))*exp(-pow((a/12-5)/2, 2)/2) AS w FROM cw)"""


def dct_sql(coeffs: int, bands: int) -> str:
    """dc(coeff, band, w): orthonormal DCT-II."""
    return f"dc AS (SELECT CAST(i AS BIGINT) AS coeff, CAST(j AS BIGINT) AS band, sqrt((CASE WHEN i = 0 THEN 1.0 ELSE 2.0 END)/{bands})*cos(pi()/{bands}*(j+0.5)*i) AS w FROM {_range('i', coeffs)} CROSS JOIN {_range('j', bands)})"


def tonnetz_sql() -> str:
    """tn(dim, pitch_class, w): sine and cosine of fifths, minor thirds and major thirds (half as far)."""
    return f"""tn AS (SELECT CAST(d AS BIGINT) AS dim, CAST(p AS BIGINT) AS pitch_class,
  (CASE WHEN d < 4 THEN 1.0 ELSE 0.5 END)*cos(pi()*((CASE WHEN d < 2 THEN 7.0/6 WHEN d < 4 THEN 3.0/2 ELSE 2.0/3 END)*p-(CASE WHEN d % 2 = 0 THEN 0.5 ELSE 0.0 END))) AS w
  FROM {_range('d', 6)} CROSS JOIN {_range('p', 12)})"""
