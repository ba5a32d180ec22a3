"""Every query with an SQL twin against DuckDB on the smallest tables; the rest return rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidewave import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name not in queries.SQL:
        return
    want = duck.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(got) == len(want)
    text = [c for c in cols if want[c].dtype.kind not in "fiub"]
    a, b = (f[cols].astype({c: str for c in text}).sort_values([*[c for c in cols if c != "value"], *(["value"] if "value" in cols else [])]).to_numpy().tolist() for f in (got, want))
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (pd.isna(u) and pd.isna(v)) or math.isclose(float(u), float(v), rel_tol=1e-6, abs_tol=2e-5), (x, y)


def spark_and_duck(spark, folder, name, signals):
    """Rows of a query and of its twin over a table of events: values by user, written last event first."""
    import datetime

    rows = [(u * 1000 + k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=7 * k), u, float(v)) for u, x in enumerate(signals) for k, v in enumerate(x)]
    df = pd.DataFrame(rows[::-1], columns=["event_id", "ts", "user_id", "value"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(folder / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    order = lambda f: f.sort_values([c for c in f.columns if c != "value"])[sorted(f.columns)].to_numpy().tolist()
    return order(queries.QUERIES[name](spark, str(folder)).toPandas()), order(con.sql(queries.SQL[name]).df())


@pytest.mark.parametrize("name", ["zero_crossing_count", "zero_crossing_rate_by_rows", "zero_crossing_rate"])
def test_values_at_the_mean(spark, tmp_path, name):
    import itertools
    import random

    rng, signals = random.Random(3), []
    while len(signals) < 12:  # one value is the mean, to rounding, and the sum depends on the order
        x = [round(rng.uniform(0, 300), 2) for _ in range(40)]
        x.insert(20, round(sum(x) / 40, 2))
        x[-1] = round(41 * x[20] - sum(x[:-1]), 2)
        forth, back = (list(itertools.accumulate(v))[-1] / 41 for v in (x, x[::-1]))
        if forth != back and (x[20] > forth) - (x[20] < forth) != (x[20] > back) - (x[20] < back):
            signals.append(x)
    got, want = spark_and_duck(spark, tmp_path, name, [*signals, [1.0, 2.0, 6.0] * 15])
    assert got == want


def test_fry_at_a_fifth(spark, tmp_path):
    ties = [[float(k), k / 1.2, float(k), k * 1.25] for k in range(1, 70)]
    got, want = spark_and_duck(spark, tmp_path, "vocal_fry_index", ties)
    assert got == want


#: A signal whose error of the mean pitch is just the tolerance of 0.15 when its frames are summed in order.
AT_THE_TOLERANCE = [
    20.16, 0.44, 78.72, 37.75, 191.41, 36.86, 46.25, 11.97, 13.35, 13.15, 35.19, 26.71, 15.98, 20.24, 2.06, 2.03, 173.26, 37.78, 7.02, 36.28, 24.88, 27.72, 5.0, 15.61, 13.84, 32.94, 19.22,
    112.68, 27.89, 188.05, 56.54, 2.95, 18.17, 34.67, 132.79, 82.73, 73.4, 31.9, 78.44, 1.27, 63.08, 106.58, 10.08, 64.23, 47.38, 181.34, 126.6, 16.15, 77.08, 16.4, 17.49, 27.81, 53.84,
    28.42, 28.64, 7.09, 34.03, 22.79, 39.48, 258.02, 41.97, 95.55, 28.45, 29.37, 30.5, 9.91, 70.83, 72.55, 14.43, 27.25, 26.81, 184.65, 141.63, 38.33, 0.37, 24.28, 2.26, 42.62, 17.74, 47.64,
]


def test_equal_signals_have_equal_reports(spark, tmp_path):
    """A task with over 128 signals merges parts of one's sums; the twin adds frames in no fixed order, so copies are compared with each other."""
    got, _ = spark_and_duck(spark, tmp_path, "pitch_report", [AT_THE_TOLERANCE] * 700)
    rows = {(metric, error, passed) for error, metric, passed, *_ in got}
    assert len(got) == 1400 and {r for r in rows if r[0] == "pitch_mean"} == {("pitch_mean", 0.15, True)} and len(rows) == 2
