"""Comparison reports: metrics of two sides joined by name, relative errors, tolerances and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pitch floor, pitch ceiling, highest formant, and the tolerances of four metrics, by speaker profile.
PROFILES = {
    "male": (75.0, 300.0, 5000.0, 0.15, 0.15, 0.20, 0.35),
    "female": (100.0, 500.0, 5500.0, 0.15, 0.15, 0.20, 0.40),
    "child": (120.0, 600.0, 8000.0, 0.20, 0.20, 0.25, 0.45),
    "neutral": (75.0, 600.0, 5500.0, 0.15, 0.15, 0.20, 0.40),
}
METRICS = ("pitch_mean", "pitch_median", "formant_f1", "formant_f2")


def tolerances(spark: SparkSession, profile: str = "neutral") -> DataFrame:
    """metric and tolerance of a speaker profile."""
    if profile not in PROFILES:
        raise ValueError(f"unknown speaker profile {profile!r}")
    return spark.createDataFrame(list(zip(METRICS, PROFILES[profile][3:], strict=True)), "metric string, tolerance double")


def relative_error(value: Column, reference: Column) -> Column:
    """|value - reference| over |reference| (at least 1e-8); null unless both are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(value) & finite(reference), F.abs(value - reference) / F.greatest(F.abs(reference), F.lit(1e-8)))


def compare(measured: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value, reference, error from two relations (keys, metric, value); either side may lack a metric."""
    b = reference.withColumnRenamed("value", "reference")
    return measured.join(b, [*keys, "metric"], "full_outer").withColumn("error", relative_error(F.col("value"), F.col("reference")))


def evaluate(report: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Checks per metric: within its tolerance; a metric that both sides lack is skipped and passes, one that one lacks fails."""
    checks = report.join(F.broadcast(limits), "metric")
    skipped = F.col("value").isNull() & F.col("reference").isNull()
    return checks.withColumn("skipped", skipped).withColumn("passed", skipped | F.coalesce(F.col("error") <= F.col("tolerance"), F.lit(False))).select(*keys, "metric", "error", "tolerance", "skipped", "passed")


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all checks passed, and the score: the share of points earned of those not skipped, in percent."""
    counted = F.sum((~F.col("skipped")).cast("int"))
    earned = F.sum((~F.col("skipped") & F.col("passed")).cast("int"))
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.when(counted > 0, F.round(100.0 * earned / counted, 4)).alias("score"))


def profile(name: str = "neutral") -> dict[str, float]:
    """Pitch floor, pitch ceiling and highest formant of a speaker profile."""
    if name not in PROFILES:
        raise ValueError(f"unknown speaker profile {name!r}")
    return dict(zip(("pitch_floor", "pitch_ceiling", "max_formant"), PROFILES[name][:3], strict=True))


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """metric, value from a JSON file of the form {"pitch": {"mean_hz": .., "median_hz": ..}, "formants": {"f1": .., ..}}; numbers
    only, `_hz` dropped from names. A missing block gives no rows. The two may stand within one block `praat` at the top."""
    text = spark.read.text(path, wholetext=True).select("value")
    inner = F.coalesce(F.get_json_object("value", "$.praat"), F.col("value"))
    blocks = text.select(F.from_json(inner, "pitch map<string,string>, formants map<string,string>").alias("r"))
    rows = lambda block, prefix: blocks.select(F.explode(f"r.{block}").alias("k", "v")).select(F.concat(F.lit(prefix), F.regexp_replace(F.lower("k"), "_hz$", "")).alias("metric"), F.col("v").try_cast("double").alias("value"))
    return rows("pitch", "pitch_").union(rows("formants", "formant_")).where("value is not null")


def reference_metrics(signals: DataFrame, sample_rate: int, n: int = 2048, hop: int = 512, name: str = "neutral", order: int = 12) -> DataFrame:
    """signal_id, metric, value: mean, median and voiced share of the pitch, and median formants, within a speaker profile."""
    from tidewave.operators import formants, pitch

    limits = profile(name)
    top = min(limits["max_formant"], sample_rate / 2)
    f0 = pitch.yin(pitch.frame_autocorrelation(signals, n, hop), n, sample_rate, limits["pitch_floor"], limits["pitch_ceiling"])
    voiced = F.when(F.col("f0") > 0, F.col("f0"))
    tones = f0.groupBy("signal_id").agg(F.avg(voiced).alias("pitch_mean"), F.median(voiced).alias("pitch_median"), F.avg((F.col("f0") > 0).cast("double")).alias("pitch_voiced_ratio"))
    slower, rate = formants.at_formant_rate(signals, sample_rate, top)
    size, step = (max(1, x * rate // sample_rate) for x in (n, hop))
    medians = formants.frequencies(formants.contours(formants.candidates(slower, rate, order, size, step, top), 3, top))
    rows = tones.unpivot("signal_id", ["pitch_mean", "pitch_median", "pitch_voiced_ratio"], "metric", "value")
    return rows.union(medians.select("signal_id", F.concat(F.lit("formant_f"), F.col("formant").cast("string")).alias("metric"), F.col("freq").alias("value")))


def compare_with_reference(signals: DataFrame, reference: DataFrame, sample_rate: int, n: int = 2048, hop: int = 512, name: str = "neutral") -> DataFrame:
    """Checks of every signal against one reference (metric, value): signal_id, metric, error, tolerance, skipped, passed."""
    spark = signals.sparkSession
    every = signals.select("signal_id").join(F.broadcast(reference.where(F.col("metric").isin(*METRICS)).dropDuplicates(["metric"])))  # four rows at most
    measured = reference_metrics(signals, sample_rate, n, hop, name).where(F.col("metric").isin(*METRICS))
    return evaluate(compare(measured, every, ["signal_id"]), tolerances(spark, name), ["signal_id"])
