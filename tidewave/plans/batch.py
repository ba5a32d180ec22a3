"""Feature rows of a folder of audio files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.plans.extract import extract_core
from tidewave.sources import files
from tidewave.sources.signals import to_mono


def folder_signals(spark: SparkSession, folder: str, sample_rate: int) -> tuple[DataFrame, DataFrame]:
    """(signals with their path, rows of files that failed: path, error). Files are brought to one rate and one channel.

    The distinct rates of the files, a handful, are all that the driver sees.
    """
    loaded = files.load_audio(files.audio_files(spark, folder)).withColumn("signal_id", F.xxhash64("path"))
    good = to_mono(loaded.where("error is null").select("path", "signal_id", "sample_rate", "channels")).where(F.size("samples") > 0)
    rates = [r["sample_rate"] for r in good.select("sample_rate").distinct().collect()]
    parts = [good.where(F.col("sample_rate") == r).withColumn("samples", files.resample(F.col("samples"), r, sample_rate)) for r in rates]
    signals = reduce(DataFrame.unionByName, parts) if parts else good
    return signals.withColumn("sample_rate", F.lit(sample_rate)), loaded.where("error is not null").select("path", "error")


def extract_folder(spark: SparkSession, folder: str, sample_rate: int = 22050, n: int = 2048, hop: int = 512) -> tuple[DataFrame, DataFrame]:
    """(feature rows with their path, rows of files that failed: path, error)."""
    signals, errors = folder_signals(spark, folder, sample_rate)
    rows = extract_core(signals.drop("path"), sample_rate, n, hop)
    return rows.join(signals.select("signal_id", "path"), "signal_id").drop("signal_id"), errors
