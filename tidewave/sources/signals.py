"""Signals (signal_id, sample_rate, samples array<double>) from tables whose rows are samples, and frames of signals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions.arrays import let

def from_rows(rows: DataFrame, key: str, value: str, order: list[str], sample_rate: int) -> DataFrame:
    """One signal per key, samples in the given (total) order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return rows.groupBy(F.col(key).cast("long").alias("signal_id")).agg(F.transform(ordered, lambda r: r["_v"]).alias("samples")).select("signal_id", F.lit(sample_rate).alias("sample_rate"), "samples")


def user_signals(spark: SparkSession, sf_dir: str, sample_rate: int = 1000) -> DataFrame:
    return from_rows(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "value", "ts", "event_id"), "user_id", "value", ["ts", "event_id"], sample_rate)


def supplier_signals(spark: SparkSession, sf_dir: str, sample_rate: int = 1000) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return from_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *order), "l_suppkey", "l_extendedprice", order, sample_rate)


def embedding_signals(spark: SparkSession, sf_dir: str, sample_rate: int = 22050) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("signal_id"), F.lit(sample_rate).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"))


def centered(signals: DataFrame) -> DataFrame:
    """Each signal less its own mean."""
    mean = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("samples"), F.lit(1))
    return signals.withColumn("samples", let(mean, lambda m: F.transform("samples", lambda v: v - m)))


def means_in_order(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """key and _mean of its values, added in the given order: rows come in runs of a key, and a task holds the sum so far."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, so_far, n = None, 0.0, 0
        for batch in batches:
            keys, values, done = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), []
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if b == a:
                    continue
                if keys[a] != last:
                    done += [(last, so_far / n)] if n else []
                    last, so_far, n = keys[a], 0.0, 0
                so_far, n = float(np.add.accumulate(np.append(so_far, values[a:b]))[-1]), n + int(b - a)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([m for _, m in done], pa.float64())], [key, "_mean"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([so_far / n], pa.float64())], [key, "_mean"])

    # mapInArrow reads all columns it is given; only the key and the value go there.
    runs = rows.repartition(key).sortWithinPartitions(key, *order)
    return runs.select(F.col(key).cast("long").alias(key), F.col(value).cast("double").alias(value)).mapInArrow(run, f"{key} long, _mean double")


def centered_rows(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """`centered` of rows that are samples: values less the mean of their key.

    An average of rows in any order differs from that in theirs by rounding, which changes the sign of a value that close to it. Keys that have one
    (few) get their mean in order; all others the average, so that rows of a key need not meet.
    """
    x = F.col(value).cast("double")
    means = rows.groupBy(key).agg(F.avg(x).alias("_about"), F.sum(F.abs(x)).alias("_size"))
    met = rows.join(means, key)
    close = met.where(F.abs(x - F.col("_about")) <= 1e-15 * F.col("_size")).select(key).distinct()
    exact = means_in_order(rows.join(close, key, "left_semi").where(F.col(value).isNotNull()), key, value, order)
    met = met.join(exact, key, "left")
    return met.withColumn(value, x - F.coalesce("_mean", "_about")).drop("_mean", "_about", "_size")


def to_mono(signals: DataFrame, channels: str = "channels", policy: str = "mean") -> DataFrame:
    """samples from an array of channels: their mean, or the first one."""
    if policy not in ("mean", "first"):
        raise ValueError("policy must be 'mean' or 'first'")
    if policy == "first":
        return signals.withColumn("samples", F.get(channels, F.lit(0))).drop(channels)
    zero = F.transform(F.get(channels, F.lit(0)), lambda v: F.lit(0.0))
    added = F.aggregate(channels, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return signals.withColumn("samples", F.transform(added, lambda v: v / F.size(channels))).drop(channels)


def checked(n: int, hop: int) -> None:
    if n <= 0 or hop <= 0:
        raise ValueError("frame_length and hop_length must be positive")


def frame_array(samples: Column, n: int, hop: int, pad: bool = True) -> Column:
    """Array of frames; a signal shorter than a frame is padded with zeros on the right (or has none without `pad`)."""
    checked(n, hop)
    x = F.when(F.size(samples) < n, F.concat(samples, F.array_repeat(F.lit(0.0), n - F.size(samples)))).otherwise(samples) if pad else samples
    least = 1 if pad else n

    def cut(x: Column) -> Column:
        starts = F.when(F.size(x) >= n, F.sequence(F.lit(0), F.floor((F.size(x) - n) / hop).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(x, i * hop + 1, n))

    return F.when(F.size(samples) >= least, let(x, cut)).otherwise(F.array().cast("array<array<double>>"))


def frames(signals: DataFrame, n: int, hop: int, pad: bool = True) -> DataFrame:
    """One row per frame: signal_id, sample_rate, frame_idx, frame."""
    return signals.select("signal_id", "sample_rate", F.posexplode(frame_array(F.col("samples"), n, hop, pad)).alias("frame_idx", "frame")).withColumn("frame_idx", F.col("frame_idx").cast("long"))


def points_of_rows(rows: DataFrame, key: str, value: str, order: list[str], bucket: Column) -> DataFrame:
    """Samples with their places: signal_id, size (of the signal), i (place from 0), x. No task sees a whole signal.

    `bucket` cuts a key's rows into runs along the order (an hour of the time, say): numbers within a run come from a window
    over the run, and the runs before it are prefix sums of their counts.
    """
    keyed = rows.select(F.col(key).cast("long").alias("signal_id"), *order, F.col(value).cast("double").alias("_v"), bucket.alias("_b"))
    counts = keyed.groupBy("signal_id", "_b").agg(F.count("*").alias("_n"))
    signal = Window.partitionBy("signal_id")
    runs = counts.select("signal_id", "_b", (F.sum("_n").over(signal.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(signal).alias("size"))
    within = F.row_number().over(Window.partitionBy("signal_id", "_b").orderBy(*order)) - 1
    return keyed.withColumn("_i", within).join(runs, ["signal_id", "_b"]).select("signal_id", "size", (F.col("_i") + F.col("_before")).alias("i"), F.col("_v").alias("x"))


def points_of(signals: DataFrame) -> DataFrame:
    """The same of signals that are arrays."""
    return signals.select("signal_id", F.size("samples").cast("long").alias("size"), F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def frames_of_points(points: DataFrame, n: int, hop: int, sample_rate: int = 0, pad: bool = True) -> DataFrame:
    """The frames of `frames` from samples with their places: each sample goes to the frames it falls in."""
    checked(n, hop)
    last = F.floor((F.greatest("size", F.lit(n)) - n) / hop)
    first = F.greatest(F.ceil((F.col("i") - n + 1) / hop), F.lit(0))
    until = F.least(F.floor(F.col("i") / hop), last)
    points = points if pad else points.where(F.col("size") >= n)
    spread = points.where(first <= until).select("signal_id", F.explode(F.sequence(first, until)).alias("frame_idx"), F.col("i").alias("_i"), F.col("x").alias("_v"))
    grouped = spread.groupBy("signal_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s"))
    values = F.transform("_s", lambda s: s["_v"])
    frame = F.concat(values, F.array_repeat(F.lit(0.0), n - F.size("_s")))
    return grouped.select("signal_id", F.lit(sample_rate).alias("sample_rate"), "frame_idx", frame.alias("frame"))


def frames_of_rows(rows: DataFrame, key: str, value: str, order: list[str], bucket: Column, n: int, hop: int, sample_rate: int = 0) -> DataFrame:
    """The frames of `frames`, straight from rows that are samples, for signals too long for one row or task: a task sees single runs
    and frames. A signal shorter than a frame gives one, padded with zeros."""
    return frames_of_points(points_of_rows(rows, key, value, order, bucket), n, hop, sample_rate)


def blocks_of_points(points: DataFrame, length: int) -> DataFrame:
    """Disjoint runs of `length` samples, the last one of a signal as long as it is: signal_id, block, samples."""
    rows = points.groupBy("signal_id", F.floor(F.col("i") / length).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_s"))
    return rows.select("signal_id", "block", F.transform("_s", lambda s: s["x"]).alias("samples"))


def halo_blocks(points: DataFrame, length: int, before: int, after: int) -> DataFrame:
    """Runs of `length` samples with the samples `before` and `after` them: signal_id, size, block, at (places from block * length - before on), x."""
    last = F.floor((F.col("size") - 1) / length)
    first, until = F.greatest(F.floor((F.col("i") - after) / length), F.lit(0)), F.least(F.floor((F.col("i") + before) / length), last)
    rows = points.select("signal_id", "size", "i", "x", F.explode(F.sequence(first, until)).alias("block"))
    held = rows.groupBy("signal_id", "size", "block").agg(F.collect_list(F.struct((F.col("i") - F.col("block") * length + before).cast("int").alias("at"), "x")).alias("_s"))
    return held.select("signal_id", "size", "block", F.transform("_s", lambda s: s["at"]).alias("at"), F.transform("_s", lambda s: s["x"]).alias("x"))


def scattered(at, x, size: int):
    """The values of a row of `halo_blocks` at their places in an array of zeros."""
    import numpy as np

    out = np.zeros(size)
    out[np.asarray(at.values)] = np.asarray(x.values)
    return out


def samples_long(signals: DataFrame) -> DataFrame:
    """One row per sample: signal_id, sample_rate, n, x."""
    return signals.select("signal_id", "sample_rate", F.posexplode("samples").alias("n", "x")).withColumn("n", F.col("n").cast("long"))
