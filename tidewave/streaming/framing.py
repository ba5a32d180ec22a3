"""Features of streams: frames over keyed state, and functionals over event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators.stats import moments


def frame_stream(stream: DataFrame, key: str, order: str, value: str, n: int, hop: int, feature: Callable, idle_seconds: int | None = None) -> DataFrame:
    """feature(frame) for every full frame of every key: key, frame_idx, value.

    State per key is the tail that no frame has used up, and the next frame's number. Rows of a micro-batch are put in order
    of `order`; rows that come after their place was used count where they arrive. An incomplete tail gives no frame. With
    `idle_seconds`, a key that has had no rows for so long loses its state; rows that come later start it anew.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import numpy as np

        if state.hasTimedOut:
            state.remove()
            return
        tail, at = state.get if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        held = np.concatenate([np.asarray(tail, float), rows[value].to_numpy(float)])
        count = max(0, (len(held) - n) // hop + 1)
        out = [feature(held[i * hop : i * hop + n]) for i in range(count)]
        state.update((held[count * hop :].tolist(), at + count))
        if idle_seconds:
            state.setTimeoutDuration(1000 * idle_seconds)
        yield pd.DataFrame({key: [group[0]] * count, "frame_idx": np.arange(at, at + count), "value": np.asarray(out, float)})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, frame_idx long, value double", "tail array<double>, at long", "append", "ProcessingTimeTimeout" if idle_seconds else "NoTimeout")


def window_functionals(stream: DataFrame, time: str, value: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """count and functionals per event-time window and key; with `late`, rows that far behind the newest are dropped and windows close."""
    rows = stream.withWatermark(time, late) if late else stream
    grouped = rows.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys)
    out = grouped.agg(F.count("*").alias("n"), *[c.alias(s) for s, c in moments(F.col(value)).items()])
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap: key, session_start, session_end (last row plus gap), n."""
    rows = stream.withWatermark(time, late) if late else stream
    out = rows.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is there now and return it: Parquet output and checkpoint below `folder`."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, as a stream reads folders or patterns
