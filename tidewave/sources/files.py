"""Audio files as signals, and flat feature rows as files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.sources.signals import halo_blocks, scattered

#: Suffixes taken for audio, and the first bytes of files that stand in for missing audio.
SUFFIXES = ("wav", "flac", "mp3", "ogg", "m4a")
OTHERS = {b"fLaC": "FLAC", b"OggS": "Ogg", b"ID3": "MP3", b"\xff\xfb": "MP3", b"ftyp": "M4A"}
PLACEHOLDERS = ("404:", "File not found:", "version https://git-lfs.github.com/spec/")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of all audio files below a folder, whatever the case of their suffix. Order by path where it matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)).select("path", "length", "content")


def _decode(content: bytes) -> tuple[int | None, list[list[float]] | None, str | None]:
    """Sample rate, channels and error of WAV data with 8, 16, 24 or 32 bit samples; full scale is 1. Other formats have no decoder here."""
    import io
    import wave

    import numpy as np

    for begin, kind in OTHERS.items():
        if content[: len(begin)] == begin or content[4 : 4 + len(begin)] == begin:
            return None, None, f"no decoder for {kind} files, only for WAV"

    try:
        with wave.open(io.BytesIO(content)) as w:
            width, raw = w.getsampwidth(), w.readframes(w.getnframes())
            if width == 1:
                x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
            elif width == 3:
                b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
            else:
                x = np.frombuffer(raw, f"<i{width}").astype(float) / float(1 << (8 * width - 1))
            return w.getframerate(), x.reshape(-1, w.getnchannels()).T.tolist(), None
    except (wave.Error, EOFError, ValueError) as e:
        return None, None, f"cannot decode: {e or 'truncated'}"


def load_audio(files: DataFrame) -> DataFrame:
    """path, sample_rate, channels (array of arrays) and error of files with binary content. An undecodable file is a row with an error."""

    @F.pandas_udf("sample_rate int, channels array<array<double>>, error string")
    def decode(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decode(c) for c in content], columns=["sample_rate", "channels", "error"])

    head = F.substring("content", 1, 64).cast("string")
    hint = F.when(F.greatest(*[head.startswith(p).cast("int") for p in PLACEHOLDERS]) == 1, F.lit(" (the file is a placeholder, not audio)")).otherwise("")
    return files.select("path", decode("content").alias("d"), hint.alias("hint")).select("path", "d.sample_rate", "d.channels", F.concat("d.error", "hint").alias("error"))


def _kernel(source: int, target: int, width: int, rolloff: float):
    """Filters of windowed-sinc resampling (one per phase), their reach and the steps up and down."""
    import numpy as np

    g = math.gcd(source, target)
    up, down = target // g, source // g
    cutoff = min(source, target) / g * rolloff
    reach = math.ceil(width * down / cutoff)
    idx = np.arange(-reach, reach + down)[None, :] / down
    t = np.clip((idx - np.arange(up)[:, None] / up) * cutoff, -width, width)
    return np.sinc(t) * np.cos(t * np.pi / width / 2) ** 2 * cutoff / down, reach, up, down


def resample_points(points: DataFrame, source: int, target: int, width: int = 6, rolloff: float = 0.99, per: int = 4096) -> DataFrame:
    """`resample` of samples with their places (`sources.signals`), for signals of any length: every block of about `per` samples reads the kernel's
    reach from its neighbours, so the result does not depend on the cut: signal_id, size, i, x."""
    if source == target:
        return points
    _, reach, up, down = _kernel(source, target, width, rolloff)
    length = max(1, per // down) * down

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kernel = _kernel(source, target, width, rolloff)[0]
        for batch in batches:
            for row in range(batch.num_rows):
                x = scattered(batch.column("at")[row], batch.column("x")[row], length + 2 * reach + down)
                y = (np.lib.stride_tricks.sliding_window_view(x, kernel.shape[1])[::down][: length // down] @ kernel.T).reshape(-1)
                first, size = batch.column("block")[row].as_py() * (length // down) * up, math.ceil(batch.column("size")[row].as_py() * up / down)
                y = y[: max(0, size - first)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), batch.column("signal_id")[row].as_py(), np.int64)), pa.array(np.full(len(y), size, np.int64)), pa.array(first + np.arange(len(y))), pa.array(y)], ["signal_id", "size", "i", "x"])

    return halo_blocks(points, length, reach, reach + down).mapInArrow(run, "signal_id long, size long, i long, x double")


def resample(samples: Column, source: int, target: int, width: int = 6, rolloff: float = 0.99) -> Column:
    """Windowed-sinc resampling of arrays from one rate to another; no change for equal rates."""
    if source == target:
        return samples

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        import numpy as np

        kernel, reach, up, down = _kernel(source, target, width, rolloff)

        def one(x):
            x = np.asarray(x, float)
            padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + down)])
            frames = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[1])[::down]
            return (frames @ kernel.T).reshape(-1)[: math.ceil(len(x) * up / down)]

        return batch.map(one)

    return run(samples)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double columns as null, for sinks that have no such numbers."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """Feature rows with a header of all columns in alphabetical order; an error if there are none."""
    if rows.isEmpty():
        raise ValueError("no feature rows to write")
    rows.select(*sorted(rows.columns)).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    nan_to_null(rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
