"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a temporary one only where it is unset and
    the driver runs all tasks itself."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewave-"))
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/tidewave-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors cost no rework."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    _tables.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def file_system(path: str):
    """The Arrow file system of a path (file, hdfs, s3...) and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _delete(path: str) -> None:
    store, inner = file_system(path)
    store.delete_dir(inner)
    _tables.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables of which nothing is read any more: all that was made of them has been written itself."""
    for df in tables:
        _delete(df.written_to)


def tables_so_far() -> int:
    """How many written tables there are now: a mark for `release`."""
    return len(_tables)


def release(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written after a mark that are still there, but for those to keep. Results of operators read such tables, so
    this is for a caller who has stored what it needs of them."""
    kept = {df.written_to for df in keep}
    for path in [p for p in _tables[mark:] if p not in kept]:
        _delete(path)
