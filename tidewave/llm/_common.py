"""Shared helpers: reading tables, the shared folder, written intermediate tables and file access from tasks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
_tables: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a temporary one only where it is unset and
    the driver runs all tasks itself."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewave-"))
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/tidewave-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors cost no rework."""
    bound_batches(df.sparkSession)
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    _tables.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables of which nothing is read any more: all that was made of them has been written itself."""
    for df in tables:
        _delete(df.written_to)


def _delete(path: str) -> None:
    store, inner = file_system(path)
    store.delete_dir(inner)
    _tables.remove(path)


def tables_so_far() -> int:
    """How many written tables there are now: a mark for `release`."""
    return len(_tables)


def release(mark: int, *keep: DataFrame) -> None:
    """Delete the tables written after a mark that are still there, but for those to keep. Results of operators read such tables, so
    this is for a caller who has stored what it needs of them."""
    kept = {df.written_to for df in keep}
    for path in [p for p in _tables[mark:] if p not in kept]:
        _delete(path)


_live: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps from task to task under `key`, made when first asked for. Workers outlive stages, so all
    that other keys hold is dropped then: one operator's memory at a time."""
    if key not in _live:
        _live.clear()
        made = make()
        _live[key] = made
    return _live[key]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that `df` has as columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def lean(run):
    """`run` for mapInArrow, whose worker gives its unused memory back to the system when a task ends: workers are kept for later
    tasks of other operators."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB for this session, unless its user has set a size: tasks hold a few batches at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, "8m")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def file_system(path: str):
    """The Arrow file system of a path (file, hdfs, s3...) and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_output(path: str):
    """A writable stream on a path of any file system that Arrow knows; made in tasks."""
    store, inner = file_system(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def open_input(path: str):
    """A random-access handle on such a path; local files are memory-mapped."""
    import pyarrow as pa
    from pyarrow import fs

    store, inner = file_system(path)
    return pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner)
