"""Helpers that every training-data operator uses."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}
#: The folder of the condensed() that is at work, if any.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh local one where it is unset and Spark runs in one
    process (tests); on a cluster an error, for executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="vecspark-")
    return _OWN_FOLDERS[app]


def lean_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand a batch, unless the session says otherwise: Spark's default of ten thousand is
    tens of MB on either side of each task. The setting stays, for most results are computed later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, not the stages before the table.
    """
    path = f"{_SCOPE.get() or shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def condensed(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What build() returns, as a table; the tables that it materialised on the way go once this one is written.

    Nothing refers to them by then: the lineage of the result ends at its own table.
    """
    folder = f"{_SCOPE.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.set(folder)
    try:
        out = build()
        _SCOPE.reset(scope)
        return materialise(out, name)
    finally:
        if _SCOPE.get() == folder:
            _SCOPE.reset(scope)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Memory that numpy freed goes back to the system, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` has about `limit` bytes in each; a longer text stands alone. Memory freed goes
    back to the system, for the workers of an executor share its bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        pa.default_memory_pool().release_unused()
        give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column (null: empty), and the offset of each row with the end as last."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
