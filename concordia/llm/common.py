"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.session import ensure_checkpoint_dir


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the session's shared checkpoint folder and
    read it back. Every reader then sees one fixed copy that outlives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the plan runs once, so its shuffle files can go at once
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """stage() with the rows dealt to buckets by ``key``: no later join by it shuffles them again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/stages/{table}"
    (df.limit(0).write.format("parquet").bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table))
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.repartition(buckets, key).write.insertInto(table)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.table(table)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give the memory that a task freed back to the system: Python workers outlive their tasks,
    and what their allocators keep would count against the next task's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, with release() at its end."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def released_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over a group, with release() at its end."""
    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return group


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id,
                              F.lit("")).cast("binary")) % m


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Cells of a string or binary column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Cells as str; null counts as empty, bytes that are no UTF-8 become U+FFFD."""
    return [b.decode("utf-8", "replace") for b in as_bytes(column)]


def byte_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``limit`` bytes (one row at least, none dropped)."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def list_array(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and each row's end."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow binary column from flat bytes and each row's end."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()),
                                                          pa.py_buffer(data.tobytes())])


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads the bits of 64-bit keys."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ship(__name__)
