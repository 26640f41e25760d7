"""Row identity, shared intermediate tables and Arrow access for the operators here."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import run_folder


# What a Python worker is sent at a time: it makes arrays several times as large.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers of jobs run inside get batches of bounded size, or one longer row."""
    before = spark.conf.get(_BATCH_LIMIT)
    spark.conf.set(_BATCH_LIMIT, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH_LIMIT, before)


def release() -> None:
    """Give memory that is free but still held by the allocators back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in the GNU library only
    if trim:
        trim(0)


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over batches, after which its Python worker is small again.

    Spark keeps workers for later tasks. One that has made large arrays would hold their
    room while it is idle, beside the JVM and the workers of the steps that follow.
    """

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def stash(df: DataFrame, purpose: str, *parts: str) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    Cuts the lineage like a checkpoint, in compressed Parquet: lost executors
    do not matter afterwards, and a table used twice is computed once. It is
    written in ``small_batches``.
    """
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    with small_batches(spark):
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    # shuffle files of finished steps go when the driver's JVM finds their plans unused
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.stashed_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables whose readers are all written themselves, so that nothing asks for them again."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.stashed_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, th, text): an id that repeats or is NULL is told apart by ``th``, a hash of the text.

    Rows with equal id and equal text are the same in every respect, so
    whatever is found for one of them holds for the others.
    """
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(whole_text(text_col)).alias("th"),
        whole_text(text_col).alias("text"),
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["th"] == right["th"])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without NULLs, not copied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    size = len(column)
    if size == 0 or offsets is None:
        return np.zeros(size + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + size + 1].astype(np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def segments(offsets: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut rows into pieces of about ``limit`` units: (first row, end row, from, to).

    Short rows share a piece. A long row is cut, with ``overlap`` units repeated,
    so that every run of overlap + 1 units lies in exactly one piece.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        low, high = int(offsets[row]), int(offsets[row + 1])
        if high - low > limit + overlap:
            for at in range(low, high - overlap, limit):
                yield row, row + 1, at, min(high, at + limit + overlap)
            row += 1
        else:
            end = int(np.searchsorted(offsets, low + limit + overlap, "right")) - 1
            end = min(max(end, row + 1), rows)
            yield row, end, low, int(offsets[end])
            row = end


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, th): all columns in one struct, so that no name of theirs can clash."""
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("th")
    )


def in_row(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The carried columns again, some of them replaced."""
    return [(replaced[c] if c in replaced else in_row(c)).alias(c) for c in columns]
