"""Helpers shared by the training-data operators: shared scratch tables, checked broadcasts, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and has no more rows than this; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own is set only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Bytes of rows that go to a Python worker at a time; a session that sets its own bound keeps it.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what executors and workers buffer between them: 10,000 rows, the usual bound, can be long texts all."""
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def stash(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = os.path.join(shared_dir(spark), "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a counted side below BROADCAST_ROWS; otherwise Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col: str, n: int):
    """crc32 of the decimal text of an id, modulo n (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def text_sha(text_col: str = "text"):
    """SHA-256 of a text, in hex; with the doc_id it names a row where an id is null or has several texts."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def drop_rows(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", sha=None) -> DataFrame:
    """The documents that are not among the rows (doc_id, sha). Columns stay as they were."""
    gone = drop.select(F.col("doc_id").alias("__drop_id"), F.col("sha").alias("__drop_sha"))
    on = docs[id_col].cast("long").eqNullSafe(F.col("__drop_id")) & ((text_sha() if sha is None else sha) == F.col("__drop_sha"))
    return docs.join(maybe_broadcast(gone, gone.count()), on, "left_anti")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut behind white space only, so that no word is split."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def doc_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about max_bytes of text (one row at least), for bounded worker memory.

    After the last one the worker, which lives on for other tasks, gives back what it no longer uses.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        start = 0
        ends = np.cumsum(sizes)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
