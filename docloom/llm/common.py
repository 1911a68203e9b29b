"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local master gets a folder of
    its own; a cluster an error, as no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    for df in written:
        spark, path = df.sparkSession, getattr(df, "_written_to", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shielded(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns under names that clash with nothing, beside text; and those names."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text")), names


def restored(docs: DataFrame, names: list[str]) -> list[Column]:
    """The columns of ``docs`` out of a shielded frame."""
    return [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def held_out_py(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def sample_order(doc_id: Column) -> Column:
    """A uniform number in [0, 1) that depends on the id only."""
    h = F.crc32(F.concat(F.lit("fit:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return h / F.lit(float(2**32))


def release(spark: SparkSession | None = None) -> None:
    """Gives freed memory back: this process's, and the driver's JVM's if a session is given."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
    if spark is not None and hasattr(spark, "_jvm"):
        spark._jvm.System.gc()


def tidy(apply):
    """A function for mapInArrow that gives its worker's freed memory back at the end of a task: workers outlive their tasks,
    and those of several stages wait side by side in one executor."""

    def run(batches):
        try:
            yield from apply(batches)
        finally:
            release()

    return run


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string or binary column, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)

