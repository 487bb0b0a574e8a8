"""What the training-data operators share: paths, materialised tables, bounded joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import BROADCAST_BYTES, bounded, drop, made, mark, materialise, ready, released, scratch, size_of

__all__ = ["BROADCAST_BYTES", "bounded", "crc32", "drop", "looked_up", "made", "mark", "materialise", "partitions", "prefix", "read", "ready", "released", "relieved", "rest", "scratch", "size_of", "slices"]

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix(df: DataFrame, start: str) -> str:
    """start, with as many _ behind it as it takes that no column's name begins so."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start += "_"
    return start


def looked_up(rows: DataFrame, column: str, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows left joined to table (without n) where column equals key. table: a row for each key, and n, how many of the rows have it.

    Keys that have more than their share of rows, a quarter of what a shuffle partition holds on average, are fewer than
    four times the partitions, so these are broadcast whatever the input's size; all others are joined by a shuffle in which no key is hot."""
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    share = max(1, total // (4 * partitions(rows.sparkSession)))
    hot, rest = F.broadcast(table.filter(F.col(n) > share).drop(n)), table.filter(F.col(n) <= share).drop(n)
    some, same = F.broadcast(table.filter(F.col(n) > share).select(F.col(key).alias("_b_key"))), F.col(column) == F.col("_b_key")
    cold = rows.join(some, same, "left_anti").join(rest, F.col(column) == F.col(key), "left")
    return rows.join(hot, F.col(column) == F.col(key)).unionByName(cold)


def crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Its rows in order, about size bytes of a column of texts at a time: a slice ends with the row that fills it."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def rest(spark: SparkSession) -> None:
    """Ask executors for the heap that earlier stages used and nothing needs any more: a JVM keeps it, and what Python workers
    take of an executor's memory comes on top. One short task for each core, between stages."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("gc")).write.format("noop").mode("overwrite").save()


def relieve() -> None:
    """Give memory that a Python worker no longer uses back to its machine: workers are kept, and what one stage held would
    otherwise stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def relieved(f: Callable) -> Callable:
    """f (of one or two arguments, as Spark counts them), or the iterator it returns, and then relieve()."""

    def done(out):
        if isinstance(out, Iterator):
            return _to_its_end(out)
        relieve()
        return out

    if f.__code__.co_argcount - len(f.__defaults__ or ()) == 1:
        return wraps(f)(lambda a: done(f(a)))
    return wraps(f)(lambda a, b: done(f(a, b)))


def _to_its_end(it: Iterator) -> Iterator:
    try:
        yield from it
    finally:
        relieve()
