"""Helpers shared by the operators' Spark plans."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.session import table, written

__all__ = ["held_out", "lean", "lowest", "materialize", "parts_for", "release_memory", "small_or_shuffled", "table"]


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    return written(df)


_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8  # fixed numbers of the C library's mallopt


def _give_back_memory() -> None:
    """Let this process return large blocks to the system as soon as they are freed.

    Python workers are reused from stage to stage and several wait beside each executor; by default
    each keeps what its largest task once needed.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is not None:
        for what, value in ((_MMAP_THRESHOLD, 4 << 20), (_TRIM_THRESHOLD, 8 << 20), (_ARENA_MAX, 2)):
            tune(what, value)


# on import, and so in every worker that runs one of the operators
_give_back_memory()


def release_memory() -> None:
    """Give back also the small blocks that earlier tasks of this worker process freed."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`fn` over batches, whose worker gives back what was freed when the partition ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return run


def parts_for(df: DataFrame, bytes_each: int = 2 << 20, least: int = 8, most: int = 1 << 26) -> int:
    """How many buckets hold about `bytes_each` bytes of a plan's estimated input size.

    The estimate comes from the plan's statistics (file sizes), without running a job; it only
    decides how finely work is cut, never which rows are handled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(most, math.ceil(size / bytes_each)))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo `mod`, equals `rest` (null ids: the empty text)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(mod) == F.lit(rest)


#: Rows that a side of a join may have to be sent to every executor.
BROADCAST_ROWS = 500_000


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a written table of narrow rows, marked for broadcast if it is counted to have at most `rows`."""
    return F.broadcast(df) if df.count() <= rows else df


def lowest(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """About `limit` rows at most: those with the smallest `key`, a 64-bit hash.

    The hash range that holds them follows from a count, so that tasks send what is needed and not
    `limit` rows each.
    """
    n = df.count()
    if n <= limit:
        return df
    share = min(1.0, (limit + 8 * math.sqrt(limit)) / n)
    return df.where(key <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy(key).limit(limit)
