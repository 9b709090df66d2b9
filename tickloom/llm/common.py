"""What the operators share: reading tables, cutting lineage, bounded work inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.shipping import ship
from tickloom.functions.store import cut, scratch, shared_dir  # noqa: F401

#: Rows of an Arrow batch that carries whole texts; bounds what one Python worker holds at once.
TEXT_ROWS = 1000
#: Bytes of text that a task works on at once within a batch.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What Python tasks over whole texts need: this package on the executors, and smaller Arrow batches unless the session sets their size itself."""
    ship(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(TEXT_ROWS))


#: What a Python worker keeps from task to task: one thing at most, see ``held`` and ``tidy``.
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What ``make`` made when this worker first asked for ``key``; it is let go once a task asks for or needs another."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give the memory that this worker has freed back to the system; its allocators would keep it for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def tidy(batches: Iterator, keep: str | None = None) -> Iterator:
    """The batches of a task, each after the memory of the one before is released; of what the worker held, only ``keep`` stays."""
    for key in [k for k in _held if k != keep]:
        del _held[key]
    for batch in batches:
        yield batch
        del batch
        release()


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, or as large as they come."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.nbytes for b in kept) >= most:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept = []
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of an array of strings, each of about ``most`` bytes or a single longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


def partitions_for(rows: int, each: int, least: int = 1) -> int:
    """Partitions of about ``each`` rows."""
    return max(least, -(-rows // each))


def unsigned_hex(column) -> F.Column:
    """16 lower-case hex digits of a 64-bit column."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
