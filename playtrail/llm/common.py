"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.shipping import ship

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch handed to Python: texts are long, and two batches of each task are in memory on both sides.
#: Buffers of several megabytes also stay with the executor's allocator when they are freed.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and keep batches of texts small for this session."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened where ``df`` has such a column already."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unit(seed: int, *cols: Column) -> Column:
    """A number strictly between 0 and 1 drawn from the hash of the columns."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (h.cast("double") + 0.5) / float(2**53)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that, at its end, gives freed memory back to the system.

    Workers live on between tasks and stages, beside an executor whose heap has grown; what one task needed
    for its texts would otherwise stay with its worker.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
            if trim is not None:
                trim(0)

    return wrapped
