"""Sums of small arrays over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays added up in one task, and those that reach the driver at most.
TREE = 32

_SCHEMA = "part bigint, data binary"


def tree_sum(df: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], tasks: int | None = None) -> np.ndarray | None:
    """The sum of one flat array of doubles per task, in an order that does not depend on when tasks end.

    ``sums`` gets a task's batches and returns its array, or None without rows.  Arrays are added up in rounds of
    ``TREE`` a task until at most ``TREE`` are left for the driver.  ``tasks`` is the number of tasks that
    read ``df``; it is counted if not given.  None for an empty table.
    """
    tasks = tasks or task_count(df)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums(batches)
        if total is not None:
            yield _row(TaskContext.get().partitionId(), total)

    def added(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["data"].to_pylist(), strict=True))
        return pa.Table.from_batches([_row(rows[0][0] // TREE, sum(np.frombuffer(d, "<f8") for _, d in rows))])

    parts = df.mapInArrow(partial, _SCHEMA)
    while tasks > TREE:
        parts = parts.groupBy(F.floor(F.col("part") / TREE).alias("_g")).applyInArrow(added, _SCHEMA)
        tasks = -(-tasks // TREE)
    rows = sorted((r["part"], bytes(r["data"])) for r in parts.collect())
    return sum(np.frombuffer(d, "<f8") for _, d in rows) if rows else None


def task_count(df: DataFrame) -> int:
    """One more than the highest number of a task that reads ``df``."""
    return 1 + (df.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0)


def _row(part: int, total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "data"])
