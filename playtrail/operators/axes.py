"""Axes of all ids from the smallest to the largest, with zeros, as intervals.

An id that occurs is an interval of one; what lies between two of them is one interval of zeros, however wide.  So
an axis of hashed 64-bit ids has at most twice as many rows as ids, and its cells and ranges can still be asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators.ordering import positions
from playtrail.scratch import through_table


def axis_intervals(counts: DataFrame, axis: str, low: int | None, high: int | None) -> DataFrame:
    """(first, last, n): the axis from ``low`` to ``high``, an interval for each id that occurs and for each gap.

    ``counts`` has ``axis`` and ``n``; ids outside the bounds and null ids are left out.  Empty if a bound is None.
    """
    empty = counts.select(F.col(axis).cast("bigint").alias("first"), F.col(axis).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")).where("false")
    if low is None or high is None or low > high:
        return empty
    totals = counts.where(F.col(axis).between(low, high)).groupBy(F.col(axis).cast("bigint").alias("id")).agg(F.sum("n").cast("bigint").alias("n"))
    placed = through_table(positions(totals, [F.asc("id")], name="place"), "axis")
    following = placed.select((F.col("place") - 1).alias("place"), F.col("id").alias("next"))
    # Between an id and the next one; the last has none and goes on to the upper bound.
    joined = placed.join(following, "place", "left")
    beyond = F.coalesce(F.col("next") - 1, F.lit(high))
    gaps = joined.where(beyond > F.col("id")).select((F.col("id") + 1).alias("first"), beyond.alias("last"), F.lit(0).cast("bigint").alias("n"))
    smallest = placed.agg(F.min("id").alias("id"))
    before = smallest.select(F.lit(low).cast("bigint").alias("first"), F.coalesce(F.col("id") - 1, F.lit(high)).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
    return placed.select(F.col("id").alias("first"), F.col("id").alias("last"), "n").unionByName(gaps).unionByName(before.where("first <= last"))


def axis_range(intervals: DataFrame, low: int, high: int) -> DataFrame:
    """The part of an axis between two ids, as intervals."""
    met = intervals.where((F.col("last") >= low) & (F.col("first") <= high))
    return met.select(F.greatest("first", F.lit(low)).alias("first"), F.least("last", F.lit(high)).alias("last"), "n")


def axis_ids(intervals: DataFrame) -> DataFrame:
    """(id, n) for every id of the intervals: for ranges that the caller has made small."""
    return intervals.select(F.explode(F.sequence("first", "last")).alias("id"), "n")


def axis_cells(intervals: DataFrame, asked: DataFrame, low: int, high: int) -> DataFrame:
    """(id, n) for given ids: their count, 0 inside the bounds, null outside."""
    known = intervals.where("n > 0").select(F.col("first").alias("id"), "n")
    found = asked.select("id").distinct().join(known, "id", "left")
    return found.select("id", F.when(F.col("id").between(low, high), F.coalesce("n", F.lit(0))).alias("n"))
