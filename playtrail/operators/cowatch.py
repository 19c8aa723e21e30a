"""Distinct pairs of titles watched by the same users, counted exactly on a grid of title blocks.

Titles are numbered and cut into blocks, as few as a meeting of two blocks can count at a time.  A user's titles of two blocks
travel as one row to the meeting of these blocks: no pair is shuffled.  A meeting lists its users' pairs in pieces of ``PAIRS``
numbers, adds equal ones up, and gives one row per pair; a row needs no further counting, so pairs below the threshold
stay there.  A meeting with more different pairs than it may hold gives partial counts and begins again, and meetings of
blocks with many users are dealt over several tasks by a hash of the user; both are added up afterwards.

With a threshold on the count, titles with fewer users are left out before: no pair of theirs can reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators.ordering import dense_index
from playtrail.scratch import through_table

#: Titles of a block at least, users listed at a time, and users of a meeting that go to one task, about.
BLOCK, USERS, PER_TASK = 512, 16_384, 1_000_000
#: Pairs that a meeting has on average, lists at a time, and holds at most.
MEETING, PAIRS, HELD = 8_000_000, 4_000_000, 16_000_000

_COUNTS = "x bigint, y bigint, n bigint"


def _listed(left: np.ndarray, l_sizes: np.ndarray, right: np.ndarray, r_sizes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Numbers ``left * width + right`` of all pairs of every row's two lists, at most about ``PAIRS`` at a time."""
    times = np.repeat(r_sizes, l_sizes)  # every left title meets all right ones of its row
    begin = np.repeat(np.cumsum(r_sizes) - r_sizes, l_sizes)
    ends = np.cumsum(times)
    lo = 0
    while lo < len(left):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        own = times[lo:hi]
        at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own - begin[lo:hi], own)
        yield np.repeat(left[lo:hi] * width, own) + right[at]
        lo = hi


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def cowatch_pairs(seen: DataFrame, least: int = 1, user_col: str = "customer_id", block: int | None = None, per_task: int = PER_TASK) -> DataFrame:
    """(content_id, other_id, n): pairs of titles, the smaller id first, that at least ``least`` users have both watched.

    ``seen`` has a row per user and title; repeated rows count once, nulls are left out.
    """
    rows = seen.select(F.col(user_col).alias("user"), "content_id").where("user IS NOT NULL AND content_id IS NOT NULL").distinct()
    rows = through_table(rows, "seen")
    titles = rows.groupBy("content_id").count().where(F.col("count") >= least)
    index = through_table(dense_index(titles), "titles")
    placed = through_table(rows.join(index, "content_id").select("user", "idx"), "placed")
    n, pairs = index.count(), placed.groupBy("user").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    # How the work is dealt: the result does not depend on it.
    block = block or max(BLOCK, -(-n // max(1, math.isqrt(int(2 * pairs / MEETING)))))
    kept = placed.select("user", F.floor(F.col("idx") / block).cast("int").alias("block"), F.pmod("idx", F.lit(block)).cast("int").alias("place"))
    packed = through_table(kept.groupBy("user", "block").agg(F.collect_list("place").alias("places")), "packed")
    dealt = packed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("salts"))
    sides = packed.join(dealt, "block")
    one, two = (sides.select("user", *[F.col(c).alias(c + side) for c in ("block", "places", "salts")]) for side in "ab")
    # A user's titles of one block meet each other in one list.
    cells = one.join(two, "user").where("blocka <= blockb").select(
        F.col("blocka").alias("a"), F.col("blockb").alias("b"), F.least("saltsa", "saltsb").cast("int").alias("salts"),
        F.pmod(F.xxhash64("user"), F.least("saltsa", "saltsb")).cast("int").alias("salt"),
        F.col("placesa").alias("l"), F.when(F.col("blocka") < F.col("blockb"), F.col("placesb")).otherwise(F.array().cast("array<int>")).alias("r"),
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(parts, "a", "b", "salt").sortWithinPartitions("a", "b", "salt")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, whole = None, True
        keys, counts, fresh, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def add() -> None:
            nonlocal keys, counts, fresh, waiting
            if fresh:
                keys, counts = _added(np.concatenate([keys, *fresh]), np.concatenate([counts, np.ones(waiting, np.int64)]))
                fresh, waiting = [], 0

        def counted(end: bool) -> pa.RecordBatch:
            nonlocal keys, counts, whole
            whole = whole and end
            enough = counts >= least if whole and cell[2] == 1 else np.ones(len(counts), bool)
            columns = [cell[0] * block + keys[enough] // block, cell[1] * block + keys[enough] % block, counts[enough]]
            keys, counts = keys[:0], counts[:0]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["x", "y", "n"])

        for batch in batches:
            a, b, salts, salt = (batch.column(i).to_numpy() for i in range(4))
            lists = [batch.column(i) for i in (4, 5)]
            sizes = [np.diff(c.offsets.to_numpy()) for c in lists]
            values = [c.flatten().to_numpy().astype(np.int64) for c in lists]
            ends = [np.r_[0, np.cumsum(s)] for s in sizes]
            changes = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (salt[1:] != salt[:-1])) + 1
            cuts = np.r_[0, changes, len(a)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                key = (int(a[lo]), int(b[lo]), int(salts[lo]), int(salt[lo]))
                if key != cell:
                    if cell is not None:
                        add()
                        yield counted(True)
                    cell, whole = key, True
                for at in range(lo, hi, USERS):
                    to = min(hi, at + USERS)
                    left, l_sizes = values[0][ends[0][at] : ends[0][to]], sizes[0][at:to]
                    own = (left, l_sizes) if key[0] == key[1] else (values[1][ends[1][at] : ends[1][to]], sizes[1][at:to])
                    for found in _listed(left, l_sizes, *own, block):
                        if key[0] == key[1]:
                            found = found[found // block < found % block]
                        fresh.append(found)
                        waiting += len(found)
                        if waiting >= PAIRS:
                            add()
                        if len(keys) > HELD:
                            yield counted(False)
        if cell is not None:
            add()
            yield counted(True)

    counts = ordered.select("a", "b", "salts", "salt", "l", "r").mapInArrow(multiply, _COUNTS)
    summed = counts.groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    low, high = (index.select(F.col("idx").alias(i), F.col("content_id").alias(c)) for i, c in (("x", "content_id"), ("y", "other_id")))
    return summed.join(low, "x").join(high, "y").select("content_id", "other_id", "n")
