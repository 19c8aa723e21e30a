"""A reproducible shuffle into shards, computed from global row numbers.

Row numbers 0..n-1 follow the ids.  A keyed permutation of 0..n-1 puts row r at place p:
shard ``p mod shards``, slot ``p div shards``.  Anyone who knows n and the key can compute both.

The permutation is a Feistel network on pairs (left, right) of ``a`` times ``b`` numbers, with
``a * b`` the least product not below n: rounds add a keyed hash of one half to the other.  A place
outside 0..n-1 is sent through the network again until it falls inside (cycle walking), which
keeps the whole map one to one.  Fewer than a + b places lie outside, so few rows walk at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import fresh
from playtrail.operators.ordering import positions

ROUNDS = 6
#: More steps than any walk takes; a longer one ends the job instead of giving a wrong place.
MAX_STEPS = 64


def _halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(place: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass through the network: a permutation of 0..a*b-1."""
    a, b = _halves(n)
    state = F.struct(F.expr("0L").alias("l"), F.expr("0L").alias("r"))
    state = F.struct(F.floor(place / b).cast("bigint").alias("l"), F.pmod(place, F.lit(b)).cast("bigint").alias("r"))

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), k, right), F.lit(a)), F.lit(a)).cast("bigint")
        odd = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), k, left), F.lit(b)), F.lit(b)).cast("bigint")
        return F.struct(
            F.when(k % 2 == 0, even).otherwise(left).alias("l"), F.when(k % 2 == 0, right).otherwise(odd).alias("r")
        )

    last = F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), state, step)
    return last["l"] * b + last["r"]


def permuted(row: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The place of row number ``row`` in the shuffled order of ``n`` rows."""
    a, b = _halves(n)
    outside = a * b - n  # a walk meets each place outside at most once
    first = feistel(row, n, seed, rounds)
    if outside == 0:
        return first
    steps = F.array(*[F.lit(i) for i in range(min(outside, MAX_STEPS))])
    walked = F.aggregate(steps, first, lambda p, _: F.when(p < n, p).otherwise(feistel(p, n, seed, rounds)))
    return walked


def shard_rows(
    df: DataFrame, key: str, shards: int, seed: int = 7, ties: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``df`` with row_number, shard and slot, and the names of these columns.

    Rows are numbered by ``key``, nulls first, ties by ``ties``; rows equal in all of these may be
    numbered in any order.  Shards' row counts differ by one at most and slots run without gaps
    from 0.  Numbering is a range sort with one offset per partition boundary.  A name that ``df``
    has already is lengthened by underscores.  An empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    names = dict(zip(("row_number", "shard", "slot"), fresh(df, "row_number", "shard", "slot"), strict=True))
    place = fresh(df, "_place")[0]
    # Renamed for the numbering, whose helper columns have names of their own.
    inner = [f"c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, inner, strict=True))
    plain = df.toDF(*inner)
    order = [F.asc_nulls_first(at[c]) for c in (key, *ties)]
    numbered = positions(plain, order, name="number")
    n = numbered.count()
    numbered = numbered.withColumn("number", F.col("number") - 1)
    out = numbered.select(*[F.col(i).alias(c) for c, i in at.items()], F.col("number").alias(names["row_number"]))
    out = out.withColumn(place, permuted(F.col(names["row_number"]), max(n, 1), seed))
    checked = F.when(F.col(place) < n, F.col(place)).otherwise(F.raise_error(F.lit("a cycle walk was too long")))
    out = out.withColumn(place, checked.cast("bigint"))
    out = out.withColumn(names["shard"], F.pmod(F.col(place), F.lit(shards)).cast("int"))
    out = out.withColumn(names["slot"], F.floor(F.col(place) / shards).cast("bigint")).drop(place)
    return out, names


def write_shards(df: DataFrame, path: str, key: str, shards: int, seed: int = 7) -> None:
    """Write one folder of Parquet files per shard, in slot order."""
    out, names = shard_rows(df, key, shards, seed)
    (
        out.repartition(shards, names["shard"])
        .sortWithinPartitions(names["shard"], names["slot"])
        .write.partitionBy(names["shard"])
        .parquet(path)
    )
