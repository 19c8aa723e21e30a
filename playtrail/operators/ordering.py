"""Ranks, positions and running totals.

Groups of unknown size are numbered by range partitioning: a hot group is spread over as
many tasks as it needs, and only one offset per partition boundary is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.scratch import pin, through_table

_PART, _N, _ROW = "_part", "_n", "_row"


def positions(
    df: DataFrame,
    order: list[Column],
    keys: list[str] = (),
    name: str = "pos",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Number the rows 1..n in ``order`` (within ``keys``, if given), without a single-task sort.

    ``sums`` maps an output name to a column whose running total, current row included,
    is wanted in the same order.  The order must be total, ties broken by an id.
    """
    sums, keys = sums or {}, list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c) for c in keys], *order]
    # The bucket of a row depends on sampled bounds, so it is fixed before being used twice.
    ranged = pin(
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn(_ROW, F.monotonically_increasing_id())
        .withColumn(_PART, F.spark_partition_id())
    )
    totals = ranged.groupBy(_PART, *keys).agg(
        F.count(F.lit(1)).alias(_N), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PART,
        *keys,
        F.sum(_N).over(earlier).alias("_skip"),
        *[F.sum(f"_t_{o}").over(earlier).alias(f"_s_{o}") for o in sums],
    ).where(F.col("_skip").isNotNull())
    # One row per partition boundary at most: a boundary cuts through a single group.
    joined = ranged.join(F.broadcast(offsets), [_PART, *keys], "left")
    within = Window.partitionBy(_PART, *keys).orderBy(_ROW)
    if keys:
        local = F.row_number().over(within)
    else:
        # The generated ids count up within a partition: their low 33 bits are the place in it.
        local = F.col(_ROW).bitwiseAND(F.lit(2**33 - 1)) + 1
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = joined.withColumn(name, (local + F.coalesce("_skip", F.lit(0))).cast("bigint"))
    for out, col in sums.items():
        numbered = numbered.withColumn(
            out, F.sum(col).over(so_far) + F.coalesce(F.col(f"_s_{out}"), F.lit(0))
        )
    return numbered.drop(_PART, _ROW, "_skip", *[f"_s_{o}" for o in sums])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "pos") -> DataFrame:
    """First ``k`` rows of every group.

    The filter on ``row_number`` lets Spark cut each map task's share of a group to ``k``
    rows before the shuffle, so a hot group arrives already reduced.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).withColumn(
        name, F.col(name).cast("bigint")
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def top_items(ranking: DataFrame, n: int = 200, by: str = "score", item: str = "content_id") -> DataFrame:
    return ranking.orderBy(F.desc(by), F.asc(item)).limit(n)


def ranked(scores: DataFrame, by: str = "score", item: str = "content_id") -> DataFrame:
    """Items with their place in the list ordered by falling score, ties by id.

    The result is read from a table, so that it carries its real size into later joins.
    """
    return through_table(positions(scores, [F.desc(by), F.asc(item)], name="rank"), "ranking")


def running_count(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows numbered 1..n within groups by a plain window, for groups that are read as a whole anyway."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def dense_index(items: DataFrame, item: str = "content_id") -> DataFrame:
    """Ids numbered 0..n-1 in ascending order."""
    return positions(items.select(item), [F.asc(item)], name="idx").withColumn("idx", F.col("idx") - 1)


def best_candidate(scored: DataFrame, keys: list[str], item: str = "content_id", score: str = "score") -> DataFrame:
    """Highest-scored item per group, the smaller id among equals; combines map-side."""
    return scored.groupBy(*keys).agg(
        F.max_by(item, F.struct(F.col(score), -F.col(item))).alias(item), F.max(score).alias(score)
    )


def running_share(counts: DataFrame, n: str = "n", item: str = "content_id") -> DataFrame:
    """Items by falling count with the share of all plays reached so far."""
    total = counts.agg(F.sum(n)).scalar()
    return (
        positions(counts, [F.desc(n), F.asc(item)], name="rank", sums={"reached": n})
        .withColumn("share", F.col("reached") / total)
    )


def mid_ranks(scored: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Distinct scores with their average rank, counts of rows and of positives.

    Equal scores are counted before anything is ordered, so a score shared by many rows
    is one row here.
    """
    by = list(by)
    tied = scored.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_pos")
    )
    placed = positions(tied, [F.asc(score)], keys=by, name="place", sums={"upto": "n"})
    return placed.withColumn(
        "mid_rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    ).drop("place")
