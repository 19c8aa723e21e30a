"""Exact co-watched pairs and filled axes against plain counts."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.operators import axes, cowatch


def seen_rows():
    rng = np.random.default_rng(4)
    rows = [(int(u), int(t) * 10**10) for u in range(80) for t in rng.choice(60, rng.integers(1, 12), replace=False)]
    rows += [(1000, t * 10**10) for t in range(0, 60)]  # a user with every title
    rows += [(u, 0) for u in range(200, 260)]  # a title that many have, and nothing else
    return rows


@pytest.mark.parametrize("block,per_task,least", [(512, 65536, 1), (7, 10, 1), (7, 10, 3), (64, 20, 2), (1, 50, 1)])
def test_pairs_equal_a_plain_count(spark, monkeypatch, block, per_task, least):
    monkeypatch.setattr(cowatch, "USERS", 16)
    rows = seen_rows()
    df = spark.createDataFrame(rows + rows[:50] + [(None, 5), (7, None)], "customer_id bigint, content_id bigint").repartition(5)
    titles = {}
    for u, t in rows:
        titles.setdefault(u, set()).add(t)
    want = Counter(p for own in titles.values() for p in combinations(sorted(own), 2))
    got = cowatch.cowatch_pairs(df, least, block=block, per_task=per_task).collect()
    assert {(r["content_id"], r["other_id"]): r["n"] for r in got} == {p: n for p, n in want.items() if n >= least}
    assert len(got) == len({(r["content_id"], r["other_id"]) for r in got})


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "customer_id bigint, content_id bigint")
    assert cowatch.cowatch_pairs(df).count() == 0
    assert cowatch.cowatch_pairs(df.where("false")).count() == 0


def test_full_meetings_begin_again(spark, monkeypatch):
    for name, value in (("PAIRS", 40), ("HELD", 60), ("USERS", 5)):
        monkeypatch.setattr(cowatch, name, value)
    df = spark.createDataFrame(seen_rows(), "customer_id bigint, content_id bigint")
    titles = {}
    for u, t in seen_rows():
        titles.setdefault(u, set()).add(t)
    want = Counter(p for own in titles.values() for p in combinations(sorted(own), 2))
    got = {(r["content_id"], r["other_id"]): r["n"] for r in cowatch.cowatch_pairs(df, 2, block=30).collect()}
    assert got == {p: n for p, n in want.items() if n >= 2}


def test_few_rows_reach_the_meetings(spark):
    """Forty titles each of 600 users lay in 40 blocks of 512 and met in 1600 rows a user; pairs below the threshold left every meeting."""
    rows = [(u, 1000 * i + u % 500) for u in range(600) for i in range(40)]
    df = spark.createDataFrame(rows, "customer_id bigint, content_id bigint")
    found = cowatch.cowatch_pairs(df, 2)
    assert found.count() == 100 * 780
    packed = [p for p in found.inputFiles() if "packed" in p]
    assert packed and spark.read.parquet(*packed).count() <= 600


COUNTS = "id bigint, n bigint"


@pytest.mark.parametrize("ids,low,high", [([3, 4, 9], 1, 12), ([1, 12], 1, 12), ([5], 5, 5), ([], 2, 4), ([-3, 0], -3, 2), ([1, 50], 3, 9)])
def test_intervals_fill_the_axis(spark, ids, low, high):
    counts = spark.createDataFrame([(i, 1) for i in ids] + [(i, 2) for i in ids[:1]] + [(None, 4)], COUNTS)
    found = axes.axis_intervals(counts, "id", low, high)
    want = Counter(ids + ids[:1] * 2)
    assert sorted(map(tuple, axes.axis_ids(found).collect())) == [(i, want.get(i, 0)) for i in range(low, high + 1)]
    cells = axes.axis_cells(found, spark.range(-5, 60), low, high)
    assert {r["id"]: r["n"] for r in cells.collect()} == {i: want.get(i, 0) if low <= i <= high else None for i in range(-5, 60)}
    part = axes.axis_ids(axes.axis_range(found, low + 1, high - 1))
    assert sorted(map(tuple, part.collect())) == [(i, want.get(i, 0)) for i in range(low + 1, high)]


def test_wide_gaps_cost_a_row(spark):
    counts = spark.createDataFrame([(0, 1), (10**15, 1)], COUNTS)
    found = axes.axis_intervals(counts, "id", 0, 10**15).orderBy("first").collect()
    assert [tuple(r) for r in found] == [(0, 0, 1), (1, 10**15 - 1, 0), (10**15, 10**15, 1)]
    assert axes.axis_intervals(counts, "id", None, None).count() == 0


def test_many_ids(spark):
    ids = [int(i) for i in np.random.default_rng(1).choice(5000, 700, replace=False)]
    counts = spark.createDataFrame([(i, i % 3 + 1) for i in ids], COUNTS).repartition(6)
    found = axes.axis_ids(axes.axis_intervals(counts, "id", 0, 4999))
    assert found.agg(F.sum("n")).first()[0] == sum(i % 3 + 1 for i in ids) and found.count() == found.distinct().count() == 5000
