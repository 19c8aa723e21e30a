"""Distributed positions, running totals and ranks against plain Python, with a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from playtrail.operators import counting, evaluate, ordering


def skewed(n=600, seed=1):
    """A third of all rows belong to user 0, a third of all contents are content 5."""
    rng = random.Random(seed)
    return [
        (i, 0 if i % 3 == 0 else rng.randrange(1, 30), 5 if i % 3 == 1 else rng.randrange(40), rng.randrange(20))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(skewed(), "id bigint, user bigint, item bigint, w bigint").repartition(7).cache()


def test_global_positions_and_sums(rows):
    got = ordering.positions(rows, [F.desc("w"), F.asc("id")], sums={"total": "w"}).collect()
    want = sorted(skewed(), key=lambda r: (-r[3], r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == [r[0] for r in want]
    running = 0
    for r in sorted(got, key=lambda r: r["pos"]):
        running += r["w"]
        assert r["total"] == running
    assert sorted(r["pos"] for r in got) == list(range(1, len(want) + 1))


def test_positions_within_a_hot_group(rows):
    got = ordering.positions(rows, [F.asc("w"), F.asc("id")], keys=["user"], sums={"total": "w"}).collect()
    by_user = {}
    for r in sorted(skewed(), key=lambda r: (r[3], r[0])):
        by_user.setdefault(r[1], []).append(r)
    assert len(by_user[0]) >= 200
    place = {r["id"]: (r["pos"], r["total"]) for r in got}
    for group in by_user.values():
        running = 0
        for i, r in enumerate(group, 1):
            running += r[3]
            assert place[r[0]] == (i, running)


def test_positions_do_not_depend_on_partitions(spark, rows):
    def at(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        return sorted(map(tuple, ordering.positions(rows, [F.asc("id")], keys=["user"]).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert at(1) == at(3) == at(50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranked(rows):
    scores = rows.groupBy("item").agg(F.sum("w").alias("score")).withColumnRenamed("item", "content_id")
    want = sorted(map(tuple, scores.collect()), key=lambda r: (-r[1], r[0]))
    got = sorted(ordering.ranked(scores).collect(), key=lambda r: r["rank"])
    assert [(r["content_id"], r["score"], r["rank"]) for r in got] == [(*r, i) for i, r in enumerate(want, 1)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id bigint, user bigint")
    assert ordering.positions(empty, [F.asc("id")]).count() == 0
    assert ordering.positions(empty, [F.asc("id")], keys=["user"]).count() == 0


def test_top_k_prunes_before_the_shuffle(rows):
    plan = ordering.top_k(rows, ["user"], [F.desc("w"), F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_auc_with_ties(spark):
    rng = random.Random(3)
    data = [(rng.randrange(3), float(rng.randrange(4)), rng.randrange(2)) for _ in range(120)]
    scored = spark.createDataFrame(data, "account_id bigint, score double, label int")

    def auc(part):
        pos, neg = [r[1] for r in part if r[2]], [r[1] for r in part if not r[2]]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    assert evaluate.roc_auc(scored).first()["auc"] == pytest.approx(auc(data))
    for r in evaluate.auc_per_user(scored).collect():
        assert r["auc"] == pytest.approx(auc([d for d in data if d[0] == r["account_id"]]))


def test_median_from_running_counts(spark):
    data = [(1, 0.1)] * 3 + [(1, 0.4), (1, 0.9)] + [(0, 0.2), (0, 0.6)]
    medians, histogram = counting.score_summary(spark.createDataFrame(data, "label int, score double"))
    assert {r["label"]: r["median"] for r in medians.collect()} == {1: 0.1, 0: pytest.approx(0.4)}
    assert sum(r["n"] for r in histogram.collect()) == 7


def test_coverage_curve(spark):
    plays = spark.createDataFrame([(c,) for c in [1] * 6 + [2] * 3 + [3]], "content_id bigint")
    got = [(r["content_id"], r["rank"], r["reached"], r["share"]) for r in counting.coverage_curve(plays).orderBy("rank").collect()]
    assert got == [(1, 1, 6, 0.6), (2, 2, 9, 0.9), (3, 3, 10, 1.0)]


def test_zero_filled_axis(spark):
    counts = spark.createDataFrame([(2, 7, 3), (5, 7, 1)], "account_id bigint, content_id bigint, n bigint")
    ids = spark.createDataFrame([(2,), (5,), (10**15,)], "account_id bigint")
    got = {r["account_id"]: r["n"] for r in counting.zero_filled_axis(counts, ids, "account_id").collect()}
    assert got == {2: 3, 5: 1, 10**15: 0}
    pairs = spark.createDataFrame([(2, 7), (2, 8)], "account_id bigint, content_id bigint")
    assert {tuple(r) for r in counting.zero_filled_cells(counts, pairs).collect()} == {(2, 7, 3), (2, 8, 0)}
