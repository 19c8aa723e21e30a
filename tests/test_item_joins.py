"""Tables with a row per title or user are joined by merging, however small Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from playtrail.operators import features, networks, sampling, slates
from playtrail.operators.features import NUMERIC
from playtrail.scratch import pin, through_table


def joins(df, capsys):
    capsys.readouterr()
    df.explain()
    plan = capsys.readouterr().out
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.range(40).select(F.col("id").alias("content_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"))
    return through_table(rows, "vectors")


def test_item_vectors_are_not_broadcast(spark, capsys):
    rows = [(i, "ab"[i % 2], "cd"[i % 2], "ef"[i % 2], *[float(i)] * len(NUMERIC)) for i in range(12)]
    rollup = pin(spark.createDataFrame(rows, ", ".join(["content_id bigint, show_type string, country_of_origin string, audience string", *[f"{c} double" for c in NUMERIC]])))
    catalog = spark.createDataFrame([(i, "xy"[i % 2], "u,v"[: 1 + 2 * (i % 2)]) for i in range(11)], "content_id bigint, category string, keywords string")
    found = features.item_vectors(catalog, rollup, {"category": 2, "keywords": 2}, min_country=1, n_iter=1)
    merged, sent = joins(found, capsys)
    # Only the three tables of levels may go to every task.
    assert merged >= 7 and sent <= 3
    assert {r["n"] for r in found.select(F.size("vector").alias("n")).collect()} == {2 + 2 + 1 + len(NUMERIC) + 2 + 2}


def test_scalars_are_not_broadcast(vectors, capsys):
    scalar = vectors.select("content_id", F.lit(1.0).alias("x"))
    found = features.model_item_features(vectors, [(scalar, "x"), (scalar.where("content_id > 3"), "x")][:1])
    assert joins(found, capsys) == (1, 0)


@pytest.mark.parametrize("pairs", [networks.pair_examples_with_vectors, slates.pair_rows])
def test_vectors_of_pairs_are_not_broadcast(spark, vectors, capsys, pairs):
    found = pairs(spark.createDataFrame([(1, 2), (2, 99)], "a bigint, b bigint"), vectors)
    assert joins(found, capsys) == (2, 0)
    assert [(r["a"], r["b"]) for r in found.collect()] == [(1, 2)]


def test_vectors_of_sequences_are_not_broadcast(spark, vectors, capsys):
    rows = spark.createDataFrame([(7, 1, 3), (7, 2, 5)], "customer_id bigint, pos bigint, content_id bigint")
    for found in (networks.sequence_lists(rows, vectors, ["customer_id"], "past"), slates.pooled(rows, vectors, ["customer_id"], "past")):
        assert joins(found, capsys) == (1, 0)
        assert found.count() == 1


def test_numbered_titles_are_not_broadcast(spark, vectors, capsys):
    index = through_table(vectors.select("content_id", F.col("content_id").alias("idx")), "index")
    found = sampling.random_items(spark.range(9), index, 117, F.col("id"))
    assert joins(found, capsys) == (1, 0)
    assert found.count() == 9
