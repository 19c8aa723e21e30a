"""The index of inverted lists against brute force."""

import numpy as np
import pytest

from playtrail.operators import inverted

KIND = "content_id bigint, vector array<double>"


def table(spark, n=1500, dims=12, seed=2, hot=0.4):
    """Rows in loose groups, one of which holds ``hot`` of them, with copies that tie."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, dims)) * 2
    own = np.where(rng.random(n) < hot, 0, rng.integers(0, 20, n))
    rows = np.round(middle[own] + rng.normal(size=(n, dims)), 4)
    rows[100:110] = rows[0]
    return rows, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], KIND).repartition(4)


def nearest(rows, q, k):
    d = np.round(np.sqrt(((rows - q) ** 2).sum(axis=1)), 6)
    return [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(d)), d))[:k]]


def test_all_lists_and_rows_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(inverted, "PART", 100)
    monkeypatch.setattr(inverted, "QUERIES", 7)
    rows, df = table(spark)
    index = inverted.build_index(df, lists=9, sample=400)
    assert index.sizes.sum() == len(rows) and index.parts().max() > 1
    asked = [(i, rows[i].tolist()) for i in range(0, 1500, 50)]
    queries = spark.createDataFrame(asked, "query bigint, vector array<double>")
    found, met = inverted.search(index, queries, 10, probes=9, rerank=1500)
    got = {}
    for r in found.orderBy("query", "rn").collect():
        got.setdefault(r["query"], []).append((r["content_id"], r["distance"]))
    assert got == {q: nearest(rows, rows[q], 10) for q, _ in asked}
    assert {r["codes"] for r in met.collect()} == {len(rows)}
    exact = inverted.exact_neighbors(df, queries, 10).collect()
    assert {(r["query"], r["content_id"]) for r in exact} == {(q, i) for q, _ in asked for i, _ in nearest(rows, rows[q], 10)}


def test_few_lists_find_most(spark):
    rows, df = table(spark, n=4000, dims=16)
    index = inverted.build_index(df)
    queries = df.where("content_id % 100 = 0").withColumnRenamed("content_id", "query")
    found, took = inverted.sufficient(index, queries, 20)
    assert took["recall"] >= 0.9 and took["full_share"] < 0.2 and took["code_share"] < 1
    assert found.count() == queries.count() * 20
    hits = sum(
        len({r["content_id"] for r in found.where(f"query = {q}").collect()} & {i for i, _ in nearest(rows, rows[q], 20)}) for q in (0, 1000, 3900)
    )
    assert hits >= 45


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(n)], KIND)
    index = inverted.build_index(df)
    found, took = inverted.sufficient(index, df.withColumnRenamed("content_id", "query"), 5)
    assert found.count() == n * n and (not n or took["recall"] == 1)
