"""Spectral divide and conquer against numpy, and whitening against a plain version."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.llm import queries, whitening
from tests.llm.helpers import SF

KIND = "vec_id bigint, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    yield "one", np.array([[3.0]])
    yield "random", np.cov(rng.standard_normal((200, 40)).T)
    yield "graded", q @ np.diag(2.0 ** -np.arange(40)) @ q.T
    yield "two values", q @ np.diag([1.0] * 15 + [2.0] * 25) @ q.T
    yield "clusters", q @ np.diag(np.repeat([1.0, 1 + 1e-9, 2, 5], 10)) @ q.T
    yield "identity", 3 * np.eye(40)
    yield "zero", np.zeros((5, 5))
    yield "rank one", np.outer(q[0], q[0])
    yield "few rows", np.cov(rng.standard_normal((7, 40)).T)
    yield "negative too", q @ np.diag(np.arange(40) - 20.0) @ q.T
    yield "on the shift", np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])


@pytest.mark.parametrize("name,a", list(matrices()), ids=[n for n, _ in matrices()])
def test_components_of_a_matrix(name, a):
    values, vectors = whitening.spectral_components(a)
    scale = max(np.abs(a).max() * len(a), 1e-300)
    assert np.all(np.diff(values) <= 1e-14 * scale)
    assert np.abs(values - np.linalg.eigvalsh((a + a.T) / 2)[::-1]).max() <= 1e-14 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * scale


def test_polar_factor():
    a = np.cov(np.random.default_rng(2).standard_normal((60, 20)).T) - 0.9 * np.eye(20)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def plain(rows, most=32):
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in x], dtype=float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return kept, deviation, y, values[:most], vectors[:, :most], values.sum()


def compare(rows, got):
    kept, deviation, y, values, vectors, total = plain(rows)
    count = int((values > 1e-10 * total).sum())
    assert len(got) == len(kept) * count
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r
        assert r["n"] == len(kept) and r["identity_error"] <= 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / total, rel_tol=1e-9)
    want = y @ vectors / np.sqrt(np.maximum(values, 1e-300))
    for i, (k, _) in enumerate(kept):
        assert {r["deviation"] for r in by_id[k].values()} == {deviation[i]}
    found = np.array([[by_id[k][c + 1]["whitened"] for c in range(count)] for k, _ in kept])
    # Signs are free, one for each component.
    signs = np.sign((found * want[:, :count]).sum(axis=0))
    assert np.abs(found * signs - want[:, :count]).max() < 1e-6


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(rows, queries.QUERIES["op13_embedding_whitening"](spark, SF).collect())


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, KIND).withColumn("whitened", F.lit("x")).withColumn("deviation", F.lit(1)).repartition(5)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return queries.QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect()


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(6).astype(np.float32).tolist(), None) for i in range(40)]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (103, [float("nan")] * 6, 1), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1), (105, [1.0, 2.0], 1)]
    twice = [(50, good[0][1], 2), (51, good[0][1], 2), (None, good[1][1], 2), (None, good[1][1], 2), (52, [0.0] * 6, None)]
    rows = good + bad + twice
    got = run(spark, rows, tmp_path)
    assert {r["vec_id"] for r in got} == {*range(40), 50, 51, 52, None}
    compare([(k, v) for k, v, _ in rows if k != 105], [r for r in got if r["vec_id"] is not None] + [r for r in got if r["vec_id"] is None])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, [(1, None, 0)]], ids=["empty", "one", "equal", "null"])
def test_without_components(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == []


def test_few_dimensions_and_a_constant_one(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(a) * 0.5 + float(b), 7.0], 0) for i, (a, b) in enumerate(rng.standard_normal((50, 2)) * 10)]
    compare([(k, v) for k, v, _ in rows], run(spark, rows, tmp_path))


def test_deviations_beyond_a_long():
    model = whitening.Whitening(10**12, [10**18 + 3, 5 * 10**11], np.eye(2) * 10**12, 2)
    x = np.array([[10**6 + 50, 1], [10**6 - 3, 0]])
    _, squares = model.batch(x)
    want = [sum((10**12 * int(c) - s) ** 2 for c, s in zip(row, model.sums, strict=True)) for row in x]
    assert [int(s) for s in squares.to_pylist()] == want
