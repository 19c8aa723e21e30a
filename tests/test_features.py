"""Tokens, bags of words, SVD, scaling, neighbours and greedy slates against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.functions.columns import tokens
from playtrail.operators import counting, features, similarity, slates


def test_tokens(spark):
    df = spark.createDataFrame([("",), ("a,,b",), (None,), ("a|b",), ("a,",)], "s string")
    assert [r[0] for r in df.select(tokens(F.col("s"), ",")).collect()] == [[], ["a", "", "b"], [], ["a|b"], ["a", ""]]
    assert df.where("s = 'a|b'").select(tokens(F.col("s"), "|")).first()[0] == ["a", "b"]


def test_bag_folds_case_after_dedupe(spark):
    df = spark.createDataFrame([(1, "A/a/a", "x,x"), (1, "a", None), (None, "z", "z")], "content_id bigint, category string, cast_first_name string")
    bag = {(r["token"], r["n"]) for r in features.bag_of_words(df, "category").collect()}
    assert bag == {("a", 2)}
    assert {(r["token"], r["n"]) for r in features.bag_of_words(df, "cast_first_name").collect()} == {("x", 2)}


def dense(bow, items, words):
    a = np.zeros((len(items), len(words)))
    for c, t, n in bow:
        a[items.index(c), words.index(t)] += n
    return a


def test_truncated_svd_equals_numpy(spark):
    rng = np.random.default_rng(5)
    basis = rng.random((4, 60))
    weights = rng.random((50, 4)) * np.array([9, 5, 3, 2])
    a = np.round(weights @ basis).astype(int)
    bow = [(int(i), f"w{j:02d}", int(a[i, j])) for i in range(50) for j in range(60) if a[i, j]]
    df = spark.createDataFrame(bow, "content_id bigint, token string, n bigint").repartition(5)
    projected, singular = features.truncated_svd(df, 3, oversample=12, n_iter=6)
    u, s, vt = np.linalg.svd(a.astype(float), full_matrices=False)
    assert singular == pytest.approx(s[:3], rel=1e-6)
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])
    want = u[:, :3] * s[:3] * signs
    got = np.stack([r["vec"] for r in projected.orderBy("content_id").collect()])
    assert np.abs(got - want).max() < 1e-3 * s[0]
    ratio = features.explained_variance(df, projected, 50).orderBy("component").collect()
    total = a.var(0).sum()
    assert [r["ratio"] for r in ratio] == pytest.approx(list(want.var(0) / total), rel=1e-3)


def test_svd_of_a_small_vocabulary_is_exact(spark):
    bow = [(i, "abcde"[j], 1 + (i * j) % 4) for i in range(30) for j in range(5) if (i + j) % 2]
    projected, singular = features.truncated_svd(spark.createDataFrame(bow, "content_id bigint, token string, n bigint"), 20)
    a = dense(bow, list(range(30)), list("abcde"))
    assert singular == pytest.approx(np.linalg.svd(a, compute_uv=False), abs=1e-6)


def test_standard_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0, [1.0, 7.0]), (2, 4.0, 5.0, [3.0, 7.0]), (3, None, 5.0, [8.0, 7.0])], "content_id bigint, x double, c double, v array<double>")
    got = features.standard_scale(df, ["x", "c"]).orderBy("content_id").collect()
    assert [r["x"] for r in got] == [-1.0, 1.0, None] and [r["c"] for r in got] == [0, 0, 0]
    v = np.stack([r["v"] for r in features.scale_vector(df, "v").orderBy("content_id").collect()])
    assert v[:, 0] == pytest.approx((np.array([1, 3, 8]) - 4) / np.std([1, 3, 8])) and not v[:, 1].any()


def test_one_hot_array_and_rows_agree(spark):
    df = spark.createDataFrame([(i, "abcd"[i % 4] if i < 11 else "z") for i in range(12)], "content_id bigint, show_type string")
    kept = counting.frequency_cut(df, "show_type", top=4)
    levels = sorted(r["level"] for r in kept.collect())
    assert levels == ["a", "b", "c", "d"]
    arrays = {r[0]: r[1] for r in features.one_hot_arrays(df, "show_type", kept, "hot").collect()}
    rows = {(r["content_id"], r["level"]) for r in features.one_hot_top(df).collect()}
    assert {(c, levels[i]) for c, a in arrays.items() for i, x in enumerate(a) if x} == rows
    assert arrays[11] == [0, 0, 0, 0]


@pytest.mark.parametrize("block", [16, 1024])
def test_knn_with_many_copies(spark, monkeypatch, block):
    """A third of the vectors are the same one; stripes are small, so many of them meet."""
    monkeypatch.setattr(similarity, "STRIPE_ROWS", block)
    rng = np.random.default_rng(1)
    v = np.vstack([np.ones((60, 5)), rng.integers(0, 3, (60, 5)) * 10.0, rng.random((60, 5)) + 40])
    ids = rng.permutation(1000)[:180]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "content_id bigint, vector array<double>")
    got = sorted(map(tuple, similarity.knn(df.repartition(3), 9).select("content_id", "rn", "neighbor_id", "distance").collect()))
    want = []
    for i, x in zip(ids, v):
        d = np.round(np.sqrt(((v - x) ** 2).sum(1)), 6)
        order = np.lexsort((ids, d))[:9]
        want += [(int(i), n + 1, int(ids[o]), float(d[o])) for n, o in enumerate(order)]
    assert got == sorted(want)


def test_knn_with_fewer_vectors_than_neighbors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "content_id bigint, vector array<double>")
    assert similarity.knn(df, 50).count() == 4


@pytest.mark.parametrize("stripe,held", [(7, 0), (4096, 0), (4096, 10**6)])
def test_greedy_slates(spark, monkeypatch, stripe, held):
    """Against plain loops, by rounds and at once: a user with all titles, one with few, one without a past, one with nothing left."""
    monkeypatch.setattr(similarity, "STRIPE_ROWS", stripe)
    monkeypatch.setattr(slates, "HELD", held)
    monkeypatch.setattr(slates.LazySlates, "FIRST", 3)
    rng = np.random.default_rng(3)
    d, k = 4, 5
    v = {c: np.round(rng.normal(size=d), 3) for c in range(40)}
    vectors = spark.createDataFrame([(c, x.tolist()) for c, x in v.items()], "content_id bigint, vector array<double>")
    past = {u: random.Random(u).sample(range(40), 3 + u) for u in range(4)} | {4: [], 5: [999]}
    shared, own = [30, 31, 32], {0: list(range(20, 40)), 1: [1, 2], 2: list(range(40)), 3: [7], 4: [5], 5: [6]}
    seen = {0: [31], 1: [1, 30, 31, 32, 999], 2: [0], 3: [7, 30, 31, 32]}
    frame = lambda rows: spark.createDataFrame([(u, c) for u in rows for c in rows[u]], "customer_id bigint, content_id bigint")

    class Model:
        coefficients = type("W", (), {"toArray": staticmethod(lambda: rng_weights)})

    rng_weights = rng.normal(size=4 * d)

    def pool(items):
        m = np.stack([v[c] for c in items if c in v] or [np.zeros(d)])
        return np.r_[m.mean(0), m.max(0)]

    want = set()
    for u in past:
        p, slate = pool(past[u]), []
        for pos in range(1, k + 1):
            left = [c for c in {*own[u], *shared} - set(seen.get(u, [])) if c not in slate]
            if not left:
                break
            score = {c: round(float(np.r_[p - pool(slate + [c]), p * pool(slate + [c])] @ rng_weights), 7) for c in left}
            slate.append(min(left, key=lambda c: (-score[c], c)))
            want.add((u, pos, slate[-1]))
    users = spark.createDataFrame([(u,) for u in past], "customer_id bigint")
    titles = spark.createDataFrame([(c,) for c in shared], "content_id bigint")
    got = slates.greedy_slates(users, frame(past), titles, frame(own), frame(seen), vectors, Model, k)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(20))
def test_lazy_slates_equal_full_scoring(seed):
    """Also with ties: rows that repeat, and vectors of few values."""
    rng = np.random.default_rng(seed)
    d, n = 5, 300
    v = np.round(rng.normal(size=(n, d)), seed % 3)
    v[n // 2 :] = v[: n // 2] if seed % 2 else v[n // 2 :]
    weights, past = rng.normal(size=4 * d), rng.normal(size=2 * d)
    ids = np.arange(n) * 3
    able = rng.random(n) < 0.8
    lazy = slates.LazySlates(ids, v, weights)
    lazy.FIRST = 7
    got = lazy.slate(past, able, 20)
    direction, total, top, want = slates._direction(past, weights), np.zeros(d), np.zeros(d), []
    for m in range(20):
        rows = np.array([r for r in np.flatnonzero(able) if r not in want])
        scores = np.round(slates._next_scores(direction, total, top, m, v[rows]), 9)
        best = int(rows[slates._pick(scores, ids[rows])])
        want.append(best)
        total, top = total + v[best], v[best] if m == 0 else np.maximum(top, v[best])
    assert got == want


def test_slates_of_few_bytes_are_grown_in_all_tasks(spark):
    """Users are small rows and much work: joins that are merged into one task must not leave the work there."""
    vectors = spark.createDataFrame([(c, [float(c % 7), c / 50]) for c in range(50)], "content_id bigint, vector array<double>")
    past = spark.createDataFrame([(u, u % 50) for u in range(200)], "customer_id bigint, content_id bigint")
    model = type("M", (), {"coefficients": type("W", (), {"toArray": staticmethod(lambda: np.arange(8.0))})})
    got = slates.greedy_slates(past.select("customer_id"), past, vectors, past.where("false"), past, vectors, model, 3)
    tasks = {r[0] for r in got.select(F.spark_partition_id()).collect()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == 600


def test_parts_of_many_users_give_the_same_slates():
    rng = np.random.default_rng(5)
    lazy = slates.LazySlates(np.arange(200), rng.normal(size=(200, 4)), rng.normal(size=16))
    pasts = list(rng.normal(size=(9, 8)))
    able = rng.random(200) < 0.7
    assert [lazy.slate(p, able, 20, parts) for p, parts in zip(pasts, lazy.parts(pasts), strict=True)] == [lazy.slate(p, able, 20) for p in pasts]


def test_every_title_is_encoded(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(30, 5)), rng.normal(size=(6, 3))
    y = np.c_[x, np.ones(30)] @ w
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "content_id bigint, vector array<double>")
    targets = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y) if i < 20], "content_id bigint, vector array<double>")
    got = {r["content_id"]: r["vector"] for r in features.linear_encoder(vectors, targets, ridge=1e-9).collect()}
    assert len(got) == 30 and np.abs(np.stack([got[i] for i in range(30)]) - y).max() < 1e-5


def test_learning_curve(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "f array<double>, label int")
    rows = rows.withColumn("features", array_to_vector("f"))
    curve = slates.learning_curve(rows.limit(300), rows.limit(100), 8).orderBy("iteration").collect()
    loss = [r["train_loss"] for r in curve]
    assert loss[0] == pytest.approx(np.log(2)) and all(a >= b - 1e-9 for a, b in zip(loss, loss[1:])) and curve[-1]["train_accuracy"] > 0.8
    assert all(0 <= r["validation_accuracy"] <= 1 for r in curve)


def test_probes_reach_the_recall(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 8)))]
    vectors = spark.createDataFrame(rows, "content_id bigint, vector array<double>")
    exact = similarity.knn(vectors, 10).cache()
    hits = lambda probes: exact.join(similarity.knn(vectors, 10, probes), ["content_id", "neighbor_id"], "left_semi").count()
    assert exact.count() == 40_000 and hits(1) < 0.9 * 40_000
    probes, found = similarity.probes_for(vectors, exact, 10)
    # Blocks are cut by sampled ranges, so another index of the same vectors finds a few pairs more or less.
    assert probes > 1 and found >= 0.9 * 40_000 and abs(hits(probes) - found) < 0.05 * 40_000


def test_probes_are_chosen_without_a_search_for_each_number(spark, monkeypatch):
    """The blocks are made and searched once, and the pairs counted by their blocks are those that searches find."""
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5000, 8)))], "content_id bigint, vector array<double>").cache()
    exact = similarity.knn(vectors, 10).cache()
    blocks = similarity.vector_blocks(vectors)
    made, searched, search = [], [], similarity._searched
    monkeypatch.setattr(similarity, "vector_blocks", lambda v: (made.append(1), blocks)[1])
    monkeypatch.setattr(similarity, "_searched", lambda b, k, p: (searched.append(p), search(b, k, p))[1])
    probes, found = similarity.probes_for(vectors, exact, 10)
    assert len(made) == 1 and searched == [probes] and probes > 1
    reached = {r["probes"]: r["pairs"] for r in similarity._reached(blocks, exact).collect()}
    for p in (1, 2, probes):
        hits = exact.join(search(blocks, 10, p), ["content_id", "neighbor_id"], "left_semi").count()
        assert hits == sum(n for least, n in reached.items() if least <= p)
    assert found == hits
