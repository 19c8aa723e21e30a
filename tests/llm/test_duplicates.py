"""Near duplicates against all pairs."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from playtrail.llm import components, embedding_dedup, queries, simhash
from playtrail.llm.common import BATCH_BYTES, prepare
from tests.llm.helpers import DOCS, SF, odd_documents, roots, words


def plain_fingerprint(text):
    own = [w.lower() for w in words(text)]
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def all_pairs(fps, bits=4):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits]


def expected(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = roots(set(fps), all_pairs(sorted(set(fps))))
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return [(d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, fps, strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_simhash_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect()]
    assert ordered(got) == ordered(expected(docs))


def test_simhash_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = simhash.simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert ordered(tuple(r) for r in got.collect()) == ordered(expected([r[:2] for r in odd_documents()]))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {r[2] for r in expected([r[:2] for r in odd_documents()])}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if i is not None)
    assert ids.count(None) == (None in want)
    assert simhash.simhash_components(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("segment_bits", "parts", "bits"), [(2, 3, 4), (4, 2, 4), (8, 1, 3), (2, 5, 4)])
def test_grid_loses_no_link(spark, segment_bits, parts, bits):
    """Planted numbers around centres, whatever the segments; small blocks exercise hot cells."""
    rng = np.random.default_rng(5)
    found = set()
    for centre in rng.integers(0, 2**63, 12):
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            found.add(int(centre) ^ sum(1 << int(f) for f in flips))
    fps = sorted(found)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    table = spark.createDataFrame(signed, "fp bigint")
    links = simhash.fingerprint_links(table, bits, segment_bits, parts, block=8).collect()
    got = [((r["a"]) % 2**64, (r["b"]) % 2**64) for r in links]
    assert roots(fps, got) == roots(fps, all_pairs(fps, bits))
    assert len(got) < 64 * len(fps)


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, i % 7) for i in range(80)], []])
def test_components(spark, links):
    rng = np.random.default_rng(1)
    names = [int(x) for x in rng.permutation(200) - 100]
    named = [(names[a], names[b]) for a, b in links]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(named, "a bigint, b bigint").repartition(4)).collect()}
    nodes = {x for link in named for x in link}
    want = roots(nodes, named)
    assert got == {n: r for n, r in want.items() if n != r}


def plain_cosines(rows, threshold=0.9):
    """Rows (vec_id, n_links, component_id, kept) from all pairs."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = []
    for i in range(n):
        for j in range(i + 1, n):
            x, y = rows[i][1], rows[j][1]
            if usable(x) and usable(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((i, j))
    root, count, least = roots(range(n), links), [0] * n, {}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(rows[i][0], least.get(r, rows[i][0]))
    return [(rows[i][0], count[i], least.get(root[i]), rows[i][0] is not None and least.get(root[i]) == rows[i][0]) for i in range(n)]


def test_embedding_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op3_embedding_near_dedup"](spark, SF).collect()]
    assert ordered(got) == ordered(plain_cosines(rows))


def test_embedding_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.3])).tolist()) for i in range(120)]
    rows += [(200 + i, base[0].tolist()) for i in range(30)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7)]
    rows += [(None, base[0].tolist()), (None, None), (306, [1e-200] * 8), (307, [1e200] * 8), (308, [1.0] * 8), (309, [2.0] * 4), (310, [1.0] * 4), (7, base[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("x")).withColumn("node", F.lit(1))
    got = embedding_dedup.embedding_components(table, least_rows=16, most_rows=20)
    scaled = [(i, None if v is None or not v or None in v else (np.array(v) / max(1e-300, np.abs(v).max())).tolist()) for i, v in rows]
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain_cosines(scaled))
    assert embedding_dedup.embedding_components(table.limit(0)).count() == 0


def test_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 33))
    x[::5] = np.sign(x[::5]) * rng.choice([1e-3, 1.0], size=x[::5].shape)
    tile = embedding_dedup._tile([v.tobytes() for v in x])
    unit, q, s, e = tile
    bound = (s[:, None] * s) * (q @ q.T) + e[None] * (1 + e[:, None]) + e[:, None]
    assert (bound + 1e-6 >= unit @ unit.T).all()
    for threshold in (0.0, 0.2, 0.5):
        got = {(int(a), int(b)) for i, j in embedding_dedup.tile_pairs(tile, tile, threshold, True) for a, b in zip(i, j)}
        want = {(int(a), int(b)) for a, b in np.argwhere(unit @ unit.T >= threshold) if a < b}
        assert got == want


def test_stage_keeps_one_of_each_group(spark):
    """Planted copies with words replaced and other capitals, against all pairs of fingerprints."""
    rng = np.random.default_rng(7)
    vocabulary = [f"{'bcdfghklmnprst'[i % 14]}{'aeiou'[i % 5]}{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        text = rng.choice(vocabulary, rng.integers(150, 600))
        rows.append(" ".join(text))
        for share in (0.0, 0.004, 0.01, 0.02, 0.05):
            copy = text.copy()
            at = rng.random(len(copy)) < share
            copy[at] = rng.choice(vocabulary, at.sum())
            rows.append(" ".join(copy).title() if share == 0.01 else " ".join(copy))
    rows = list(enumerate(rows))
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF)
    want = {c for _, _, c in expected(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and len(want) < 0.8 * len(rows)


def test_one_of_each_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).withColumn("fp", F.lit(1)).withColumn("row", F.lit("x"))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 8, 9, 10, 11, 12] and ids.count(None) == 1
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_worker_for_each_task(spark, monkeypatch):
    """Two Python steps of one task have a worker each; a table's plan has at most one between two exchanges."""
    plans = []

    def seen(links, spanned=False, run=simhash.components):
        plans.append(links)
        assert spanned
        return run(links, spanned)

    monkeypatch.setattr(simhash, "components", seen)
    docs = spark.createDataFrame([(i, f"one two three four {i % 3}") for i in range(9)], "doc_id bigint, text string")
    assert len({r["component_id"] for r in simhash.simhash_components(docs).collect()}) <= 3
    (links,) = plans
    top = links.where("a <> b")._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert top.count("MapInArrow") == 1


def test_batches_are_bounded_by_bytes(spark):
    """Texts of 300 KB come a few at a time, and one longer than a batch comes whole."""
    prepare(spark)
    sizes = [300_000] * 40 + [3_000_000]
    docs = spark.range(len(sizes), numPartitions=1).select(F.expr(f"repeat('x', int(array({','.join(map(str, sizes))})[int(id)]))").alias("text"))

    def measure(batches):
        for b in batches:
            n, total = len(b), sum(len(t.as_py()) for t in b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([total], pa.int64())], names=["n", "bytes"])

    found = docs.mapInArrow(measure, "n int, bytes bigint").collect()
    assert sum(r["n"] for r in found) == len(sizes) and sum(r["bytes"] for r in found) == sum(sizes)
    assert max(r["bytes"] for r in found if r["n"] > 1) <= BATCH_BYTES + max(sizes)
    assert max(r["n"] for r in found) <= 5
