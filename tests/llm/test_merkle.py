"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from playtrail.llm import merkle, queries
from tests.llm.helpers import DOCS, SF, odd_documents, sorted_rows

FIELDS = "doc_id source lang n_chars text".split()
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    """For each level below the last: the run's members, and the place in it."""
    for nodes in levels[:-1]:
        yield nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        i //= 16


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r, leaf_of(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[s] = levels_of([leaf for _, leaf in groups[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (r, leaf) in enumerate(groups[s]):
            proof, folded = [], leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                folded = leaf_of(r | {"text": r["text"] and r["text"].translate(SMALL)})
            for members, at in [*way(trees[s], i), *way(top, k)]:
                proof += members[:at] + members[at + 1 :]
                folded = h(*members[:at], folded, *members[at + 1 :])
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def queried(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return sorted_rows(queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)))


def test_manifest_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows)
    assert sorted_rows(queries.QUERIES["op12_merkle_manifest"](spark, SF)) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("shape", ["one", "lone groups", "lone and others", "one group", "deep", "many groups", "odd", "turns"])
def test_shapes(spark, tmp_path, monkeypatch, shape):
    """Lone leaves and groups, last runs of one member, several levels, more groups than one run, salts."""
    monkeypatch.setattr(merkle, "PER_KEY", 2)
    rng = random.Random(shape)
    counts = {
        "one": {"a": 1}, "lone groups": {"a": 1, None: 1, "": 1, "B": 1}, "lone and others": {None: 1, "ä": 17, "z": 16, "": 2},
        "one group": {None: 33}, "deep": {"hot": 16**3 + 1, "b": 257, "c": 256}, "many groups": {f"s{i}": 1 + i % 3 for i in range(300)},
        "turns": {"\U0001f642": 18, "\uffee": 3, "t": 20, "n": 5, None: 19},
    }
    if shape == "odd":
        rows = odd_documents()
    else:
        rows = [(i, rng.choice(["Some Text", "none", None, "", "ÄÖ ABC"]), "en", s, i) for i, s in enumerate([s for s, c in counts[shape].items() for _ in range(c)])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("run", F.lit(1)).withColumn("g", F.lit("x"))
    assert queried(spark, docs, tmp_path) == plain([dict(zip("doc_id text lang source n_chars".split(), r, strict=True)) for r in rows])


def test_empty_table(spark, tmp_path):
    assert queried(spark, spark.createDataFrame([], DOCS), tmp_path) == []


def test_limit_of_rows_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    queries.QUERIES["op12_merkle_manifest"](spark, SF).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
