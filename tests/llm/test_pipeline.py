"""The pipeline's stages, each on what its predecessor kept."""

import os
from collections import Counter

import corpus_pipeline
import pytest
from playtrail.scratch import through_table
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, SF, odd_documents
from tests.llm.test_archives_tokens import token_ids
from tests.llm.test_duplicates import expected
from tests.llm.test_mixing_sharding import water_fill


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = through_table(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_take_effect(spark, stages):
    for kept in stages[1:-1]:
        assert kept.columns == stages[0].columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first, quality = set(ids(stages[1])), set(ids(stages[2]))
    good = {d for d, q in labels.items() if q == 1}
    assert len(good - first) <= 0.01 * len(good) and len(good - quality) <= 0.02 * len(good)
    assert quality < first


def test_near_duplicates_of_the_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted({c for _, _, c in expected(rows)})


def test_mix_and_packing_of_the_stages(stages):
    docs = {r["doc_id"]: r for r in stages[3].collect()}
    copies = Counter(ids(stages[4]))
    assert set(copies) <= set(docs) and max(copies.values()) <= 2
    size = {d: len(r["text"].split()) for d, r in docs.items()}
    sizes, taken = Counter(), Counter()
    for d, r in docs.items():
        sizes[r["source"]] += size[d]
        taken[r["source"]] += size[d] * copies[d]
    for s, t in water_fill(sizes).items():
        assert abs(taken[s] - t) <= max(size[d] for d, r in docs.items() if r["source"] == s) / 2
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {d: c * len(token_ids(docs[d]["text"])) for d, c in copies.items()}
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, rows.drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_through(spark, empty):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    for name in ("_told", "size", "fp", "_copy"):
        docs = docs.withColumn(name, F.lit("x"))
    docs = docs.limit(0) if empty else docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = through_table(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
    assert not empty or docs.count() == 0
    assert os.path.isdir(SF)
