"""A training corpus from raw documents: language, quality, near duplicates, mixture, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.llm import language, mixing, packing, simhash, weak_labels
from playtrail.llm.common import fresh, prepare
from playtrail.scratch import through_table

#: A language is believed from this score on; 0.5 is halfway between "not it" and "it".
SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts surely in another language than they are said to be in."""
    prepare(spark)
    model = language.train(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"))
    told = fresh(docs, "_told")[0]
    known = F.col(f"{told}.lang_pred") != language.UNKNOWN
    wrong = F.col("lang").isin(model.languages) & (F.col(f"{told}.lang_pred") != F.col("lang")) & (F.col(f"{told}.score") >= SURE)
    seen = docs.withColumn(told, language.language_of(docs, model))
    return seen.where(known & ~F.coalesce(wrong, F.lit(False))).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the scorer learned from weak labels puts below its threshold."""
    prepare(spark)
    scorer = weak_labels.train(docs)
    told = fresh(docs, "_told")[0]
    scored = docs.withColumn(told, weak_labels.score_of(docs, scorer))
    return scored.where(F.col(f"{told}.score") >= weak_labels.KEEP).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the SimHash operator links, with its four-word shingles and 4 of 64 bits."""
    prepare(spark)
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target, documents repeated as often as the mix takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs the mix into sequences; workers are shared with the other stages and keep no words between tasks."""
    prepare(spark)
    return packing.pack_documents(docs, keep_encoder=False)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first stages learn models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
