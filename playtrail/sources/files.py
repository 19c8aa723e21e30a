"""Readers and writers of the inputs, the slates, the item vectors and the models."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrail.schema import CATALOG, PLAYS


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, sep: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    # Only the empty field is null, so that a country code such as NA survives.
    return spark.read.schema(schema).options(header=True, sep=sep, nullValue="", mode="FAILFAST").csv(path)


def read_plays(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, PLAYS, fmt, ",")


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, CATALOG, fmt, ";")


def constant_columns(df: DataFrame, value: str = "N") -> list[str]:
    """Columns holding ``value`` in every row; a null keeps a column. One pass, one row back."""
    same = [F.every(F.coalesce(F.col(c).cast("string") == value, F.lit(False))).alias(c) for c in df.columns]
    row = df.agg(*same).first()
    return [c for c in df.columns if row[c]]


def drop_constant_columns(df: DataFrame, value: str = "N") -> DataFrame:
    return df.drop(*constant_columns(df, value))


def slate_lines(recs: DataFrame, users: DataFrame) -> DataFrame:
    """One row per account with its slate as a JSON list; an account without items gets ``[]``."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content_id"))), lambda c: c["content_id"])
    slates = recs.groupBy("account_id").agg(cells.alias("items"))
    text = F.concat(F.lit("["), F.array_join(F.col("items").cast("array<string>"), ", "), F.lit("]"))
    return users.select("account_id").join(slates, "account_id", "left").select(
        "account_id", F.coalesce(text, F.lit("[]")).alias("recs")
    )


def write_recs(recs: DataFrame, users: DataFrame, path: str) -> None:
    """Headerless CSV ``account, "[1, 2, …]"``, ordered by account over the part files."""
    lines = slate_lines(recs, users).orderBy("account_id")
    lines.write.mode("errorifexists").options(header=False, escape='"').csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("content_id", "vector").write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(
        [T.StructField("content_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
    )
    return spark.read.schema(schema).parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().save(path)


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)


def profile(df: DataFrame) -> DataFrame:
    """Rows, filled rows and distinct values of every column.

    Columns are turned into rows and counted by value first: distinct values then need no
    set per column, and one value filling a third of a column is combined map-side.
    """
    counts = value_counts(df, df.columns)
    return counts.groupBy("field").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count("value").alias("distinct_values"),
    )


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(cells)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
