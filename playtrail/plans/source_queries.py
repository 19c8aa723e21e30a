"""Queries: files in and out, profiles (s)."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrail.operators.shaping import distinct_ids
from playtrail.plans.evaluation_queries import SLATES, parts
from playtrail.plans.registry import query
from playtrail.plans.views import catalog, content_or_none, plays, raw_plays, sql, table
from playtrail.schema import CATALOG, PLAYS
from playtrail.scratch import scratch_path
from playtrail.sources import files

CATALOG_COLUMNS = [
    "asset_id", "content_id", "show_type", "released_year", "country_of_origin", "category", "keywords",
    "cast_first_name", "run_time_min", "audience", "made_for_tv", "pay_per_view", "pack_premium_1",
    "pack_premium_2", "start_vod_date",
]


def oracle_catalog(*without: str) -> str:
    cols = [c for c in CATALOG_COLUMNS if c not in without]
    return sql(f"SELECT {', '.join(cols)} FROM catalog".replace(" content_id", " coalesce(content_id, -1) AS content_id"))


@query("s01_read_plays", sql("SELECT account_id, customer_id, asset_id, tunein, tuneout, resume FROM plays"))
def s01(spark, sf_dir):
    path = scratch_path(spark, "plays-csv")
    raw_plays(spark, sf_dir).select(*PLAYS.names).write.option("header", True).csv(path)
    return files.read_plays(spark, path)


@query("s02_read_catalog", oracle_catalog())
def s02(spark, sf_dir):
    path = scratch_path(spark, "catalog-csv")
    rows = catalog(spark, sf_dir)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in CATALOG.fields if f.name not in rows.columns}
    rows.withColumns(missing).select(*CATALOG.names).write.options(header=True, sep=";").csv(path)
    return files.read_catalog(spark, path).select(*CATALOG_COLUMNS).withColumn("content_id", content_or_none())


@query("s03_drop_constant_flag_columns", oracle_catalog("pack_premium_1"))
def s03(spark, sf_dir):
    return files.drop_constant_columns(catalog(spark, sf_dir)).withColumn("content_id", content_or_none())


@query(
    "s04_write_recommendations",
    sql(
        """SELECT account_id || ',' || CASE WHEN items IS NULL THEN '[]' ELSE '"[' || items || ']"' END AS line
        FROM (SELECT DISTINCT account_id FROM plays)
        LEFT JOIN (SELECT account_id, string_agg(content_id, ', ' ORDER BY pos) AS items FROM preds GROUP BY 1)
        USING (account_id)""",
        *SLATES[:4],
    ),
)
def s04(spark, sf_dir):
    path = scratch_path(spark, "recs-csv")
    files.write_recs(parts(spark, sf_dir)[1], distinct_ids(plays(spark, sf_dir), "account_id"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "s05_item_vector_store",
    """SELECT vec_id AS content_id, CAST(len(embedding) AS INTEGER) AS dims,
    round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def s05(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("content_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    files.write_vectors(vectors, path)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return files.read_vectors(spark, path).select(
        "content_id", F.size("vector").alias("dims"), F.round(total, 6).alias("total")
    )


@query(
    "s07_profile_table",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM catalog"
            for c in CATALOG_COLUMNS
        )
    ),
)
def s07(spark, sf_dir):
    return files.profile(catalog(spark, sf_dir))


@query(
    "s07_value_counts",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM catalog GROUP BY ALL"
            for c in ["show_type", "country_of_origin", "audience"]
        )
    ),
)
def s07_values(spark, sf_dir):
    return files.value_counts(catalog(spark, sf_dir), ["show_type", "country_of_origin", "audience"])
