"""Queries: item features (f)."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrail.operators import counting, features, shaping
from playtrail.plans.counting_queries import ROLLUP, counted
from playtrail.plans.registry import query
from playtrail.plans.views import CUTOFF, catalog, sql
from playtrail.scratch import pin

# Ranks of the three token projections, as the item vectors use them.
RANKS = {"category": 20, "keywords": 40, "cast_first_name": 25}


def rollup(spark, sf_dir):
    return counting.content_rollup(catalog(spark, sf_dir))


def _cut(col: str, condition: str) -> str:
    return f"""SELECT content_id, {col} AS level, 1 AS value FROM rollup WHERE {col} IN (
     SELECT {col} FROM rollup GROUP BY {col} {condition})"""


@query("f01_one_hot_top", sql(_cut("show_type", "ORDER BY count(*) DESC, show_type LIMIT 4"), ROLLUP))
def f01(spark, sf_dir):
    return features.one_hot_top(rollup(spark, sf_dir))


@query("f02_one_hot_min_count", sql(_cut("country_of_origin", "HAVING count(*) > 40"), ROLLUP))
def f02(spark, sf_dir):
    return features.one_hot_min_count(rollup(spark, sf_dir), min_count=40)


@query(
    "f03_one_hot_drop_rarest",
    sql(_cut("audience", "QUALIFY row_number() OVER (ORDER BY count(*), audience DESC) > 1"), ROLLUP),
)
def f03(spark, sf_dir):
    return features.one_hot_drop_rarest(rollup(spark, sf_dir))


BOW = """SELECT '{col}' AS field, content_id, lower(token) AS token, CAST(count({count}) AS BIGINT) AS n FROM (
  SELECT content_id, unnest(string_split({col}, '{sep}')) AS token FROM catalog
  WHERE content_id IS NOT NULL AND {col} IS NOT NULL) GROUP BY content_id, lower(token)"""


@query(
    "f04_bag_of_words",
    sql(" UNION ALL ".join([
        BOW.format(col="category", sep="/", count="DISTINCT token"),
        BOW.format(col="keywords", sep=",", count="DISTINCT token"),
        BOW.format(col="cast_first_name", sep=",", count="*"),
    ])),
)
def f04(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    bags = [features.bag_of_words(rows, c).select(F.lit(c).alias("field"), "content_id", "token", "n") for c in RANKS]
    return bags[0].unionByName(bags[1]).unionByName(bags[2])


# Contents, vocabulary and squared entries of the three token columns; variances over all contents.
BAGS = "bags AS (" + " UNION ALL ".join([
    BOW.format(col="category", sep="/", count="DISTINCT token"),
    BOW.format(col="keywords", sep=",", count="DISTINCT token"),
    BOW.format(col="cast_first_name", sep=",", count="*"),
]) + "), ranks AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k})" for c, k in RANKS.items()) + ") t(field, k))"


@query(
    "f05_truncated_svd",
    sql("""SELECT field, count(DISTINCT content_id) AS contents, CAST(least(any_value(k), count(DISTINCT token)) AS INTEGER) AS rank,
     true AS falling, true AS within FROM bags JOIN ranks USING (field) GROUP BY field""", BAGS),
)
def f05(spark, sf_dir):
    """Per token column: contents, rank, whether singular values fall, and whether they hold a share of the energy."""
    bows = pin(f04(spark, sf_dir))
    projected, singular = features.stacked_svd(bows, RANKS)
    energy = bows.groupBy("field").agg(F.sum(F.col("n") * F.col("n")).alias("energy"))
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    known = [(f, len(v), all(a >= b - 1e-9 for a, b in zip(v, v[1:]))) for f, v in singular.items()]
    return (
        projected.groupBy("field")
        .agg(F.count(F.lit(1)).alias("contents"), F.sum(square).alias("kept"))
        .join(energy, "field")
        .join(spark.createDataFrame(known, "field string, rank int, falling boolean"), "field")
        .select("field", "contents", "rank", "falling", (F.col("kept") / F.col("energy")).between(0.01, 1 + 1e-9).alias("within"))
    )


@query(
    "f06_explained_variance",
    sql("""SELECT field, CAST(least(any_value(k), count(*)) AS INTEGER) AS components, round(sum(s2 / n - (s1 / n) ^ 2), 6) AS total, true AS within
    FROM (SELECT field, token, sum(n) AS s1, sum(n * n) AS s2 FROM bags GROUP BY ALL) JOIN ranks USING (field)
    CROSS JOIN (SELECT CAST(count(DISTINCT content_id) AS DOUBLE) AS n FROM catalog) GROUP BY field""", BAGS),
)
def f06(spark, sf_dir):
    """Variance of the three token columns, and whether the components explain a share of it."""
    out, bows = [], pin(f04(spark, sf_dir))
    n_items = shaping.distinct_ids(catalog(spark, sf_dir), "content_id").count()
    every, _ = features.stacked_svd(bows, RANKS)
    every = pin(every)
    for col in RANKS:
        bow, projected = (df.where(F.col("field") == col).drop("field") for df in (bows, every))
        explained = features.explained_variance(bow, projected, n_items)
        out.append(
            explained.agg(F.count(F.lit(1)).cast("int").alias("components"), F.sum("ratio").alias("share")).select(
                F.lit(col).alias("field"), "components", F.round(features.token_variance(bow, n_items), 6).alias("total"),
                F.col("share").between(0, 1 + 1e-9).alias("within"),
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2])


SCALED = ["released_year_mean", "run_time_min_mean", "pack_premium_1_mean", "pay_per_view_mean"]


@query(
    "f07_standard_scaling",
    sql("SELECT content_id, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}" for c in SCALED
    ) + " FROM rollup", ROLLUP),
)
def f07(spark, sf_dir):
    scaled = features.standard_scale(rollup(spark, sf_dir), SCALED)
    return scaled.select("content_id", *[F.round(c, 6).alias(c) for c in SCALED])


@query(
    "f09_item_vectors",
    sql("""SELECT content_id, CAST((SELECT least(4, count(DISTINCT show_type)) FROM rollup)
     + (SELECT count(*) FROM (SELECT country_of_origin FROM rollup WHERE country_of_origin IS NOT NULL GROUP BY 1 HAVING count(*) > 40))
     + (SELECT count(DISTINCT audience) - 1 FROM rollup) + 7
     + (SELECT sum(least(k, words)) FROM (SELECT field, count(DISTINCT token) AS words FROM bags GROUP BY field) JOIN ranks USING (field))
     AS INTEGER) AS dims, true AS finite FROM rollup""", ROLLUP, BAGS),
)
def f09(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    vectors = features.item_vectors(rows, pin(counting.content_rollup(rows)), RANKS, min_country=40)
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < 1e6))
    return vectors.select("content_id", F.size("vector").alias("dims"), finite.alias("finite"))


DUMMY_COLUMNS = [
    "show_type", "released_year", "country_of_origin", "category", "audience", "made_for_tv",
    "pay_per_view", "pack_premium_1", "pack_premium_2",
]


@query(
    "f10_get_dummies",
    sql(" UNION ALL ".join(
        [f"SELECT asset_id, '{c}=' || {c} AS feature, CAST(1 AS DOUBLE) AS value FROM catalog WHERE {c} IS NOT NULL" for c in DUMMY_COLUMNS]
        + ["SELECT asset_id, 'run_time_min', run_time_min FROM catalog WHERE run_time_min IS NOT NULL"]
    )),
)
def f10(spark, sf_dir):
    return features.dummies(catalog(spark, sf_dir), DUMMY_COLUMNS, ["run_time_min"])


def model_features(spark, sf_dir, vectors):
    base = counted(spark, sf_dir)
    return features.model_item_features(
        vectors,
        [
            (counting.reproduction_popularity(base), "play_share"),
            (counting.user_popularity(base), "user_share"),
            (counting.release_delta(catalog(spark, sf_dir), CUTOFF), "release_delta"),
        ],
    )
