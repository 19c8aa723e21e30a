"""Queries: splits, popularity recommenders and evaluation (e, r01-r05, j02-j07, t05, u, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.operators import counting, evaluate, ordering, recommend, shaping
from playtrail.plans import popularity
from playtrail.plans.registry import query
from playtrail.plans.views import CUTOFF, ORACLE_SPLIT, catalog, event_plays, plays, sql


def history():
    return F.col("period").isin(1, 2)


def holdout():
    return F.col("period") == 3


def oracle_ranking(kind: str = "plays", history: str = "period IN (1, 2)", name: str = "ranking") -> str:
    train = "SELECT p.* FROM plays p JOIN split USING (account_id) WHERE NOT is_test"
    score = "CAST(count(*) AS BIGINT)"
    if kind == "per_asset":
        score = "round(count(*) / ln(count(DISTINCT asset_id) + 1), 6)"
    if kind == "first_play":
        train = f"""SELECT * FROM ({train}) QUALIFY row_number() OVER (PARTITION BY account_id, content_id
          ORDER BY tunein NULLS FIRST, asset_id, tuneout NULLS FIRST, customer_id, resume) = 1"""
    return f"""{name} AS (
 SELECT content_id, row_number() OVER (ORDER BY score DESC, content_id) AS rank
 FROM (SELECT content_id, {score} AS score FROM ({train}) t
       WHERE {history} AND content_id IS NOT NULL GROUP BY content_id))"""


def oracle_seen(history: str = "period IN (1, 2)", name: str = "seen") -> str:
    return f"""{name} AS (
 SELECT DISTINCT account_id, content_id FROM plays JOIN split USING (account_id)
 WHERE is_test AND {history} AND content_id IS NOT NULL)"""


def oracle_preds(ranking: str = "ranking", seen: str = "seen", name: str = "preds") -> str:
    return f"""{name} AS (
 SELECT * FROM (SELECT account_id, content_id, row_number() OVER (PARTITION BY account_id ORDER BY rank) AS pos
  FROM (SELECT account_id FROM split WHERE is_test) CROSS JOIN {ranking} ANTI JOIN {seen} USING (account_id, content_id))
 WHERE pos <= 20)"""


def oracle_truth(holdout: str = "period = 3", name: str = "truth") -> str:
    return f"""{name} AS (
 SELECT * FROM (SELECT account_id, content_id,
   row_number() OVER (PARTITION BY account_id ORDER BY min(tunein), content_id) AS pos
  FROM plays JOIN split USING (account_id)
  WHERE is_test AND {holdout} AND content_id IS NOT NULL GROUP BY account_id, content_id)
 WHERE pos <= 20)"""


def oracle_ap(preds: str = "preds", truth: str = "truth", name: str = "ap") -> str:
    return f"""{name} AS (
 SELECT account_id, coalesce(ap, 0) AS ap FROM (SELECT account_id FROM split WHERE is_test)
 LEFT JOIN (SELECT account_id, avg(hit_no / pos) AS ap FROM (
   SELECT p.account_id, p.pos, row_number() OVER (PARTITION BY p.account_id ORDER BY p.pos) AS hit_no
   FROM {preds} p JOIN {truth} t ON p.account_id = t.account_id AND p.content_id = t.content_id)
  GROUP BY account_id) USING (account_id))"""


SLATES = [ORACLE_SPLIT, oracle_ranking(), oracle_seen(), oracle_preds(), oracle_truth()]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = popularity.popularity_evaluation(plays(spark, sf_dir), history(), holdout())
    return scored.select("account_id", F.round("ap", 9).alias("ap"))


def parts(spark: SparkSession, sf_dir: str, ranking: str = "plays"):
    log = plays(spark, sf_dir)
    return popularity.evaluation_parts(log, popularity.play_summary(log), history(), holdout(), ranking)


query("flagship_popularity_ap", sql("SELECT account_id, round(ap, 9) AS ap FROM ap", *SLATES, oracle_ap()))(flagship)


@query("e01_average_precision", sql("SELECT account_id, round(ap, 9) AS ap FROM ap", *SLATES, oracle_ap()))
def e01(spark, sf_dir):
    users, preds, truth = parts(spark, sf_dir)
    return evaluate.average_precision(preds, truth, 20, users).select("account_id", F.round("ap", 9).alias("ap"))


@query("e02_map_at_k", sql("SELECT count(*) AS users, round(avg(ap), 9) AS map FROM ap", *SLATES, oracle_ap()))
def e02(spark, sf_dir):
    return evaluate.map_at_k(*parts(spark, sf_dir)).select("users", F.round("map", 9).alias("map"))


@query("e06_user_split", sql("SELECT account_id, is_test FROM split", ORACLE_SPLIT))
def e06(spark, sf_dir):
    return shaping.split_users(plays(spark, sf_dir))


@query("e07_temporal_split", sql("""SELECT side, count(*) AS n, count(DISTINCT account_id) AS accounts FROM (
  SELECT CASE WHEN coalesce(month(tuneout), 0) <> 3 THEN 'history' ELSE 'holdout' END AS side, account_id FROM plays)
  GROUP BY side"""))
def e07(spark, sf_dir):
    before, after = shaping.split_time(plays(spark, sf_dir), "tuneout", 3)

    def side(df, name):
        per_account = df.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
        return per_account.agg(F.sum("n").alias("n"), F.count("account_id").alias("accounts")).select(
            F.lit(name).alias("side"), "n", "accounts"
        )

    return side(before, "history").unionByName(side(after, "holdout"))


SLATE_SQL = "SELECT account_id, pos, content_id FROM preds"


@query("r01_popular_unseen", sql(SLATE_SQL, *SLATES[:4]))
def r01(spark, sf_dir):
    return parts(spark, sf_dir)[1]


@query("r02_popular_unseen_per_asset", sql(SLATE_SQL, ORACLE_SPLIT, oracle_ranking("per_asset"), *SLATES[2:4]))
def r02(spark, sf_dir):
    return parts(spark, sf_dir, "per_asset")[1]


@query("r03_popular_unseen_first_play", sql(SLATE_SQL, ORACLE_SPLIT, oracle_ranking("first_play"), *SLATES[2:4]))
def r03(spark, sf_dir):
    return parts(spark, sf_dir, "first_play")[1]


def oracle_month(m: int) -> list[str]:
    now, then = f"period = {m}", f"period = {m + 1}"
    return [
        oracle_ranking("plays", now, f"ranking{m}"), oracle_seen(now, f"seen{m}"),
        oracle_preds(f"ranking{m}", f"seen{m}", f"preds{m}"), oracle_truth(then, f"truth{m}"),
        oracle_ap(f"preds{m}", f"truth{m}", f"ap{m}"),
    ]


def oracle_months(first_play: bool) -> str:
    ctes = [ORACLE_SPLIT, *oracle_month(1), *oracle_month(2)]
    if first_play:
        ctes = [ORACLE_SPLIT, *oracle_month(1), *oracle_month(2)]
        ctes[1], ctes[6] = (oracle_ranking("first_play", f"period = {m}", f"ranking{m}") for m in (1, 2))
    maps = ", ".join(f"(SELECT avg(ap) FROM ap{m}) AS m{m}" for m in (1, 2))
    return sql(
        f"""SELECT month, round(map, 9) AS map FROM (SELECT unnest(['1', '2', 'mean']) AS month,
        unnest([m1, m2, (m1 + m2) / 2]) AS map FROM (SELECT {maps}))""",
        *ctes,
    )


@query("r04_month_over_month", oracle_months(False))
def r04(spark, sf_dir):
    return popularity.month_over_month(plays(spark, sf_dir)).withColumn("map", F.round("map", 9))


@query("r04_month_over_month_first_play", oracle_months(True))
def r04_first_play(spark, sf_dir):
    return popularity.month_over_month(plays(spark, sf_dir), dedupe=True).withColumn("map", F.round("map", 9))


@query(
    "r05_head_catalogue_filter",
    sql("""SELECT account_id, content_id, tunein FROM plays WHERE period IN (1, 2) AND content_id IN (
     SELECT content_id FROM (SELECT content_id, sum(n) OVER (ORDER BY n DESC, content_id ROWS UNBOUNDED PRECEDING)
       / sum(n) OVER () AS share FROM (SELECT content_id, count(*) AS n FROM plays
       WHERE period IN (1, 2) AND content_id IS NOT NULL GROUP BY content_id)) WHERE share < 0.99)"""),
)
def r05(spark, sf_dir):
    before = plays(spark, sf_dir).where(history())
    return recommend.head_plays(before).select("account_id", "content_id", "tunein")


@query(
    "r14_new_releases",
    sql(f"""SELECT content_id, max(start_vod_date) AS latest_start FROM catalog WHERE content_id IS NOT NULL
    GROUP BY content_id HAVING max(start_vod_date) > TIMESTAMP '{CUTOFF}'"""),
)
def r14(spark, sf_dir):
    return recommend.new_releases(catalog(spark, sf_dir), CUTOFF)


@query(
    "r15_popular_backfill",
    sql("""SELECT account_id, content_id, row_number() OVER (PARTITION BY account_id ORDER BY min(place), content_id) AS pos
    FROM (SELECT account_id, content_id, pos AS place FROM truth WHERE pos <= 8 UNION ALL
     SELECT account_id, content_id, 100 + pos FROM preds WHERE pos <= 15) GROUP BY account_id, content_id
    QUALIFY pos <= 20""", *SLATES),
)
def r15(spark, sf_dir):
    _, preds, truth = parts(spark, sf_dir)
    return recommend.backfill(truth.where("pos <= 8"), preds, 15, 20)


# Observed pairs scored by the popularity of the content; positive if played in the holdout period.
SCORED = """scored AS (SELECT account_id, content_id, CAST(n AS DOUBLE) AS score, label FROM
 (SELECT account_id, content_id, max(CASE WHEN period = 3 THEN 1 ELSE 0 END) AS label FROM plays
  WHERE content_id IS NOT NULL GROUP BY account_id, content_id)
 JOIN (SELECT content_id, count_if(period IN (1, 2)) AS n FROM plays WHERE content_id IS NOT NULL GROUP BY content_id)
 USING (content_id))"""
RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score)
  + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS mid FROM scored)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = plays(spark, sf_dir).where(F.col("content_id").isNotNull())
    label = F.max(F.when(holdout(), 1).otherwise(0)).alias("label")
    pairs = log.groupBy("account_id", "content_id").agg(label)
    scores = log.groupBy("content_id").agg(F.count_if(history()).cast("double").alias("score"))
    return pairs.join(scores, "content_id")


@query(
    "e03_auc_per_user",
    sql("""SELECT account_id, round((sum(CASE WHEN label = 1 THEN mid END) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc
    FROM (SELECT *, CAST(sum(label) OVER (PARTITION BY account_id) AS DOUBLE) AS p,
      count(*) OVER (PARTITION BY account_id) AS n FROM ranked)
    WHERE p > 0 AND p < n GROUP BY account_id, p, n""", SCORED, RANKED.format(by="account_id")),
)
def e03(spark, sf_dir):
    aucs = evaluate.auc_per_user(scored_pairs(spark, sf_dir))
    return aucs.select("account_id", F.round("auc", 9).alias("auc"))


@query(
    "e04_pooled_roc_auc",
    sql("""SELECT round((sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2)
     / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))), 9) AS auc FROM ranked""", SCORED, RANKED.format(by="1")),
)
def e04(spark, sf_dir):
    return evaluate.roc_auc(scored_pairs(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(
    "w05_mid_ranks",
    sql("""SELECT account_id, score, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, max(mid) AS mid_rank
    FROM ranked GROUP BY account_id, score""", SCORED, RANKED.format(by="account_id")),
)
def w05(spark, sf_dir):
    return ordering.mid_ranks(scored_pairs(spark, sf_dir), ["account_id"]).drop("upto")


PROBABILITY = "(SELECT label, (score + 0.5) / (max(score) OVER () + 1) AS score FROM scored)"


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scored_pairs(spark, sf_dir)
    return pairs.withColumn("score", (F.col("score") + 0.5) / (pairs.agg(F.max("score")).scalar() + 1))


@query(
    "e05_binary_loss",
    sql(f"""SELECT count(*) AS n, round(avg(-CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END), 6) AS loss,
    round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 9) AS accuracy FROM {PROBABILITY}""", SCORED),
)
def e05(spark, sf_dir):
    loss = evaluate.pair_loss(probabilities(spark, sf_dir))
    return loss.select("n", F.round("loss", 6).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


@query(
    "a19_score_summary",
    sql(f"""SELECT label, 0 AS bin, median(score) AS value FROM {PROBABILITY} GROUP BY label UNION ALL
    SELECT label, CAST(least(floor(score * 10) + 1, 10) AS INTEGER), CAST(count(*) AS DOUBLE) FROM {PROBABILITY} GROUP BY ALL""", SCORED)
    .replace("median(score) AS value", "round(median(score), 9) AS value"),
)
def a19(spark, sf_dir):
    medians, histogram = counting.score_summary(probabilities(spark, sf_dir))
    return medians.select("label", F.lit(0).alias("bin"), F.round("median", 9).alias("value")).unionByName(
        histogram.select("label", F.col("bin").cast("int").alias("bin"), F.col("n").cast("double").alias("value"))
    )


@query(
    "e08_integrity_checks",
    sql("""SELECT 'account_id is set' AS rule, count(*) AS rows, CAST(count_if(account_id IS NULL) AS BIGINT) AS violations FROM plays
    UNION ALL SELECT 'content_id is set', count(*), CAST(count_if(content_id IS NULL) AS BIGINT) FROM plays
    UNION ALL SELECT 'ends after it begins', count(*), CAST(count_if(tuneout < tunein) AS BIGINT) FROM plays
    UNION ALL SELECT 'every account id is present', 1,
     CASE WHEN count(DISTINCT account_id) = max(account_id) + 1 THEN 0 ELSE 1 END FROM plays"""),
)
def e08(spark, sf_dir):
    log = plays(spark, sf_dir)
    rows = evaluate.check(
        log,
        {**evaluate.no_nulls(log.select("account_id", "content_id")), "ends after it begins": F.col("tuneout") >= F.col("tunein")},
    )
    accounts = shaping.distinct_ids(log, "account_id").agg(F.count("*").alias("n"), F.max("account_id").alias("hi"))
    return rows.unionByName(evaluate.check(accounts, {"every account id is present": F.col("n") == F.col("hi") + 1}))
