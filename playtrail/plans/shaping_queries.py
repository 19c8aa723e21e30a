"""Queries: projections, filters, joins, de-duplication, set operations, scalar functions (p, j, d, u, t, x)."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrail.functions import columns as X
from playtrail.operators import counting, evaluate, ordering, recommend, shaping
from playtrail.plans.evaluation_queries import SLATES, holdout, history, parts
from playtrail.plans.registry import query
from playtrail.plans.views import CUTOFF, content_or_none, ORACLE_SPLIT, catalog, plays, raw_plays, sql, table


@query("p01_select_columns", sql("SELECT customer_id, asset_id FROM plays"))
def p01(spark, sf_dir):
    return plays(spark, sf_dir).select("customer_id", "asset_id")


@query(
    "p02_drop_null_keys",
    sql("SELECT account_id, content_id, tunein FROM plays WHERE content_id IS NOT NULL AND account_id IS NOT NULL"),
)
def p02(spark, sf_dir):
    rows = plays(spark, sf_dir).select("account_id", "content_id", "tunein")
    return shaping.drop_null_keys(rows, ["content_id", "account_id"])


@query("p03_exclude_resumes", sql("SELECT customer_id, asset_id, tunein FROM plays WHERE resume = 0"))
def p03(spark, sf_dir):
    return shaping.exclude_resumes(plays(spark, sf_dir)).select("customer_id", "asset_id", "tunein")


@query(
    "p04_period_predicates",
    sql("""SELECT resume, CAST(count_if(month(ts) IN (1, 2)) AS BIGINT) AS in_months, CAST(count_if(coalesce(month(ts), 0) <> 3) AS BIGINT) AS not_in,
    CAST(count_if(month(ts) < 3) AS BIGINT) AS before, CAST(count_if(year(ts) = 1998 AND month(ts) IN (11, 12)) AS BIGINT) AS in_year,
    CAST(count_if(ts IS NULL OR NOT (year(ts) = 1998 AND month(ts) = 12)) AS BIGINT) AS not_in_year
    FROM (SELECT resume, CASE WHEN resume = 1 AND asset_id % 3 = 0 THEN NULL ELSE tunein END AS ts FROM plays) GROUP BY resume"""),
)
def p04(spark, sf_dir):
    ts = F.when(~((F.col("resume") == 1) & (F.col("asset_id") % 3 == 0)), F.col("tunein"))
    return plays(spark, sf_dir).withColumn("ts", ts).groupBy("resume").agg(
        F.count_if(X.in_period(F.col("ts"), {1, 2})).alias("in_months"),
        F.count_if(X.in_period(F.col("ts"), 3, "not_in")).alias("not_in"),
        F.count_if(X.in_period(F.col("ts"), 3, "before")).alias("before"),
        F.count_if(X.in_period(F.col("ts"), {11, 12}, year=1998)).alias("in_year"),
        F.count_if(X.in_period(F.col("ts"), 12, "not_in", year=1998)).alias("not_in_year"),
    )


@query(
    "p05_membership_filter",
    sql("""SELECT account_id, content_id, tunein FROM plays
    WHERE content_id IN (SELECT content_id FROM catalog WHERE pay_per_view = 'Y' AND content_id IS NOT NULL)"""),
)
def p05(spark, sf_dir):
    keys = catalog(spark, sf_dir).where("pay_per_view = 'Y'").select("content_id")
    return shaping.keep_members(plays(spark, sf_dir), keys, "content_id").select("account_id", "content_id", "tunein")


@query("p06_constant_column", sql("SELECT account_id, coalesce(content_id, -1) AS content_id, 1 AS rating FROM plays"))
def p06(spark, sf_dir):
    return plays(spark, sf_dir).select("account_id", content_or_none(), F.lit(1).alias("rating"))


@query(
    "p07_id_cast",
    sql("""SELECT account_id, coalesce(TRY_CAST(CASE WHEN resume = 1 THEN 'n/a' ELSE CAST(asset_id AS VARCHAR) END AS BIGINT), -1)
    AS asset_id FROM plays"""),
)
def p07(spark, sf_dir):
    text = F.when(F.col("resume") == 1, "n/a").otherwise(F.col("asset_id").cast("string"))
    rows = plays(spark, sf_dir).select("account_id", text.alias("asset_id"))
    return shaping.cast_ids(rows, ["account_id", "asset_id"]).fillna(-1, "asset_id")


@query(
    "p08_fill_missing",
    sql("""SELECT asset_id, coalesce(show_type, '') AS show_type, coalesce(audience, '') AS audience,
    coalesce(made_for_tv, 'N') AS made_for_tv, coalesce(len(string_split(category, '/')), 0) AS n_categories FROM catalog"""),
)
def p08(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("parts", F.split("category", "/"))
    filled = shaping.fill_missing(rows, {"show_type": "", "audience": "", "made_for_tv": "N", "parts": []})
    return filled.select(
        "asset_id", "show_type", "audience", "made_for_tv", F.size("parts").cast("bigint").alias("n_categories")
    )


@query(
    "p09_rename_flatten",
    sql("""SELECT content_id, avg(run_time_min) AS "run_time_min-mean", median(run_time_min) AS "run_time_min-median",
    max(released_year) AS "released_year-max" FROM catalog WHERE content_id IS NOT NULL GROUP BY content_id"""),
)
def p09(spark, sf_dir):
    return catalog(spark, sf_dir).where("content_id IS NOT NULL").groupBy("content_id").agg(
        F.avg("run_time_min").alias("run_time_min-mean"),
        F.median("run_time_min").alias("run_time_min-median"),
        F.max("released_year").alias("released_year-max"),
    )


@query("p10_asset_content_remap", sql("SELECT customer_id, content_id, tunein FROM plays WHERE content_id IS NOT NULL"))
def p10(spark, sf_dir):
    mapped = shaping.remap_assets(raw_plays(spark, sf_dir), catalog(spark, sf_dir))
    return mapped.select("customer_id", "content_id", "tunein")


@query("j01_enrich_plays", sql("SELECT account_id, customer_id, asset_id, coalesce(content_id, -1) AS content_id, tunein, tuneout, resume FROM plays"))
def j01(spark, sf_dir):
    enriched = shaping.enrich_plays(raw_plays(spark, sf_dir), catalog(spark, sf_dir))
    return enriched.drop("period").withColumn("content_id", content_or_none())


@query(
    "j02_user_spine_left_join",
    sql("""SELECT account_id, coalesce(content_id, -1) AS content_id FROM (SELECT account_id FROM split WHERE is_test) LEFT JOIN
    (SELECT DISTINCT account_id, content_id FROM plays WHERE tunein >= TIMESTAMP '2000-10-01' AND content_id IS NOT NULL) USING (account_id)""", ORACLE_SPLIT),
)
def j02(spark, sf_dir):
    log = plays(spark, sf_dir)
    users = shaping.distinct_ids(log.where(shaping.is_test(log)), "account_id")
    recent = counting.seen_items(log.where("tunein >= TIMESTAMP_NTZ '2000-10-01'"))
    return shaping.with_history(users, recent).select("account_id", content_or_none())


BOTH_SLATES = """SELECT account_id, coalesce(p, '') AS pred, coalesce(t, '') AS truth
 FROM (SELECT account_id, string_agg(content_id, ' ' ORDER BY pos) AS p FROM preds GROUP BY 1)
 {join} JOIN (SELECT account_id, string_agg(content_id, ' ' ORDER BY pos) AS t FROM truth GROUP BY 1) USING (account_id)"""


def as_text(slates):
    def text(c):
        return F.array_join(F.col(c).cast("array<string>"), " ")

    return slates.select("account_id", text("pred").alias("pred"), text("true").alias("truth"))


@query("j03_truth_predictions_full_join", sql(BOTH_SLATES.format(join="FULL"), *SLATES))
def j03(spark, sf_dir):
    _, preds, truth = parts(spark, sf_dir)
    return as_text(evaluate.truth_vs_preds(truth, preds))


@query("j04_recs_with_truth", sql(BOTH_SLATES.format(join="LEFT"), *SLATES))
def j04(spark, sf_dir):
    _, preds, truth = parts(spark, sf_dir)
    return as_text(evaluate.attach_truth(preds, truth))


@query(
    "j05_semi_join_user_split",
    sql("SELECT account_id, coalesce(content_id, -1) AS content_id, tunein FROM plays WHERE account_id IN (SELECT account_id FROM split WHERE is_test)", ORACLE_SPLIT),
)
def j05(spark, sf_dir):
    log = plays(spark, sf_dir)
    users = shaping.split_users(log).where("is_test")
    return shaping.keep_members(log, users, "account_id").select("account_id", content_or_none(), "tunein")


@query(
    "j06_anti_join_seen",
    sql("""SELECT DISTINCT account_id, content_id FROM plays WHERE period = 3 AND content_id IS NOT NULL
    EXCEPT SELECT account_id, content_id FROM plays WHERE period IN (1, 2)"""),
)
def j06(spark, sf_dir):
    log = plays(spark, sf_dir)
    return shaping.drop_seen(counting.seen_items(log.where(holdout())), counting.seen_items(log.where(history())))


TOP_CUSTOMERS = """top AS (SELECT content_id, count(DISTINCT customer_id) AS users FROM plays
 WHERE content_id IS NOT NULL GROUP BY content_id ORDER BY users DESC, content_id LIMIT 200)"""


@query(
    "j07_unseen_pairs",
    sql("""SELECT account_id, content_id FROM plays WHERE period = 3 AND content_id IS NOT NULL
    EXCEPT SELECT account_id, content_id FROM plays WHERE period IN (1, 2)"""),
)
def j07(spark, sf_dir):
    """Pairs of the holdout that the history has not seen."""
    log = plays(spark, sf_dir)
    return recommend.unseen_pairs(counting.seen_items(log.where(holdout())), counting.seen_items(log.where(history())))


@query(
    "j07_unseen_counts",
    sql("""SELECT account_id, (SELECT count(DISTINCT content_id) FROM plays WHERE period = 3) - n AS unseen FROM (
    SELECT account_id, count(DISTINCT CASE WHEN h.content_id IS NOT NULL THEN p.content_id END) AS n FROM plays p
    LEFT JOIN (SELECT DISTINCT content_id FROM plays WHERE period = 3) h USING (content_id) GROUP BY account_id)"""),
)
def j07_counts(spark, sf_dir):
    log = plays(spark, sf_dir)
    items = shaping.distinct_ids(log.where(holdout()), "content_id")
    return recommend.unseen_counts(shaping.distinct_ids(log, "account_id"), items, counting.seen_items(log))


@query(
    "d01_first_play_only",
    sql("""SELECT account_id, coalesce(content_id, -1) AS content_id, asset_id, tunein, tuneout, customer_id FROM plays
    QUALIFY row_number() OVER (PARTITION BY account_id, plays.content_id
     ORDER BY tunein, asset_id, tuneout, customer_id, resume) = 1"""),
)
def d01(spark, sf_dir):
    return shaping.first_play_only(plays(spark, sf_dir)).select(
        "account_id", content_or_none(), "asset_id", "tunein", "tuneout", "customer_id"
    )


@query(
    "d02_distinct_ids",
    sql("""SELECT 'account' AS kind, account_id AS id FROM plays GROUP BY account_id UNION ALL
    SELECT 'content', content_id FROM plays WHERE content_id IS NOT NULL GROUP BY content_id"""),
)
def d02(spark, sf_dir):
    log = plays(spark, sf_dir)
    accounts = shaping.distinct_ids(log, "account_id").select(F.lit("account").alias("kind"), F.col("account_id").alias("id"))
    contents = shaping.distinct_ids(log, "content_id").select(F.lit("content").alias("kind"), F.col("content_id").alias("id"))
    return shaping.merge_candidates(accounts, contents)


@query(
    "d03_array_dedupe",
    sql("""SELECT asset_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS ordered,
    array_to_string(list_sort(list_distinct(l)), '|') AS sorted FROM (SELECT asset_id, list_concat(
     string_split(keywords, ','), coalesce(string_split(category, '/'), []), coalesce(string_split(cast_first_name, ','), [])) AS l FROM catalog)"""),
)
def d03(spark, sf_dir):
    words = F.concat(X.tokens(F.col("keywords"), ","), X.tokens(F.col("category"), "/"), X.tokens(F.col("cast_first_name"), ","))
    return catalog(spark, sf_dir).select(
        "asset_id",
        F.array_join(X.dedupe_array(words), "|").alias("ordered"),
        F.array_join(X.dedupe_array(words, ordered=False), "|").alias("sorted"),
    )


@query("t01_top_popular", sql("SELECT content_id, users FROM top", TOP_CUSTOMERS))
def t01(spark, sf_dir):
    return recommend.top_popular(plays(spark, sf_dir), 200)


@query(
    "t02_ordered",
    sql("""SELECT account_id, tunein, asset_id, row_number() OVER (ORDER BY tunein, account_id, asset_id, tuneout) AS pos
    FROM (SELECT DISTINCT account_id, tunein, asset_id, tuneout FROM plays)"""),
)
def t02(spark, sf_dir):
    rows = plays(spark, sf_dir).select("account_id", "tunein", "asset_id", "tuneout").distinct()
    order = [F.asc("tunein"), F.asc("account_id"), F.asc("asset_id"), F.asc("tuneout")]
    return ordering.positions(rows, order).drop("tuneout")


@query(
    "t03_best_candidate",
    sql("""SELECT account_id, content_id, score FROM (SELECT account_id, content_id, count(*) AS score FROM plays
    WHERE content_id IS NOT NULL GROUP BY account_id, content_id)
    QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY score DESC, content_id) = 1"""),
)
def t03(spark, sf_dir):
    scored = counting.interaction_counts(plays(spark, sf_dir)).withColumnRenamed("n", "score")
    return ordering.best_candidate(scored, ["account_id"])


@query(
    "t04_truncate_sequence",
    sql("""SELECT asset_id, array_to_string(l[1:3], '|') AS head, array_to_string(list_resize(l[1:6], 6, '0'), '|') AS padded
    FROM (SELECT asset_id, list_concat(string_split(keywords, ','), coalesce(string_split(category, '/'), [])) AS l FROM catalog)"""),
)
def t04(spark, sf_dir):
    words = F.concat(X.tokens(F.col("keywords"), ","), X.tokens(F.col("category"), "/"))
    return catalog(spark, sf_dir).select(
        "asset_id",
        F.array_join(X.truncate_sequence(words, 3), "|").alias("head"),
        F.array_join(X.truncate_sequence(words, 6, F.lit("0")), "|").alias("padded"),
    )


@query(
    "t05_random_user_sample",
    sql("SELECT account_id FROM (SELECT DISTINCT account_id FROM plays) ORDER BY md5('117:' || account_id), account_id LIMIT 500"),
)
def t05(spark, sf_dir):
    return shaping.sample_users_n(shaping.distinct_ids(plays(spark, sf_dir), "account_id"), 500)


@query(
    "u01_union_all",
    sql("""SELECT account_id, coalesce(content_id, -1) AS content_id, tunein FROM plays WHERE month(tuneout) <> 3 UNION ALL
    SELECT account_id, coalesce(content_id, -1), tunein FROM plays WHERE month(tuneout) = 3"""),
)
def u01(spark, sf_dir):
    before, after = shaping.split_time(plays(spark, sf_dir), "tuneout", 3)
    return before.unionByName(after).select("account_id", content_or_none(), "tunein")


NEW_RELEASES = f"""fresh AS (SELECT content_id, max(start_vod_date) AS latest_start FROM catalog
 WHERE content_id IS NOT NULL GROUP BY content_id HAVING max(start_vod_date) > TIMESTAMP '{CUTOFF}')"""


@query(
    "u02_union_distinct",
    sql("SELECT content_id FROM top UNION SELECT content_id FROM fresh", TOP_CUSTOMERS, NEW_RELEASES),
)
def u02(spark, sf_dir):
    popular = recommend.top_popular(plays(spark, sf_dir), 200).select("content_id")
    fresh = recommend.new_releases(catalog(spark, sf_dir), CUTOFF).select("content_id")
    return shaping.merge_candidates(popular, fresh)


@query(
    "u03_difference",
    sql("""SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL
    EXCEPT SELECT content_id FROM plays WHERE period = 3 AND tunein < TIMESTAMP '2000-01-15'"""),
)
def u03(spark, sf_dir):
    """Titles that nobody plays in the first two weeks of the holdout."""
    listed = shaping.distinct_ids(catalog(spark, sf_dir), "content_id")
    early = F.col("tunein") < F.lit("2000-01-15 00:00:00").cast("timestamp_ntz")
    return shaping.difference(listed, plays(spark, sf_dir).where(holdout() & early), ["content_id"])


@query(
    "u04_intersection",
    sql("""SELECT customer_id FROM plays WHERE period IN (1, 2) INTERSECT
    SELECT customer_id FROM plays WHERE period = 3"""),
)
def u04(spark, sf_dir):
    log = plays(spark, sf_dir)
    return shaping.active_in_both(log.where(history()), log.where(holdout()))


@query(
    "w02_per_user_top_k",
    sql("""SELECT account_id, content_id, n, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, content_id) AS pos
    FROM (SELECT account_id, content_id, count(*) AS n FROM plays WHERE content_id IS NOT NULL GROUP BY ALL)
    QUALIFY pos <= 20"""),
)
def w02(spark, sf_dir):
    counts = counting.interaction_counts(plays(spark, sf_dir))
    return ordering.top_k(counts, ["account_id"], [F.desc("n"), F.asc("content_id")], 20)


@query(
    "w03_first_per_group",
    sql("""SELECT customer_id, asset_id, tunein FROM plays QUALIFY row_number() OVER
    (PARTITION BY customer_id ORDER BY tunein, asset_id) = 1"""),
)
def w03(spark, sf_dir):
    rows = plays(spark, sf_dir).select("customer_id", "asset_id", "tunein")
    return ordering.first_per_group(rows, ["customer_id"], [F.asc("tunein"), F.asc("asset_id")])


@query(
    "w04_cumulative_hits",
    sql("""SELECT p.account_id, p.pos, row_number() OVER (PARTITION BY p.account_id ORDER BY p.pos) AS hits_so_far,
    round(row_number() OVER (PARTITION BY p.account_id ORDER BY p.pos) / p.pos, 9) AS precision
    FROM preds p JOIN truth t ON p.account_id = t.account_id AND p.content_id = t.content_id""", *SLATES),
)
def w04(spark, sf_dir):
    _, preds, truth = parts(spark, sf_dir)
    hits = preds.join(truth.select("account_id", "content_id"), ["account_id", "content_id"], "left_semi")
    return evaluate.cumulative_hits(hits).select(
        "account_id", "pos", "hits_so_far", F.round("precision", 9).alias("precision")
    )


@query(
    "x01_split_tokens",
    sql("""SELECT asset_id, CASE WHEN category IS NULL THEN 0 ELSE len(string_split(category, '/')) END AS n,
    array_to_string(string_split(coalesce(category, ''), '/'), ' ') AS words FROM catalog"""),
)
def x01(spark, sf_dir):
    words = X.tokens(F.col("category"), "/")
    return catalog(spark, sf_dir).select(
        "asset_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("words")
    )


@query("x02_lowercase_tokens", sql("SELECT asset_id, lower(replace(keywords, ',', ' ')) AS words FROM catalog"))
def x02(spark, sf_dir):
    words = X.lower_tokens(X.tokens(F.col("keywords"), ","))
    return catalog(spark, sf_dir).select("asset_id", F.array_join(words, " ").alias("words"))


@query("x03_flag_to_bool", sql("SELECT asset_id, coalesce(made_for_tv, 'N') = 'Y' AS made_for_tv FROM catalog"))
def x03(spark, sf_dir):
    return catalog(spark, sf_dir).select("asset_id", X.flag(F.col("made_for_tv")).alias("made_for_tv"))


@query("x04_month", "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1")
def x04(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(X.month_of(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x05_day_difference",
    f"""SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 07:30:00')) / 86400000000.0) AS INTEGER) AS days,
    CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 86400000000.0) AS INTEGER) AS days_midnight FROM events""",
)
def x05(spark, sf_dir):
    def cutoff(text):
        return F.lit(text).cast("timestamp_ntz")

    return table(spark, sf_dir, "events").select(
        "event_id",
        X.days_since(F.col("ts"), cutoff("2024-01-15 07:30:00")).alias("days"),
        X.days_since(F.col("ts"), cutoff("2024-01-15 00:00:00")).alias("days_midnight"),
    )


@query(
    "x10_vector_arithmetic",
    """SELECT a.vec_id, CAST(2 * len(a.embedding) AS INTEGER) AS dims,
    round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i:
     CAST(a.embedding[i] AS DOUBLE) - b.embedding[i] + i * (CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))), 6) AS total
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def x10(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    both = pairs.select("vec_id", F.size("a").alias("n"), X.pair_features(F.col("a"), F.col("b")).alias("f"))
    weighted = F.transform("f", lambda x, i: F.when(i < F.col("n"), x).otherwise(x * (i - F.col("n") + 1)))
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return both.select("vec_id", F.size("f").alias("dims"), F.round(total, 6).alias("total"))
