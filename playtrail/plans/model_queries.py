"""Queries: models and slates from them, reported by what SQL can determine of them (r06-r17, e09, s06, f11, x11).

Factors and scores differ between solvers; counts, sizes, sums over folds and the invariants of slates do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions.columns import hash_int
from playtrail.operators import counting, evaluate, factors, features, recommend, sampling, shaping, similarity, slates
from playtrail.operators.ordering import dense_index
from playtrail.plans import popularity
from playtrail.plans.counting_queries import COUNTED
from playtrail.plans.evaluation_queries import history, holdout, oracle_ranking
from playtrail.plans.feature_queries import RANKS, model_features
from playtrail.plans.registry import query
from playtrail.plans.similarity_queries import DRAWS, embeddings, oracle_hash
from playtrail.plans.views import CUTOFF, ORACLE_SPLIT, catalog, plays, sql
from playtrail.scratch import apart, pin, scratch_path, through_table
from playtrail.sources import files

# Parameters of the queries: the rank of the factor models (the operators' default is 500) and of the item vectors.
RANK, DIM = 16, 30


def ratings(spark, sf_dir) -> DataFrame:
    """All-ones ratings of the head of the catalogue in the history period; the plays are joined once for the head and its ratings."""
    log = plays(spark, sf_dir).where(history()).select("account_id", "content_id")
    head = recommend.head_plays(through_table(log, "history"))
    return counting.seen_items(head).withColumn("rating", F.lit(1.0))


def history_counts(spark, sf_dir, user_col: str = "account_id") -> DataFrame:
    return counting.interaction_counts(plays(spark, sf_dir).where(history()), user_col)


# Contents reached before 99% of the history's plays, and the distinct ratings of them.
RATED = """counts AS (SELECT content_id, count(*) AS n FROM plays WHERE period IN (1, 2) AND content_id IS NOT NULL GROUP BY 1),
rated AS (SELECT DISTINCT account_id, content_id FROM plays WHERE period IN (1, 2) AND content_id IN (
 SELECT content_id FROM (SELECT content_id, sum(n) OVER (ORDER BY n DESC, content_id ROWS UNBOUNDED PRECEDING)
  / sum(n) OVER () AS share FROM counts) WHERE share < 0.99))"""


@query(
    "r06_nonnegative_mf",
    sql(f"""SELECT 'users' AS side, count(DISTINCT account_id) AS rows, {RANK} AS rank, true AS nonnegative FROM rated
    UNION ALL SELECT 'items', count(DISTINCT content_id), {RANK}, true FROM rated""", RATED),
)
def r06(spark, sf_dir):
    model = factors.fit_nmf(through_table(ratings(spark, sf_dir), "ratings"), RANK)

    def side(name, frame):
        return frame.agg(
            F.lit(name).alias("side"), F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("rank"),
            (F.min(F.array_min("vector")) >= 0).alias("nonnegative"),
        )

    return side("users", model.user_factors()).unionByName(side("items", model.item_factors()))


@query(
    "r07_cross_validate",
    sql(f"""SELECT CAST({oracle_hash("'117:' || account_id || ':' || content_id")} % 2 AS INTEGER) AS fold, count(*) AS n, true AS sound
    FROM rated GROUP BY 1""", RATED),
)
def r07(spark, sf_dir):
    """Rows of each fold, and whether its errors are finite and near the all-ones ratings."""
    scores = factors.cross_validate(through_table(ratings(spark, sf_dir), "ratings"), rank=RANK)
    return scores.select("fold", "n", ((F.col("mae") <= F.col("rmse") + 1e-12) & (F.col("rmse") < 1)).alias("sound"))


@query(
    "r08_score_given_pairs",
    sql("""SELECT 'observed' AS kind, count(*) AS pairs, true AS sound FROM (
      SELECT DISTINCT account_id, content_id FROM plays WHERE period = 3
       AND account_id IN (SELECT account_id FROM rated) AND content_id IN (SELECT content_id FROM rated))
    UNION ALL SELECT 'drawn', 4 * count(DISTINCT account_id), true FROM rated""", RATED),
)
def r08(spark, sf_dir):
    """Scores of the observed holdout pairs and of four drawn titles per account; those without factors drop out."""
    rated = through_table(ratings(spark, sf_dir), "ratings")
    model = factors.fit_nmf(rated, RANK)
    observed = counting.seen_items(plays(spark, sf_dir).where(holdout()))
    accounts = shaping.distinct_ids(rated, "account_id").select("account_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("draw"))
    drawn = sampling.random_items(accounts, model.items, 117, F.col("draw"), F.col("account_id")).select("account_id", "content_id")
    pairs = observed.withColumn("kind", F.lit("observed")).unionByName(drawn.withColumn("kind", F.lit("drawn")))
    sound = F.bool_and(F.col("score").between(-0.01, 2))
    return factors.score_pairs(model, pairs).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), sound.alias("sound"))


@query(
    "r09_implicit_mf",
    sql("""SELECT count(*) AS pairs, count(DISTINCT account_id) AS users, count(DISTINCT content_id) AS items,
    true AS better_than_chance FROM (SELECT DISTINCT account_id, content_id FROM plays
     WHERE period IN (1, 2) AND content_id IS NOT NULL)"""),
)
def r09(spark, sf_dir):
    """Size of the model, and whether it puts watched titles before random ones."""
    counts = through_table(history_counts(spark, sf_dir), "counts")
    model = factors.fit_implicit(counts, RANK)
    index = model.items
    watched = counts.select("account_id", "content_id")
    other = sampling.random_items(watched.withColumnRenamed("content_id", "anchor"), index, 117, F.col("account_id"), F.col("anchor"))
    labelled = watched.withColumn("label", F.lit(1)).unionByName(other.select("account_id", "content_id").withColumn("label", F.lit(0)))
    auc = evaluate.roc_auc(factors.score_pairs(model, labelled)).scalar()
    return counts.agg(
        F.count(F.lit(1)).alias("pairs"),
        model.model.userFactors.agg(F.count(F.lit(1))).scalar().alias("users"),
        model.model.itemFactors.agg(F.count(F.lit(1))).scalar().alias("items"),
    ).withColumn("better_than_chance", auc > 0.5)


def slate_report(recs: DataFrame, seen: DataFrame, user_col: str, k: int = 20) -> DataFrame:
    """What must hold for any slates: at most ``k``, no gaps, no repeats, nothing seen."""
    per_user = recs.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.count_distinct("content_id").alias("different")
    )
    again = recs.join(seen, [user_col, "content_id"], "left_semi").agg(F.count(F.lit(1))).scalar()
    return per_user.agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("rows"),
        F.count_if((F.col("n") > k) | (F.col("last") != F.col("n")) | (F.col("different") != F.col("n"))).alias("bad_slates"),
    ).withColumn("seen_again", again)


# Test accounts, the titles of the history and of the ranking, and how long a slate of 20 can be.
ASKED = f"""titles AS (SELECT DISTINCT content_id FROM plays WHERE period IN (1, 2) AND content_id IS NOT NULL),
asked AS (SELECT account_id, count(DISTINCT CASE WHEN period IN (1, 2) THEN content_id END) AS watched
 FROM plays JOIN split USING (account_id) WHERE is_test GROUP BY account_id)"""


@query(
    "r10_model_top_unseen",
    sql("""SELECT count(*) AS users, CAST(sum(CASE WHEN watched > 0 THEN least(20, (SELECT count(*) FROM titles) - watched)
      ELSE least(20, (SELECT count(*) FROM ranking)) END) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad_slates, CAST(0 AS BIGINT) AS seen_again,
     true AS scored FROM asked""", ORACLE_SPLIT, oracle_ranking(), ASKED),
)
def r10(spark, sf_dir):
    """Slate invariants of the model for all test accounts, cold ones filled up, and whether its MAP is a share."""
    log = plays(spark, sf_dir)
    summary = popularity.play_summary(log)
    users, popular, truth = popularity.evaluation_parts(log, summary, history(), holdout())
    counts = through_table(
        summary.where(history() & F.col("content_id").isNotNull()).groupBy("account_id", "content_id").agg(F.sum("n").alias("n")), "counts"
    )
    model = factors.fit_implicit(counts, RANK)
    seen = counts.join(users, "account_id", "left_semi").select("account_id", "content_id")
    recs = pin(recommend.backfill(factors.recommend_model(model, users, seen).drop("score"), popular, 20, 20))
    score = evaluate.map_at_k(users, recs, truth).select(F.col("map").between(0, 1)).scalar()
    return slate_report(recs, seen, "account_id").withColumn("scored", score)


@query(
    "r10_model_auc_per_user",
    sql("""SELECT account_id, count(DISTINCT content_id) AS positives, true AS sound FROM plays
    WHERE period IN (1, 2) AND content_id IS NOT NULL GROUP BY account_id
    HAVING count(DISTINCT content_id) < (SELECT count(DISTINCT content_id) FROM plays WHERE period IN (1, 2))"""),
)
def r10_auc(spark, sf_dir):
    """AUC of the model's ranking of its whole catalogue, for every account with factors."""
    counts = through_table(history_counts(spark, sf_dir), "counts")
    model = factors.fit_implicit(counts, RANK)
    found = similarity.catalogue_auc(model.user_factors(), model.item_factors(), counts)
    return found.select("account_id", "positives", F.col("auc").between(0, 1).alias("sound"))


@query(
    "r11_refit_on_all_data",
    sql("""SELECT count(*) AS users, CAST(sum(least(20, (SELECT count(DISTINCT content_id) FROM plays) - watched)) AS BIGINT) AS rows,
     CAST(0 AS BIGINT) AS bad_slates, CAST(0 AS BIGINT) AS seen_again, max(account_id) AS largest, CAST(0 AS BIGINT) AS empty
    FROM (SELECT account_id, count(DISTINCT content_id) AS watched FROM plays GROUP BY account_id)"""),
)
def r11(spark, sf_dir):
    """Slates of every account of the log, and the lines written of them."""
    log = plays(spark, sf_dir)
    counts = through_table(counting.interaction_counts(log), "counts")
    users = shaping.distinct_ids(log, "account_id")
    recs = pin(factors.final_recommendations(counts, users, recommend.popularity_ranking(log), rank=RANK))
    evaluate.require(recs, evaluate.no_nulls(recs))
    lines = files.slate_lines(recs, users).agg(F.max("account_id").alias("largest"), F.count_if(F.col("recs") == "[]").alias("empty"))
    report = slate_report(recs, counts.select("account_id", "content_id"), "account_id")
    return report.withColumns({c: lines.select(c).scalar() for c in lines.columns})


def title_vectors(spark, sf_dir, counts: DataFrame) -> DataFrame:
    """A vector for every title of the catalogue: its features, encoded to the factors of the titles watched."""
    rows = catalog(spark, sf_dir)
    described = pin(features.item_vectors(rows, pin(counting.content_rollup(rows)), RANKS, min_country=40, n_iter=1))
    return features.linear_encoder(described, factors.item_embedding(counts, DIM))


def embedding(spark, sf_dir) -> DataFrame:
    return title_vectors(spark, sf_dir, history_counts(spark, sf_dir, "customer_id"))


HISTORY_DRAWS = DRAWS.replace("WHERE content_id IS NOT NULL", "WHERE content_id IS NOT NULL AND period IN (1, 2)")


@query("r12_item_embedding", sql(
    """SELECT CAST(1 AS INTEGER) AS label, count(*) AS pairs, true AS nearer FROM draws
    UNION ALL SELECT 0, 3 * count(*), true FROM draws""", HISTORY_DRAWS.format(n=1)))
def r12(spark, sf_dir):
    """Pairs by label, and whether co-watched ones point the same way more than random ones."""
    vectors = pin(embedding(spark, sf_dir))
    seen = counting.seen_items(plays(spark, sf_dir).where(history()), "customer_id")
    pairs = sampling.pair_examples(seen, dense_index(vectors))
    norm = F.sqrt(F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    unit = vectors.select("content_id", F.transform("vector", lambda x: x / norm).alias("vector"))
    a, b = (unit.select(F.col("content_id").alias(c), F.col("vector").alias(f"v{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cosines = pin(pairs.join(apart(a), "a").join(apart(b), "b").groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.avg(dot).alias("cosine")))
    mean = {i: cosines.where(F.col("label") == i).select("cosine").scalar() for i in (0, 1)}
    return cosines.select("label", "pairs", (mean[1] > mean[0]).alias("nearer"))


@query(
    "f11_model_item_features",
    sql(f"""SELECT content_id, {DIM + 3} AS dims, round(coalesce(n, 0) / (SELECT count(*) FROM counted), 9) AS play_share
    FROM (SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL)
    LEFT JOIN (SELECT content_id, count(*) AS n FROM counted GROUP BY 1) USING (content_id)""", COUNTED),
)
def f11(spark, sf_dir):
    rows = model_features(spark, sf_dir, embedding(spark, sf_dir))
    return rows.select("content_id", F.size("vector").alias("dims"), F.round(F.element_at("vector", -3), 9).alias("play_share"))


def pair_training(spark, sf_dir):
    vectors = pin(embedding(spark, sf_dir))
    seen = counting.seen_items(plays(spark, sf_dir).where(history()), "customer_id")
    return vectors, pin(sampling.pair_examples(seen, dense_index(vectors), draws=4))


@query("r16_pair_scorer", sql("SELECT 4 * count(*) AS n, true AS useful FROM draws", HISTORY_DRAWS.format(n=4)))
def r16(spark, sf_dir):
    """Examples of the pair scorer, and whether it puts co-watched pairs before random ones."""
    vectors, pairs = pair_training(spark, sf_dir)
    rows = pin(slates.pair_rows(pairs, vectors))
    scored = slates.score_rows(slates.fit_scorer(rows), rows)
    auc = evaluate.roc_auc(scored).scalar()
    return evaluate.pair_loss(scored).select("n", ((auc > 0.5) & (F.col("loss") < 0.7)).alias("useful"))


@query("e09_learning_curve", "SELECT CAST(i AS INTEGER) AS iteration, true AS falls, true AS sound FROM range(10) t(i)")
def e09(spark, sf_dir):
    """Iterations, whether the training loss falls, and whether loss and accuracy of both sets are in range."""
    vectors, pairs = pair_training(spark, sf_dir)
    rows = slates.pair_rows(pairs, vectors)
    held = F.pmod(hash_int("validation", F.col("customer_id")), F.lit(5)) == 0
    curve = slates.learning_curve(rows.where(~held), rows.where(held))
    before = F.lag("train_loss").over(Window.orderBy("iteration"))
    share = [F.col(f"{c}_accuracy").between(0, 1) & (F.col(f"{c}_loss") > 0) for c in ("train", "validation")]
    return curve.select("iteration", F.coalesce(F.col("train_loss") <= before + 1e-9, F.lit(True)).alias("falls"), (share[0] & share[1]).alias("sound"))


@query(
    "s06_model_store",
    sql("""SELECT count(*) AS pairs, CAST(0 AS DOUBLE) AS largest_difference FROM (
    SELECT DISTINCT account_id, content_id FROM plays WHERE period IN (1, 2) AND content_id IS NOT NULL)"""),
)
def s06(spark, sf_dir):
    """Largest difference between scores before saving and after loading."""
    counts = through_table(history_counts(spark, sf_dir), "counts")
    model = factors.fit_implicit(counts, RANK)
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = factors.Factorization.load(spark, path)
    # The loaded model scores the rows that the saved one has scored, so that the two need no join.
    both = factors.score_pairs(loaded, factors.score_pairs(model, counts).withColumnRenamed("score", "before"))
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.max(F.abs(F.col("before") - F.col("score"))).alias("largest_difference"))


def sequence_parts(spark, sf_dir):
    """Vectors of all titles and the fitted scorer, both from train customers; test customers, their history and holdout."""
    log = through_table(shaping.exclude_resumes(plays(spark, sf_dir)).where(F.col("content_id").isNotNull()), "log")
    before, after = log.where(history()), log.where(holdout())
    test = shaping.is_test(log, user_col="customer_id")
    encoded = title_vectors(spark, sf_dir, counting.interaction_counts(before.where(~test), "customer_id"))
    vectors = through_table(model_features(spark, sf_dir, encoded), "features")
    examples = sampling.sequence_examples(before.where(~test), after.where(~test), dense_index(vectors))
    rows = pin(slates.sequence_rows(sampling.past_sequences(before.where(~test)), examples, vectors))
    users = pin(shaping.distinct_ids(log.where(test), "customer_id"))
    seen = pin(counting.seen_items(before.where(test), "customer_id"))
    past = sampling.past_sequences(before.where(test))
    return before.where(~test), vectors, rows, users, seen, past, after.where(test)


def evaluate_slates(recs, seen, users, after):
    truth = evaluate.truth_slates(after, user_col="customer_id")

    def by_account(df):
        return df.withColumnRenamed("customer_id", "account_id")

    score = evaluate.map_at_k(by_account(users), by_account(recs), by_account(truth)).select(F.col("map").between(0, 1)).scalar()
    return slate_report(recs, seen, "customer_id").withColumn("scored", score)


# Test customers of the log without resumes, and what each of them has watched.
TEST_CUSTOMERS = """log AS (SELECT * FROM plays WHERE resume = 0 AND content_id IS NOT NULL),
customers AS (SELECT customer_id, row_number() OVER (ORDER BY md5('117:' || customer_id), customer_id)
  <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT customer_id FROM log)),
watched AS (SELECT DISTINCT customer_id, content_id FROM log WHERE period IN (1, 2)),
shared AS ({shared}),
lengths AS (SELECT customer_id, (SELECT count(*) FROM shared)
  - count(CASE WHEN s.content_id IS NOT NULL THEN 1 END) AS n
 FROM customers LEFT JOIN watched USING (customer_id) LEFT JOIN shared s USING (content_id) WHERE is_test GROUP BY customer_id)"""

GREEDY = """SELECT count(*) AS users, CAST(sum(least(20, n)) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad_slates,
 CAST(0 AS BIGINT) AS seen_again, true AS scored FROM lengths"""


@query("r17_greedy_slate", sql(GREEDY, TEST_CUSTOMERS.format(shared=f"""
 SELECT content_id FROM (SELECT content_id FROM watched JOIN customers USING (customer_id) WHERE NOT is_test
  GROUP BY content_id ORDER BY count(*) DESC, content_id LIMIT 200)
 UNION SELECT content_id FROM catalog WHERE content_id IS NOT NULL GROUP BY content_id HAVING max(start_vod_date) > TIMESTAMP '{CUTOFF}'""")))
def r17(spark, sf_dir):
    """Greedy slates from popular, new and neighbouring candidates, for all test customers.

    The 200 popular titles and the new ones leave every customer at least 20, or else they are all titles: the
    slates' lengths don't depend on the neighbours.
    """
    train, vectors, rows, users, seen, past, after = sequence_parts(spark, sf_dir)
    shared, own = recommend.split_candidates(
        seen, recommend.top_popular(train, 200), recommend.new_releases(catalog(spark, sf_dir), CUTOFF), similarity.knn(vectors, 50), "customer_id"
    )
    recs = pin(slates.greedy_slates(users, past, shared, own, seen, vectors, slates.fit_scorer(rows)))
    return evaluate_slates(recs, seen, users, after)


@query("r13b_all_items_candidates", sql(GREEDY, TEST_CUSTOMERS.format(
    shared="SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL")))
def r13b(spark, sf_dir):
    """Greedy slates from everything unseen, for all test customers."""
    _, vectors, rows, users, seen, past, after = sequence_parts(spark, sf_dir)
    recs = pin(slates.greedy_slates(users, past, vectors, seen.where("false"), seen, vectors, slates.fit_scorer(rows)))
    return evaluate_slates(recs, seen, users, after)


@query(
    "x11_vector_pooling",
    sql("""SELECT customer_id, round(sum(average), 6) AS mean_total, round(sum(largest), 6) AS max_total FROM (
      SELECT customer_id, dim, avg(x) AS average, max(x) AS largest FROM (
       SELECT customer_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
       FROM past JOIN embeddings ON vec_id = content_id) GROUP BY customer_id, dim) GROUP BY customer_id""",
        """past AS (SELECT customer_id, content_id FROM plays WHERE period IN (1, 2) AND resume = 0 AND content_id IS NOT NULL
         GROUP BY customer_id, content_id
         QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY min(tunein), content_id) <= 20)"""),
)
def x11(spark, sf_dir):
    """Mean and maximum pooling over the first 20 contents of every customer's history."""
    before = shaping.exclude_resumes(plays(spark, sf_dir)).where(history())
    rows = slates.pooled(sampling.past_sequences(before), embeddings(spark, sf_dir), ["customer_id"])

    def total(part):
        return F.round(F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x), 6)

    return rows.select(
        "customer_id", total(F.slice("pooled", 1, 64)).alias("mean_total"), total(F.slice("pooled", 65, 64)).alias("max_total")
    )
