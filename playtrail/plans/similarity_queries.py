"""Queries: co-watching, neighbours, candidates, training examples (j08-j10, r13, g)."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrail.operators import counting, cowatch, inverted, recommend, sampling, shaping, similarity
from playtrail.operators.ordering import dense_index
from playtrail.plans.counting_queries import COUNTED, DELTA, SEQUENCE, counted
from playtrail.plans.evaluation_queries import holdout
from playtrail.plans.registry import query
from playtrail.plans.shaping_queries import NEW_RELEASES, TOP_CUSTOMERS
from playtrail.plans.views import CUTOFF, catalog, plays, sql, table
from playtrail.scratch import through_table


def oracle_hash(text: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


DRAWS = f"""draws AS (SELECT customer_id, draw, arg_min(content_id, h) AS a, arg_max(content_id, h) AS b
 FROM (SELECT customer_id, draw, content_id, {oracle_hash("'117:' || draw || ':' || customer_id || ':' || content_id", 15)} AS h
  FROM (SELECT DISTINCT customer_id, content_id FROM plays WHERE content_id IS NOT NULL)
  CROSS JOIN (SELECT unnest(range({{n}})) AS draw))
 GROUP BY customer_id, draw HAVING arg_min(content_id, h) <> arg_max(content_id, h))"""
INDEX = """item_index AS (SELECT content_id, row_number() OVER (ORDER BY content_id) - 1 AS idx
 FROM (SELECT DISTINCT content_id FROM catalog WHERE content_id IS NOT NULL))"""


def item_index(spark, sf_dir):
    return dense_index(shaping.distinct_ids(catalog(spark, sf_dir), "content_id"))


@query(
    "j08_cowatch_draws",
    sql("""SELECT least(a, b) AS content_id, greatest(a, b) AS other_id, count(*) AS n FROM draws GROUP BY 1, 2""", DRAWS.format(n=4)),
)
def j08(spark, sf_dir):
    return similarity.cowatch_draw_counts(counting.seen_items(plays(spark, sf_dir), "customer_id"))


@query(
    "j08_cowatch_pairs",
    sql("""SELECT a.content_id, b.content_id AS other_id, count(*) AS n FROM seen a JOIN seen b USING (customer_id)
    WHERE a.content_id < b.content_id GROUP BY 1, 2 HAVING count(*) >= 3""",
        "seen AS (SELECT DISTINCT customer_id, content_id FROM plays WHERE content_id IS NOT NULL)"),
)
def j08_pairs(spark, sf_dir):
    """All pairs of titles that at least three customers have both watched."""
    return cowatch.cowatch_pairs(counting.seen_items(plays(spark, sf_dir), "customer_id"), least=3)


NEIGHBORS = """neighbors AS (SELECT a.vec_id AS content_id, b.vec_id AS neighbor_id, round(sqrt(list_sum(list_transform(
   range(1, len(a.embedding) + 1), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) ^ 2))), 6) AS distance
  FROM embeddings a CROSS JOIN embeddings b
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) <= {k})"""


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("content_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


@query(
    "j09_exact_knn",
    "WITH " + NEIGHBORS.format(k=50) + """ SELECT content_id, neighbor_id, distance,
    row_number() OVER (PARTITION BY content_id ORDER BY distance, neighbor_id) AS rn FROM neighbors""",
)
def j09(spark, sf_dir):
    return similarity.knn(embeddings(spark, sf_dir), 50)


#: Least share of the exact neighbours that an approximate index has to find.
RECALL = 0.9


@query(
    "j09_approximate_knn",
    "SELECT CAST(sum(least(50, n)) AS BIGINT) AS total, true AS enough FROM (SELECT count(*) OVER () AS n FROM embeddings)",
)
def j09_approximate(spark, sf_dir):
    """Exact neighbours, and whether the index finds nine tenths of them with the probes chosen for it."""
    vectors = embeddings(spark, sf_dir)
    exact = through_table(similarity.knn(vectors, 50), "exact_neighbors")
    _, hits = similarity.probes_for(vectors, exact, 50, RECALL)
    total = F.count(F.lit(1))
    return exact.agg(total.alias("total"), (F.lit(hits) >= RECALL * total).alias("enough"))


@query("j09_index_knn")
def j09_index(spark, sf_dir):
    """The index of inverted lists, asked for 50 neighbours of every id divisible by 100: its recall, and the share of distances made."""
    vectors = embeddings(spark, sf_dir)
    queries = vectors.where("content_id % 100 = 0").withColumnRenamed("content_id", "query")
    found, took = inverted.sufficient(inverted.build_index(vectors), queries, 50, RECALL)
    counted = found.agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("neighbors"))
    return counted.withColumns({name: F.lit(value) for name, value in took.items()})


@query(
    "j10_sequence_features",
    sql(f"""SELECT customer_id, pos, content_id, round(coalesce(play_share, 0), 9) AS play_share,
     round(coalesce(user_share, 0), 9) AS user_share, round(coalesce(release_delta, 0), 9) AS release_delta
    FROM ({SEQUENCE.format(source="(SELECT * FROM plays WHERE period = 3 AND content_id IS NOT NULL AND resume = 0)")})
    LEFT JOIN (SELECT content_id, count(*) / (SELECT count(*) FROM counted) AS play_share,
      count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM counted) AS user_share
     FROM counted GROUP BY content_id) USING (content_id)
    LEFT JOIN delta USING (content_id)""", COUNTED, DELTA),
)
def j10(spark, sf_dir):
    base, log = counted(spark, sf_dir), plays(spark, sf_dir)
    features = (
        counting.release_delta(catalog(spark, sf_dir), CUTOFF).drop("days")
        .join(counting.reproduction_popularity(base), "content_id", "left")
        .join(counting.user_popularity(base), "content_id", "left")
    )
    sequences = counting.watch_sequence(shaping.exclude_resumes(log.where(holdout())))
    scalars = ["play_share", "user_share", "release_delta"]
    rows = similarity.sequence_features(sequences, features, scalars)
    return rows.withColumns({c: F.round(c, 9) for c in scalars})


@query(
    "r13_candidates",
    sql("""SELECT customer_id, content_id FROM (
      SELECT customer_id, content_id FROM (SELECT DISTINCT customer_id FROM past)
       CROSS JOIN (SELECT content_id FROM popular UNION SELECT content_id FROM fresh)
      UNION SELECT customer_id, neighbor_id FROM past JOIN neighbors USING (content_id))
    ANTI JOIN past USING (customer_id, content_id)""",
        NEW_RELEASES, NEIGHBORS.format(k=50),
        "past AS (SELECT DISTINCT customer_id, content_id FROM plays WHERE period IN (1, 2) AND resume = 0 AND content_id IS NOT NULL)",
        "popular AS (SELECT content_id FROM past GROUP BY content_id ORDER BY count(*) DESC, content_id LIMIT 200)"),
)
def r13(spark, sf_dir):
    """Candidates of every customer, from the history without resumes."""
    log = shaping.exclude_resumes(plays(spark, sf_dir)).where("period IN (1, 2)")
    past = counting.seen_items(log, "customer_id")
    return recommend.candidates(
        shaping.distinct_ids(past, "customer_id"),
        past,
        recommend.top_popular(log, 200),
        recommend.new_releases(catalog(spark, sf_dir), CUTOFF),
        similarity.knn(embeddings(spark, sf_dir), 50),
        "customer_id",
    )


@query(
    "g01_pair_examples",
    sql(f"""SELECT customer_id, draw, 0 AS slot, a, b, 1 AS label FROM draws UNION ALL
    SELECT customer_id, draw, slot, a, content_id, 0 FROM (
     SELECT customer_id, draw, slot, a, {oracle_hash("'117:neg:' || draw || ':' || customer_id || ':' || slot")}
       % (SELECT count(*) FROM item_index) AS idx
     FROM draws CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS slot)) JOIN item_index USING (idx)""",
        DRAWS.format(n=2).replace("unnest(range(2)) AS draw", "CAST(unnest(range(2)) AS INTEGER) AS draw"), INDEX),
)
def g01(spark, sf_dir):
    seen = counting.seen_items(plays(spark, sf_dir), "customer_id")
    return sampling.pair_examples(seen, item_index(spark, sf_dir), draws=2)


@query(
    "g02_sequence_examples",
    sql(f"""SELECT customer_id, example, label, pos, content_id FROM (
     SELECT customer_id, 0 AS example, 1 AS label, content_id, row_number() OVER (PARTITION BY customer_id ORDER BY pos) AS pos
      FROM prefix
     UNION ALL SELECT customer_id, example, 0, content_id, row_number() OVER (PARTITION BY customer_id, example
      ORDER BY md5('117:mix:' || customer_id || ':' || example || ':' || slot || ':' || content_id)) FROM spoilt)
    WHERE pos <= 20""",
        "past AS (SELECT DISTINCT customer_id, content_id FROM plays WHERE period IN (1, 2) AND content_id IS NOT NULL)",
        "future AS (" + SEQUENCE.format(source="(SELECT * FROM plays WHERE period = 3 AND content_id IS NOT NULL)")
        + " HAVING customer_id IN (SELECT customer_id FROM past))",
        f"""lengths AS (SELECT customer_id, 1 + {oracle_hash("'117:len:' || customer_id")} % count(*) AS cut
         FROM future GROUP BY customer_id)""",
        """prefix AS (SELECT customer_id, pos, content_id FROM future JOIN lengths USING (customer_id)
         ANTI JOIN past USING (customer_id, content_id) WHERE pos <= cut)""",
        INDEX,
        f"""extra AS (SELECT customer_id, slot, content_id FROM (SELECT customer_id, slot,
          {oracle_hash("'117:extra:' || customer_id || ':' || slot")} % (SELECT count(*) FROM item_index) AS idx
         FROM lengths CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS slot)) JOIN item_index USING (idx))""",
        """spoilt AS (SELECT customer_id, example, 0 AS slot, content_id FROM prefix
          CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS example)
         UNION ALL SELECT customer_id, example, slot, content_id FROM extra
          JOIN (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS example) ON slot <= example)"""),
)
def g02(spark, sf_dir):
    log = plays(spark, sf_dir)
    return sampling.sequence_examples(log.where("period IN (1, 2)"), log.where(holdout()), item_index(spark, sf_dir))


@query("f08_dense_id_index", sql("SELECT content_id, idx FROM item_index", INDEX))
def f08(spark, sf_dir):
    return item_index(spark, sf_dir)
