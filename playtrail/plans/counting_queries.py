"""Queries: popularity, activity, availability (a, w01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrail.operators import axes, counting, shaping
from playtrail.plans.evaluation_queries import history, holdout
from playtrail.plans.registry import query
from playtrail.plans.views import CUTOFF, catalog, event_plays, plays, raw_plays, sql
from playtrail.scratch import through_table

COUNTS = "counts AS (SELECT content_id, count(*) AS n FROM plays WHERE content_id IS NOT NULL GROUP BY content_id)"


@query("a01_item_play_count", sql("SELECT content_id, n FROM counts", COUNTS))
def a01(spark, sf_dir):
    return counting.item_play_count(plays(spark, sf_dir))


@query(
    "a02_assets_per_content",
    sql("SELECT content_id, count(DISTINCT asset_id) AS assets FROM plays WHERE content_id IS NOT NULL GROUP BY content_id"),
)
def a02(spark, sf_dir):
    return counting.assets_per_content(plays(spark, sf_dir))


@query(
    "a03_asset_normalized_popularity",
    sql("""SELECT content_id, count(*) AS n, count(DISTINCT asset_id) AS assets,
    round(count(*) / ln(count(DISTINCT asset_id) + 1), 6) AS score FROM plays WHERE content_id IS NOT NULL GROUP BY content_id"""),
)
def a03(spark, sf_dir):
    return counting.normalized_popularity(plays(spark, sf_dir))


# Plays as the sequence model counts them: no resumes, content known, first two periods.
COUNTED = """counted AS (SELECT customer_id, content_id, tunein FROM plays
 WHERE resume = 0 AND content_id IS NOT NULL AND period IN (1, 2))"""


def counted(spark, sf_dir):
    first = shaping.exclude_resumes(raw_plays(spark, sf_dir).where(history()))
    return shaping.remap_assets(first, catalog(spark, sf_dir))


@query(
    "a04_reproduction_popularity",
    sql("""SELECT content_id, round(count(*) / (SELECT count(*) FROM counted), 9) AS play_share
    FROM counted GROUP BY content_id""", COUNTED),
)
def a04(spark, sf_dir):
    shares = counting.reproduction_popularity(counted(spark, sf_dir))
    return shares.select("content_id", F.round("play_share", 9).alias("play_share"))


@query(
    "a05_user_popularity",
    sql("""SELECT content_id, round(count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM counted), 9)
    AS user_share FROM counted GROUP BY content_id""", COUNTED),
)
def a05(spark, sf_dir):
    shares = counting.user_popularity(counted(spark, sf_dir))
    return shares.select("content_id", F.round("user_share", 9).alias("user_share"))


@query(
    "a06_seen_set",
    sql("SELECT DISTINCT account_id, content_id FROM plays WHERE period IN (1, 2) AND content_id IS NOT NULL"),
)
def a06(spark, sf_dir):
    return counting.seen_items(plays(spark, sf_dir).where(history()))


@query(
    "a07_seen_list",
    sql("""SELECT account_id, content_id, row_number() OVER (PARTITION BY account_id
    ORDER BY tunein, content_id, asset_id, tuneout) AS pos FROM plays WHERE content_id IS NOT NULL"""),
)
def a07(spark, sf_dir):
    return counting.seen_list(plays(spark, sf_dir))


SEQUENCE = """SELECT customer_id, content_id, row_number() OVER (PARTITION BY customer_id
 ORDER BY min(tunein), content_id) AS pos FROM {source} GROUP BY customer_id, content_id"""


@query("a08_watch_sequence", sql(SEQUENCE.format(source="counted"), COUNTED))
def a08(spark, sf_dir):
    return counting.watch_sequence(counted(spark, sf_dir))


@query(
    "a08_watch_sequence_events",
    sql(SEQUENCE.format(source="(SELECT * FROM event_plays WHERE content_id IS NOT NULL)"), events=True),
)
def a08_events(spark, sf_dir):
    return counting.watch_sequence(event_plays(spark, sf_dir), months={1, 2}, year=2024)


@query(
    "a09_customer_choices",
    sql("""SELECT customer_id, content_id FROM (SELECT DISTINCT customer_id, content_id FROM plays WHERE content_id IS NOT NULL)
    QUALIFY count(*) OVER (PARTITION BY customer_id) >= 2"""),
)
def a09(spark, sf_dir):
    return counting.customer_choices(plays(spark, sf_dir))


def _shares(*cols):
    return ", ".join(f"round(avg(CASE WHEN {c} = 'Y' THEN 1 ELSE 0 END), 9) AS {c}_mean" for c in cols)


ROLLUP = f"""rollup AS (SELECT content_id, max(coalesce(show_type, '')) AS show_type,
  max(country_of_origin) AS country_of_origin, max(lower(coalesce(audience, ''))) AS audience,
  round(avg(released_year), 9) AS released_year_mean, round(avg(run_time_min), 9) AS run_time_min_mean,
  median(run_time_min) AS run_time_min_median,
  {_shares('made_for_tv', 'pay_per_view', 'pack_premium_1', 'pack_premium_2')},
  CAST(len(list_distinct(flatten(list(string_split(category, '/')) FILTER (category IS NOT NULL)))) AS BIGINT) AS category_tokens,
  CAST(len(list_distinct(flatten(list(string_split(keywords, ','))))) AS BIGINT) AS keywords_tokens,
  CAST(len(flatten(list(string_split(cast_first_name, ',')) FILTER (cast_first_name IS NOT NULL))) AS BIGINT) AS cast_first_name_tokens
 FROM catalog WHERE content_id IS NOT NULL GROUP BY content_id)"""


@query(
    "a10_content_rollup",
    sql("""SELECT * REPLACE (coalesce(category_tokens, 0) AS category_tokens,
    coalesce(cast_first_name_tokens, 0) AS cast_first_name_tokens) FROM rollup""", ROLLUP),
)
def a10(spark, sf_dir):
    rollup = counting.content_rollup(catalog(spark, sf_dir))
    means = [c for c in rollup.columns if c.endswith("_mean")]
    return rollup.withColumns({c: F.round(c, 9) for c in means})


@query(
    "a11_interaction_counts",
    sql("SELECT account_id, content_id, count(*) AS n FROM plays WHERE content_id IS NOT NULL AND month(tuneout) < 3 GROUP BY ALL"),
)
def a11(spark, sf_dir):
    return counting.interaction_counts(plays(spark, sf_dir).where("month(tuneout) < 3"))


@query(
    "a12_zero_filled_axes",
    sql("""SELECT 'account' AS axis, account_id AS id, count(content_id) AS n FROM plays WHERE account_id IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'content', id, CAST(coalesce(n, 0) AS BIGINT)
     FROM (SELECT DISTINCT content_id AS id FROM catalog WHERE content_id IS NOT NULL)
     LEFT JOIN (SELECT content_id AS id, n FROM counts) USING (id)""", COUNTS),
)
def a12(spark, sf_dir):
    log = plays(spark, sf_dir)
    counts = counting.interaction_counts(log)

    def axis(ids, name):
        filled = counting.zero_filled_axis(counts, shaping.distinct_ids(ids, name), name)
        return filled.select(F.lit(name[:-3]).alias("axis"), F.col(name).alias("id"), "n")

    return axis(log, "account_id").unionByName(axis(catalog(spark, sf_dir), "content_id"))


@query(
    "a12_zero_filled_grid",
    sql("""SELECT account_id, content_id, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT account_id, content_id FROM plays WHERE period = 3 AND content_id IS NOT NULL)
    LEFT JOIN (SELECT account_id, content_id, count(*) AS n FROM plays WHERE period IN (1, 2) GROUP BY ALL) USING (account_id, content_id)"""),
)
def a12_grid(spark, sf_dir):
    """The cells of the grid that the holdout asks for, with their counts in the history."""
    log = plays(spark, sf_dir)
    asked = counting.seen_items(log.where("period = 3"))
    return counting.zero_filled_cells(counting.interaction_counts(log.where("period IN (1, 2)")), asked)


AXES = """found AS (SELECT 'account_id' AS axis, account_id AS id, count(*) AS n FROM plays WHERE content_id IS NOT NULL AND account_id IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'content_id', content_id, n FROM counts),
bounds AS (SELECT 'account_id' AS axis, min(account_id) AS lo, max(account_id) AS hi FROM plays
 UNION ALL SELECT 'content_id', min(content_id), max(content_id) FROM catalog)"""


def filled_axes(spark, sf_dir):
    """Intervals of both axes, from the smallest to the largest id of the plays and of the catalogue."""
    log = plays(spark, sf_dir)
    counts = through_table(counting.interaction_counts(log), "counts")
    # Two rows: the bounds.
    for axis, low, high in counting.id_range(log, catalog(spark, sf_dir)).collect():
        yield axis, axes.axis_intervals(counts, axis, low, high)


@query(
    "a12_filled_intervals",
    sql("""SELECT axis, id AS "first", id AS "last", n FROM inside
    UNION ALL SELECT axis, id + 1, coalesce(next, hi + 1) - 1, 0 FROM (SELECT *, lead(id) OVER (PARTITION BY axis ORDER BY id) AS next FROM inside)
     WHERE coalesce(next, hi + 1) > id + 1
    UNION ALL SELECT axis, any_value(lo), min(id) - 1, 0 FROM inside GROUP BY axis HAVING min(id) > any_value(lo)""", COUNTS, AXES,
        "inside AS (SELECT axis, id, n, lo, hi FROM found JOIN bounds USING (axis) WHERE id BETWEEN lo AND hi)"),
)
def a12_intervals(spark, sf_dir):
    found = [i.select(F.lit(axis).alias("axis"), "first", "last", "n") for axis, i in filled_axes(spark, sf_dir)]
    return found[0].unionByName(found[1])


@query(
    "a12_filled_ids",
    sql("""SELECT axis, id, coalesce(n, 0) AS n FROM (SELECT axis, unnest(range(lo, hi + 1)) AS id FROM bounds) LEFT JOIN found USING (axis, id)""", COUNTS, AXES),
)
def a12_ids(spark, sf_dir):
    """Every id of both axes, as the intervals unfold."""
    found = [axes.axis_ids(i).select(F.lit(axis).alias("axis"), "id", "n") for axis, i in filled_axes(spark, sf_dir)]
    return found[0].unionByName(found[1])


@query(
    "a13_id_range",
    sql("""SELECT 'account_id' AS id, min(account_id) AS lo, max(account_id) AS hi FROM plays UNION ALL
    SELECT 'content_id', min(content_id), max(content_id) FROM catalog"""),
)
def a13(spark, sf_dir):
    return counting.id_range(plays(spark, sf_dir), catalog(spark, sf_dir))


@query(
    "a14_activity_quantiles",
    sql("""SELECT CAST(prob AS DOUBLE) AS prob, round(quantile, 6) AS plays FROM (
     SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0]) AS prob,
      unnest(quantile_cont(CAST(n AS DOUBLE), [0.5, 0.9, 0.95, 0.99, 1.0])) AS quantile
     FROM (SELECT account_id, count(content_id) AS n FROM plays GROUP BY account_id))"""),
)
def a14(spark, sf_dir):
    return counting.activity_quantiles(plays(spark, sf_dir)).select("prob", F.round("plays", 6).alias("plays"))


CURVE = """curve AS (SELECT content_id, n, row_number() OVER o AS rank, CAST(sum(n) OVER o AS BIGINT) AS reached,
  sum(n) OVER o / sum(n) OVER () AS share FROM ({counts})
 WINDOW o AS (ORDER BY n DESC, content_id ROWS UNBOUNDED PRECEDING))"""
SUMMARY = """SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (share < threshold) AS items,
 round(count(*) FILTER (share < threshold) / count(*), 9) AS item_share
 FROM curve CROSS JOIN (SELECT unnest([0.90, 0.95, 0.99]) AS threshold) GROUP BY threshold"""
HISTORY_COUNTS = "SELECT content_id, count(*) AS n FROM plays WHERE period IN (1, 2) AND content_id IS NOT NULL GROUP BY 1"
EVENT_COUNTS = "SELECT content_id, count(*) AS n FROM event_plays GROUP BY 1"


def summary(curve):
    return counting.coverage_summary(curve).withColumn("item_share", F.round("item_share", 9))


@query("a15_coverage_curve", sql(SUMMARY, CURVE.format(counts=HISTORY_COUNTS)))
def a15(spark, sf_dir):
    return summary(counting.coverage_curve(plays(spark, sf_dir).where(history())))


@query("a15_coverage_curve_events", sql(SUMMARY, CURVE.format(counts=EVENT_COUNTS), events=True))
def a15_events(spark, sf_dir):
    return summary(counting.coverage_curve(event_plays(spark, sf_dir)))


@query(
    "w01_running_share",
    sql("SELECT content_id, n, rank, reached, round(share, 9) AS share FROM curve", CURVE.format(counts=HISTORY_COUNTS)),
)
def w01(spark, sf_dir):
    curve = counting.coverage_curve(plays(spark, sf_dir).where(history()))
    return curve.withColumn("share", F.round("share", 9))


@query(
    "a16_latest_availability",
    sql("SELECT content_id, max(start_vod_date) AS latest_start FROM catalog WHERE content_id IS NOT NULL GROUP BY content_id"),
)
def a16(spark, sf_dir):
    return counting.latest_start(catalog(spark, sf_dir))


DELTA = f"""delta AS (SELECT content_id, days, days / avg(days) OVER () AS release_delta FROM (SELECT content_id,
  CAST(floor((epoch_us(max(start_vod_date)) - epoch_us(TIMESTAMP '{CUTOFF}')) / 86400000000.0) AS INTEGER) AS days
 FROM catalog WHERE content_id IS NOT NULL GROUP BY content_id))"""


@query("a17_release_delta", sql("SELECT content_id, days, round(release_delta, 9) AS release_delta FROM delta", DELTA))
def a17(spark, sf_dir):
    return counting.release_delta(catalog(spark, sf_dir), CUTOFF).withColumn("release_delta", F.round("release_delta", 9))


@query(
    "a18_frequency_cut",
    sql("""SELECT 'top' AS cut, * FROM (SELECT show_type AS level, count(*) AS n FROM rollup GROUP BY 1 ORDER BY n DESC, level LIMIT 4)
    UNION ALL SELECT 'min_count', country_of_origin, count(*) FROM rollup GROUP BY 2 HAVING count(*) > 40
    UNION ALL SELECT 'drop_last', * FROM (SELECT audience, count(*) AS n FROM rollup GROUP BY 1
     QUALIFY row_number() OVER (ORDER BY n, audience DESC) > 1)""", ROLLUP),
)
def a18(spark, sf_dir):
    rollup = counting.content_rollup(catalog(spark, sf_dir))

    def cut(name, col, **how):
        return counting.frequency_cut(rollup, col, **how).select(F.lit(name).alias("cut"), "level", "n")

    return (
        cut("top", "show_type", top=4)
        .unionByName(cut("min_count", "country_of_origin", min_count=40))
        .unionByName(cut("drop_last", "audience", drop_last=True))
    )
