"""Popularity, activity and availability aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.columns import days_since, flag, in_period, tokens
from playtrail.operators.ordering import positions, running_share
from playtrail.schema import FLAG_COLUMNS


def item_play_count(plays: DataFrame) -> DataFrame:
    return (
        plays.where(F.col("content_id").isNotNull())
        .groupBy("content_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def assets_per_content(plays: DataFrame) -> DataFrame:
    return (
        plays.where(F.col("content_id").isNotNull())
        .groupBy("content_id")
        .agg(F.count_distinct("asset_id").alias("assets"))
    )


def normalized_popularity(plays: DataFrame) -> DataFrame:
    """Plays divided by ln(distinct assets + 1).

    Counting per (content, asset) first makes the distinct count a plain count, so the
    second aggregation sees one row per asset.
    """
    per_asset = (
        plays.where(F.col("content_id").isNotNull())
        .groupBy("content_id", "asset_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_asset.groupBy("content_id").agg(
        F.sum("n").alias("n"), F.count("asset_id").alias("assets")
    ).withColumn("score", F.round(F.try_divide(F.col("n"), F.log(F.col("assets") + 1)), 6))


def reproduction_popularity(plays: DataFrame) -> DataFrame:
    """Share of all given plays that went to each content."""
    counts = item_play_count(plays)
    total = plays.agg(F.count(F.lit(1))).scalar()
    return counts.select("content_id", (F.col("n") / total).alias("play_share"))


def user_popularity(plays: DataFrame, user_col: str = "customer_id") -> DataFrame:
    """Share of all given users that played each content.

    The (content, user) pairs are made distinct first; a title everyone watched is then a
    partial count per task, not one large set.
    """
    pairs = plays.where(F.col("content_id").isNotNull()).select("content_id", user_col).distinct()
    total = plays.select(user_col).distinct().agg(F.count(user_col)).scalar()
    return pairs.groupBy("content_id").agg((F.count(user_col) / total).alias("user_share"))


def seen_items(plays: DataFrame, user_col: str = "account_id") -> DataFrame:
    return plays.where(F.col("content_id").isNotNull()).select(user_col, "content_id").distinct()


def seen_list(plays: DataFrame, user_col: str = "account_id") -> DataFrame:
    """Every play of every user in time order, repeats kept, as numbered rows."""
    rows = plays.where(F.col("content_id").isNotNull() & F.col(user_col).isNotNull()).select(
        user_col, "content_id", "tunein", "asset_id", "tuneout"
    )
    order = [F.asc("tunein"), F.asc("content_id"), F.asc("asset_id"), F.asc("tuneout")]
    return positions(rows, order, keys=[user_col]).select(user_col, "pos", "content_id")


def first_watch(plays: DataFrame, user_col: str = "customer_id") -> DataFrame:
    return (
        plays.where(F.col("content_id").isNotNull() & F.col(user_col).isNotNull())
        .groupBy(user_col, "content_id")
        .agg(F.min("tunein").alias("first_ts"))
    )


def watch_sequence(plays: DataFrame, months=None, user_col: str = "customer_id", year: int | None = None) -> DataFrame:
    """Distinct contents of each user in order of first play, as numbered rows."""
    if months is not None:
        plays = plays.where(in_period(F.col("tunein"), months, year=year))
    order = [F.asc("first_ts"), F.asc("content_id")]
    return positions(first_watch(plays, user_col), order, keys=[user_col]).select(
        user_col, "pos", "content_id"
    )


def customer_choices(plays: DataFrame, min_items: int = 2, user_col: str = "customer_id") -> DataFrame:
    """Distinct (user, content) of the users with at least ``min_items`` contents."""
    pairs = seen_items(plays, user_col)
    enough = pairs.groupBy(user_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_items)
    return pairs.join(enough, user_col, "left_semi")


def interaction_counts(plays: DataFrame, user_col: str = "account_id") -> DataFrame:
    return (
        plays.where(F.col("content_id").isNotNull() & F.col(user_col).isNotNull())
        .groupBy(user_col, "content_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def id_range(plays: DataFrame, catalog: DataFrame) -> DataFrame:
    """Smallest and largest account (from the plays) and content (from the catalogue)."""
    accounts = plays.agg(F.min("account_id").alias("lo"), F.max("account_id").alias("hi"))
    contents = catalog.agg(F.min("content_id").alias("lo"), F.max("content_id").alias("hi"))
    return accounts.select(F.lit("account_id").alias("id"), "lo", "hi").unionByName(
        contents.select(F.lit("content_id").alias("id"), "lo", "hi")
    )


def zero_filled_axis(counts: DataFrame, ids: DataFrame, axis: str) -> DataFrame:
    """All given ids of an axis with their total, zero where there is no play.

    The ids are those that occur, not a range up to the largest: hashed ids have no range worth filling.
    """
    totals = counts.groupBy(axis).agg(F.sum("n").alias("n"))
    return ids.select(axis).distinct().join(totals, axis, "left").select(axis, F.coalesce("n", F.lit(0)).alias("n"))


def zero_filled_cells(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The counts of given (account, content) pairs, zero where there is no play."""
    cells = pairs.select("account_id", "content_id").distinct()
    return cells.join(counts, ["account_id", "content_id"], "left").fillna({"n": 0})


def activity_quantiles(plays: DataFrame, probs=(0.5, 0.9, 0.95, 0.99, 1.0), user_col: str = "account_id") -> DataFrame:
    """Quantiles, linearly interpolated, of the number of plays per user.

    Users are first grouped by their number of plays, so the exact percentile merges a
    short histogram instead of one value per user.
    """
    per_user = (
        plays.where(F.col(user_col).isNotNull()).groupBy(user_col).agg(F.count("content_id").alias("n"))
    )
    histogram = per_user.groupBy("n").agg(F.count(F.lit(1)).alias("users"))
    at = F.array(*[F.lit(float(p)) for p in probs])
    row = histogram.agg(F.percentile("n", at, F.col("users")).alias("v"))
    return row.select(F.posexplode("v").alias("i", "plays")).select(
        F.element_at(at, F.col("i") + 1).alias("prob"), "plays"
    )


def coverage_curve(plays: DataFrame) -> DataFrame:
    return running_share(item_play_count(plays))


def coverage_summary(curve: DataFrame, thresholds=(0.90, 0.95, 0.99)) -> DataFrame:
    """For each threshold the number and share of items whose running share stays below it."""
    below = curve.agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.count_if(F.col("share") < t).alias(f"_{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("items"))
            for i, t in enumerate(thresholds)
        ]
    )
    return below.select("n_items", F.inline(rows)).select(
        "threshold", "items", (F.col("items") / F.col("n_items")).alias("item_share")
    )


def latest_start(catalog: DataFrame) -> DataFrame:
    return (
        catalog.where(F.col("content_id").isNotNull())
        .groupBy("content_id")
        .agg(F.max("start_vod_date").alias("latest_start"))
    )


def release_delta(catalog: DataFrame, cutoff: str) -> DataFrame:
    """Days from ``cutoff`` to the latest availability, divided by their mean."""
    days = latest_start(catalog).select(
        "content_id", days_since(F.col("latest_start"), F.lit(cutoff).cast("timestamp_ntz")).alias("days")
    )
    mean = days.agg(F.avg("days")).scalar()
    return days.withColumn("release_delta", F.try_divide(F.col("days").cast("double"), mean))


def level_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def frequency_cut(df: DataFrame, col: str, top: int | None = None, min_count: int | None = None, drop_last: bool = False) -> DataFrame:
    """Levels of a column with their counts: the ``top`` ones, those above ``min_count``, or all but the rarest."""
    levels = level_counts(df, col)
    if min_count is not None:
        levels = levels.where(F.col("n") > min_count)
    if drop_last:
        rarest = levels.agg(F.max(F.struct((-F.col("n")).alias("n"), F.col("level")))["level"]).scalar()
        levels = levels.where(F.col("level") != rarest)
    if top is not None:
        levels = levels.orderBy(F.desc("n"), F.asc("level")).limit(top)
    return levels


def score_summary(scored: DataFrame, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Median score per label, and a histogram over ``[0, 1]`` in equal bins.

    Equal scores are counted first; the median is read off their running count, so neither a
    label with most of the rows nor many different scores end up in one task.
    """
    tied = scored.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(tied, [F.asc("score")], keys=["label"], sums={"upto": "n"})
    sizes = tied.groupBy("label").agg(F.sum("n").alias("n"))
    at = placed.select("label", "score", "upto").join(sizes, "label")

    def reaching(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col("score")))

    medians = at.groupBy("label", "n").agg(
        ((reaching(F.floor((F.col("n") + 1) / 2)) + reaching(F.floor((F.col("n") + 2) / 2))) / 2).alias("median")
    )
    bin_no = F.least(F.floor(F.col("score") * bins) + 1, F.lit(bins)).cast("bigint")
    histogram = tied.groupBy("label", bin_no.alias("bin")).agg(F.sum("n").alias("n"))
    return medians.select("label", "median", "n"), histogram


def clean_catalog(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with missing text as empty, audience in lower case and flags as booleans."""
    text = {c: F.coalesce(c, F.lit("")) for c in ["show_type", "country_of_origin"]}
    return catalog.where(F.col("content_id").isNotNull()).withColumns(
        {
            **text,
            "audience": F.lower(F.coalesce("audience", F.lit(""))),
            **{c: flag(F.col(c)) for c in FLAG_COLUMNS},
        }
    )


# Separator of each token column, and whether repeats within a content are kept.
TOKEN_COLUMNS = {"category": ("/", False), "keywords": (",", False), "cast_first_name": (",", True)}


def content_tokens(catalog: DataFrame, col: str) -> DataFrame:
    """Tokens of each content with their count; de-duplicated columns count every token once."""
    sep, repeats = TOKEN_COLUMNS[col]
    rows = catalog.where(F.col("content_id").isNotNull()).select(
        "content_id", F.explode(tokens(F.col(col), sep)).alias("token")
    )
    n = F.count(F.lit(1)) if repeats else F.max(F.lit(1).cast("bigint"))
    return rows.groupBy("content_id", "token").agg(n.alias("n"))


def content_rollup(catalog: DataFrame) -> DataFrame:
    """One row per content: largest text values, mean year, run times and flags, token counts."""
    rows = clean_catalog(catalog)

    def share(c: str) -> Column:
        return F.avg(F.col(c).cast("int"))

    rollup = rows.groupBy("content_id").agg(
        F.max("show_type").alias("show_type"),
        F.max("country_of_origin").alias("country_of_origin"),
        F.max("audience").alias("audience"),
        F.avg("released_year").alias("released_year_mean"),
        F.avg("run_time_min").alias("run_time_min_mean"),
        F.median("run_time_min").alias("run_time_min_median"),
        *[share(c).alias(f"{c}_mean") for c in FLAG_COLUMNS],
    )
    for col in TOKEN_COLUMNS:
        counts = content_tokens(catalog, col).groupBy("content_id").agg(F.sum("n").alias(f"{col}_tokens"))
        rollup = rollup.join(counts, "content_id", "left").fillna({f"{col}_tokens": 0})
    return rollup
