"""Filters, joins, de-duplication and splits of the play log."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.columns import hash_hex, hash_long, in_period
from playtrail.operators.ordering import first_per_group


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def exclude_resumes(plays: DataFrame) -> DataFrame:
    return plays.where(F.col("resume") == 0)


def keep_members(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(members, on, "left_semi")


def cast_ids(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ids as BIGINT; text that is no number becomes null instead of failing the job."""
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in cols})


def fill_missing(df: DataFrame, defaults: dict) -> DataFrame:
    """Replace nulls; an empty list as default stands for an empty array of the column's type."""
    types = dict(df.dtypes)
    filled = {}
    for name, value in defaults.items():
        default = F.array().cast(types[name]) if value == [] else F.lit(value)
        filled[name] = F.coalesce(F.col(name), default)
    return df.withColumns(filled)


def asset_map(catalog: DataFrame, order: str | None = None) -> DataFrame:
    """One content per asset: the last listed one by ``order`` (the larger content id if none)."""
    return (
        catalog.where(F.col("content_id").isNotNull())
        .groupBy("asset_id")
        .agg(F.max_by("content_id", F.struct(order or "content_id", "content_id")).alias("content_id"))
    )


def remap_assets(plays: DataFrame, catalog: DataFrame, how: str = "inner", order: str | None = None) -> DataFrame:
    """Replace each play's asset by its content; ``inner`` drops unmatched plays, ``left`` keeps them."""
    return plays.drop("content_id").join(asset_map(catalog, order), "asset_id", how)


def enrich_plays(plays: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every play with its content id, null where the catalogue has none.

    The side is left to Catalyst: it broadcasts the two catalogue columns when they are
    small, and otherwise joins by shuffle with skewed assets split at run time.
    """
    return plays.join(catalog.select("asset_id", "content_id"), "asset_id", "left")


def with_history(users: DataFrame, history: DataFrame, on: str = "account_id") -> DataFrame:
    """All users with their history rows; a user without any keeps one row of nulls."""
    return users.select(on).join(history, on, "left")


def drop_seen(candidates: DataFrame, seen: DataFrame, user_col: str = "account_id") -> DataFrame:
    return candidates.join(seen.select(user_col, "content_id"), [user_col, "content_id"], "left_anti")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def merge_candidates(*frames: DataFrame) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged.distinct()


def active_in_both(a: DataFrame, b: DataFrame, user_col: str = "customer_id") -> DataFrame:
    return a.select(user_col).intersect(b.select(user_col))


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def first_play_only(plays: DataFrame, user_col: str = "account_id") -> DataFrame:
    """The earliest play of each (account, content); plays without content count as one content.

    Meant to run before any period filter: a title first played in the holdout period loses
    its earlier-by-file plays as well.
    """
    order = [F.asc("tunein"), F.asc("asset_id"), F.asc("tuneout"), F.asc("customer_id"), F.asc("resume")]
    return first_per_group(plays, [user_col, "content_id"], order)


def split_time(plays: DataFrame, col: str, holdout: int, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """History (all but the holdout month, missing timestamps included) and holdout."""
    ts = F.col(col)
    return (
        plays.where(in_period(ts, holdout, "not_in", year)),
        plays.where(in_period(ts, holdout, "in", year)),
    )


def split_key(seed: int = 117, user_col: str = "account_id") -> Column:
    """The number by which accounts are put in random order for the split."""
    return hash_long(seed, F.col(user_col))


def split_cut(plays: DataFrame, prop: float = 0.2, seed: int = 117, user_col: str = "account_id", key: Column | None = None) -> tuple[int, int] | None:
    """Key and id of the last test account, ``ceil(prop * n)`` accounts deep in key order.

    The first 16 of the key's 60 bits cut the accounts into at most 65,536 even buckets.  Their
    counts tell which bucket holds the cut, and only the accounts of that bucket are ordered.
    """
    key = split_key(seed, user_col) if key is None else key
    accounts = plays.where(F.col(user_col).isNotNull()).select(user_col, key.alias("h"), F.shiftright(key, 44).alias("b"))
    buckets = accounts.distinct().groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    place = math.ceil(prop * sum(r["n"] for r in buckets))
    for r in sorted(buckets):
        if 0 < place <= r["n"]:
            inside = accounts.where(F.col("b") == r["b"]).distinct()
            cut = inside.orderBy("h", user_col).offset(place - 1).limit(1).first()
            return cut["h"], cut[user_col]
        place -= r["n"]
    return None


def before_cut(cut: tuple[int, int] | None, seed: int = 117, user_col: str = "account_id", key: Column | None = None) -> Column:
    """Predicate for rows of the accounts up to a cut of :func:`split_cut`."""
    key = split_key(seed, user_col) if key is None else key
    if cut is None:
        return F.lit(False)
    return F.col(user_col).isNotNull() & ((key < cut[0]) | ((key == cut[0]) & (F.col(user_col) <= F.lit(cut[1]))))


def is_test(plays: DataFrame, prop: float = 0.2, seed: int = 117, user_col: str = "account_id", key: Column | None = None) -> Column:
    """Predicate for plays of test accounts: key order up to the cut.

    The cut is two values, fetched once, so the split costs its readers no join and no further
    pass over the accounts.  A stored :func:`split_key` column given as ``key`` is compared as
    it is, which Parquet can do on its own.
    """
    return before_cut(split_cut(plays, prop, seed, user_col, key), seed, user_col, key)


def split_users(plays: DataFrame, prop: float = 0.2, seed: int = 117, user_col: str = "account_id") -> DataFrame:
    """Accounts with ``is_test`` set for exactly ``ceil(prop * n)`` of them."""
    test = is_test(plays, prop, seed, user_col)
    return distinct_ids(plays, user_col).withColumn("is_test", test)


def sample_users_n(users: DataFrame, n: int, seed: int = 117, user_col: str = "account_id") -> DataFrame:
    """``n`` users in a reproducible random order."""
    return (
        users.select(user_col, hash_hex(seed, F.col(user_col)).alias("_h"))
        .orderBy("_h", user_col)
        .limit(n)
        .drop("_h")
    )
