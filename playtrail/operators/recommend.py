"""Slates from rankings: popularity recommenders, candidates, back-fill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.operators.counting import (
    coverage_curve,
    item_play_count,
    latest_start,
    normalized_popularity,
    seen_items,
)
from playtrail.operators.ordering import ranked, top_items, top_k
from playtrail.operators.shaping import drop_seen, first_play_only, keep_members, merge_candidates
from playtrail.operators.similarity import dealt, stripe_of
from playtrail.scratch import through_table

# Ranks up to here are looked up by broadcast (under 2 MB); deeper ones by shuffle.
HEAD_RANKS = 1 << 16

# An account's seen ranks are counted in stretches of so many ranks.
STRETCH = 4096


def popularity_ranking(plays: DataFrame, ranking: str = "plays") -> DataFrame:
    """Contents by rank: ``plays``, ``per_asset`` (asset-normalized) or ``first_play`` (one play per account)."""
    if ranking == "plays":
        scores = item_play_count(plays).withColumnRenamed("n", "score")
    elif ranking == "per_asset":
        scores = normalized_popularity(plays)
    elif ranking == "first_play":
        scores = item_play_count(first_play_only(plays)).withColumnRenamed("n", "score")
    else:
        raise ValueError(f"unknown ranking {ranking!r}")
    return ranked(scores.select("content_id", "score")).select("content_id", "rank")


def unseen_ranks(users: DataFrame, seen_ranks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ranks each account has not seen, by arithmetic on its seen ranks.

    Between two neighbouring seen ranks lies a run of unseen ones, and the number of unseen
    ranks above the j-th seen rank r is r - j; only the runs that still start within the
    first ``k`` are unfolded.  No user-by-item product is formed and no list is collected.

    An account that has seen most of the catalogue is counted in stretches of ``STRETCH`` ranks, so that
    no task sorts more than that of it; stretches that begin with ``k`` unseen ranks above
    them are dropped whole.
    """
    zero = F.lit(0).cast("bigint")
    marks = seen_ranks.select("account_id", "rank").unionByName(users.select("account_id", zero.alias("rank")))
    marks = marks.withColumn("stretch", F.floor(F.col("rank") / STRETCH))
    in_order = Window.partitionBy("account_id").orderBy("stretch")
    stretches = (
        marks.groupBy("account_id", "stretch")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
        .select(
            "account_id",
            "stretch",
            F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.lead("first").over(in_order).alias("later"),
        )
        .where(F.col("stretch") * STRETCH - F.col("before") < k)
    )
    w = Window.partitionBy("account_id", "stretch").orderBy("rank")
    runs = marks.join(stretches, ["account_id", "stretch"]).select(
        "account_id",
        "rank",
        (F.row_number().over(w) - 1 + F.col("before")).alias("seen_above"),
        F.coalesce(F.lead("rank").over(w), "later").alias("next_rank"),
    ).where(F.col("rank") - F.col("seen_above") < k)
    last = F.col("seen_above") + k
    runs = runs.withColumn("last", F.least(F.coalesce(F.col("next_rank") - 1, last), last))
    return runs.where(F.col("last") > F.col("rank")).select(
        "account_id",
        "seen_above",
        F.explode(F.sequence(F.col("rank") + 1, F.col("last"))).alias("rank"),
    ).select("account_id", (F.col("rank") - F.col("seen_above")).alias("pos"), "rank")


def contents_at(ranks: DataFrame, ranking: DataFrame) -> DataFrame:
    """Replace ranks by contents.

    Nearly every account asks for the first ranks: those come from a broadcast of at most
    ``HEAD_RANKS`` rows, and only the rare deep ranks are shuffled.  The ranks are written once for both.
    """
    ranks = through_table(ranks, "ranks")
    head = F.broadcast(ranking.where(F.col("rank") <= HEAD_RANKS))
    tail = ranking.where(F.col("rank") > HEAD_RANKS)
    return (
        ranks.where(F.col("rank") <= HEAD_RANKS)
        .join(head, "rank")
        .unionByName(ranks.where(F.col("rank") > HEAD_RANKS).join(tail, "rank"))
        .drop("rank")
    )


def recommend_popular(ranking: DataFrame, users: DataFrame, seen: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` of a ranking per account, without what the account has seen."""
    users = users.select("account_id")
    seen_ranks = (
        seen.join(users, "account_id", "left_semi").join(ranking, "content_id").select("account_id", "rank")
    )
    return contents_at(unseen_ranks(users, seen_ranks, k), ranking).select("account_id", "pos", "content_id")


def head_items(curve: DataFrame, share: float = 0.99) -> DataFrame:
    """Items before the running share reaches ``share``; the item that reaches it is left out."""
    return curve.where(F.col("share") < share).select("content_id")


def head_plays(plays: DataFrame, share: float = 0.99) -> DataFrame:
    return keep_members(plays, head_items(coverage_curve(plays), share), "content_id")


def new_releases(catalog: DataFrame, cutoff: str) -> DataFrame:
    return latest_start(catalog).where(F.col("latest_start") > F.lit(cutoff).cast("timestamp_ntz"))


#: Users and items of a meeting that lists candidates: at most so many squared rows leave it.
LISTED = 1024


def candidates(users: DataFrame, history: DataFrame, top: DataFrame, new: DataFrame, neighbors: DataFrame, user_col: str = "account_id") -> DataFrame:
    """Popular items, new releases and neighbours of everything watched, without the watched, for every user.

    This listing has a row per user and shared item by its nature.  Slates don't need it: they take the two
    parts of :func:`split_candidates` as they are.  Stripes of users meet stripes of items; own candidates and what was watched
    go to the one meeting they concern, so that the listing is neither made distinct nor joined.
    """
    everyone = through_table(users.select(user_col).where(F.col(user_col).isNotNull()).distinct(), "candidate_users")
    history = history.join(everyone, user_col, "left_semi")
    shared, own = split_candidates(history, top, new, neighbors, user_col)
    own = through_table(own, "own_candidates")
    offered = shared.select("content_id", F.lit(True).alias("shared")).unionByName(own.select("content_id", F.lit(False).alias("shared")))
    items = through_table(offered.groupBy("content_id").agg(F.bool_or("shared").alias("shared")), "candidate_items")
    n_users, n_items = (max(1, -(-df.count() // LISTED)) for df in (everyone, items))
    marks = own.select(user_col, "content_id", F.lit(True).alias("own")).unionByName(history.select(user_col, "content_id", F.lit(False).alias("own")))
    marks = marks.select(user_col, "content_id", "own", stripe_of(user_col, n_users).alias("u"), stripe_of("content_id", n_items).alias("i"))
    left = dealt(everyone, user_col, "u", n_users, "i", n_items)
    # Rows without a mark are the users; their content is 0, as a null would make the ids floats.
    left = left.select(user_col, F.lit(0).cast("bigint").alias("content_id"), F.lit(None).cast("boolean").alias("own"), "u", "i").unionByName(marks)
    right = dealt(items, "content_id", "i", n_items, "u", n_users)

    def listed(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("content_id")
        ids = known["content_id"].to_numpy(dtype=np.int64)
        mine = asked["own"].isna().to_numpy()
        who = np.sort(asked[user_col].to_numpy()[mine].astype(np.int64))
        able = np.repeat(known["shared"].to_numpy(dtype=bool)[None, :], len(who), axis=0)
        marked = asked[~mine]
        for value in (True, False):  # what was watched goes last and wins
            chosen = marked[marked["own"].astype(bool) == value]
            content = chosen["content_id"].to_numpy(dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, content), max(0, len(ids) - 1))
            there = ids[at] == content if len(ids) else np.zeros(0, bool)
            able[np.searchsorted(who, chosen[user_col].to_numpy(dtype=np.int64)[there]), at[there]] = value
        u, i = np.nonzero(able)
        return pd.DataFrame({user_col: who[u], "content_id": ids[i]})

    return left.groupBy("u", "i").cogroup(right.groupBy("u", "i")).applyInPandas(listed, f"{user_col} bigint, content_id bigint")


def split_candidates(history: DataFrame, top: DataFrame, new: DataFrame, neighbors: DataFrame, user_col: str = "account_id") -> tuple[DataFrame, DataFrame]:
    """Candidates in two parts: contents offered to everyone, and each account's own neighbours."""
    shared = merge_candidates(top.select("content_id"), new.select("content_id"))
    near = neighbors.select("content_id", F.col("neighbor_id"))
    own = history.join(near, "content_id").select(user_col, F.col("neighbor_id").alias("content_id")).distinct()
    return shared, own


def unseen_pairs(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Given (user, item) pairs without the observed ones."""
    return drop_seen(pairs.select("account_id", "content_id").distinct(), seen)


def unseen_counts(users: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """How many of all items each user has not seen; the pairs themselves are never formed."""
    n_items = items.agg(F.count(F.lit(1))).scalar()
    observed = keep_members(seen, items, "content_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))
    return users.join(observed, "account_id", "left").select(
        "account_id", (n_items - F.coalesce("_n", F.lit(0))).alias("unseen")
    )


def backfill(slate: DataFrame, popular: DataFrame, n: int, k: int = 20) -> DataFrame:
    """Append the first ``n`` popular unseen items to each slate, drop repeats, cut to ``k``.

    Both inputs hold at most a slate per account; repeats keep their first place.
    """
    tail = popular.where(F.col("pos") <= n)
    both = slate.select("account_id", "content_id", F.lit(0).alias("_src"), "pos").unionByName(
        tail.select("account_id", "content_id", F.lit(1).alias("_src"), "pos")
    )
    firsts = both.groupBy("account_id", "content_id").agg(F.min(F.struct("_src", "pos")).alias("_at"))
    order = [F.asc("_at._src"), F.asc("_at.pos"), F.asc("content_id")]
    return top_k(firsts, ["account_id"], order, k).select("account_id", "pos", "content_id")


def top_popular(plays: DataFrame, n: int = 200, user_col: str = "customer_id") -> DataFrame:
    """The ``n`` contents with most distinct users."""
    pairs = seen_items(plays, user_col)
    users = pairs.groupBy("content_id").agg(F.count(F.lit(1)).alias("users"))
    return top_items(users, n, by="users")
