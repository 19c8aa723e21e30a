"""Average precision, AUC, losses and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.operators.counting import first_watch
from playtrail.operators.ordering import mid_ranks, running_count, top_k


def truth_slates(plays: DataFrame, k: int = 20, user_col: str = "account_id") -> DataFrame:
    """First ``k`` distinct contents of each user by first play."""
    order = [F.asc("first_ts"), F.asc("content_id")]
    return top_k(first_watch(plays, user_col), [user_col], order, k).drop("first_ts")


def slate_pairs(preds: DataFrame, truth: DataFrame, k: int = 20, users: DataFrame | None = None) -> DataFrame:
    """Predicted and true slate of each account side by side, as arrays of at most ``k``.

    Both sides and the list of accounts meet in one aggregation, hence in one shuffle.  With
    ``users`` exactly those accounts come out, otherwise every account of either side.
    """
    none = F.lit(None).cast("struct<pos:bigint,content_id:bigint>")
    cell = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("content_id").cast("bigint").alias("content_id"))

    def tagged(df: DataFrame, pred: Column, true: Column, listed: bool) -> DataFrame:
        return df.select("account_id", pred.alias("pred"), true.alias("true"), F.lit(listed).alias("listed"))

    cut = F.col("pos") <= k
    sides = tagged(preds.where(cut), cell, none, users is None).unionByName(
        tagged(truth.where(cut), none, cell, users is None)
    )
    if users is not None:
        sides = sides.unionByName(tagged(users, none, none, True))
    return (
        sides.groupBy("account_id")
        .agg(
            F.max("listed").alias("listed"),
            F.array_sort(F.collect_list("pred")).alias("pred"),
            F.array_sort(F.collect_list("true")).alias("true"),
        )
        .where("listed")
        .select("account_id", F.col("pred.content_id").alias("pred"), F.col("pred.pos").alias("pred_pos"), F.col("true.content_id").alias("true"))
    )


def ap_of(pred: Column, pred_pos: Column, true: Column) -> Column:
    """Mean, over the hits, of hits so far divided by position; 0 without a hit.

    A repeated prediction counts at its first place only, but still takes up its later ones.
    """
    cells = F.arrays_zip(pred.alias("item"), pred_pos.alias("pos"))
    hits = F.filter(
        cells,
        lambda c, i: F.array_contains(true, c["item"]) & (F.array_position(pred, c["item"]) == i + 1),
    )
    precisions = F.transform(hits, lambda c, i: (i + 1) / c["pos"])
    total = F.aggregate(precisions, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.try_divide(total, F.size(hits)), F.lit(0.0))


def average_precision(preds: DataFrame, truth: DataFrame, k: int = 20, users: DataFrame | None = None) -> DataFrame:
    return slate_pairs(preds, truth, k, users).select(
        "account_id", ap_of(F.col("pred"), F.col("pred_pos"), F.col("true")).alias("ap")
    )


def map_at_k(users: DataFrame, preds: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """Mean average precision over all listed users; those without a hit count 0."""
    return average_precision(preds, truth, k, users).agg(
        F.count(F.lit(1)).alias("users"), F.avg("ap").alias("map")
    )


def cumulative_hits(hits: DataFrame) -> DataFrame:
    """Hits so far divided by position, for the hit rows of slates."""
    numbered = running_count(hits, ["account_id"], [F.asc("pos")], "hits_so_far")
    return numbered.withColumn("precision", F.col("hits_so_far") / F.col("pos"))


def truth_vs_preds(truth: DataFrame, preds: DataFrame, k: int = 20) -> DataFrame:
    return slate_pairs(preds, truth, k).select("account_id", "true", "pred")


def attach_truth(recs: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """Every recommended account with its truth, empty if there is none."""
    return slate_pairs(recs, truth, k, recs.select("account_id")).select("account_id", "pred", "true")


def _auc(ranks: DataFrame, by: list[str]) -> DataFrame:
    sums = ranks.groupBy(*by).agg(
        F.sum(F.col("mid_rank") * F.col("n_pos")).alias("_rank_sum"),
        F.sum("n_pos").cast("double").alias("_pos"),
        F.sum("n").cast("double").alias("_all"),
    )
    negatives = F.col("_all") - F.col("_pos")
    u = F.col("_rank_sum") - F.col("_pos") * (F.col("_pos") + 1) / 2
    return sums.select(*by, F.try_divide(u, F.col("_pos") * negatives).alias("auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of all rows, by rank sum, equal scores at their mean rank."""
    return _auc(mid_ranks(scored), [])


def auc_per_user(scored: DataFrame, user_col: str = "account_id") -> DataFrame:
    """AUC within each user; users without a positive or a negative are left out."""
    return _auc(mid_ranks(scored, [user_col]), [user_col]).where(F.col("auc").isNotNull())


def pair_loss(scored: DataFrame, p: str = "score", label: str = "label") -> DataFrame:
    """Mean cross-entropy and accuracy of predicted probabilities."""
    eps = 1e-7
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    loss = -F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))
    right = ((F.col(p) >= 0.5) == (F.col(label) == 1)).cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(right).alias("accuracy")
    )


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows breaking it; all rules share one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"_{i}") for i, rule in enumerate(rules.values())],
    )
    report = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("violations")) for i, name in enumerate(rules)]
    )
    return counts.select("rows", F.inline(report)).select("rule", "rows", "violations")


def require(df: DataFrame, rules: dict[str, Column]) -> None:
    """Raise if any rule is broken."""
    broken = [(r["rule"], r["violations"]) for r in check(df, rules).where("violations > 0").collect()]
    if broken:
        raise AssertionError(f"integrity rules broken: {broken}")


def no_nulls(df: DataFrame) -> dict[str, Column]:
    return {f"{c} is set": F.col(c).isNotNull() for c in df.columns}
