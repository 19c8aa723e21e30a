"""Item features from the catalogue: one-hot levels, bags of words, truncated SVD, scaling, vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.operators.counting import content_tokens, frequency_cut
from playtrail.operators.ordering import dense_index
from playtrail.scratch import apart, pin, through_table

NUMERIC = [
    "released_year_mean", "run_time_min_mean", "run_time_min_median", "made_for_tv_mean",
    "pay_per_view_mean", "pack_premium_1_mean", "pack_premium_2_mean",
]

#: Numbers of a token matrix that goes to every task at most: 8 MB.
FEW = 1_000_000


def one_hot(rows: DataFrame, col: str, levels: DataFrame, item: str = "content_id") -> DataFrame:
    """Rows (item, level, 1) for the levels kept; an item of another level has no row."""
    kept = levels.select(F.col("level").alias(col))
    return rows.select(item, col).join(kept, col).select(item, F.col(col).alias("level"), F.lit(1).alias("value"))


def one_hot_top(rollup: DataFrame, col: str = "show_type", n: int = 4) -> DataFrame:
    return one_hot(rollup, col, frequency_cut(rollup, col, top=n))


def one_hot_min_count(rollup: DataFrame, col: str = "country_of_origin", min_count: int = 50) -> DataFrame:
    return one_hot(rollup, col, frequency_cut(rollup, col, min_count=min_count))


def one_hot_drop_rarest(rollup: DataFrame, col: str = "audience") -> DataFrame:
    return one_hot(rollup, col, frequency_cut(rollup, col, drop_last=True))


def one_hot_arrays(rows: DataFrame, col: str, levels: DataFrame, name: str, item: str = "content_id") -> DataFrame:
    """(item, 0/1 for every level in alphabetical order, all zeros for any other value).

    Levels are numbered by a range sort and joined; their list is never on the driver.
    """
    index = through_table(dense_index(levels.select("level").where("level IS NOT NULL").distinct(), "level"), "levels")
    n = index.count()
    placed = rows.select(item, F.col(col).alias("level")).join(index, "level", "left")
    if not n:
        return placed.select(item, F.array().cast("array<double>").alias(name))
    hot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((i == F.col("idx")).cast("double"), F.lit(0.0)))
    return placed.select(item, hot.alias(name))


def bag_of_words(catalog: DataFrame, col: str) -> DataFrame:
    """Token counts per content; case is folded after de-duplication, so ``A`` and ``a`` count 2."""
    return (
        content_tokens(catalog, col)
        .groupBy("content_id", F.lower("token").alias("token"))
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def dummies(catalog: DataFrame, cols: list[str], numeric: list[str] = ()) -> DataFrame:
    """Rows (asset, feature, value): one ``column=value`` per filled cell, numeric columns as they are."""
    cells = [
        F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("feature"), F.lit(1.0).alias("value"))
        for c in cols
    ] + [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric]
    return catalog.select("asset_id", F.inline(F.array(*cells))).where("feature IS NOT NULL AND value IS NOT NULL")


def fit_scale(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every column, nulls skipped; a constant column divides by 1."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 1.0) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    scale = fit_scale(df, cols)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def scale_vector(df: DataFrame, col: str) -> DataFrame:
    """Standard scaling of every element of an array column."""
    stats = df.agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(col)).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    n = max(int(stats["count"]), 1)
    mean = np.asarray(stats["mean"])
    deviation = np.sqrt(np.asarray(stats["variance"]) * (n - 1) / n)
    deviation[deviation < 1e-12] = 1.0
    centre, width = _lit_array(mean), _lit_array(deviation)
    centred = F.zip_with(col, centre, lambda x, m: x - m)
    return df.withColumn(col, F.zip_with(centred, width, lambda x, d: x / d))


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _times(df: DataFrame, key: str, matrices: dict[str, np.ndarray]) -> DataFrame:
    """Multiply every row vector by its field's small matrix."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for field, part in batch.groupby("field", sort=False):
                rows = np.stack(part["vec"].to_numpy()) @ matrices[field]
                yield pd.DataFrame({"field": field, key: part[key], "vec": list(rows)})

    return df.select("field", key, "vec").mapInPandas(apply, f"field string, {key} {dict(df.dtypes)[key]}, vec array<double>")


def _gram(df: DataFrame, widths: dict[str, int]) -> dict[str, np.ndarray]:
    """Per field, the sum of the outer products of the row vectors: small matrices per task, added up."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for field, part in batch.groupby("field", sort=False):
                rows = np.stack(part["vec"].to_numpy())
                total[field] = total.get(field, 0) + rows.T @ rows
        if total:
            yield pd.DataFrame({"field": list(total), "vec": [t.ravel() for t in total.values()]})

    parts = df.select("field", "vec").mapInPandas(partial, "field string, vec array<double>")
    summed = parts.groupBy("field").agg(Summarizer.sum(array_to_vector("vec")).alias("g")).collect()
    found = {f: np.zeros((w, w)) for f, w in widths.items()}
    return found | {r["field"]: np.asarray(r["g"].toArray()).reshape(widths[r["field"]], -1) for r in summed}


def _orthonormal(df: DataFrame, key: str, widths: dict[str, int]) -> DataFrame:
    """Orthonormal basis of each field's column space; directions without weight become zero."""
    matrices = {}
    for field, gram in _gram(df, widths).items():
        values, vectors = np.linalg.eigh(gram)
        keep = values > max(values.max(initial=0), 0) * 1e-13
        matrices[field] = vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
    return _times(df, key, matrices)


def _apply(entries: DataFrame, side: DataFrame, on: str, to: str, few: bool = False) -> DataFrame:
    """Sparse matrices (rows of ``entries``) times tall matrices; the sums combine map-side.

    Only a side of ``few`` rows goes to every task.
    """
    summed = Summarizer.sum(array_to_vector("vec"), F.col("n").cast("double"))
    product = entries.join(F.broadcast(side) if few else apart(side), ["field", on]).groupBy("field", to).agg(summed.alias("v"))
    return pin(product.select("field", to, vector_to_array("v").alias("vec")))


def _gaussian(tokens: DataFrame, widths: dict[str, int], seed: int) -> DataFrame:
    """One random row per token, drawn from hashes of the token and so always the same."""

    def uniform(j: Column, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "token", j), 11).cast("double") + 0.5) / float(2**53)

    width = F.create_map(*[F.lit(x) for item in widths.items() for x in item])[F.col("field")]
    normal = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda j: F.sqrt(-2 * F.log(uniform(j, 1))) * F.cos(2 * F.pi() * uniform(j, 2)),
    )
    return tokens.select("field", "token", normal.alias("vec"))


def stacked_svd(bows: DataFrame, ranks: dict[str, int], oversample: int = 10, n_iter: int = 5, seed: int = 117) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Uncentred truncated projections (field, content_id, vec) of several fields' token counts, and their singular values.

    Randomized subspace iteration on the sparse long form (field, content_id, token, n), all fields in the
    same jobs.  All tall matrices stay distributed; the driver only sees squares of ``rank + oversample``
    numbers, so neither the number of contents nor the vocabulary is bounded.  The largest loading of each
    component is positive.  A vocabulary no wider than the sketch needs no iteration to be exact.
    """
    entries = pin(bows.select("field", "content_id", "token", "n"))
    tokens = entries.select("field", "token").distinct()
    vocabulary = {r["field"]: r["count"] for r in tokens.groupBy("field").count().collect()}
    widths = {f: min(ranks[f] + oversample, v) for f, v in vocabulary.items()}
    if not widths:
        none = entries.select("field", "content_id", F.array().cast("array<double>").alias("vec"))
        return none, {f: np.zeros(0) for f in ranks}
    few = sum(widths[f] * v for f, v in vocabulary.items()) <= FEW
    y = _apply(entries, _gaussian(tokens, widths, seed), "token", "content_id", few)
    for _ in range(n_iter if any(widths[f] < v for f, v in vocabulary.items()) else 0):
        z = _apply(entries, _orthonormal(y, "content_id", widths), "content_id", "token")
        y = _apply(entries, _orthonormal(z, "token", widths), "token", "content_id", few)
    q = pin(_orthonormal(y, "content_id", widths))
    b = _apply(entries, q, "content_id", "token")
    singular, rotations = {f: np.zeros(0) for f in ranks}, {}
    for field, gram in _gram(b, widths).items():
        values, rotation = np.linalg.eigh(gram)
        best = np.argsort(values)[::-1][: min(ranks[field], vocabulary[field])]
        singular[field], rotations[field] = np.sqrt(np.maximum(values[best], 0)), rotation[:, best]
    signs = _signs(b, rotations)
    return _times(q, "content_id", {f: r * signs[f] * singular[f] for f, r in rotations.items()}), singular


def truncated_svd(bow: DataFrame, k: int, oversample: int = 10, n_iter: int = 5, seed: int = 117) -> tuple[DataFrame, np.ndarray]:
    """:func:`stacked_svd` of one field: (content_id, vec) and the singular values."""
    projected, singular = stacked_svd(bow.withColumn("field", F.lit("")), {"": k}, oversample, n_iter, seed)
    return projected.drop("field"), singular[""]


def _signs(loadings: DataFrame, rotations: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """+1 or -1 per component, making its largest loading (the first token among equals) positive."""

    def extreme(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for field, part in batch.groupby("field", sort=False):
                rows = np.stack(part["vec"].to_numpy()) @ rotations[field]
                at = np.abs(rows).argmax(0)
                yield pd.DataFrame(
                    {"field": field, "c": np.arange(rows.shape[1]), "token": part["token"].to_numpy()[at], "v": rows[at, np.arange(rows.shape[1])]}
                )

    largest = loadings.select("field", "token", "vec").mapInPandas(extreme, "field string, c int, token string, v double")
    rows = largest.groupBy("field", "c").agg(F.max_by("v", F.struct(F.round(F.abs("v"), 9), "token")).alias("v")).collect()
    signs = {f: np.ones(r.shape[1]) for f, r in rotations.items()}
    for r in rows:
        signs[r["field"]][r["c"]] = -1.0 if r["v"] < 0 else 1.0
    return signs


def token_variance(bow: DataFrame, n_items: int) -> Column:
    """Sum of the population variances of all token columns, as a scalar."""
    sums = bow.groupBy("token").agg(
        F.sum("n").cast("double").alias("s1"), F.sum(F.col("n") * F.col("n")).cast("double").alias("s2")
    )
    return sums.agg(F.sum(F.col("s2") / n_items - (F.col("s1") / n_items) ** 2)).scalar()


def explained_variance(bow: DataFrame, projected: DataFrame, n_items: int) -> DataFrame:
    """Population variance of each component, and its share of the variance of all token columns."""
    total = token_variance(bow, n_items)
    moments = projected.select(F.posexplode("vec").alias("component", "x")).groupBy("component").agg(
        F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2")
    )
    variance = F.col("s2") / n_items - (F.col("s1") / n_items) ** 2
    return moments.select("component", variance.alias("variance")).withColumn(
        "ratio", F.try_divide(F.col("variance"), total)
    )


def item_vectors(catalog: DataFrame, rollup: DataFrame, ranks: dict[str, int], min_country: int = 50, n_iter: int = 5) -> DataFrame:
    """One vector per content: one-hot levels, then the scaled SVD projections and numbers.

    ``ranks`` names the token columns and the rank of each.  A missing number becomes the
    column's mean, that is 0 after scaling.
    """
    levels = {
        "show_type": frequency_cut(rollup, "show_type", top=4),
        "country_of_origin": frequency_cut(rollup, "country_of_origin", min_count=min_country),
        "audience": frequency_cut(rollup, "audience", drop_last=True),
    }
    numbers = standard_scale(rollup, NUMERIC)
    filled = F.transform(F.array(*NUMERIC), lambda x: F.coalesce(x, F.lit(0.0)))
    rows = numbers.select("content_id", filled.alias("_numbers"))
    for c, kept in levels.items():
        rows = rows.join(apart(one_hot_arrays(rollup, c, kept, f"_{c}")), "content_id")
    rows = rows.select("content_id", F.concat(*[f"_{c}" for c in levels], "_numbers").alias("vector"))
    bags = [bag_of_words(catalog, c).select(F.lit(c).alias("field"), "content_id", "token", "n") for c in ranks]
    projected, singular = stacked_svd(reduce(DataFrame.unionByName, bags), ranks, n_iter=n_iter)
    projected = pin(projected)
    for col in ranks:
        # A content without tokens is a row of zeros and takes part in the scaling.
        zeros = _lit_array([0.0] * len(singular[col])).cast("array<double>")
        own = projected.where(F.col("field") == col).select("content_id", "vec")
        filled = rollup.select("content_id").join(apart(own), "content_id", "left").select(
            "content_id", F.coalesce("vec", zeros).alias("vec")
        )
        rows = rows.join(apart(scale_vector(filled, "vec")), "content_id").select(
            "content_id", F.concat("vector", "vec").alias("vector")
        )
    return rows


def linear_encoder(vectors: DataFrame, targets: DataFrame, ridge: float = 1e-2) -> DataFrame:
    """Targets predicted from the vectors by least squares, for every row of ``vectors``.

    ``targets`` gives vectors of some of the items; all others get theirs from what is known of them.  The
    normal equations are sums over rows, one small matrix per task.
    """
    known = vectors.join(apart(targets.select("content_id", F.col("vector").alias("_t"))), "content_id")
    one = F.array(F.lit(1.0))
    rows = known.select(F.lit("").alias("field"), F.concat("vector", one, "_t").alias("vec"))
    sizes = known.select(F.size("vector").alias("n"), F.size("_t").alias("m")).first()
    if sizes is None:
        return vectors.limit(0)
    n = sizes["n"] + 1
    gram = _gram(rows, {"": n + sizes["m"]})[""]
    solved = np.linalg.solve(gram[:n, :n] + ridge * np.eye(n), gram[:n, n:])
    longer = vectors.select(F.lit("").alias("field"), "content_id", F.concat("vector", one).alias("vec"))
    return _times(longer, "content_id", {"": solved}).select("content_id", F.col("vec").alias("vector"))


def model_item_features(vectors: DataFrame, scalars: list[tuple[DataFrame, str]]) -> DataFrame:
    """Append one number per item from each (frame, column); a missing one counts 0."""
    joined = reduce(lambda df, s: df.join(apart(s[0].select("content_id", s[1])), "content_id", "left"), scalars, vectors)
    extra = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for _, c in scalars]
    return joined.select("content_id", F.concat("vector", F.array(*extra)).alias("vector"))
