"""Co-watched pairs, exact nearest neighbours, features along sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.columns import hash_hex, no_vector
from playtrail.operators.ordering import top_k
from playtrail.operators.sampling import cowatch_draws
from playtrail.scratch import apart, through_table

# Rows of a stripe on a grid of meetings, and rows of one product within a meeting.
STRIPE_ROWS = 4096
STEP = 64
#: Numbers of a stripe whose rows meet in products only, and rows and columns of such a product.
NUMBERS, ROWS, COLUMNS = 2_000_000, 256, 4096
#: Positives of a meeting that counts what stands below them; rows and numbers of the items' stripes there, at most.
POSITIVES, AUC_ROWS, AUC_NUMBERS = 1_000_000, 32_768, 1_000_000

MAX_PIVOTS = 1024
BLOCK_ROWS = 1024
# The block directory is kept to this many entries by making the blocks larger.
MAX_BLOCKS = 50_000
DECIMALS = 6


def cowatch_draw_counts(seen: DataFrame, draws: int = 4, seed: int = 117, user_col: str = "customer_id") -> DataFrame:
    """Pairs of contents drawn from the same customers, with how often each pair was drawn.

    ``draws`` pairs are drawn of every customer; these are not the counts of all pairs.
    """
    drawn = cowatch_draws(seen, draws, seed, user_col)
    return drawn.groupBy(
        F.least("a", "b").alias("content_id"), F.greatest("a", "b").alias("other_id")
    ).agg(F.count(F.lit(1)).alias("n"))


def _matrix(cells: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in cells])


def _unpack(payload: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(payload, dtype=np.float64).reshape(rows, -1)


def _in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the number of the nearest pivot."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = _matrix(batch["vector"])
                d = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)
                yield batch.assign(cell=d.argmin(1))

    return vectors.select("content_id", "vector").mapInPandas(
        assign, "content_id bigint, vector array<double>, cell int"
    )


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cells(vectors: DataFrame, n: int, size: int) -> DataFrame:
    """Vectors with the nearest of a few drawn pivots, about one pivot per block."""
    wanted = min(MAX_PIVOTS, -(-n // size))
    drawn = vectors.select("content_id", "vector").orderBy(hash_hex("pivot", F.col("content_id"))).limit(wanted)
    pivots = drawn.toPandas()["vector"]
    return _in_cells(vectors, _matrix(pivots) if len(pivots) else np.zeros((1, 1)))


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """Vectors in blocks: ids, packed values, centre and radius of every block.

    A block holds vectors near to one another, and blocks grow with the data so
    that their number stays bounded.  Rows are ordered over
    as many tasks as there is data; a cell holding many copies of one vector simply fills several
    blocks.  The blocks are written, so they stay as they are.
    """
    n = max(1, vectors.count())
    size = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    rows = _cells(vectors, n, size)
    ordered = rows.repartitionByRange(min(_parts(vectors), -(-n // size)), "cell", "content_id").sortWithinPartitions(
        "cell", "content_id"
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, same_cell in batch.groupby("cell", sort=False):
                if held and held[0]["cell"].iat[0] != same_cell["cell"].iat[0]:
                    yield block(pd.concat(held))
                    held = []
                while len(same_cell):
                    room = size - sum(map(len, held))
                    held.append(same_cell.iloc[:room])
                    same_cell = same_cell.iloc[room:]
                    if sum(map(len, held)) == size:
                        yield block(pd.concat(held))
                        held = []
        if held:
            yield block(pd.concat(held))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(rows["vector"])
        centre = v.mean(0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(1).max()))
        ids = rows["content_id"].tolist()
        return pd.DataFrame(
            {"block": [ids[0]], "ids": [ids], "payload": [v.tobytes()], "centre": [centre.tolist()], "radius": [radius]}
        )

    packed = ordered.mapInPandas(
        pack, "block bigint, ids array<bigint>, payload binary, centre array<double>, radius double"
    )
    return through_table(packed, "blocks")


def _block_pairs(blocks: DataFrame, k: int, probes: int | None) -> DataFrame:
    """Block pairs that can hold one of the ``k`` nearest of some query.

    Every vector of block Q has k vectors within the radius u that covers the nearest blocks
    counting k; a block whose closest possible point is farther than u is left out.  With
    ``probes`` only that many nearest blocks are kept, which makes the result approximate.
    """
    directory = blocks.select("block", "centre", "radius", F.size("ids").alias("n")).toPandas()
    if not len(directory):
        return blocks.select(F.col("block").alias("q"), F.col("block").alias("s"))
    names, centres = directory["block"].to_numpy(), _matrix(directory["centre"])
    radii, sizes = directory["radius"].to_numpy(), directory["n"].to_numpy()
    slack = 1e-5 * (1 + float(np.abs(centres).max()) + float(radii.max()))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, centre, radius in zip(batch["block"], batch["centre"], batch["radius"]):
                gap = np.sqrt(((centres - np.asarray(centre)) ** 2).sum(1))
                reach = gap + radius + radii
                order = np.argsort(reach, kind="stable")
                upto = np.searchsorted(np.cumsum(sizes[order]), k)
                limit = reach[order[min(upto, len(order) - 1)]]
                keep = gap - radius - radii <= limit + slack
                if probes is not None:
                    keep &= gap <= np.sort(gap)[min(probes, len(gap)) - 1]
                yield pd.DataFrame({"q": q, "s": names[keep]})

    found = blocks.select("block", "centre", "radius").mapInPandas(partners, "q bigint, s bigint")
    # Pairs are few and small but each is much work, so their number of tasks is not left to their size.
    return found.repartition(_parts(blocks), "q", "s")


def _nearest(q: np.ndarray, s: np.ndarray, s_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, id and rounded distance of the ``k`` nearest rows of ``s``; ties by id."""
    q2, s2 = (q * q).sum(1), (s * s).sum(1)
    slack = 1e-5 * (1 + max(np.abs(q).max(), np.abs(s).max()) * q.shape[1])

    def exact(rows: np.ndarray, cols: np.ndarray, _: np.ndarray) -> np.ndarray:
        return -np.round(np.sqrt(((q[rows] - s[cols]) ** 2).sum(1)), DECIMALS)

    def about(rows: np.ndarray, products: np.ndarray) -> np.ndarray:
        return -np.sqrt(np.maximum(q2[rows] - 2 * products, 0))

    def bar(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return (q2[rows] - (slack - values) ** 2) / 2

    # The nearest rows are those of the largest q.s - s.s / 2.
    rows, cols, values = _best(np.c_[q, np.ones(len(q))], np.c_[s, -s2 / 2], s_ids, k, exact, about, bar)
    return rows, s_ids[cols], -values


def _best(u: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, exact, about, bar, gone: tuple[np.ndarray, np.ndarray] | None = None):
    """Row of ``u``, row of ``v`` and value of the ``k`` best rows of ``v`` for every row of ``u``; ties by id.

    ``exact(rows, cols, products)`` gives values, ``about(rows, products)`` what they are nearly, and ``bar(rows, values)`` the least product
    of what may be no worse than these values.  A row's k-th value so far is a bar to all further products, so that few are looked at again;
    ``v`` is gone through by falling length, and a row ends where no length reaches its bar.  ``gone`` pairs (rows in order) don't count.
    """
    length = np.sqrt((v * v).sum(1))
    order = np.argsort(-length, kind="stable")
    v, length, reach = v[order], length[order], np.sqrt((u * u).sum(1))
    if gone is not None:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        gone = gone[0], place[gone[1]]
    out = []
    for lo in range(0, len(u), ROWS):
        n = min(ROWS, len(u) - lo)
        least = np.full(n, -np.inf)
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if gone is not None:
            a, b = np.searchsorted(gone[0], [lo, lo + n])
            gone_rows, gone_cols = gone[0][a:b] - lo, gone[1][a:b]
        for c in range(0, len(v), COLUMNS):
            alive = np.flatnonzero(reach[lo : lo + n] * length[c] * (1 + 1e-9) + 1e-9 >= least)
            if not len(alive):
                break
            products = u[lo + alive] @ v[c : c + COLUMNS].T
            if gone is not None:
                at = np.full(n, -1)
                at[alive] = np.arange(len(alive))
                here = (gone_cols >= c) & (gone_cols < c + COLUMNS) & (at[gone_rows] >= 0)
                products[at[gone_rows[here]], gone_cols[here] - c] = -np.inf
            limit = least[alive]
            new = np.flatnonzero(limit == -np.inf)
            if len(new) and products.shape[1] > k:
                found = np.partition(products[new], products.shape[1] - k, axis=1)[:, products.shape[1] - k]
                some = found > -np.inf
                limit[new[some]] = bar(lo + alive[new[some]], about(lo + alive[new[some]], found[some]))
            rows, cols = np.nonzero((products >= limit[:, None]) & (products > -np.inf))
            if len(rows):
                waiting.append((alive[rows], cols + c, exact(lo + alive[rows], order[cols + c], products[rows, cols])))
            if sum(len(w[0]) for w in waiting) > k * n or (len(new) and len(rows)):
                kept = _kept(kept, waiting, ids[order], k)
                waiting = []
                full = np.flatnonzero(np.bincount(kept[0], minlength=n) >= k)
                last = np.searchsorted(kept[0], full, "right") - 1
                least[full] = bar(lo + full, kept[2][last])
        rows, cols, values = _kept(kept, waiting, ids[order], k)
        out.append((rows + lo, order[cols], values))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _kept(kept, waiting, ids: np.ndarray, k: int):
    """The ``k`` best of every row among those kept and those found since, rows in order and the best first."""
    rows, cols, values = (np.concatenate(c) for c in zip(kept, *waiting, strict=True))
    best = _first_k(rows, np.lexsort((ids[cols], -values, rows)), k)
    return rows[best], cols[best], values[best]


def _first_k(groups: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` positions of every group in an order that keeps groups together."""
    sorted_groups, n = groups[order], np.arange(len(order))
    starts = np.r_[True, sorted_groups[1:] != sorted_groups[:-1]][: len(order)]
    return order[n - np.maximum.accumulate(np.where(starts, n, 0)) < k]


def knn(vectors: DataFrame, k: int = 50, probes: int | None = None) -> DataFrame:
    """The ``k`` nearest vectors of every vector by Euclidean distance, itself included.

    Vectors are dealt into stripes, and every two stripes meet in one task, on a grid: each vector is sent
    once per stripe, products are made a few rows at a time, and only ``k`` rows per query leave a meeting.
    With ``probes`` a query looks into the blocks with the nearest centres only, which makes the result approximate.
    """
    if probes is not None:
        return _probed(vectors, k, probes)
    rows = through_table(vectors.select("content_id", "vector"), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    q_stripes, s_stripes = grid(n, n, width, rows)
    left = dealt(rows, "content_id", "q", q_stripes, "s", s_stripes)
    right = dealt(rows, "content_id", "s", s_stripes, "q", q_stripes)

    def compare(q_rows: pd.DataFrame, s_rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"content_id": [], "neighbor_id": [], "distance": []}).astype({"content_id": "int64", "neighbor_id": "int64"})]
        if len(q_rows) and len(s_rows):
            q_ids, s_ids = q_rows["content_id"].to_numpy(), s_rows["content_id"].to_numpy()
            q, s = _matrix(q_rows["vector"]), _matrix(s_rows["vector"])
            rows, near, dist = _nearest(q, s, s_ids, k)
            out.append(pd.DataFrame({"content_id": q_ids[rows], "neighbor_id": near, "distance": dist}))
        return pd.concat(out)

    found = left.groupBy("q", "s").cogroup(right.groupBy("q", "s")).applyInPandas(
        compare, "content_id bigint, neighbor_id bigint, distance double"
    )
    return top_k(found, ["content_id"], [F.asc("distance"), F.asc("neighbor_id")], k, name="rn")


def probes_for(vectors: DataFrame, exact: DataFrame, k: int = 50, recall: float = 0.9) -> tuple[int, int]:
    """The least power of two of probes that finds a share ``recall`` of the pairs of ``exact``, and how many pairs it finds.

    No number of probes serves tables of all sizes.  A search finds those exact pairs whose neighbour lies in a block that the query's block
    looks into, as nothing there is nearer than in the whole table: pairs are counted by how many probes reach their blocks, and the
    blocks, made once, are searched with the number that suffices.
    """
    blocks = vector_blocks(vectors)
    wanted, probes = recall * exact.count(), 1
    reached = {r["probes"]: r["pairs"] for r in _reached(blocks, exact).collect()}
    while sum(n for p, n in reached.items() if p <= probes) < wanted and probes < MAX_BLOCKS:
        probes *= 2
    return probes, exact.join(_searched(blocks, k, probes), ["content_id", "neighbor_id"], "left_semi").count()


def _reached(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(probes, pairs): how many of the (content_id, neighbor_id) are first looked at with that power of two of probes."""
    directory = blocks.select("block", "centre").toPandas().sort_values("block")
    names = directory["block"].to_numpy()
    centres = _matrix(directory["centre"]) if len(directory) else np.zeros((0, 1))
    placed = through_table(blocks.select("block", F.explode("ids").alias("id")), "placed")
    q, s = (placed.select(F.col("id").alias(c), F.col("block").alias(n)) for c, n in (("content_id", "q"), ("neighbor_id", "s")))
    met = pairs.select("content_id", "neighbor_id").join(apart(q), "content_id").join(apart(s), "neighbor_id").groupBy("q", "s").agg(F.count(F.lit(1)).alias("n"))

    def levels(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gap = np.sqrt(((centres - centres[np.searchsorted(names, key[0])]) ** 2).sum(1))
        before = np.searchsorted(np.sort(gap), gap[np.searchsorted(names, rows["s"])])  # blocks whose centres are nearer
        probes = 2 ** np.ceil(np.log2(before + 1)).astype(np.int64)
        return pd.DataFrame({"probes": probes, "pairs": rows["n"]}).groupby("probes", as_index=False).sum()

    found = met.groupBy("q").applyInPandas(levels, "probes bigint, pairs bigint")
    return found.groupBy("probes").agg(F.sum("pairs").alias("pairs"))


def stripes_for(n: int, df: DataFrame) -> int:
    """Stripes of at most ``STRIPE_ROWS`` rows, and enough of them to give all tasks something to do."""
    return max(1, -(-n // STRIPE_ROWS), min(math.isqrt(_parts(df)), -(-n // STEP)))


def grid(n_left: int, n_right: int, width: int | None, df: DataFrame, meetings: int = 0) -> tuple[int, int]:
    """Stripes of both sides of a grid: of at most ``NUMBERS`` numbers, and enough to give all tasks something to do.

    A row is sent once per stripe of the other side, so stripes are few, and the next one is cut where that sends fewer rows again.
    """
    rows = max(STRIPE_ROWS, NUMBERS // max(width or 1, 1))
    left, right = max(1, -(-n_left // rows)), max(1, -(-n_right // rows))
    while left * right < max(_parts(df), meetings):
        able = [n_right if left * STEP < n_left else math.inf, n_left if right * STEP < n_right else math.inf]
        if able == [math.inf, math.inf]:
            break
        left, right = (left + 1, right) if able[0] <= able[1] else (left, right + 1)
    return left, right


def stripe_of(col: str, stripes: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(stripes)).cast("int")


def dealt(rows: DataFrame, key: str, own: str, stripes: int, other: str, others: int) -> DataFrame:
    """Rows with their own stripe, once for every stripe of the other side."""
    every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
    return rows.select("*", stripe_of(key, stripes).alias(own)).select("*", every)


def _probed(vectors: DataFrame, k: int, probes: int) -> DataFrame:
    return _searched(vector_blocks(vectors), k, probes)


def _searched(blocks: DataFrame, k: int, probes: int) -> DataFrame:
    """The ``k`` nearest in the blocks looked into.

    Stripes of blocks meet on a grid: a block is sent once per stripe that it looks into or is looked at from, however many blocks
    of that stripe it meets, and ``k`` rows per query leave a meeting.
    """
    n, width = blocks.agg(F.sum(F.size("ids")), F.max(F.size("centre"))).first()
    q_stripes, s_stripes = grid(n or 0, n or 0, width, blocks)
    pairs = through_table(
        _block_pairs(blocks, k, probes).select("q", "s", stripe_of("q", q_stripes).alias("u"), stripe_of("s", s_stripes).alias("i")), "block_pairs"
    )
    body = [blocks.select(F.col("block").alias(c), F.col("ids").alias(f"{c}_ids"), F.col("payload").alias(f"{c}_data")) for c in ("q", "s")]
    left = pairs.groupBy("q", "u", "i").agg(F.sort_array(F.collect_list("s")).alias("wanted")).join(apart(body[0]), "q")
    right = pairs.select("s", F.col("u").alias("s_u"), F.col("i").alias("s_i")).distinct().join(apart(body[1]), "s")

    def compare(asking: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"content_id": [], "neighbor_id": [], "distance": []}).astype({"content_id": "int64", "neighbor_id": "int64"})]
        held = {s: (np.asarray(ids), _unpack(data, len(ids))) for s, ids, data in zip(asked["s"], asked["s_ids"], asked["s_data"])}
        last, s_ids, s = None, None, None
        for wanted, _, ids, data in sorted(zip(map(tuple, asking["wanted"]), asking["q"], asking["q_ids"], asking["q_data"])):
            if last != wanted:
                last = wanted
                s_ids, s = (np.concatenate(c) for c in zip(*[held[b] for b in last], strict=True))
            ids = np.asarray(ids)
            rows, near, dist = _nearest(_unpack(data, len(ids)), s, s_ids, k)
            out.append(pd.DataFrame({"content_id": ids[rows], "neighbor_id": near, "distance": dist}))
        return pd.concat(out)

    found = left.groupBy("u", "i").cogroup(right.groupBy("s_u", "s_i")).applyInPandas(compare, "content_id bigint, neighbor_id bigint, distance double")
    return top_k(found, ["content_id"], [F.asc("distance"), F.asc("neighbor_id")], k, name="rn")


def _meetings(users: DataFrame, items: DataFrame, seen: DataFrame, user_col: str):
    """Stripes of users, with what they have seen, and stripes of items, grouped to meet on a grid."""
    users = through_table(users.select(user_col, "vector"), "user_vectors")
    items = through_table(items.select("content_id", "vector"), "item_vectors")
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n_users, n_items = grid(users.count(), n, width, users)
    watched = seen.where(F.col(user_col).isNotNull() & F.col("content_id").isNotNull()).select(
        user_col, no_vector().alias("vector"), "content_id",
        stripe_of(user_col, n_users).alias("u"), stripe_of("content_id", n_items).alias("i"),
    )
    left = dealt(users, user_col, "u", n_users, "i", n_items).withColumn("content_id", F.lit(None).cast("bigint"))
    left = left.select(user_col, "vector", "content_id", "u", "i").union(watched.select(user_col, "vector", "content_id", "u", "i"))
    right = dealt(items, "content_id", "i", n_items, "u", n_users)
    return left.groupBy("u", "i").cogroup(right.groupBy("u", "i"))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _known_pairs(pairs: pa.Table, u_ids: np.ndarray, i_ids: np.ndarray, user_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose user and item are both there, by user."""
    pu, pi = _ids(pairs[user_col]), _ids(pairs["content_id"])
    at_u, at_i = np.searchsorted(u_ids, pu), np.searchsorted(i_ids, pi)
    there = (at_u < len(u_ids)) & (at_i < len(i_ids))
    there[there] = (u_ids[at_u[there]] == pu[there]) & (i_ids[at_i[there]] == pi[there])
    order = np.argsort(at_u[there], kind="stable")
    return at_u[there][order], at_i[there][order]


def best_products(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, user_col: str = "account_id") -> DataFrame:
    """The ``k`` unseen items of every user with the largest dot product of their vectors.

    Stripes of users meet stripes of items on a grid: a user's vector is sent once per stripe of items and an
    item's once per stripe of users.  What the users have seen goes to the one meeting that it concerns
    and is struck out of the product before the ``k`` best leave it; a user who has seen nearly
    everything costs no more than any other.
    """

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        has = pc.greater(pc.list_value_length(left["vector"]), 0)
        known, gone, right = left.filter(has).sort_by(user_col), left.filter(pc.invert(has)), right.sort_by("content_id")
        u_ids, i_ids = _ids(known[user_col]), _ids(right["content_id"])
        rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(u_ids) and len(i_ids):
            rows, cols, scores = _best(
                _rows(known["vector"]), _rows(right["vector"]), i_ids, k, lambda r, c, x: np.round(x, 9), lambda r, x: x, lambda r, x: x - 2e-9,
                _known_pairs(gone, u_ids, i_ids, user_col),
            )
        return pa.table({user_col: u_ids[rows], "content_id": i_ids[cols], "score": scores})

    found = _meetings(users, items, seen, user_col).applyInArrow(score, f"{user_col} bigint, content_id bigint, score double")
    return top_k(found, [user_col], [F.desc("score"), F.asc("content_id")], k)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _pair_scores(users: DataFrame, items: DataFrame, pairs: DataFrame, user_col: str) -> DataFrame:
    """(user, content_id, score) of the pairs whose user and item have vectors: a pair goes to the one meeting that it concerns, without a vector."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        has = pc.greater(pc.list_value_length(left["vector"]), 0)
        known, asked, right = left.filter(has).sort_by(user_col), left.filter(pc.invert(has)), right.sort_by("content_id")
        u_ids, i_ids = _ids(known[user_col]), _ids(right["content_id"])
        rows, cols = _known_pairs(asked, u_ids, i_ids, user_col)
        u, v, found = _rows(known["vector"]), _rows(right["vector"]), np.zeros(len(rows))
        step = max(1, COLUMNS * ROWS // max(1, u.shape[1]))
        for lo in range(0, len(rows), step):
            found[lo : lo + step] = np.einsum("pr,pr->p", u[rows[lo : lo + step]], v[cols[lo : lo + step]])
        return pa.table({user_col: u_ids[rows], "content_id": i_ids[cols], "score": np.round(found, DECIMALS)})

    return _meetings(users, items, pairs, user_col).applyInArrow(score, f"{user_col} bigint, content_id bigint, score double")


def _below(products: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    """How many of a row's products lie below its points, added up over them, those beside one counting half; all to six decimals.

    The products are changed.  Whole numbers of millionths that fit four bytes are sorted in half the time of doubles.
    """
    scale = 10.0**DECIMALS
    keys = np.rint(np.multiply(products, scale, out=products), out=products)
    points = [np.rint(p * scale) for p in points]
    if max(np.abs(x).max(initial=0) for x in (keys, *points)) < 2**31 - 1:
        keys, points = keys.astype(np.int32), [p.astype(np.int32) for p in points]
    keys.sort(axis=1)
    return np.array([(np.searchsorted(row, p, "left") + np.searchsorted(row, p, "right")).sum() / 2 for row, p in zip(keys, points, strict=True)])


def catalogue_auc(users: DataFrame, items: DataFrame, positives: DataFrame, user_col: str = "account_id") -> DataFrame:
    """(user, positives, auc) of ranking the whole catalogue by dot product, for users with positives and negatives.

    Every stripe of items is ranked against the user's positives by counts: each positive learns how many
    items of the stripe stand below it and beside it, so one row per user and stripe leaves a meeting.
    """
    scored = through_table(_pair_scores(users, items, positives.select(user_col, "content_id").distinct(), user_col), "positives")
    n_users, n_items = stripes_for(users.count(), users), auc_stripes(items)
    # Users with many positives are met in blocks of them: no meeting holds more than about POSITIVES.
    most = scored.groupBy(stripe_of(user_col, n_users).alias("u")).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // POSITIVES))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    # A user's positives of a block travel as one list.
    asked = scored.groupBy(user_col, stripe_of(user_col, n_users).alias("u"), stripe_of("content_id", blocks).alias("b")).agg(F.collect_list("score").alias("scores"))
    asked = asked.select("*", no_vector().alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))).alias("i"))
    left = dealt(users.select(user_col, "vector"), user_col, "u", n_users, "i", n_items).withColumn("scores", no_vector()).select("*", every)
    left = left.unionByName(asked)
    right = dealt(items.select("content_id", "vector"), "content_id", "i", n_items, "u", n_users).select("*", every)

    def count(own: pa.Table, others: pa.Table) -> pa.Table:
        has = pc.greater(pc.list_value_length(own["vector"]), 0)
        known, asked = own.filter(has), own.filter(pc.invert(has)).sort_by(user_col)
        ids, asking = _ids(known[user_col]), _ids(asked[user_col])
        at = np.minimum(np.searchsorted(asking, ids), max(len(asking) - 1, 0))
        met = np.flatnonzero(asking[at] == ids) if len(asking) and len(others) else np.zeros(0, np.int64)
        below = np.zeros(len(met))
        if len(met):
            u, v, points = _rows(known["vector"]), _rows(others["vector"]).T, asked["scores"].combine_chunks()
            for lo in range(0, len(met), STEP):
                some = met[lo : lo + STEP]
                below[lo : lo + STEP] = _below(u[some] @ v, [points[int(i)].values.to_numpy(zero_copy_only=False) for i in at[some]])
        return pa.table({user_col: ids[met], "below": below})

    counted = left.groupBy("u", "i", "b").cogroup(right.groupBy("u", "i", "b")).applyInArrow(count, f"{user_col} bigint, below double")
    below = counted.groupBy(user_col).agg(F.sum("below").alias("below"))
    total = items.agg(F.count(F.lit(1))).scalar().cast("double")
    n = F.col("positives").cast("double")
    # Positives count among themselves half each, which is no part of the area.
    area = (F.col("below") - n * n / 2) / (n * (total - n))
    per_user = scored.groupBy(user_col).agg(F.count(F.lit(1)).alias("positives"))
    return per_user.join(below, user_col).where(n < total).select(user_col, "positives", area.alias("auc"))


def auc_stripes(items: DataFrame) -> int:
    """Stripes of items that users and their positives are sent to: as few as a task's memory allows, as there are more positives than items."""
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    rows = min(AUC_ROWS, max(STRIPE_ROWS, AUC_NUMBERS // max(width or 1, 1)))
    return max(1, -(-n // rows), min(math.isqrt(_parts(items)), -(-n // STEP)))


def sequence_features(sequences: DataFrame, features: DataFrame, scalars: list[str]) -> DataFrame:
    """Item features on every element of the sequences; a missing scalar counts 0."""
    joined = sequences.join(features, "content_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in scalars})
