"""An index for nearest neighbours: inverted lists of short codes, and exact distances for the best of them.

Centres are fitted on a sample of at most about ``SAMPLE`` rows; every row is put on the list of its nearest centre and what
it differs from the centre by is coded, two dimensions to a byte.  A search looks into the lists of the centres nearest
to a query, adds up table entries for the codes, and takes full vectors for the ``rerank`` best rows only.

Long lists are cut into parts, and queries that meet on a list into blocks, both by hash: no group grows with the data.
Centres and code books are bounded (``MOST_LISTS`` centres, 256 entries for two dimensions) and go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators.ordering import top_k
from playtrail.operators.similarity import best_products
from playtrail.scratch import through_table

SAMPLE, MOST_LISTS, ENTRIES = 16_384, 4096, 256
#: Rows of a part of a list, and queries of a block.
PART, QUERIES = 16_384, 1024


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None], 0)


def centres(rows: np.ndarray, count: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``count`` centres of the rows by Lloyd's rounds; a centre that loses all its rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    found = rows[rng.permutation(len(rows))[:count]].copy()
    for _ in range(rounds):
        own, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for lo in range(0, len(rows), 4096):
            d = _squares(rows[lo : lo + 4096], found)
            own[lo : lo + 4096] = d.argmin(axis=1)
            far[lo : lo + 4096] = d.min(axis=1)
        size = np.bincount(own, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, own, rows)
        found = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], found)
        empty = np.flatnonzero(size == 0)
        found[empty] = rows[np.argsort(-far)[: len(empty)]]
    return found


@dataclass
class Coder:
    """Centres of the lists, and one code book for each two dimensions of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, rows: np.ndarray, lists: int) -> Coder:
        found = centres(rows, lists)
        rest = rows - found[_squares(rows, found).argmin(axis=1)]
        return cls(found, [centres(rest[:, d : d + 2], min(ENTRIES, len(rows))) for d in range(0, rows.shape[1], 2)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _squares(rows, self.centres).argmin(axis=1)
        rest = rows - self.centres[own]
        codes = [_squares(rest[:, 2 * i : 2 * i + 2], b).argmin(axis=1) for i, b in enumerate(self.books)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, query: np.ndarray, listed: int) -> np.ndarray:
        """Squared distances of the query's residual to all entries of all books."""
        rest = query - self.centres[listed]
        found = np.full((len(self.books), ENTRIES), np.inf)
        for i, b in enumerate(self.books):
            found[i, : len(b)] = _squares(rest[None, 2 * i : 2 * i + 2], b)[0]
        return found


@dataclass
class Index:
    coder: Coder
    #: list, part, content_id, code
    codes: DataFrame
    vectors: DataFrame
    #: rows of each list
    sizes: np.ndarray
    rows: int

    def parts(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // PART))


def build_index(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Index all rows (content_id, vector) of equal dimensions; one list for each root of the rows, ``MOST_LISTS`` at most."""
    kept = through_table(vectors.select("content_id", F.col("vector").cast("array<double>").alias("vector")), "index_vectors")
    n = kept.count()
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    # As many rows as the sample has on the average; the hash deals them evenly.
    share = F.pmod(F.xxhash64(F.lit("sample"), "content_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    drawn = kept.where(share).orderBy("content_id").select("vector").toPandas()["vector"] if n else []
    if not len(drawn):
        drawn = kept.limit(1).toPandas()["vector"] if n else [np.zeros(2)]
    coder = Coder.fit(np.stack(drawn), min(lists, len(drawn)))
    known = kept.sparkSession.sparkContext.broadcast(coder)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            own, codes = known.value.encode(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "content_id", "code"]
            )

    coded = through_table(kept.mapInArrow(assign, "list int, content_id bigint, code binary"), "codes")
    sizes = np.zeros(len(coder.centres), np.int64)
    for r in coded.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    parts = F.array(*[F.lit(int(p)) for p in np.maximum(1, -(-sizes // PART))])
    placed = coded.withColumn("part", F.pmod(F.xxhash64("content_id"), F.get(parts, F.col("list"))).cast("int"))
    return Index(coder, placed, kept, sizes, n)


def search(index: Index, queries: DataFrame, k: int, probes: int, rerank: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest rows found for each query (query, content_id, distance, rn), and how many codes each query met.

    ``queries`` has (query, vector).  Distances are exact, ties go to the smaller id.
    """
    spark = queries.sparkSession
    known = spark.sparkContext.broadcast(index.coder)
    probes = min(probes, len(index.coder.centres))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            d = _squares(rows, known.value.centres)
            lists = np.argpartition(d, probes - 1, axis=1)[:, :probes]
            at = np.repeat(np.arange(len(b)), probes)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(lists.ravel().astype(np.int32))], names=["query", "vector", "list"])

    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(near, "query bigint, vector array<double>, list int")
    asked = through_table(asked, "asked")
    met = np.zeros(len(index.sizes), np.int64)
    for r in asked.groupBy("list").count().collect():  # one row a list
        met[r["list"]] = r["count"]
    blocks = F.array(*[F.lit(int(b)) for b in np.maximum(1, -(-met // QUERIES))])
    parts = F.array(*[F.lit(int(p)) for p in index.parts()])
    left = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.get(blocks, F.col("list"))).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("list")) - 1)))
    right = index.codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)))

    def compare(own: pa.Table, listed: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(listed):
            codes = np.frombuffer(b"".join(listed["code"].to_pylist()), np.uint8).reshape(len(listed), -1)
            ids = listed["content_id"].to_numpy()
            books = np.arange(codes.shape[1])
            for q, v, at in zip(own["query"].to_pylist(), own["vector"].to_pylist(), own["list"].to_pylist(), strict=True):
                d = known.value.tables(np.array(v), at)[books[None, :], codes].sum(axis=1)
                best = np.argpartition(d, rerank - 1)[:rerank] if len(d) > rerank else np.arange(len(d))
                out.append((np.full(len(best), q), ids[best], d[best]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "content_id": pa.array(columns[1], pa.int64()), "about": pa.array(columns[2], pa.float64())})

    key = ["list", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query bigint, content_id bigint, about double")
    best = top_k(found, ["query"], [F.asc("about"), F.asc("content_id")], rerank).select("query", "content_id")
    pairs = best.join(index.vectors, "content_id").join(queries.select("query", F.col("vector").cast("array<double>").alias("_q")), "query")
    exact = F.sqrt(F.aggregate(F.zip_with("vector", "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    nearest = top_k(pairs.select("query", "content_id", F.round(exact, 6).alias("distance")), ["query"], [F.asc("distance"), F.asc("content_id")], k, name="rn")
    size = F.array(*[F.lit(int(s)) for s in index.sizes])
    return nearest, asked.groupBy("query").agg(F.sum(F.get(size, F.col("list"))).alias("codes"))


def exact_neighbors(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query by products on a grid of stripes (query, content_id)."""
    def squared(v):
        return F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)

    double = F.col("vector").cast("array<double>")
    asked = queries.select("query", F.concat(F.transform(double, lambda x: 2 * x), F.array(F.lit(-1.0))).alias("vector"))
    rows = vectors.select("content_id", F.concat(double, F.array(squared(double))).alias("vector"))
    none = queries.select("query", F.lit(None).cast("bigint").alias("content_id")).where("false")
    return best_products(asked, rows, none, k, "query").select("query", "content_id")


def sufficient(index: Index, queries: DataFrame, k: int, recall: float = 0.9, rerank: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """The neighbours found with the fewest lists, doubled until the share ``recall`` of the true ones is found, and what it took.

    The index is built once.  The figures: recall, lists looked into, the share of all rows that codes were compared of and that
    full distances were made of (centres included) for a query on the average.
    """
    true = through_table(exact_neighbors(index.vectors, queries, k), "true_neighbors")
    wanted, asked = true.count(), queries.count()
    rerank = rerank or 2 * k
    probes = max(1, len(index.sizes) // 16)
    while True:
        found, met = search(index, queries, k, probes, rerank)
        found = through_table(found, "found_neighbors")
        hits = true.join(found, ["query", "content_id"], "left_semi").count()
        if not wanted or hits >= recall * wanted or (probes >= len(index.sizes) and rerank >= index.rows):
            break
        if probes < len(index.sizes):
            probes = min(2 * probes, len(index.sizes))
        else:
            rerank *= 2
    codes = met.agg(F.sum("codes")).first()[0] or 0
    total = max(1, asked * index.rows)
    full = (min(rerank, index.rows) + len(index.sizes)) * asked
    return found, {"recall": hits / max(1, wanted), "probes": probes, "lists": len(index.sizes), "rerank": rerank, "code_share": codes / total, "full_share": full / total}
