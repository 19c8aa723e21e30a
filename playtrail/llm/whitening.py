"""Whitened principal components of embeddings, found by spectral divide and conquer with QDWH.

Entries become whole numbers first, so that counts, sums and products of what is left after taking off the nearest
whole mean are exact as long as they fit in a double; the rest of the mean is taken off the product, which is centring before
multiplying but for rounding.  Tasks send one matrix of sums each, and these are added up in a tree.

The covariance (dimensions squared, whatever the number of rows) is split on the driver.  The polar factor of the covariance less
a shift, by the dynamically weighted Halley iteration, has eigenvalues +1 above and -1 below the shift: half of it and
half of the identity is the projector on the invariant subspace above.  Orthonormal bases of both subspaces carry the
covariance over to two smaller matrices, which are split in turn until single components are left.

The components and means (dimensions times ``components`` numbers) go to all tasks, which whiten their rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from playtrail.operators.sums import tree_sum
from playtrail.scratch import through_table

COMPONENTS = 32
#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000

_EPS = np.finfo(float).eps


def polar(a: np.ndarray, most: int = 60) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, nonsingular matrix by QDWH."""
    size = np.linalg.norm(a)
    x, low, eye = a / size, _EPS, np.eye(len(a))
    for _ in range(most):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        u = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        if w > 100:  # the QR form is stable where the matrix is far from orthogonal
            q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, eye]))
            part = q[: len(a)] @ q[len(a) :].T / np.sqrt(w)
        else:
            part = np.linalg.solve(eye + w * (x.T @ x), x.T).T
        before, x = x, v / w * x + (u - v / w) * part
        x = (x + x.T) / 2
        low = min(1.0, low * (u + v * low**2) / (1 + w * low**2))
        if np.linalg.norm(x - before) <= 10 * np.sqrt(len(a)) * _EPS and low > 0.9:
            break
    return x


def _bases(a: np.ndarray, shift: float, draws: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift, and what couples them; None if all is on one side."""
    size, eye = len(a), np.eye(len(a))
    above = (polar(a - shift * eye) + eye) / 2
    if not np.isfinite(above).all():
        return None
    k = round(np.trace(above))
    if not 0 < k < size:
        return None
    q, _ = np.linalg.qr(above @ draws.standard_normal((size, k)))
    q, _ = np.linalg.qr(above @ q)
    below = eye - above
    r, _ = np.linalg.qr(below @ draws.standard_normal((size, size - k)))
    both, _ = np.linalg.qr(np.hstack([q, below @ r]))
    q, r = both[:, :k], both[:, k:]
    return q, r, float(np.linalg.norm(q.T @ a @ r))


def spectral_components(a: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    whole = (a + a.T) / 2
    scale = np.linalg.norm(whole)
    draws = np.random.default_rng(seed)
    values, vectors = [], []
    open_ = [np.eye(len(a))]
    while open_:
        q = open_.pop()
        part = q.T @ whole @ q
        part = (part + part.T) / 2
        diagonal = np.diag(part)
        if len(part) == 1 or np.linalg.norm(part - np.diag(diagonal)) <= len(a) * _EPS * scale / 4:
            values += diagonal.tolist()
            vectors.append(q)
            continue
        low, high = diagonal.min(), diagonal.max()
        spread = np.linalg.norm(part - np.trace(part) / len(part) * np.eye(len(part)))
        # The mean has eigenvalues on both sides; steps aside are for an eigenvalue that lies on the shift.
        mean = float(diagonal.mean())
        tries = [float(np.median(diagonal)), (low + high) / 2, mean, *(mean + spread * f for f in (1e-3, -1e-3, 0.05, -0.05, 0.2, -0.2))]
        best = None
        for shift in tries:
            found = _bases(part, shift, draws)
            if found is not None and (best is None or found[2] < best[2]):
                best = found
            if best is not None and best[2] <= 8 * len(a) * _EPS * scale:
                break
        if best is None:
            raise ArithmeticError("the covariance could not be split")
        open_ += [q @ best[1], q @ best[0]]
    if not vectors:
        return np.zeros(0), np.zeros((0, 0))
    # One more pass of orthonormal columns takes the rounding of the products off.
    order = np.argsort(-np.array(values), kind="stable")
    basis = np.hstack(vectors)[:, order]
    basis = basis @ (1.5 * np.eye(len(a)) - 0.5 * (basis.T @ basis))
    return np.einsum("ij,ij->j", basis, whole @ basis), basis


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and finite throughout, of the most common length, the longer one among equals."""
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)
    sizes = kept.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept.where(F.size(vector) == (sizes[0] if sizes else 0))


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers of a batch of vectors, a row each."""
    c = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    if len(c) and np.abs(c).max() >= 2.0**62:
        raise OverflowError("an entry does not fit in a long")
    return c.astype(np.int64).reshape(-1, dims) + OFFSET


class Whitening:
    """The fitted numbers: rows, exact sums, components with their variances, and the total variance."""

    def __init__(self, n: int, sums: list[int], second: np.ndarray, components: int):
        self.n, self.sums = n, sums
        self.dims = len(sums)
        self.middle = [_nearest(s, n) for s in sums]
        self.left = [s - n * m for s, m in zip(sums, self.middle, strict=True)]  # n times what the mean is beside the middle
        rest = np.array([float(Fraction(r, n)) for r in self.left])
        self.rest = rest
        covariance = second / n - np.outer(rest, rest)
        values, vectors = spectral_components(covariance)
        self.total = float(np.trace(covariance))
        # A direction without variance cannot be scaled to one.
        sure = values > self.dims * _EPS * max(self.total, 0.0)
        kept = np.flatnonzero(sure)[:components]
        self.values, self.vectors = values[kept], vectors[:, kept]

    def batch(self, x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Whitened rows and the exact squared distances of n times the row from the sums."""
        z = x - np.array(self.middle, np.int64)
        whitened = (z - self.rest) @ (self.vectors / np.sqrt(self.values))
        most = (int(np.abs(z).max(initial=0)) + 1) * self.n
        if self.dims * most**2 < 2**63:
            away = z * self.n - np.array(self.left, np.int64)
            squares = pa.array(np.einsum("ij,ij->i", away, away)).cast(pa.decimal128(38, 0))
        else:
            exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.left, strict=True)) for row in z.tolist()]
            squares = pa.array([decimal.Decimal(e) for e in exact], pa.decimal128(38, 0))
        return whitened, squares


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def fit(df: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """The components of all vectors of ``df``, which must be usable; None for an empty table."""
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"))
    first = vectors.select(F.size("v")).first()
    if first is None:
        return None
    dims = first[0]

    def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            x = _whole(b.column(0), dims) - OFFSET
            n += len(x)
            # Halves of 31 bits, so that no sum of a batch leaves the long.
            high, low = (x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 31) + w for t, h, w in zip(total, high, low, strict=True)]
        total = [t + OFFSET * n for t in total]
        numbers = pa.array([decimal.Decimal(t) for t in [n, *total]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), numbers], names=["dim", "total"])

    sums = vectors.mapInArrow(column_sums, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    n, *totals = [int(r["total"]) for r in sorted(sums.collect(), key=lambda r: r["dim"])]  # one number a dimension
    middle = [_nearest(t, n) for t in totals]

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        found = None
        for b in batches:
            z = (_whole(b.column(0), dims) - np.array(middle, np.int64)).astype(float)
            found = z.T @ z if found is None else found + z.T @ z
        return None if found is None else found.ravel()

    return Whitening(n, totals, tree_sum(vectors, products).reshape(dims, dims), components)


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """Whitened rows of all usable vectors: (key, deviation, whitened), the fit, and the whitened rows' distance from the identity.

    The fit is over the same rows.  ``whitened`` has an entry for each component with variance, at most ``components``: equal
    vectors have no components, and give empty arrays.  ``deviation`` is exact (38 digits).  The distance is the largest entry, in
    absolute value, of the covariance of the written rows less the identity; 0 without components.  Repeated rows count as
    often as they occur; a null key is kept; an empty table gives an empty one and None.
    """
    kept = usable(df, vector)
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    model = fit(kept, vector, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema), None, None
    dims, width = model.dims, len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, squares = model.batch(_whole(b.column(1), dims))
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([b.column(0), squares, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=schema.names)

    chosen = kept.select(key, F.col(vector).cast("array<double>").alias("_v" if key != "_v" else "__v"))
    table = through_table(chosen.mapInArrow(rows, schema), "whitened")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        found = None
        for b in batches:
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            one = np.hstack([w, np.ones((len(w), 1))])
            found = w.T @ one if found is None else found + w.T @ one
        return None if found is None else found.ravel()

    error = 0.0
    if width:
        total = tree_sum(table.select("whitened"), moments).reshape(width, width + 1) / model.n
        error = float(np.abs(total[:, :-1] - np.outer(total[:, -1], total[:, -1]) - np.eye(width)).max())
    return table, model, error


def by_component(table: DataFrame, model: Whitening | None, error: float | None, key: str) -> DataFrame:
    """A row for each whitened row and component: key, component, n, deviation, whitened, explained, identity_error."""
    shares: list[Column] = [F.lit(float(v / model.total)) for v in model.values] if model else []
    explained = F.array(*shares) if shares else F.array().cast("array<double>")
    long = table.select(key, "deviation", F.posexplode("whitened").alias("_at", "_w"))
    return long.select(
        key, (F.col("_at") + 1).alias("component"), F.lit(model.n if model else None).cast("bigint").alias("n"), "deviation",
        F.col("_w").alias("whitened"), F.get(explained, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
