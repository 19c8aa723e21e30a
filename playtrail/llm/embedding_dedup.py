"""Near-duplicate vectors by quantised tile products.

Vectors are scaled to length 1 and quantised to 8 bits: ``x = s q + e`` with whole numbers q from -127
to 127.  The length of e is computed for each vector, so that for two vectors

    x . y  <=  s_x s_y (q_x . q_y) + |e_y| (1 + |e_x|) + |e_x|

holds rigorously.  Tiles of vectors meet in tasks: the products of the whole numbers are exact in
single precision (they stay below 2^24), and only pairs whose bound reaches the threshold are
recomputed from the given components in double precision.

Equal vectors are one node with a count.  Meetings emit link counts and a spanning forest, never all
pairs.  All tiles meet, so the work grows with the square of the number of different vectors; the
data moved is that square over the tile's rows, which grow with the input up to a fixed memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrail.llm.common import parts_of
from playtrail.llm.components import Forest, components
from playtrail.operators.ordering import positions
from playtrail.scratch import through_table

THRESHOLD = 0.9
#: A tile's rows: as many as make enough meetings for all tasks, within these limits.
LEAST_ROWS, MOST_ROWS = 1024, 8192
#: Rows of a tile multiplied at a time; products of that many rows and a tile are in memory.
STRIP = 512
#: Above any rounding of the bound's own arithmetic.
SLACK = 1e-5

MEETING = "kind string, a bigint, b bigint, n bigint"


def _tile(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in double precision, whole numbers as floats, scales, lengths of the errors."""
    x = np.stack([np.frombuffer(b, "<f8") for b in blobs])
    # Scaled by the largest component first: squares of very large or small numbers leave the range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None])
    e = np.sqrt(((x - q * s[:, None]) ** 2).sum(axis=1))
    return x, q.astype(np.float32), s, e


def tile_pairs(left, right, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of at least ``threshold``, a strip of rows at a time."""
    x, qx, sx, ex = left
    y, qy, sy, ey = right
    worst, scale = float(ey.max()), sy.astype(np.float32)
    # Sums of products of whole numbers are exact in single precision up to 2^24; longer vectors are cut.
    width = max(1, (1 << 24) // (127 * 127))
    for lo in range(0, len(x), STRIP):
        rows = slice(lo, lo + STRIP)
        first = lo if same else 0
        p = np.zeros((len(x[rows]), len(y) - first), np.float32)
        for c in range(0, qx.shape[1], width):
            p += qx[rows, c : c + width] @ qy[first:, c : c + width].T
        p *= scale[first:]
        bound = (threshold - ex[rows] - worst * (1 + ex[rows]) - SLACK) / sx[rows]
        i, j = np.divmod(np.flatnonzero(p >= bound.astype(np.float32)[:, None]), p.shape[1])
        i, j = i + lo, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            yield a[near], b[near]


def _vectors(embeddings: DataFrame, vector: str) -> DataFrame:
    """(vec_id, content) with the components as bytes of doubles; null where a vector can't link."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column(0), b.column(1)
            values = column.values.to_numpy(zero_copy_only=False).astype("<f8")
            offsets = column.offsets.to_numpy()
            holes = np.array(column.values.is_null().to_pylist(), bool) if column.values.null_count else np.zeros(len(values), bool)
            bad = ~np.isfinite(values) | holes
            valid = column.is_valid().to_pylist()
            content = []
            for lo, hi, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True):
                own = values[lo:hi]
                ok = ok and hi > lo and not bad[lo:hi].any() and own.any()
                content.append(own.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(content, pa.binary())], names=["vec_id", "content"])

    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("content", T.BinaryType())])
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(pack, kind)


def embedding_components(
    embeddings: DataFrame, vector: str = "embedding", threshold: float = THRESHOLD, least_rows: int = LEAST_ROWS, most_rows: int = MOST_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): every vector's links and the smallest id reachable.

    Pairs with a cosine of at least ``threshold`` are linked, all of them and no others, whatever the other columns say.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and so do
    vectors of different lengths.  Equal vectors of several rows link with each other.  A row with a null id
    takes part, but null never is a component's name unless no row of it has an id.
    An empty table gives an empty one.
    """
    rows = through_table(_vectors(embeddings, vector), "vectors")
    classes = rows.where("content is not null").groupBy("content").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    # Numbered by length and content: a tile is a range of numbers.
    wide = classes.withColumn("width", F.length("content"))
    placed = through_table(positions(wide, [F.asc("width"), F.asc("content")], name="node"), "vector_classes")
    n = placed.count()
    size = max(least_rows, min(most_rows, math.ceil(n / max(1, math.isqrt(4 * parts_of(rows))))))
    tiles = max(1, math.ceil(n / size))
    met = _meetings(placed, size, tiles, threshold)
    nodes = placed.select("content", "node", "least", "copies")
    counts = met.where("kind = 'count'").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(met.where("kind = 'link'").select("a", "b"))
    joined = (
        nodes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    found = joined.join(names, "component").select("content", links.alias("n_links"), "component_id")
    out = rows.join(through_table(found, "vector_links"), "content", "left")
    component = F.when(F.col("content").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _meetings(placed: DataFrame, size: int, tiles: int, threshold: float) -> DataFrame:
    """Rows ('count', node, null, links to other rows) and ('link', node, node, null) of all meetings of two tiles."""

    def meet(key, pdf):
        import pandas as pd

        lo, hi = divmod(int(key[0]), tiles)
        forest, out = Forest(), []
        for width in pdf["width"].unique():
            own = pdf[pdf["width"] == width]
            sides = [own[own["tile"] == t] for t in (lo, hi)]
            if not all(len(s) for s in sides):
                continue
            packed = [_tile(s["content"].tolist()) for s in sides[: 1 if lo == hi else 2]]
            nodes = [s["node"].to_numpy() for s in sides]
            copies = [s["copies"].to_numpy() for s in sides]
            sums = [np.zeros(len(s), np.int64) for s in sides]
            for i, j in tile_pairs(packed[0], packed[-1], threshold, lo == hi):
                np.add.at(sums[0], i, copies[1][j])
                np.add.at(sums[0] if lo == hi else sums[1], j, copies[0][i])
                for a, b in zip(nodes[0][i].tolist(), nodes[1][j].tolist(), strict=True):
                    forest.union(a, b)
            for side in range(1 if lo == hi else 2):
                at = np.flatnonzero(sums[side])
                out.append(pd.DataFrame({"kind": "count", "a": nodes[side][at], "b": None, "n": sums[side][at]}))
        links = forest.links()
        out.append(pd.DataFrame({"kind": "link", "a": [x for x, _ in links], "b": [y for _, y in links], "n": None}))
        return pd.concat(out).astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    tile = F.floor((F.col("node") - 1) / size).cast("bigint")
    others = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")),
        lambda j: F.least(F.col("tile"), j) * F.lit(tiles) + F.greatest(F.col("tile"), j),
    )
    dealt = placed.withColumn("tile", tile).select("node", "copies", "width", "content", "tile", F.explode(others).alias("meeting"))
    return through_table(dealt.groupBy("meeting").applyInPandas(meet, MEETING), "meetings")
