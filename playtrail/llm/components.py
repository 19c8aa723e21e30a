"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.scratch import drop_path, scratch_path


class Forest:
    """Union-find over ids met in one task; the root of a tree is its smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.parent[hi] = lo

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in self.parent if self.find(x) != x]


def block_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a block whose symmetric matrix says what is linked, by breadth-first search."""
    open_, out = linked.any(axis=1), []
    while True:
        at = int(open_.argmax())
        if not open_[at]:
            return out
        open_[at] = False
        front = np.array([at])
        while len(front):
            found = linked[front].any(axis=0) & open_
            front = np.flatnonzero(found)
            open_[front] = False
            out += [(at, int(x)) for x in front]


def links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's links."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.union(x, y)
        if len(forest.parent) > 500_000:
            yield links_batch(forest.links())
            forest = Forest()
    yield links_batch(forest.links())


def components(links: DataFrame, spanned: bool = False) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes other than it.

    ``links`` has bigint columns (a, b); ``spanned`` says that each task made a forest of them already.  Each round hangs the larger neighbours of every node below its
    smallest neighbour, then the smaller ones, until nothing changes; the number of rounds grows with the logarithm
    of the longest chain.  Rounds are written as tables, so that a lost executor costs no earlier round.
    """
    spark = links.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        table = spark.read.schema("a bigint, b bigint").parquet(path)
        state = table.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return table, path, tuple(state)

    def hang(pairs: DataFrame) -> DataFrame:
        """Every pair (a, b) with a > b: link a and all its smaller neighbours to the smallest of them."""
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        below = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return below.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    first = links.where("a <> b")
    if not spanned:
        first = first.mapInArrow(trees, "a bigint, b bigint")
    edges, path, state = write(first.select(*down).distinct())
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            edges.select(F.col("b").alias("a"), F.col("a").alias("far"))
            .join(least, "a")
            .select(F.col("far").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        edges, new_path, new_state = write(hang(large))
        drop_path(spark, path)
        path = new_path
        if new_state == state:
            break
        state = new_state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
