"""Near-duplicate documents by SimHash, found in a grid of segment bit counts.

A 64-bit fingerprint is mapped to the bit counts of its segments.  The Manhattan distance of two such
vectors is never above the number of differing bits.  The vector is cut into parts, and of two
fingerprints with at most ``bits`` differing bits some part has a distance of at most
``bits // parts``.  Each fingerprint goes to the grid cells that its counts reach by adding up to that much, in each part: two
vectors so near meet in the cell of their larger counts.  Those that meet are verified exactly.

Equal fingerprints are one node.  A cell emits a spanning forest of what it links, never all
pairs; a cell with more than ``block`` fingerprints is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import fresh, giving_back, parts_of
from playtrail.llm.components import block_links, components, links_batch, trees
from playtrail.scratch import through_table

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENT_BITS, PARTS, BLOCK = 2, 3, 1024

#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text, as an unsigned number; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashed in word_hashes(text, shingle, seed):
        bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashed)
    on = np.flatnonzero(2 * ones > n)
    return int(sum(1 << int(i) for i in on))


def word_hashes(text: str | None, shingle: int, seed: int = SEED) -> Iterator[list[int]]:
    """Hashes of the text's shingles in order, some at a time; a text with fewer words is one shingle, nothing without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    for lo in range(0, len(starts), SHINGLES):
        yield [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[lo : lo + SHINGLES], stops[lo : lo + SHINGLES], strict=True)]


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of all rows; fp holds the 64 bits in a signed number."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id bigint, fp bigint")


def _cells(fps: np.ndarray, bits: int, segment_bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint) for all cells that the fingerprints go to."""
    segments = -(-64 // segment_bits)
    counts = np.stack(
        [np.bitwise_count((fps >> np.uint64(i * segment_bits)) & np.uint64((1 << segment_bits) - 1)) for i in range(segments)]
    ).astype(np.int64)
    most = [min(segment_bits, 64 - i * segment_bits) for i in range(segments)]
    cells, owners = [], []
    every, radius, base = np.arange(len(fps)), bits // parts, segment_bits + 1
    for part in range(parts):
        own = range(part * segments // parts, (part + 1) * segments // parts)
        weight = {s: base**i for i, s in enumerate(own)}
        if base ** len(weight) * parts >= 2**63:
            raise ValueError("a part has too many segments for one cell number")
        home = sum(counts[s] * w for s, w in weight.items())
        for steps in range(radius + 1):
            for up in combinations_with_replacement(own, steps):
                room = np.ones(len(fps), bool)
                for s in set(up):
                    room &= counts[s] + up.count(s) <= most[s]
                at = every[room]
                cells.append((home[at] + sum(weight[s] for s in up)) * parts + part)
                owners.append(at)
    return np.concatenate(cells), np.concatenate(owners)


def fingerprint_links(fps: DataFrame, bits: int = BITS, segment_bits: int = SEGMENT_BITS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of the distinct numbers ``fp`` that connect all those within ``bits`` bits, and no others.

    They span what is linked within a task: a pair stands for a chain of links, not always for one.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cells, at = _cells(own.view(np.uint64), bits, segment_bits, parts)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(own[at])], names=["cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, pair): what is left of the last group waits for the next batch."""
        rest = [np.zeros(0, np.int64)] * 3
        for b in batches:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns, strict=True)]
            cell, pair, fp = columns
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield links_batch(_groups(fp[:last], cuts))
            rest = [c[last:] for c in columns]
        yield links_batch(_groups(rest[2], np.array([len(rest[2])])))

    def _groups(fp: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        lo = 0
        for hi in cuts.tolist():
            own = fp[lo:hi]
            lo = hi
            if len(own) < 2:
                continue
            u = own.view(np.uint64)
            if len(own) == 2:
                if int(np.bitwise_count(u[0] ^ u[1])) <= bits:
                    out.append((int(own[0]), int(own[1])))
                continue
            linked = np.bitwise_count(u[:, None] ^ u[None, :]) <= bits
            if np.count_nonzero(linked) == len(own):
                continue
            np.fill_diagonal(linked, False)
            out += [(int(own[x]), int(own[y])) for x, y in block_links(linked)]
        return out

    n = parts_of(fps)
    distinct = fps.select("fp").distinct()
    dealt = through_table(distinct.mapInArrow(deal, "cell bigint, fp bigint"), "simhash_cells")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    shared = dealt.join(sizes.where("n > 1"), "cell")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.least(F.col("own"), j).cast("bigint") * F.col("blocks") + F.greatest(F.col("own"), j),
    )
    meetings = (
        shared.withColumn("blocks", blocks).withColumn("own", own)
        .select("cell", F.explode(others).alias("pair"), "fp")
        .repartition(n, "cell", "pair")
        .sortWithinPartitions("cell", "pair")
    )
    # Both in one call: a second one in the same task would be a second worker beside the first.
    return meetings.mapInArrow(lambda batches: trees(meet(batches)), "a bigint, b bigint")


def simhash_components(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_fp, component_id) of all rows of ``docs``.

    Reads ``doc_id`` and ``text``.  component_id is the smallest doc_id reachable by links of at most ``bits`` differing
    bits, itself included; null only if no row of the component has an id.  Null, empty and wordless texts have the
    fingerprint 0 and are linked like any other.  Texts of any length count in whole.  Repeated rows each get a row.
    """
    fps = through_table(with_fingerprints(docs, shingle, seed), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(classes, bits), spanned=True)
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component_fp", F.coalesce("component", "fp")
    )
    least = placed.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(least, "component_fp").select("fp", "component_fp", "component_id")
    return fps.join(through_table(by_fp, "fingerprint_classes"), "fp")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, with all columns of ``docs``.

    Where several rows of a group carry that id (or the group has no id at all), one of them stays.
    """
    shingle, seed = parameters.get("shingle", SHINGLE), parameters.get("seed", SEED)
    name = lambda text: int(np.uint64(fingerprint(text, shingle, seed)).view(np.int64))
    return keep_first(docs, simhash_components(docs, **parameters), name)


def keep_first(docs: DataFrame, found: DataFrame, name: Callable[[str | None], int]) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` keeps; ``found`` has (doc_id, fp, component_fp, component_id), ``name`` makes fp from a text."""
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = F.count(F.lit(1)).alias("n")
    ids = through_table(found.groupBy("doc_id").agg(rows, F.bool_or(chosen).alias("kept")).where("kept"), "kept")
    me, n = fresh(docs, "_kept_id", "_n")
    names = ids.select(F.col("doc_id").alias(me), F.col("n").alias(n))
    # By shuffle at every size: a broadcast that fits a small table would not fit a large one.
    own = docs.join(names.hint("merge"), F.col("doc_id").eqNullSafe(F.col(me)))
    if ids.where("n > 1").isEmpty():
        return own.select(*docs.columns)
    single = own.where(F.col(n) == 1).select(*docs.columns)
    repeated = own.where(F.col(n) > 1).select(*docs.columns)
    return single.unionByName(_first_of_repeated(repeated, found.where(chosen), name))


def _first_of_repeated(rows: DataFrame, chosen: DataFrame, name: Callable[[str | None], int]) -> DataFrame:
    """One row per group among rows whose ids stand on several rows, told apart by their fingerprints."""

    @F.pandas_udf("bigint")
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([name(x) for x in t], dtype="int64")

    fp, near, group, owner = fresh(rows, "_fp", "_near", "_group", "_owner")
    classes = chosen.select(F.col("fp").alias(near), F.col("component_fp").alias(group), F.col("doc_id").alias(owner)).distinct()
    same = (F.col(fp) == F.col(near)) & F.col("doc_id").eqNullSafe(F.col(owner))
    marked = rows.withColumn(fp, fingerprints("text")).join(classes, same)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    one = marked.groupBy(group).agg(F.min_by(whole, F.xxhash64(*rows.columns)).alias(fp))
    return one.select(*[F.col(f"{fp}.`{c}`").alias(c) for c in rows.columns])
