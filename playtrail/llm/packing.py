"""Packing documents into sequences of fixed length by best-two-fit.

A sequence is filled greedily, longest piece that fits first.  Then its smallest document gives way to two
unpacked documents if they fit the gap it leaves more tightly.  Pieces of equal length are alike, so
the method runs on the counts of the lengths, at most one row per length: each pattern of lengths is
repeated as often as the counts make the next sequences come out the same.  The patterns
say, for each length, which range of its pieces goes where; the pieces are numbered within their
lengths by a range sort and find their places by a join with that bounded table.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import giving_back
from playtrail.llm.tokens import encoder, public_vocabulary
from playtrail.operators.ordering import positions
from playtrail.scratch import through_table

CAPACITY = 1024
END_ID = 2
#: Words that an encoder remembers which lives for one task.
TASK_WORDS = 200_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SLOTS = ("length", "lo", "hi", "first_sequence", "per_sequence", "base")


def pieces_of(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    keep_ids: bool = False,
    keep_encoder: bool = True,
) -> DataFrame:
    """Token pieces of whole texts: (doc_id, piece, start, length, ids_crc32[, ids]).

    Reads ``doc_id`` and ``text``; a null text is empty.  Every document ends with ``end_id``.  Documents longer than
    ``capacity`` are cut into pieces of that length, the first one shorter if the length leaves a rest.
    With ``keep_encoder`` workers keep the words they have met for their next tasks, which saves time and takes memory.
    """
    vocabulary = vocabulary or public_vocabulary()
    end = struct.pack("<I", end_id)

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (encoder(vocabulary) if keep_encoder else encoder(vocabulary, TASK_WORDS, keep=False)).encode
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                rows, kept = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for d, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, stop = 0, n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        own = ids[4 * start : 4 * stop]
                        rows.append((d, k, start, stop - start, zlib.crc32(own)))
                        if keep_ids:
                            kept.append(own)
                        start, stop = stop, stop + capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def best_two_fit(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns (length -> how often in a sequence) and how many sequences have them, in turn."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    while left:
        # below[x]: the longest length that still has pieces and is not above x.
        below, lengths = [0] * (capacity + 1), sorted(left)
        for n in lengths:
            below[n] = n
        for x in range(1, capacity + 1):
            below[x] = below[x] or below[x - 1]
        filled: dict[int, int] = {}
        gap = capacity
        while n := below[gap]:
            times = min(left[n], gap // n)
            filled[n] = times
            gap -= times * n
            if times == left[n] and gap >= n:  # none left: go on with the next shorter one
                gap_below = below[n - 1]
                while gap_below and gap_below in filled:
                    gap_below = below[gap_below - 1]
                for x in range(n, capacity + 1):
                    if below[x] == n:
                        below[x] = gap_below
        pattern, used = dict(filled), dict(filled)
        if gap and sum(filled.values()) > 1:
            small = min(filled)
            room = gap + small
            rest = {n: left[n] - filled.get(n, 0) for n in lengths if n < room}
            reach = [0] * (room + 1)
            for n, c in rest.items():
                if c > 0:
                    reach[n] = n
            for x in range(1, room + 1):
                reach[x] = reach[x] or reach[x - 1]
            best = (small, 0, 0)
            for a in sorted(rest, reverse=True):
                c = rest[a]
                if c <= 0:
                    continue
                b = reach[min(room - a, a)]
                if b == a and c < 2:
                    b = reach[a - 1]
                if b and a + b > best[0]:
                    best = (a + b, a, b)
            if best[1]:
                pattern[small] -= 1
                for n in best[1:]:
                    pattern[n] = pattern.get(n, 0) + 1
                    used[n] = used.get(n, 0) + 1
                pattern = {n: c for n, c in pattern.items() if c}
        # As long as each length has what one sequence looks at, the next one comes out the same.
        times = max(1, min(left[n] // c for n, c in used.items()))
        yield pattern, times
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]


def slots_of(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``SLOTS``: pieces lo..hi-1 of a length go ``per_sequence`` at a time from ``base`` on."""
    given, sequence, rows = Counter(), 0, []
    for pattern, times in best_two_fit(counts, capacity):
        base = 0
        for n in sorted(pattern, reverse=True):
            c = pattern[n]
            rows.append((n, given[n], given[n] + c * times, sequence, c, base))
            given[n] += c * times
            base += c * n
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence_id and offset.

    ``pieces`` has doc_id, piece and length, and any further columns but these two.  Every sequence has at most ``capacity``
    tokens, its offsets run without gaps from 0.  Equal pieces may take each other's places.  An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    names = [f"c{i}" for i in range(len(pieces.columns))]
    at = dict(zip(pieces.columns, names, strict=True))
    plain = pieces.toDF(*names)
    order = [F.asc_nulls_first(at["doc_id"]), F.asc(at["piece"])]
    # One row per length: bounded by the capacity.
    lengths = {r[0]: r[1] for r in plain.groupBy(at["length"]).count().collect()}
    # From Arrow: rows of Python objects would start workers of another kind, which stay beside the first ones.
    rows = slots_of(lengths, capacity)
    slots = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(SLOTS)}))
    numbered = positions(plain, order, keys=[at["length"]], name="number").withColumn("number", F.col("number") - 1)
    # Lengths are at most ``capacity``, patterns a few per length: the table is bounded by the capacity alone.
    hit = (F.col(at["length"]) == F.col("length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))
    within = F.col("number") - F.col("lo")
    return numbered.join(F.broadcast(slots), hit).select(
        *[F.col(n).alias(c) for c, n in at.items()],
        (F.col("first_sequence") + F.floor(within / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("base") + F.pmod(within, F.col("per_sequence")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, keep_encoder: bool = True
) -> DataFrame:
    """Cut and pack all documents: the columns of ``pieces_of`` with sequence_id and offset."""
    pieces = pieces_of(docs, capacity, vocabulary, end_id, keep_encoder=keep_encoder)
    return pack(through_table(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces that kept their ids; at most ``capacity`` tokens meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
