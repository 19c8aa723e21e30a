"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits.  Level 0 has the lowest chunk of every id, level k the k-th chunk
of the ids that need it.  Beside each level stands a bitmap that says which ids go on in the next
level, and a rank directory: the number of ones before every 512th bit.  The chunk of id number i on the
next level stands at the rank of its bit, so any id is read with one rank per level, without decoding
anything before it.

A file holds segments of 2^20 ids, so that id number i is in segment i >> 20, and at its end the
documents' ids and starts and the segments' places.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import parts_of
from playtrail.llm.files import new_file, open_file
from playtrail.llm.tokens import encoder, public_vocabulary
from playtrail.operators.ordering import positions
from playtrail.scratch import scratch_path, through_table

MAGIC = b"PTCODES1"
SEGMENT = 1 << 20
RANK_BITS = 512
END_ID = 2
#: A file is closed once it has so many ids.
FILE_IDS = 1 << 26

FILES = "part int, number int, file string, n_docs bigint, n_tokens bigint"


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels, bitmaps and rank directories of up to 2^20 ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, higher = (rest & 0xFF).astype(np.uint8), rest >> np.uint32(8)
        more = higher != 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else []
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(more) else np.zeros(0, "<u4")
        levels.append((len(chunks), chunks.tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = higher[more]
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<I", n) for n, *_ in levels)
    return head + b"".join(x for _, *parts in levels for x in parts)


class Segment:
    """A coded segment, read in whole or at one place."""

    def __init__(self, data: bytes):
        (n,) = struct.unpack_from("<I", data)
        sizes, at = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n
        self.levels = []
        for size in sizes:
            n_bits, n_ranks = -(-size // 8), -(-size // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + size)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + size + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += size + n_bits + 4 * n_ranks

    def all(self) -> np.ndarray:
        ids, at = self.levels[0][0].astype("<u4"), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            if k:
                ids[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            on = np.flatnonzero(np.unpackbits(bits, bitorder="little", count=len(chunks)))
            at = on if at is None else at[on]
        return ids

    def one(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not (bits[i >> 3] >> (i & 7)) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : i >> 3]
            partial = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + partial.bit_count()
        return value


class Writer:
    """One file: ids come in document by document and leave in segments."""

    def __init__(self, folder: str):
        self.name, self.out = new_file(folder, ".codes")
        self.held, self.n_held, self.n = [], 0, 0
        self.docs, self.starts, self.places = [], [], []
        self.at = self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        a = np.frombuffer(ids, "<u4")
        self.n += len(a)
        self.held.append(a)
        self.n_held += len(a)
        if self.n_held >= SEGMENT:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, "<u4")])
        whole = len(ids) if last else len(ids) - len(ids) % SEGMENT
        for i in range(0, whole, SEGMENT):
            data = encode_segment(ids[i : min(i + SEGMENT, whole)])
            self.places.append((self.at, len(data)))
            self.at += self.out.write(data)
        self.held = [ids[whole:]]
        self.n_held = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        starts = np.array([*self.starts, self.n], "<u8")
        places = np.array(self.places, "<u8").reshape(-1, 2)
        foot = known.tobytes() + ids.tobytes() + starts.tobytes() + places.tobytes()
        self.out.write(foot)
        self.out.write(struct.pack("<QQQ", len(self.docs), len(self.places), len(foot)) + MAGIC)
        self.out.close()


class Reader:
    """One file: documents in order, or any id by its number."""

    def __init__(self, name: str):
        self.file = open_file(name)
        size = self.file.size()
        tail = self.file.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        if tail[24:] != MAGIC:
            raise ValueError(f"{name} is not a whole file of codes")
        n, m, length = struct.unpack("<QQQ", tail[:24])
        foot = self.file.read_at(length, size - 24 - len(MAGIC) - length)
        known = np.frombuffer(foot, np.uint8, n)
        ids = np.frombuffer(foot, "<i8", n, n)
        self.docs = [int(d) if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.starts = np.frombuffer(foot, "<u8", n + 1, 9 * n).astype(np.int64)
        self.places = np.frombuffer(foot, "<u8", 2 * m, 9 * n + 8 * (n + 1)).reshape(-1, 2)

    def segment(self, k: int) -> Segment:
        at, length = map(int, self.places[k])
        return Segment(self.file.read_at(length, at))

    def token(self, i: int) -> int:
        return self.segment(i // SEGMENT).one(i % SEGMENT)

    def pieces(self, lo: int, hi: int, memory: dict | None = None) -> Iterator[np.ndarray]:
        """Ids lo..hi-1, a segment's share at a time; ``memory`` keeps the last segment read."""
        memory = {} if memory is None else memory
        while lo < hi:
            k = lo // SEGMENT
            if k not in memory:
                memory.clear()
                memory[k] = self.segment(k).all()
            end = min(hi, (k + 1) * SEGMENT)
            yield memory[k][lo - k * SEGMENT : end - k * SEGMENT]
            lo = end

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        memory: dict = {}
        for d, lo, hi in zip(self.docs, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield d, lo, hi - lo, self.pieces(lo, hi, memory)


def write_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode every whole text and write the ids in files; returns the table of files.

    Reads ``doc_id`` and ``text``.  A null text is empty; every document ends with ``end_id``.  Documents
    stand in ascending order of doc_id, null first, ties by text: ``part`` and ``number`` order the files.
    An empty table gives no files.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or public_vocabulary()
    folder = folder or scratch_path(spark, "codes")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, rows, part = encoder(vocabulary).encode, None, [], None
        for b in batches:
            texts = b.column(1).to_pylist()
            part = b.column(2)[0].as_py() if len(b) else part
            for lo in range(0, len(texts), 256):
                some = [t or "" for t in texts[lo : lo + 256]]
                for d, ids in zip(b.column(0).slice(lo, 256).to_pylist(), encode(some), strict=True):
                    writer = writer or Writer(folder)
                    writer.add(d, ids + end)
                    if writer.n >= FILE_IDS:
                        writer.close()
                        rows.append((part, len(rows), writer.name, len(writer.docs), writer.n))
                        writer = None
        if writer:
            writer.close()
            rows.append((part, len(rows), writer.name, len(writer.docs), writer.n))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        names = ["part", "number", "file", "n_docs", "n_tokens"]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    ordered = docs.select("doc_id", "text").repartitionByRange(
        parts_of(docs), F.asc_nulls_first("doc_id"), F.xxhash64("text")
    )
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    return through_table(ordered.mapInArrow(write, FILES), "code_files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32), one row per document.

    ``start`` counts the ids of all documents before it, over all files in their order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc, start, n, pieces in Reader(name).documents():
                    crc = 0
                    for ids in pieces:
                        crc = zlib.crc32(ids.tobytes(), crc)
                    rows.append((doc, before + start, n, crc))
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = positions(files, [F.asc("part"), F.asc("number")], name="place", sums={"upto": "n_tokens"})
    named = placed.select("file", (F.col("upto") - F.col("n_tokens")).alias("before"), "place")
    spread = named.repartition(parts_of(files), "place").select("file", "before")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
