"""Language identification by string kernels.

A text is its set of character n-grams of all lengths up to ``SPECTRUM`` (blended spectrum, presence
only); the kernel of two texts is the size of the common set over the root of the product of both
sizes.  Kernel values with a bounded number of landmark texts give Nyström coordinates, in which one
ridge regression per language is solved.  Texts are scored in batches: a matrix of kernel values
times a matrix of coefficients.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import giving_back
from playtrail.operators.ordering import top_k

SPECTRUM = 4
#: n-grams are hashed into 2^HASH_BITS buckets.
HASH_BITS = 17
LANDMARKS = 128
#: The model is fitted on at most so many texts, as many of each language and one at least, drawn by the hash of their ids.
TRAIN_ROWS = 2000
RIDGE = 1e-3
#: Languages whose cut-offs go to every task: a name and a number each.
MOST_BROADCAST = 50_000
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
_FACTOR, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


class Presence:
    """Sets of hashed n-grams of whole texts; the buffer is used again for every text."""

    def __init__(self, spectrum: int = SPECTRUM, bits: int = HASH_BITS):
        self.spectrum, self.shift = spectrum, np.uint32(32 - bits)
        self.flags = np.zeros(1 << bits, bool)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Bucket numbers in ascending order; None where there is no letter."""
        letters = _OTHER.sub(" ", (text or "").lower()).strip()
        if not any(map(str.isalpha, letters)):
            return None
        # Surrogates can't come from a table; "replace" keeps a stray one from ending the job.
        a = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), "<u4")
        h = a
        with np.errstate(over="ignore"):
            for n in range(1, self.spectrum + 1):
                if n > 1:
                    h = h[:-1] * _FACTOR + a[n - 1 :]
                self.flags[((h + np.uint32(n * 7919)) * _MIX) >> self.shift] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


@dataclass
class Model:
    languages: list[str]
    spectrum: int
    bits: int
    row: np.ndarray  # bucket -> row of ``grams``; the last row, all zero, for buckets of no landmark
    grams: np.ndarray  # rows of landmarks' presence
    sizes: np.ndarray  # roots of the landmarks' set sizes
    coefficients: np.ndarray

    def kernel(self, found: np.ndarray) -> np.ndarray:
        rows = self.row[found]
        common = np.add.reduce(self.grams[rows[rows >= 0]], axis=0, dtype=np.uint32)
        return common / (self.sizes * np.sqrt(len(found)))


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, spectrum: int = SPECTRUM, bits: int = HASH_BITS) -> Model:
    """Fit on (language, bucket numbers) pairs; the first ones of each language are landmarks."""
    languages = sorted({s[0] for s in samples})
    each = max(1, landmarks // max(1, len(languages)))
    marks = [f for lang in languages for f in [f for s, f in samples if s == lang][:each]]
    row = np.full(1 << bits, -1, np.int32)
    if not marks:
        empty = np.zeros((0, 0), np.uint8)
        return Model([], spectrum, bits, row, empty, np.zeros(0), np.zeros((0, 0)))
    seen = np.unique(np.concatenate(marks))
    row[seen] = np.arange(len(seen))
    grams = np.zeros((len(seen), len(marks)), np.uint8)
    for j, m in enumerate(marks):
        grams[row[m], j] = 1
    model = Model(languages, spectrum, bits, row, grams, np.sqrt([len(m) for m in marks]), np.zeros((0, 0)))
    among = np.stack([model.kernel(m) for m in marks])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.stack([model.kernel(f) for _, f in samples]) @ root
    y = np.array([[s == lang for lang in languages] for s, _ in samples], float)
    # Languages count alike, however many samples they have.
    weight = 1.0 / y.sum(axis=0)[y.argmax(axis=1)]
    x1 = np.hstack([x, np.ones((len(x), 1))])
    gram = (x1 * weight[:, None]).T @ x1 + ridge * np.eye(x1.shape[1])
    solved = np.linalg.solve(gram, (x1 * weight[:, None]).T @ y)
    model.coefficients = np.vstack([root @ solved[:-1], solved[-1:]])
    return model


def predict(model: Model, texts) -> list[tuple[str, float]]:
    """(language, score) per text, all kernel values of the batch at once; the score is between 0 and 1."""
    presence = Presence(model.spectrum, model.bits)
    k = np.zeros((len(texts), model.grams.shape[1] + 1))
    known = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        found = presence(t)
        if found is not None and model.languages:
            known[i] = True
            k[i, :-1] = model.kernel(found)
            k[i, -1] = 1
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    scores = k @ model.coefficients
    best = scores.argmax(axis=1)
    top = np.clip(scores[np.arange(len(texts)), best], 0, 1)
    return [(model.languages[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, top, known, strict=True)]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, spectrum: int = SPECTRUM, bits: int = HASH_BITS) -> Model:
    """Learn from text and lang of documents that are not held out.

    The sample is bounded: at most ``rows`` ids, as many for each language and at least one, chosen by the
    hash of the id.  Every language is learned that has a text to learn from.  Null languages, null ids and texts without letters teach nothing.
    """
    taught = docs.where((remainder(F.col("doc_id")) != 0) & F.col("lang").isNotNull())
    # A language's own cut-off on the hash lets a little more through than is wanted, so that no task gets
    # rows of a language by the map task; an id that stands on many rows counts once.
    sizes = taught.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_ids"))
    languages = sizes.count()
    if not languages:
        return fit([], landmarks, spectrum=spectrum, bits=bits)
    each = max(1, rows // languages)
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 40) / (0.8 * F.col("_ids")))
    near = sizes.select("lang", F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("bigint")).alias("_cut"))
    if languages <= MOST_BROADCAST:  # else the rows would be dealt by language before they are few
        near = F.broadcast(near)
    few = taught.select("lang", "doc_id").join(near, "lang").where(F.col("_cut").isNull() | (F.xxhash64("doc_id") < F.col("_cut")))
    ids = few.select("lang", "doc_id").distinct()
    drawn = top_k(ids, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], each, "_place").select("lang", "doc_id")

    @giving_back
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(spectrum, bits)
        for b in batches:
            found = [presence(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([None if f is None else f.astype(np.int32) for f in found], pa.list_(pa.int32()))],
                names=["lang", "doc_id", "grams"],
            )

    # Bounded by ``rows``; rows that repeat an id are one sample.
    texts = taught.join(F.broadcast(drawn), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    table = texts.mapInArrow(sets, "lang string, doc_id bigint, grams array<int>").where("grams is not null")
    found = table.select("lang", "grams", F.xxhash64("doc_id").alias("h"), "doc_id").toArrow().sort_by([("lang", "ascending"), ("h", "ascending"), ("doc_id", "ascending")])
    samples = [(lang, np.array(g.values)) for lang, g in zip(found["lang"].to_pylist(), found["grams"], strict=True)]
    return fit(samples, landmarks, spectrum=spectrum, bits=bits)


def language_of(docs: DataFrame, model: Model) -> Column:
    """A struct column (lang_pred, score) from the column ``text``, whole; ``und`` and 0 for null or no letter."""
    # Bounded by the landmarks and the hash: a few megabytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @giving_back
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            found = [x for lo in range(0, len(t), 500) for x in predict(shared.value, t.iloc[lo : lo + 500].tolist())]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return udf.asNondeterministic()(F.col("text"))


def identify(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for all rows of ``docs``; learned from those not held out.

    A null id is neither held out nor learned from.  Repeated rows each get a row, an empty table none.
    """
    model = train(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"), **parameters)
    told = docs.select("doc_id", language_of(docs, model).alias("told"))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return told.select("doc_id", held.alias("held_out"), "told.lang_pred", "told.score")
