"""A quality classifier learned from weak labels.

Simple rules vote good, bad or nothing on every document.  Expectation maximisation over the counts of
the vote patterns estimates how often each rule is right about good and about bad documents, without any
true label; the posterior of a pattern is the soft label of its documents.  A linear scorer on hashed
features of the text is trained on these labels, so that it also judges what the rules abstain on.

All documents are voted on and counted; only pattern counts reach the driver, and the scorer is
fitted on a bounded sample.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import giving_back
from playtrail.scratch import through_table

#: The scorer is fitted on at most so many documents, drawn by the hash of their ids.
TRAIN_ROWS = 2000
BUCKETS = 1 << 12
KEEP = 0.3

RULES = ("symbols", "plain_words", "lettered", "capitals", "lower_words", "lines", "vocabulary", "neighbours", "sentences", "word_length")
_MARKS = "#*$%&|<>"
_ENDS = (".", "!", "?", ":", '"', "…", "。", "！", "？", "：", "।", "॥", "؟", "۔", "”", "»", "」", "』", "።", "။", "។")

_LOWER, _UPPER, _DIGIT, _OTHER, _PUNCTUATION, _SIGN = 1, 2, 3, 4, 5, 6


def _classes() -> np.ndarray:
    """Kind of each code point: letters with case, digits, letters (and their marks) without; other ASCII characters by themselves."""
    by_category = {"Ll": _LOWER, "Lu": _UPPER, "Lt": _UPPER, "L": _OTHER, "M": _OTHER, "N": _DIGIT, "P": _PUNCTUATION}
    kind = np.full(sys.maxunicode + 1, _SIGN, np.uint8)
    for i in range(len(kind)):
        name = unicodedata.category(chr(i))
        kind[i] = by_category.get(name) or by_category.get(name[0], _SIGN)
    ascii_ = np.arange(128)
    kind[:128] = np.where(np.isin(kind[:128], (_LOWER, _UPPER, _DIGIT)), kind[:128], ascii_ + 8)
    return kind


_KIND = _classes()
_STOP = _KIND == _PUNCTUATION
_STOP[list(b".,;:!?\"')")] = True
#: Letters of scripts that put no space between words: Thai to Myanmar, Khmer, ideographs and kana.
_UNSPACED = np.zeros(sys.maxunicode + 1, bool)
for _lo, _hi in ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x312F), (0x31A0, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1B000, 0x1B2FF), (0x20000, 0x3FFFF)):
    _UNSPACED[_lo : _hi + 1] = True
_UNSPACED &= _KIND == _OTHER
_SPACE = np.isin(np.arange(sys.maxunicode + 1), list(b" \t\n\x0b\x0c\r"))
_MARK_KINDS = [ord(m) + 8 for m in _MARKS]


def _upto(flags: np.ndarray) -> np.ndarray:
    """How many hold before each place, and in all."""
    return np.concatenate([[0], np.cumsum(flags)])


def facts(text: str | None) -> tuple | None:
    """What the rules and the features look at, of the whole text; None without words.  The last one is the characters' kinds.

    Case is judged on words with letters that have case, or without any letters, and lengths on words of scripts that
    put spaces between words; the numbers of these words stand before the kinds.
    """
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    if not n:
        return None
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _KIND[raw]
    count = np.bincount(kinds, minlength=264)
    letters = int(count[_LOWER] + count[_UPPER])
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    # Words by their first and last character.
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2] - 1
    before = last - (_STOP[raw[last]] & (last > first))
    lower, cased, other = _upto(kinds == _LOWER), _upto(kinds <= _UPPER), _upto(kinds == _OTHER)
    has_case, has_other = cased[last + 1] > cased[first], other[last + 1] > other[first]
    lettered = has_case | has_other
    lowered = lower[last + 1] > lower[first]
    judged = n - int((has_other & ~has_case).sum())
    if count[_OTHER]:
        unspaced = _upto(_UNSPACED[raw])
        spaced = unspaced[last + 1] == unspaced[first]
    else:
        spaced = np.ones(n, bool)
    return (
        n,
        float(count[_MARK_KINDS].sum()) / n,
        float(count[_UPPER]) / max(1, letters),
        letters,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines),
        len(set(words)) / n,
        sum(map(bytes.__eq__, words[1:], words)) / max(1, n - 1),
        sum(x.endswith(_ENDS) for x in lines) / max(1, len(lines)),
        float((last + 1 - first)[spaced].sum()) / max(1, int(spaced.sum())),
        float((kinds[before] <= _OTHER).sum()) / n,
        float(lettered.sum()) / n,
        float(lowered.sum()) / max(1, int(has_case.sum())),
        judged,
        int(spaced.sum()),
        kinds,
    )


def votes(f: tuple | None) -> str:
    """One character per rule: g, b or - (no vote)."""
    if f is None:
        return "-" * len(RULES)
    n, symbols, capitals, letters, doubled, n_lines, kinds, same, ended, length, plain, lettered, lowered, judged, spaced, _ = f

    def vote(asked: bool, bad: bool, good: bool) -> str:
        return "-" if not asked else "b" if bad else "g" if good else "-"

    return "".join(
        (
            vote(n >= 5, symbols > 0.1, symbols < 0.02),
            vote(n >= 12, plain < 0.8, plain > 0.93),
            vote(n >= 12, lettered < 0.85, lettered > 0.95),
            vote(letters >= 30, capitals > 0.3, capitals < 0.15),
            vote(judged >= 8, lowered < 0.6, lowered > 0.85),
            vote(n_lines >= 3, doubled > 0.3, doubled < 0.1),
            vote(n >= 40, kinds < 0.35, kinds > 0.5),
            vote(n >= 20, same > 0.15, same < 0.05),
            vote(n >= 20, ended < 0.3, ended > 0.7),
            vote(spaced >= 20, not 2 <= length <= 13, 3 <= length <= 11),
        )
    )


def _signs(patterns: list[str], width: int) -> np.ndarray:
    return np.array([[{"g": 1, "b": -1, "-": 0}[c] for c in p] for p in patterns], float).reshape(len(patterns), width)


@dataclass
class LabelModel:
    prior: float  # share of good documents
    right: np.ndarray  # (rules, 2): share of right votes on bad and on good documents

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability that a document with these votes is good."""
        v = _signs(patterns, len(self.right))
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        bad, good = self.right[:, 0], self.right[:, 1]
        odds += (v > 0) @ np.log(good / (1 - bad)) + (v < 0) @ np.log((1 - good) / bad)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimate(counts: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation maximisation over vote patterns and their counts.

    Rules are taken to err independently given the class and to abstain alike on both classes.  A rule looks for one
    fault, so it may miss most bad documents, but it calls more than half of the good ones good.
    """
    patterns = sorted(counts)
    width = len(patterns[0]) if patterns else len(RULES)
    model = LabelModel(0.7, np.tile([0.5, 0.9], (width, 1)))
    n = np.array([counts[p] for p in patterns], float)
    if not n.sum():
        return model
    v = _signs(patterns, width)
    for _ in range(rounds):
        good = model.posterior(patterns) * n
        bad = n - good
        right = np.stack(
            [((v < 0).T @ bad + 2) / (np.abs(v).T @ bad + 2.5), ((v > 0).T @ good + 2) / (np.abs(v).T @ good + 2.5)], axis=1
        )
        new = LabelModel(float(np.clip(good.sum() / n.sum(), 0.01, 0.99)), np.clip(right, [0.02, 0.55], [0.995, 0.999]))
        moved = abs(new.prior - model.prior) + np.abs(new.right - model.right).max()
        model = new
        if moved < 1e-9:
            break
    return model


def features(f: tuple | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text's facts, scaled to length 1: kinds of characters in runs of 3 to 5, and levels of the shares."""
    if f is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    k = f[-1].astype(np.uint32)
    total = np.zeros(buckets)
    h = k
    with np.errstate(over="ignore"):
        for n in range(2, 6):
            if len(k) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + k[n - 1 :]
            if n >= 3:
                total += np.bincount(((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=buckets)[:buckets]
    share = np.sqrt(total / max(1, total.sum()))
    levels = [min(9, int(x * 10)) for x in (f[1], f[2], f[4], f[6], f[7], f[8], f[9] / 20, *f[10:13])]
    # What a script has no case or no spaces for says nothing.
    levels[1] = levels[1] if f[3] or not f[11] else -1
    levels[9] = levels[9] if f[13] or not f[11] else -1
    levels[6] = levels[6] if f[14] else -1
    for i, level in enumerate(levels):
        share[(i * 7919 + level * 104_729 + 13) % buckets] += 0.5
    at = np.flatnonzero(share)
    return at.astype(np.int32), (share[at] / np.sqrt((share[at] ** 2).sum())).astype(np.float32)


def fit_scorer(x: np.ndarray, p: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the last one the constant, of a logistic regression on soft labels (accelerated gradient descent).

    Both classes count alike, however many documents they have.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1], x.dtype)
    if not len(x):
        return w
    p = p.astype(x.dtype)
    share = float(np.clip(p.mean(), 0.01, 0.99))
    weight = (p * 0.5 / share + (1 - p) * 0.5 / (1 - share)).astype(x.dtype) / len(x)
    # Rows have length sqrt(2): the gradient's Lipschitz constant is at most half the weights' sum.
    step, ahead, last, t = x.dtype.type(1.8 / weight.sum()), w, w, 1.0
    for _ in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        w = ahead - step * (x.T @ (weight * (z - p)) + x.dtype.type(ridge) * ahead)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = w + x.dtype.type((t - 1) / t_next) * (w - last)
        last, t = w, t_next
    return w


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    buckets: int

    def score(self, f: tuple | None) -> float:
        """Probability that the text with these facts is good; 0 without words."""
        at, value = features(f, self.buckets)
        if not len(at):
            return 0.0
        z = float(self.weights[at] @ value + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _votes_udf():
    @F.pandas_udf("string")
    @giving_back
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([votes(facts(x)) for x in t], dtype=object)

    return udf.asNondeterministic()


def train(docs: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Scorer:
    """Vote on all documents, estimate the rules' accuracies, and fit the scorer on at most ``rows`` documents.

    Reads ``doc_id`` and ``text``; texts without words get no votes and teach nothing.
    """
    voted = through_table(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _votes_udf()("text").alias("votes")), "votes"
    )
    cast = voted.where(F.col("votes") != "-" * len(RULES))
    # At most 3^10 patterns.
    counts = {r["votes"]: r["count"] for r in cast.groupBy("votes").count().collect()}
    model = estimate(counts)
    named = cast.where("doc_id is not null")
    # A cut-off on the hash lets a little more through than is wanted; an id that stands on many rows counts once.
    ids = named.agg(F.approx_count_distinct("doc_id")).first()[0]
    share = (2.0 * rows + 40) / max(0.8 * ids, 1.0)
    if share < 1:
        named = named.where(F.xxhash64("doc_id") < int(share * 2**64) - 2**63)
    drawn = named.groupBy("doc_id").agg(F.min("votes").alias("votes")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @giving_back
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(facts(t), buckets) for t in b.column(1).to_pylist()]
            at = pa.array([f[0] for f in found], pa.list_(pa.int32()))
            value = pa.array([f[1] for f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), at, value], names=["votes", "at", "value"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id", "votes").agg(F.min("text").alias("text")).select("votes", "text")
    found = texts.mapInArrow(sets, "votes string, at array<int>, value array<float>").toArrow()
    x = np.zeros((len(found), buckets), np.float32)
    for i, (at, value) in enumerate(zip(found["at"], found["value"], strict=True)):
        x[i, np.array(at.values)] = np.array(value.values)
    return Scorer(model, fit_scorer(x, model.posterior(found["votes"].to_pylist())), buckets)


def score_of(docs: DataFrame, scorer: Scorer) -> Column:
    """A struct column (votes, score) from the column ``text``, whole; no votes and 0 for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded: ``buckets`` weights

    @F.pandas_udf("votes string, score double")
    @giving_back
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            known = map(facts, t)
            yield pd.DataFrame([(votes(f), shared.value.score(f)) for f in known], columns=["votes", "score"])

    return udf.asNondeterministic()(F.col("text"))


def classify(docs: DataFrame, keep: float = KEEP, **parameters) -> DataFrame:
    """(doc_id, votes, label, score, kept) for all rows: the rules' votes, their posterior, the scorer's probability.

    kept: score of at least ``keep``.  A null, empty or wordless text has score 0 and is not kept.  Repeated rows each get
    a row, an empty table none.
    """
    scorer = train(docs, **parameters)
    told = docs.select("doc_id", score_of(docs, scorer).alias("told"))
    right, prior = scorer.labels.right, scorer.labels.prior
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for i in range(len(RULES)):
        vote = F.substring("told.votes", i + 1, 1)
        bad, good = map(float, right[i])
        odds += F.when(vote == "g", float(np.log(good / (1 - bad)))).when(vote == "b", float(np.log((1 - good) / bad))).otherwise(0.0)
    return told.select(
        "doc_id", "told.votes", (1 / (1 + F.exp(-odds))).alias("label"), "told.score", (F.col("told.score") >= keep).alias("kept")
    )
