"""Quality rules on compression: repetitive or incompressible texts leave the band of ordinary prose.

The ratio of a text's UTF-8 bytes to its zstandard frame grows with the text's length, so the limits
depend on it: they are given at some lengths and interpolated on the logarithm between them.  The least also
depends on how many bytes a character takes, as short texts in scripts of many characters hardly shrink.  The
whole text is measured, and every fixed chunk of it, so that a repetitive or random passage shows in a
long document as well: by its share of the chunks, or by its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import fresh

#: (bytes, least ratio, least ratio of wide text, greatest ratio); below the first length nothing is judged.  Of real prose (licences,
#: tutorials and help texts in English, German, French, Polish, Vietnamese, Russian, Ukrainian, Bulgarian, Greek, Korean, Japanese and
#: Chinese, 150 random cuts of each length) the least is below nearly every cut from 512 bytes on.  In one-byte letters it is above what base64
#: and letters mixed with digits reach from 1 KB on and random lower-case words from 2 KB on; shorter ones look like prose to it, and random
#: hexadecimal words (1.9) do at all lengths.  The greatest leaves room above plain prose of that length.
BANDS = (
    (128, 0.90, 0.78, 2.10),
    (256, 1.04, 0.90, 2.30),
    (512, 1.25, 1.00, 2.50),
    (1024, 1.48, 1.12, 2.70),
    (2048, 1.69, 1.29, 2.90),
    (4096, 1.74, 1.42, 3.10),
    (16384, 1.78, 1.50, 3.60),
    (65536, 1.78, 1.52, 4.20),
    (1048576, 1.78, 1.52, 5.00),
)
#: Bytes a character up to which a text is narrow and from which on it is wide; between them the least ratio is, too.  Scripts
#: of thousands of characters have few repeated bytes in a short text, whatever it says.
NARROW, WIDE = 1.1, 1.6
CHUNK = 4096
#: Greatest share of a document's chunks outside their band.
BAD_CHUNKS = 0.25
#: So many chunks outside their band in a row reject a document of any length.
BAD_RUN = 2
LEVEL = 3

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

COLUMNS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "ratio": "double",
    "n_chunks": "bigint",
    "bad_chunks": "bigint",
}


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words in windows that stand twice or more in the text, the first time included."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    kinds, width = len(number), 1
    while width < window:
        # Windows of twice the width, or of the full width with an overlap, are pairs of narrower ones.
        step = min(width, window - width)
        pairs = ids[: len(ids) - step] * kinds + ids[step:]
        values, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        kinds, width = len(values), width + step
    twice = counts[ids] > 1
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def width_of(data: bytes) -> float:
    """Bytes a character; a character cut by the edge of a chunk hardly counts."""
    if data.isascii():
        return 1.0
    begins = np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return len(data) / max(1, begins)


def limits(n: int, width: float = 1.0, bands=BANDS) -> tuple[float, float]:
    """The least and the greatest ratio of an ordinary text of ``n`` bytes, ``width`` of them a character."""
    x, at = np.log([b[0] for b in bands]), np.log(n)
    narrow, wide, greatest = (float(np.interp(at, x, [b[i] for b in bands])) for i in (1, 2, 3))
    share = min(1.0, max(0.0, (width - NARROW) / (WIDE - NARROW)))
    return narrow + share * (wide - narrow), greatest


def _outside(data: bytes, compress, bands) -> tuple[float | None, bool]:
    if len(data) < bands[0][0]:
        return None, False
    ratio = len(data) / len(compress(data))
    low, high = limits(len(data), width_of(data), bands)
    return ratio, not low <= ratio <= high


def measure(text: str | None, compress, bands=BANDS, chunk: int = CHUNK) -> tuple:
    """The values of ``COLUMNS`` and whether the whole text or a run of chunks is outside its band."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ratio, bad = _outside(data, compress, bands)
    # The last chunk takes the rest, so that no short one stands alone.
    starts = range(0, max(chunk, len(data) - chunk + 1), chunk)
    chunks = [data[a:b] for a, b in zip(starts, chain(starts[1:], [len(data)]), strict=True)]
    outside = [_outside(c, compress, bands)[1] for c in chunks]
    run = any(all(outside[i : i + BAD_RUN]) for i in range(len(outside) - BAD_RUN + 1))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        ratio,
        len(chunks),
        sum(outside),
        bad or run,
    )


def quality_measures(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``docs`` with the measures, base_failed, outside_band and kept, and the names of these columns.

    Reads ``text``, in whole.  A null or empty text has no words and fails the base rules.  Texts too short for
    the first band pass the bands.  kept: neither base_failed nor outside_band.  ratio is null where the text is too
    short to be judged.  A name that ``docs`` has already is lengthened by underscores.
    """
    wanted = [*COLUMNS, "base_failed", "outside_band", "kept"]
    names = dict(zip(wanted, fresh(docs, *wanted), strict=True))
    cell = fresh(docs, "_measures")[0]
    kind = ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", outside boolean"

    @F.pandas_udf(kind)
    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for t in texts:
            rows = [measure(x, compress, bands, chunk) for x in t]
            yield pd.DataFrame(rows, columns=[*COLUMNS, "outside"]).astype({"ratio": "float64", "outside": bool})

    out = docs.withColumn(cell, measures.asNondeterministic()(F.col("text")))
    words, repeat = F.col(f"{cell}.n_words"), F.col(f"{cell}.n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEATED_PERCENT * words)
    outside = F.col(f"{cell}.outside") | (F.col(f"{cell}.bad_chunks") > bad_chunks * F.col(f"{cell}.n_chunks"))
    return out.select(
        *docs.columns,
        *[F.col(f"{cell}.{c}").alias(names[c]) for c in COLUMNS],
        failed.alias(names["base_failed"]),
        outside.alias(names["outside_band"]),
        (~failed & ~outside).alias(names["kept"]),
    ), names
