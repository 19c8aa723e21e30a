"""Small tables with odd rows, and brute-force helpers."""

from __future__ import annotations

import zlib

import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACES = " \t\n\x0b\x0c\r"

PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven sailors sing old songs about the sea. "


def odd_documents():
    """Nulls in every column, empty and very long texts, repeated rows, ties, odd white space."""
    long = " ".join(f"word{i % 977} other{i}" for i in range(60_000))
    rows = [
        (1, PROSE * 3, "en", "a", 1),
        (1, PROSE * 3, "en", "a", 1),
        (2, PROSE * 3, "en", "b", 1),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "a row without an id and some words in it", "en", "a", 5),
        (None, None, None, None, None),
        (5, long, "en", "c", len(long)),
        (6, " \t\n ", "de", "c", 4),
        (7, "12345 67890 !!! ???", "de", None, 3),
        (8, "  two  spaces\n\nand\x0blines \x85 \xa0x　 'll it's I'LL don't\n", "fr", "a", 3),
        (9, "Ünïcödé ñ 中文字符 🙂 <|endoftext|> end", "fr", "a", 3),
        (10, "spam spam spam spam " * 200, "en", "b", 3),
        (11, "one", "en", "b", 3),
        (12, "one two three", "en", "", 3),
    ]
    return rows


def words(text):
    return (text or "").encode().split()


_TOKENIZER = None


def token_ids(text, end=2):
    global _TOKENIZER
    _TOKENIZER = _TOKENIZER or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc_of(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def roots(nodes, links):
    """Smallest node reachable."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))
