"""Token ids of whole texts inside tasks, with a bounded memory of units already encoded.

A byte-level tokenizer never joins what a single space or line feed between two visible characters
separates, nor a run of Latin letters with the marks after it.  Texts are cut at such places only, so the
ids of a text are those of its units in order, and a unit that was seen before costs one lookup.
"""

from __future__ import annotations

import re
from itertools import chain, islice
from struct import pack

import numpy as np

#: A run of letters followed by marks, with an optional space in front; both classes are plain, so
#: that the cut between them does not depend on a version of the Unicode tables.
_CORE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:$%&*#|]+)")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,!?;:$%&*#|"
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Characters of text, and new words, handled at a time.
CHARS, WORDS = 1_000_000, 10_000

#: Words that a worker remembers: some 200 bytes each.
REMEMBERED = 1_000_000

_ENCODERS: dict[tuple[str, int], Encoder] = {}


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Name of a vocabulary file of the ``public_tokenizers`` package; workers find its place themselves."""
    return f"public:{name}"


def _visible(s: str) -> bool:
    """Whether a string neither is empty nor begins or ends with white space."""
    return bool(s) and not s[0].isspace() and not s[-1].isspace()


def encoder(vocabulary: str, remembered: int = REMEMBERED, keep: bool = True) -> Encoder:
    """This worker's encoder, kept between tasks, or one for this task alone that starts without words."""
    if not keep:
        return Encoder(vocabulary, remembered)
    key = (vocabulary, remembered)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, remembered)
    return _ENCODERS[key]


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, by the ``tokenizers`` library without special tokens."""

    def __init__(self, vocabulary: str, remembered: int):
        from tokenizers import Tokenizer

        path = vocabulary
        if vocabulary.startswith("public:"):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary.removeprefix("public:"))
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        (self.line_feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.first: dict[str, bytes] = {}  # ids of strings as they stand
        self.rest: dict[str, bytes] = {}  # ids of visible strings with a space in front, which the key leaves out
        self.odd: dict[str, bytes] = {}  # ids of strings with white space at an end

    def encode(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = []
        batch, chars = [], 0
        for t in texts:
            batch.append(t)
            chars += len(t)
            if chars >= CHARS:
                found += self._encode(batch)
                batch, chars = [], 0
        return found + self._encode(batch)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        self._learn({u[0] for u in split}.difference(self.first))
        # First units count as well here: that costs a few words and saves a copy of every list.
        self._learn_words(set().union(*split).difference(self.rest))
        out = []
        for text, units in zip(texts, split, strict=True):
            # Where white space stands side by side, only some of the spaces are certain cuts.
            if len(units) == 1 or _visible(units[0][-1:]):
                try:
                    out.append(self.first[units[0]] + b"".join(map(self.rest.__getitem__, islice(units, 1, None))))
                    continue
                except KeyError:
                    pass
            pieces = _CUT.split(text)
            pieces[1:] = [" " + p for p in pieces[1:]]
            self._learn(set(pieces))
            out.append(b"".join(map(self._known, pieces)))
        for memory, most in ((self.rest, self.remembered), (self.first, self.remembered // 4), (self.odd, self.remembered // 4)):
            for k in list(islice(reversed(memory), max(0, len(memory) - most))):
                del memory[k]
        return out

    def _learn_words(self, words: set[str]) -> None:
        """Remember strings that follow a space: plain words and words with marks here, all else by :meth:`_learn`."""
        plain, marked, other = [], [], []
        rest = self.rest
        for w in words:
            core = w.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or _LETTERS.fullmatch(core)):
                if len(core) == len(w):
                    plain.append(w)
                else:
                    marked.append((w, core))
                    if core not in rest and core not in words:
                        plain.append(core)
            elif _visible(w):
                other.append(" " + w)
        plain = list(dict.fromkeys(plain))
        # All in one text: a line feed between two words is always a token of its own, and no word has one.
        for lo in range(0, len(plain), WORDS):
            some = plain[lo : lo + WORDS]
            found = self.tokenizer.encode_batch_fast([" " + "\n ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            data, cuts = ids.tobytes(), (np.flatnonzero(ids == self.line_feed) * 4).tolist()
            starts = [0, *(c + 4 for c in cuts)]
            rest.update(zip(some, [data[a:b] for a, b in zip(starts, [*cuts, len(data)], strict=True)], strict=True))
        marks = {w[len(core) :] for w, core in marked}
        self._learn({*other, *marks.difference(self.first)})
        first = self.first
        for w, core in marked:
            rest[w] = rest[core] + first[w[len(core) :]]

    def _place(self, s: str) -> tuple[dict[str, bytes], str]:
        if s[:1] != " ":
            return self.first, s
        return (self.rest, s[1:]) if _visible(s[1:]) else (self.odd, s)

    def _known(self, s: str) -> bytes:
        memory, key = self._place(s)
        return memory[key]

    def _learn(self, wanted: set[str]) -> None:
        """Remember the ids of strings that stand between certain cuts."""
        cut = {s: self._cut(s) for s in wanted}
        new = []
        for atom in set(chain.from_iterable(cut.values())):
            memory, key = self._place(atom)
            if key not in memory:
                new.append((atom, memory, key))
        found = self.tokenizer.encode_batch_fast([a for a, _, _ in new], add_special_tokens=False)
        for (_, memory, key), e in zip(new, found, strict=True):
            memory[key] = pack(f"<{len(e)}I", *e.ids)
        for s, atoms in cut.items():
            if len(atoms) != 1 or atoms[0] != s:
                memory, key = self._place(s)
                memory[key] = b"".join(map(self._known, atoms))

    @staticmethod
    def _cut(s: str) -> list[str]:
        lines = s.split("\n")
        if len(lines) > 1:
            apart = all(x and not x[0].isspace() and not x[-1].isspace() for x in lines[1:-1])
            head, tail = lines[0], lines[-1]
            if not (apart and head and not head[-1].isspace() and tail and not tail[0].isspace()):
                return [s] if s else []
        found = []
        for i, line in enumerate(lines):
            if i:
                found.append("\n")
            m = _CORE.fullmatch(line)
            found += m.groups() if m else [line] if line else []
        return found
