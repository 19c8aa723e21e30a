"""Encoding and decoding by a SentencePiece model of kind BPE, in vectorised merge rounds.

The text gets a space in front, spaces become U+2581, and words are cut before a space that follows another
character and around line feeds: no piece reaches across such a place.  New words of a batch become one flat array of symbols.  In
every round each word looks at the least rank among its neighbouring pairs, all its pairs of that rank are
merged at once from the left, and the array is compacted; words without a pair leave it.

The library merges one pair at a time: least rank first, leftmost among equals.  A round does the same if no
merge makes a pair of a rank not above its own.  A piece that can make one (a longer piece holds it and
ranks no higher, or it shares its rank) is *touchy*: of these only the leftmost of the word is merged in a round.

In words of more than ``LONG`` characters a pair need not wait for the least rank of the whole word.
Whatever could take one of its two symbols first lies within a piece's length on either side, so
the least rank within that distance decides, and places far apart are merged in the same round.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from playtrail.llm.common import fresh

SPACE = "▁"
#: Characters of a word from which on ranks are compared within a piece's length only.
LONG = 64
#: Words and characters that a worker remembers, and characters of new words that are merged at a time.
REMEMBERED, REMEMBERED_CHARS, CHARS = 500_000, 8_000_000, 1_000_000
#: Symbols from here on are characters that are no pieces: this number and the code point.
_PLAIN = 1 << 24
_NEVER = np.iinfo(np.int32).max

_MODELS: dict[str, PieceModel] = {}


def public_model(name: str = "piece_bpe_32k.model") -> str:
    """Name of a model file of the ``public_tokenizers`` package; workers find its place themselves."""
    return f"public:{name}"


def piece_model(path: str) -> PieceModel:
    """This worker's model, kept between tasks with the words it remembers."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("playtrail.each_byte", _each_byte)


class PieceModel:
    """Pieces, ranks and joins of a model file; texts to ids and ids to texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import sentencepiece_model_pb2

        if path.startswith("public:"):
            import public_tokenizers

            path = public_tokenizers.path(path.removeprefix("public:"))
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds, spec, how = proto.SentencePiece, proto.normalizer_spec, proto.trainer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        known = {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
        if how.model_type != how.BPE or not how.byte_fallback or how.treat_whitespace_as_suffix or not plain:
            raise ValueError("only BPE models with byte fallback, a space in front and no other normalization are supported")
        if any(p.type not in known for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.remembered = remembered
        self.spaced: dict[str, bytes] = {}  # ids of words with one space in front, which the key leaves out
        self.others: dict[str, bytes] = {}  # ids of words as they stand
        self.remembered_chars = 0
        self.end_id = how.eos_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        self.surface, self.is_control = [], []
        for i, p in enumerate(proto.pieces):
            value = p.piece.replace(SPACE, " ").encode()
            if p.type == kinds.BYTE:
                value = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[value[0]] = i
            elif p.type == kinds.CONTROL:
                value = b""
            elif p.type == kinds.UNKNOWN:
                value = how.unk_surface.encode()
            self.surface.append(value)
            self.is_control.append(p.type == kinds.CONTROL)
        self.is_control = np.array(self.is_control)
        self.opens = [p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        self._joins(normal, {i: p.score for i, p in enumerate(proto.pieces)})
        self._cuts(normal)

    def _joins(self, normal: dict[str, int], score: dict[int, float]) -> None:
        """Sorted keys of all pairs that join to a piece, with the piece and its rank."""
        values = sorted({score[i] for i in normal.values()}, reverse=True)
        place = {v: r for r, v in enumerate(values)}
        rank = {p: place[score[i]] for p, i in normal.items()}
        shared = np.bincount(list(rank.values()), minlength=len(values))
        self.char = {p: i for p, i in normal.items() if len(p) == 1}
        self.longest = max(map(len, normal))
        size = len(score)
        self.rank = np.full(size, _NEVER, np.int32)
        self.touchy = np.zeros(size, bool)
        keys, joined = [], []

        def symbol(s: str) -> int | None:
            return normal.get(s, _PLAIN + ord(s) if len(s) == 1 else None)

        for p, i in normal.items():
            self.rank[i] = rank[p]
            self.touchy[i] |= shared[rank[p]] > 1
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is None or right is None:
                    continue
                keys.append(left << 32 | right)
                joined.append(i)
                for part, s in ((p[:k], left), (p[k:], right)):
                    if len(part) > 1 and rank[part] >= rank[p]:
                        self.touchy[s] = True
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.joined = np.array(joined, np.int32)[order]
        # Characters that are pieces by code point, for those of the basic plane; others are looked up one by one.
        self.low = np.arange(0x10000, dtype=np.int32) + _PLAIN
        self.high: dict[int, int] = {}
        for c, i in self.char.items():
            if ord(c) < 0x10000:
                self.low[ord(c)] = i
            else:
                self.high[ord(c)] = i

    def _cuts(self, normal: dict[str, int]) -> None:
        """Where words end: before a space that follows another character, if no piece holds such a place."""
        across = any(SPACE in p.lstrip(SPACE) for p in normal)
        self.cuts = not across
        self.lines = not any("\n" in p for p in normal)
        # Runs of spaces are pieces of one rank behind all others and no piece has two spaces and more: then a run is
        # merged from the left after all else, and may be cut behind the longest such piece if every run begins with it.
        runs = [p for p in normal if len(p) > 1 and not p.strip(SPACE)]
        most, last = max(map(len, runs), default=0), int(self.rank[[i for p, i in normal.items() if len(p) > 1]].max())
        behind = {int(self.rank[normal[p]]) for p in runs} == {last}
        alone = not any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal)
        self.run = 0
        if runs and behind and alone and self.cuts:
            of = {n: self.merged(self.symbols(SPACE * n), np.array([n]))[0].tolist() for n in range(1, 3 * most + 1)}
            if all(of[n] == [normal[SPACE * most], *of[n - most]] for n in range(most + 1, 3 * most + 1)):
                self.run = most

    def words(self, line: str) -> list[str]:
        """Parts of a line whose spaces are U+2581 already; they can be encoded one by one."""
        if not self.cuts:
            return [line] if line else []
        parts = line.split(SPACE)
        found, spaces = [parts[0]] if parts[0] else [], 0
        for p in islice(parts, 1, None):
            spaces += 1
            if p:
                found.append(SPACE * spaces + p)
                spaces = 0
        if spaces:
            found.append(SPACE * spaces)
        if self.run and SPACE * (self.run + 1) in line:
            found = [x for w in found for x in self._cut_run(w)]
        return found

    def _cut_run(self, word: str) -> list[str]:
        n = len(word) - len(word.lstrip(SPACE))
        whole = max(0, n - 1) // self.run
        return [SPACE * self.run] * whole + [word[whole * self.run :]]

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        found = self.low[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            found[i] = self.high.get(int(points[i]), _PLAIN + int(points[i]))
        return found

    def _pairs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every symbol the piece it makes with the next one and that piece's rank."""
        ranks = np.full(len(symbols), _NEVER, np.int32)
        made = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1 and len(self.keys):
            wide = symbols.astype(np.int64)
            key = (wide[:-1] << 32) | wide[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            made[:-1] = np.where(hit, self.joined[at], 0)
            ranks[:-1] = np.where(hit, self.rank[made[:-1]], _NEVER)
        return made, ranks

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (each at least one long) after all merges, and the words' new lengths."""
        word = np.arange(len(lengths))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            starts = np.cumsum(lengths) - lengths
            made, ranks = self._pairs(symbols)
            ranks[starts + lengths - 1] = _NEVER
            least = np.minimum.reduceat(ranks, starts)
            open_ = least < _NEVER
            of = np.repeat(np.arange(len(word)), lengths)
            if not open_.all():
                stays = open_[of]
                done.append((word[~open_], lengths[~open_], symbols[~stays]))
                symbols, made, ranks, of = symbols[stays], made[stays], ranks[stays], of[stays]
                word, lengths, least = word[open_], lengths[open_], least[open_]
                of = np.repeat(np.arange(len(word)), lengths)
                if not len(word):
                    break
            hit = ranks == least[of]
            take = self._from_left(hit, ranks)
            # Of touchy pieces the word's first one only.
            at = np.flatnonzero(hit)
            first = at[np.diff(of[at], prepend=-1) > 0]
            touchy = self.touchy[made[first]]
            if touchy.any():
                careful = np.zeros(len(word), bool)
                careful[of[first[touchy]]] = True
                take &= ~careful[of]
                take[first] = True
            symbols, lengths = self._joined(symbols, made, take, of, lengths)
        if not done:
            return symbols, lengths
        words = np.concatenate([d[0] for d in done])
        sizes, flat = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
        order = np.argsort(words)
        begins = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return flat[np.repeat(begins, sizes) + within], sizes

    @staticmethod
    def _from_left(hit: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Every other hit of each run of overlapping hits of one rank, its first one included."""
        index = np.arange(len(hit))
        follows = np.zeros(len(hit), bool)
        follows[1:] = hit[1:] & hit[:-1] & (ranks[1:] == ranks[:-1])
        begin = np.maximum.accumulate(np.where(follows, 0, index))
        return hit & ((index - begin) % 2 == 0)

    @staticmethod
    def _joined(symbols, made, take, of, lengths):
        symbols = np.where(take, made, symbols)
        gone = np.zeros(len(symbols), bool)
        gone[1:] = take[:-1]
        return symbols[~gone], lengths - np.bincount(of[gone], minlength=len(lengths))

    def merged_long(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of one long word after all merges; ranks are compared within a piece's length."""
        reach = self.longest
        while True:
            made, ranks = self._pairs(symbols)
            if not (ranks < _NEVER).any():
                return symbols
            before = _least_before(ranks, reach)
            after = _least_before(ranks[::-1], reach)[::-1]
            near = np.minimum(before, after)
            free = (ranks < _NEVER) & (ranks <= near)
            # A run of equal ranks is merged from its true beginning only, in turn.
            index = np.arange(len(ranks))
            same = np.zeros(len(ranks), bool)
            same[1:] = (ranks[1:] == ranks[:-1]) & (ranks[1:] < _NEVER)
            begin = np.maximum.accumulate(np.where(same, 0, index))
            take = free & free[begin] & ((index - begin) % 2 == 0)
            take &= ~self.touchy[made] | (before > ranks)
            symbols, _ = self._joined(symbols, made, take, np.zeros(len(symbols), np.int64), np.array([len(symbols)]))

    def _ids(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; characters that are no pieces as their bytes."""
        plain = np.flatnonzero(symbols >= _PLAIN)
        if not len(plain):
            return symbols, lengths
        count = np.ones(len(symbols), np.int64)
        points = symbols[plain] - _PLAIN
        count[plain] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.repeat(symbols, count)
        at = (np.cumsum(count) - count)[plain]
        for place, point in zip(at.tolist(), points.tolist(), strict=True):
            data = chr(point).encode()
            out[place : place + len(data)] = self.byte_ids[list(data)]
        ends = np.cumsum(lengths)
        return out, np.add.reduceat(count, ends - lengths)

    def _learn(self, words: list[str], keys: list[str], memory: dict[str, bytes]) -> None:
        """Remember the ids of words under keys."""
        short = [(k, w) for k, w in zip(keys, words, strict=True) if len(w) <= LONG]
        for lo in range(0, len(short), CHARS // LONG):
            some = short[lo : lo + CHARS // LONG]
            lengths = np.array([len(w) for _, w in some])
            ids, sizes = self._ids(*self.merged(self.symbols("".join([w for _, w in some])), lengths))
            data, ends = ids.astype("<i4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            memory.update(zip([k for k, _ in some], [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        if len(short) < len(words):
            memory.update((k, self._long(w)) for k, w in zip(keys, words, strict=True) if len(w) > LONG)
        self.remembered_chars += sum(map(len, words))

    def _long(self, word: str) -> bytes:
        found = self.merged_long(self.symbols(word))
        return self._ids(found, np.array([len(found)]))[0].astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit numbers, without an end id."""
        found, batch, chars = [], [], 0
        for t in texts:
            batch.append(t)
            chars += len(t)
            if chars >= CHARS:
                found += self._encode(batch)
                batch, chars = [], 0
        return found + self._encode(batch)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[tuple[list[str], dict[str, bytes]]]] = []
        spaced, others = set(), set()
        for t in texts:
            lines = []
            for k, line in enumerate(t.split("\n") if self.lines else [t]):
                if k:
                    lines.append((["\n"], self.others))
                units = line.split(" ")
                if not self.cuts or "" in units or SPACE in line:
                    # More than single spaces between words; only the first line gets a space in front.
                    words = self.words((SPACE if not k and t else "") + line.replace(" ", SPACE))
                    others.update(words)
                    lines.append((words, self.others))
                    continue
                if k:
                    others.add(units[0])
                    lines.append((units[:1], self.others))
                    del units[0]
                spaced.update(units)
                lines.append((units, self.spaced))
            others.add("\n")
            split.append(lines)
        spaced, others = spaced.difference(self.spaced), others.difference(self.others)
        self._learn([SPACE + p for p in spaced], list(spaced), self.spaced)
        self._learn(list(others), list(others), self.others)
        out = [b"".join([b"".join(map(memory.__getitem__, words)) for words, memory in lines]) for lines in split]
        # What was known before this batch is the more common, so the batch's own words go first.
        for fresh_words in ((spaced, others), (list(self.spaced), list(self.others))):
            if len(self.spaced) + len(self.others) <= self.remembered and self.remembered_chars <= REMEMBERED_CHARS:
                break
            for words, memory in zip(fresh_words, (self.spaced, self.others), strict=True):
                self.remembered_chars -= sum(map(len, words)) + (len(words) if memory is self.spaced else 0)
                for w in words:
                    memory.pop(w, None)
            self.remembered_chars = max(0, self.remembered_chars)
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of any ids of the model, as the library has it: control ids are empty, a wrong byte is U+FFFD."""
        ids = np.asarray(ids, np.int32)
        control = self.is_control[ids]
        parts = np.split(ids, np.flatnonzero(control))
        parts = [p[int(self.is_control[p[0]]) :] for p in parts if len(p)]  # bytes do not go on behind a control id
        data = [b"".join(map(self.surface.__getitem__, p.tolist())) for p in parts if len(p)]
        if not control.all() and self.opens[ids[np.argmin(control)]]:
            data[0] = data[0][1:]  # the space in front
        return "".join([_text(d) for d in data])


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="playtrail.each_byte")


def _least_before(ranks: np.ndarray, reach: int) -> np.ndarray:
    """The least of up to ``reach`` values before each place."""
    found = np.full(len(ranks), _NEVER, ranks.dtype)
    found[1:] = ranks[:-1]
    have = 1
    while have < reach:
        step = min(have, reach - have)
        moved = np.full(len(ranks), _NEVER, ranks.dtype)
        moved[step:] = found[:-step]
        found = np.minimum(found, moved)
        have += step
    return found


def encode_documents(
    docs: DataFrame, text: str = "text", model: str | None = None, end: bool = True, keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all but the text, if not given) with the ids of every whole text, and the name of that column.

    A null text is empty; an empty text has the end id alone (no id at all without ``end``).  Rows are taken one by one, so
    repeated rows and nulls in other columns stay as they are, and an empty table gives an empty one.
    The column is ``ids``, lengthened by underscores where ``docs`` has such a column.
    """
    model = model or public_model()
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    name = fresh(docs, "ids")[0]
    chosen = docs.select(*[F.col(c) for c in keep], F.col(text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_model(model)
        last = np.array([known.end_id] if end else [], "<i4").tobytes()
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                found = known.encode([t or "" for t in part.column(len(keep)).to_pylist()])
                data = [f + last for f in found]
                offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(data))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], ids], names=[*keep, name])

    schema = StructType([*chosen.schema.fields[:-1], StructField(name, ArrayType(IntegerType()))])
    return chosen.mapInArrow(encode, schema), name


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> tuple[DataFrame, str]:
    """All columns with the text of the ids (null for null), and that column's name."""
    model = model or public_model()
    name = fresh(encoded, "decoded")[0]
    at = encoded.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_model(model)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                column = part.column(at)
                texts = [known.decode(i.values.to_numpy()) if i.is_valid else None for i in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField(name, StringType())])), name
