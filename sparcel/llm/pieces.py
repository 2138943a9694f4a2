"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are written one after the other, all suffixes of that text are sorted by as many
characters as the longest piece has, and every piece of the vocabulary is found by binary search as a range of suffixes. Each
suffix of a range is an edge: the piece leads from its first character to the one after its last. The edges are sorted by
position and relaxed from left to right: an edge reaches its end if it may follow the piece that reaches its start. For a model
of merges (BPE) that is the case if merging the two pieces' characters gives just these two pieces again; then every position
has one piece that reaches it, and the pieces on the way back from a word's end are the library's encoding of the word.

Words are what lies between spaces: a piece has its space in front, so no piece reaches over a word's end. Runs of spaces are
pieces of spaces, longest first. A character without a piece becomes its UTF-8 bytes' pieces (or the unknown piece).

Defined results: NULL and empty texts have no pieces and decode to an empty text; a text's own U+2581 decodes to a space, as
with the library; everything else decodes to itself; lone surrogates cannot occur in Spark's text; repeated rows are encoded
alike; an empty table gives an empty result; other columns are never touched.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm.common import document_text, fresh
from sparcel.session import ship

SPACE = "▁"
#: Where the vocabulary lies by default; a parameter of every public function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words a worker remembers, characters cut into words and characters indexed at a time, and characters relaxed for all words at once.
REMEMBERED, TAKEN, INDEXED, LONG = 300_000, 1 << 21, 1 << 18, 64
START, NONE = -2, -1
NORMAL, UNKNOWN, BYTE = 1, 2, 6


class Vocabulary:
    """Pieces of a BPE model, numbered by rank: the characters first, then the merged pieces in the order of merging."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with the identity normalizer, a space put in front and all spaces kept is needed")
        pieces = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
        runs = [(p, i, s) for p, i, s in pieces if len(p) > 1 and set(p) == {SPACE}]
        words = [x for x in pieces if x not in runs]
        if any(SPACE in p[1:] for p, _, _ in words) or len({s for p, _, s in words if len(p) > 1}) < sum(len(p) > 1 for p, _, _ in words):
            raise ValueError("pieces of several words, or merges of the same rank")
        if any("\0" in p for p, _, _ in words):
            raise ValueError("a piece with the character that stands between words")
        ordered = sorted(words, key=lambda x: (len(x[0]) > 1, -x[2], x[0]))
        self.texts = [p for p, _, _ in ordered]
        self.ids = np.array([i for _, i, _ in ordered], np.int32)
        self.rank = {p: r for r, p in enumerate(self.texts)}
        self.characters = sum(len(p) == 1 for p in self.texts)
        self.runs = {len(p): i for p, i, _ in runs} | ({1: int(self.ids[self.rank[SPACE]])} if SPACE in self.rank else {})
        self.longest = max(map(len, self.texts), default=1)
        self._splits()

    def _splits(self) -> None:
        """For each piece the two it is merged from, and the piece that each pair of pieces makes."""
        n, rank = len(self.texts), self.rank
        self.left, self.right = np.arange(n), np.arange(n)
        made = np.array(
            [(a, b, r) for r in range(n) for text in (self.texts[r],) for at in range(1, len(text))
             if (a := rank.get(text[:at], NONE)) >= 0 and (b := rank.get(text[at:], NONE)) >= 0], np.int64,
        ).reshape(-1, 3)
        keys = made[:, 0] << 20 | made[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], made[order, 2]
        # merging a piece's characters by earlier pieces only ends in two parts; those are shorter, so known before it
        lengths = np.array([len(t) for t in self.texts])[made[:, 2]]
        for length in range(2, self.longest + 1):
            a, b, r = made[lengths == length].T
            ok = (a < r) & (b < r)
            ok[ok] = self.may_follow(a[ok], b[ok], r[ok])
            self.left[r[ok]], self.right[r[ok]] = a[ok], b[ok]

    def reachable(self, r: int) -> bool:
        """Whether merging ever makes the piece."""
        return r < self.characters or self.left[r] != r

    def without_piece(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a pair makes, or a rank above all."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], 1 << 40)

    def may_follow(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | int = 1 << 39) -> np.ndarray:
        """Whether merging the characters of a then b, by pieces of a rank under ``below``, ends in just these two pieces.

        Both are taken apart again, the later merge first. Whenever two parts that meet at the border could have been merged
        earlier than what was built on either side of them, the border would not have stayed.
        """
        result = np.ones(len(a), bool)
        here = np.arange(len(a))
        limit = np.broadcast_to(below, a.shape)
        while len(here):
            bad = self.merged(a, b) < limit
            result[here[bad]] = False
            can_a, can_b = self.left[a] != a, self.left[b] != b
            use_a = can_a & (~can_b | (a > b))
            use_b = can_b & ~use_a
            # of equal merges the left one is done first, so a border merge of the rank of b comes before b's
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, self.right[a], a), np.where(use_b, self.left[b], b)
            go = ~bad & (use_a | use_b)
            here, a, b, limit = here[go], a[go], b[go], limit[go]
        return result


def suffix_array(codes: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes sorted by their first ``depth`` characters, and these characters in that order, packed into keys.

    ``codes`` are numbers of ``bits`` bits, 0 for the ends of words; a key has as many characters as fit.
    """
    per = 62 // bits
    padded = np.concatenate((codes.astype(np.int64), np.zeros(depth + per, np.int64)))
    keys = []
    for start in range(0, depth, per):
        key = np.zeros(len(codes), np.int64)
        for k in range(min(per, depth - start)):
            key = key << bits | padded[start + k : start + k + len(codes)]
        keys.append(key)
    order = np.argsort(keys[0])
    for done in range(1, len(keys)):
        # suffixes that agree in the keys so far are sorted among themselves by the next one
        same = np.ones(len(order) - 1, bool)
        for key in keys[:done]:
            same &= key[order[1:]] == key[order[:-1]]
        tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        group = np.cumsum(np.concatenate(([True], ~same)))[tied]
        rows = order[tied]
        order[tied] = rows[np.lexsort((keys[done][rows], group))]
    return order, [k[order] for k in keys]


class Index:
    """The vocabulary's pieces in the numbers of an alphabet, ready for binary search."""

    def __init__(self, vocabulary: Vocabulary, alphabet: np.ndarray):
        self.alphabet, self.depth = alphabet, vocabulary.longest
        self.bits = max(1, len(alphabet).bit_length())
        number = {chr(c): i + 1 for i, c in enumerate(alphabet.tolist())}
        usable = [r for r, p in enumerate(vocabulary.texts) if vocabulary.reachable(r) and all(map(number.__contains__, p))]
        self.pieces = np.array(usable, np.int64)
        self.lengths = np.array([len(vocabulary.texts[r]) for r in usable], np.int64)
        self.per = 62 // self.bits
        starts = range(0, self.depth, self.per)
        self.low, self.high = np.zeros((len(starts), len(usable)), np.int64), np.zeros((len(starts), len(usable)), np.int64)
        for j, r in enumerate(usable):
            piece = [number[c] for c in vocabulary.texts[r]]
            for k, start in enumerate(starts):
                width = min(self.per, self.depth - start)
                part = piece[start : start + width]
                value = 0
                for c in part:
                    value = value << self.bits | c
                rest = self.bits * (width - len(part))
                self.low[k, j], self.high[k, j] = value << rest, (value << rest) | ((1 << rest) - 1)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every piece: (position, piece). ``codes`` are code points, 0 at the ends of words."""
        small = np.where(codes == 0, 0, np.searchsorted(self.alphabet, codes) + 1)
        order, keys = suffix_array(small, self.depth, self.bits)
        # the range of a piece's first characters, then inside it that of the next ones
        low, high = np.searchsorted(keys[0], self.low[0], "left"), np.searchsorted(keys[0], self.high[0], "right")
        for k in range(1, len(keys)):
            for j in np.flatnonzero((self.lengths > k * self.per) & (high > low)):
                inside = keys[k][low[j] : high[j]]
                low[j], high[j] = low[j] + np.searchsorted(inside, self.low[k, j], "left"), low[j] + np.searchsorted(inside, self.high[k, j], "right")
        count = high - low
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return order[rows], np.repeat(self.pieces, count)


class Encoder:
    """Encodes batches of texts; remembers words between batches, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.lengths = np.array([len(t) for t in vocabulary.texts])
        self.index = Index(vocabulary, np.zeros(0, np.uint32))
        size = 1 << 20
        self.slots, self.answers = np.full(size, -1, np.int64), np.zeros(size, bool)
        # a line end without a piece ends a word as well, and so does the character that stands between words in the index
        end = "\0" if "\n" in vocabulary.rank else "\0\n"
        self.units = re.compile(f"{SPACE}?[^{SPACE}{end}]+|{SPACE}+(?={SPACE}[^{SPACE}{end}])|{SPACE}+|[{end}]").findall

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` with a table of recent answers."""
        key = a << 20 | b
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & len(self.slots) - 1
        new = np.flatnonzero(self.slots[slot] != key)
        result = self.answers[slot]
        if len(new):
            unique, back = np.unique(key[new], return_inverse=True)
            answer = self.vocabulary.may_follow(unique >> 20, unique & (1 << 20) - 1)
            result[new] = answer[back]
            self.slots[slot[new]], self.answers[slot[new]] = key[new], answer[back]
        return result

    def relax(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces (model ids) of the words, one word after the other, and how many each has."""
        lengths = self.lengths
        codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        seen = np.unique(codes[codes != 0])
        if not np.isin(seen, self.index.alphabet).all():
            self.index = Index(self.vocabulary, np.union1d(seen, self.index.alphabet))
        position, piece = self.index.edges(codes)
        ends = np.flatnonzero(codes == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = np.full(len(codes) + 1, NONE, np.int64)
        last[starts] = START
        # a character without a piece stands alone: what follows it starts anew
        covered = codes == 0
        covered[position[lengths[piece] == 1]] = True
        last[np.flatnonzero(~covered) + 1] = START
        offset = position - np.repeat(starts, ends - starts + 1)[position]
        order = np.argsort(np.minimum(offset, 0xFFFF).astype(np.uint16), kind="stable")
        position, piece, offset = position[order], piece[order], offset[order]
        cut = np.searchsorted(offset, np.arange(int(min(offset.max(initial=0), LONG)) + 2))
        for i, j in zip(cut, cut[1:]):
            self._step(position[i:j], piece[i:j], last)
        far = np.flatnonzero(offset > LONG)
        if len(far):
            far = far[np.argsort(offset[far], kind="stable")]
            bounds = np.flatnonzero(np.concatenate(([True], offset[far][1:] != offset[far][:-1], [True])))
            for i, j in zip(bounds, bounds[1:]):
                self._step(position[far[i:j]], piece[far[i:j]], last)
        return self._back(starts, ends, codes, last)

    def _step(self, position: np.ndarray, piece: np.ndarray, last: np.ndarray) -> None:
        before = last[position]
        ok = before == START
        rest = np.flatnonzero(before >= 0)
        if len(rest):
            ok[rest] = self.follows(before[rest], piece[rest])
        position, piece = position[ok], piece[ok]
        last[position + self.lengths[piece]] = piece

    def _back(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the ends of all words back to their starts, a piece at a time."""
        v, at, word = self.vocabulary, ends.copy(), np.flatnonzero(ends > starts)
        words, found = [], []
        while len(word):
            piece = last[at[word]]
            alone = piece < 0
            words.append(word)
            # a character that stands alone is kept as a negative number for now
            found.append(np.where(alone, -codes[at[word] - 1].astype(np.int64) - 1, v.ids[piece]))
            at[word] -= np.where(alone, 1, self.lengths[piece])
            word = word[at[word] > starts[word]]
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        row, ids = np.concatenate(words[::-1]), np.concatenate(found[::-1])
        order = np.argsort(row, kind="stable")
        row, ids = row[order], ids[order]
        if (ids < 0).any():
            size = np.ones(len(ids), np.int64)
            bytes_of = {c: v.without_piece(chr(-c - 1)) for c in np.unique(ids[ids < 0]).tolist()}
            for c, b in bytes_of.items():
                size[ids == c] = len(b)
            first = np.cumsum(size) - size
            row, wide = np.repeat(row, size), np.repeat(ids, size)
            for c, b in bytes_of.items():
                for k, i in enumerate(b):
                    wide[first[ids == c] + k] = i
            ids = wide
        return ids.astype(np.int32), np.bincount(row, minlength=len(starts))

    def learn(self, words: set[str]) -> None:
        """Encode unseen words in parts of bounded size."""
        part, size = [], 0
        for word in words:
            if word[0] == SPACE == word[-1] or word == "\0":
                self._add(word, self.spaces(len(word)) if word[0] == SPACE else self.vocabulary.without_piece(word))
                continue
            part.append(word)
            size += len(word)
            if size > INDEXED:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _add(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(self.known)
        self.ids = np.append(self.ids, np.array(ids, np.int32))
        self.first = np.append(self.first, len(self.ids))

    def _learn(self, words: list[str]) -> None:
        ids, count = self.relax(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids = np.concatenate((self.ids, ids))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(count)))

    def _forget(self, words: set[str]) -> None:
        """Keep only those of the known words that are in ``words``."""
        kept = [w for w in words if w in self.known]
        ids, count = self._gather(self._at(kept))
        self.known, self.ids = dict(zip(kept, range(len(kept)))), ids
        self.first = np.concatenate(([0], np.cumsum(count)))

    def _at(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        begin, count = self.first[at], self.first[at + 1] - self.first[at]
        return self.ids[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count

    def spaces(self, left: int) -> list[int]:
        """A run of spaces is merged from the left, each piece as long as there is one."""
        out = []
        while left:
            n = next((n for n in range(min(left, max(self.vocabulary.runs, default=1)), 0, -1) if n in self.vocabulary.runs), 1)
            out.append(self.vocabulary.runs.get(n, self.vocabulary.unknown))
            left -= n
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The model ids of each text."""
        out, part, size = [], [], 0
        for text in texts:
            pieces = self._cut((SPACE + text).replace(" ", SPACE)) if text else [""]
            for i, piece in enumerate(pieces):
                part.append((i == 0, piece))
                size += len(piece)
                if size > TAKEN:
                    self._encode(part, out)
                    part, size = [], 0
        self._encode(part, out)
        return [rows[0] if len(rows) == 1 else np.concatenate(rows) for rows in out]

    def _cut(self, text: str) -> list[str]:
        """A very long text in parts that begin with a word."""
        parts, at = [], 0
        while len(text) - at > TAKEN and (m := self._next_word.search(text, at + TAKEN)):
            parts.append(text[at : m.start() + 1])
            at = m.start() + 1
        return [*parts, text[at:]]

    _next_word = re.compile(f"[^{SPACE}\n]{SPACE}[^{SPACE}\n]")

    def _encode(self, part: list[tuple[bool, str]], out: list[list[np.ndarray]]) -> None:
        rows = [self.units(text) for _, text in part]
        units = list(chain.from_iterable(rows))
        at = np.fromiter(map(self.known.get, units, repeat(NONE)), np.int64, len(units))
        if (at == NONE).any():
            new = [units[i] for i in np.flatnonzero(at == NONE).tolist()]
            words = set(new)
            if len(self.known) + len(words) > REMEMBERED:
                self._forget(set(units))
                self.learn(words)
                at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            else:
                self.learn(words)
                at[at == NONE] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ids, count = self._gather(at)
        ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum([0] + [len(r) for r in rows])].tolist()
        for k, (first, text) in enumerate(part):
            if SPACE * 2 in text:
                own, _ = self._gather(self._at(self._spaces(rows[k])))
            else:
                own = ids[ends[k] : ends[k + 1]]
            if first:
                out.append([own])
            else:
                out[-1].append(own)

    def _spaces(self, units: list[str]) -> list[str]:
        """A word's own space that stays a piece by itself is merged with the spaces before it."""
        lone, out = self.vocabulary.runs.get(1), []
        for unit in units:
            if out and unit[0] == SPACE and len(unit) > 1 and set(out[-1]) == {SPACE} and self.ids[self.first[self.known[unit]]] == lone:
                out[-1:] = [out[-1] + SPACE, unit[1:]]
            else:
                out.append(unit)
        self.learn(set(out) - self.known.keys())
        return out


class Decoder:
    """Texts of rows of ids; control pieces have none."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.output = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else {NORMAL: p.piece.replace(SPACE, " "), UNKNOWN: " ⁇ "}.get(p.type, "").encode() for p in proto.pieces
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids, without the space put in front."""
        return b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def decoder(model: bytes) -> Decoder:
    return Decoder(model)


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """A worker's encoder of a vocabulary."""
    return Encoder(Vocabulary(model))


def encode(documents: DataFrame, name: str = "pieces", text: str = "text", model: str = MODEL) -> DataFrame:
    """``documents`` with the model ids of the whole text in an array ``name``."""
    ship(documents.sparkSession)
    vocabulary = Path(model).read_bytes()

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(vocabulary).encode(list(texts)), dtype=object)

    return documents.withColumn(name, F.pandas_udf(run, "array<int>")(document_text(text)))


def decode(pieces: DataFrame, name: str = "decoded", column: str = "pieces", model: str = MODEL) -> DataFrame:
    """``pieces`` with the text of the ids of ``column`` in ``name``; NULL is as empty."""
    ship(pieces.sparkSession)
    vocabulary = Path(model).read_bytes()

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([decoder(vocabulary).decode(np.asarray(r)) for r in rows], dtype=object)

    return pieces.withColumn(name, F.pandas_udf(run, "string")(F.coalesce(F.col(column), F.array().cast("array<int>"))))


def round_trip(documents: DataFrame, name: str = "pieces", decoded: str = "decoded", text: str = "text", model: str = MODEL) -> DataFrame:
    """``encode`` and then ``decode`` in one worker: the ids in ``name`` and their text in ``decoded``."""
    ship(documents.sparkSession)
    vocabulary = Path(model).read_bytes()
    both = fresh(documents, "both")

    def run(texts: pd.Series) -> pd.DataFrame:
        ids = encoder(vocabulary).encode(list(texts))
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "back": [decoder(vocabulary).decode(i) for i in ids]})

    out = documents.withColumn(both, F.pandas_udf(run, "struct<ids: array<int>, back: string>")(document_text(text)))
    return out.withColumn(name, F.col(f"{both}.ids")).withColumn(decoded, F.col(f"{both}.back")).drop(both)
