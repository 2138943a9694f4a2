"""Periodic runs of words by recompression.

A batch of texts is compressed bottom-up into a run-length grammar: block compression replaces each stretch of one repeated
symbol, pair compression replaces each pair of a left and a right symbol, in turn, until every text is one symbol. How a symbol
is parsed depends only on itself and its neighbours, so equal stretches get equal symbols but for their edges; the longest common
extension of two positions is found by climbing the levels while the symbols agree and coming down where they first differ, a
constant number of steps for each level in either direction.

A run of period ``p`` and of at least ``4 p`` words holds one multiple ``i`` of ``3 p`` so that ``i`` and ``i + p`` are both
inside. Those pairs, for every ``p``, are the harmonic grid: about ``n log n / 3`` for ``n`` words. Most differ in their first
word; the two extensions of the others give the run exactly.

A run is a stretch of at least ``max(6, 4 p)`` words with smallest period ``p`` that no neighbouring word extends. Words are
``[^\\x20\\x09-\\x0D]+`` and numbered from 0.

Defined results: a NULL text is an empty one and has no runs; repeated rows and NULL ids keep their rows; an empty table gives an
empty result; only the id and the results are returned, so other columns may have any names. A text is one unit of work: a
task holds the words of one text, or of several small ones, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm.common import document_text
from sparcel.session import ship

#: Words compressed together; a longer text is compressed alone.
WORDS = 1 << 16
#: Grid pairs compared at a time.
PAIRS = 1 << 17
LEAST, TIMES = 6, 4
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


@dataclass
class Level:
    """Symbols of one level; for each its place one level up, and the first and last place below each symbol of the level above."""

    symbols: np.ndarray
    blocks: bool = False
    up: np.ndarray | None = None
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


def _coin(symbols: np.ndarray, seed: int) -> np.ndarray:
    """A side for every symbol, tossed anew for each seed, so that two symbols that fall on one side soon part."""
    x = symbols.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x >> np.uint64(63) == 1


def compress(symbols: np.ndarray, fences: int) -> list[Level]:
    """The levels of the grammar of ``symbols``. Symbols below ``fences`` occur once each and stay alone."""
    levels, names, seed = [Level(symbols)], int(symbols.max()) + 1, 0
    while True:
        last, level = levels[-1], levels[-1].symbols
        inner = (level[:-1] >= fences) & (level[1:] >= fences)
        if not inner.any():
            return levels
        if len(levels) % 2:
            last.blocks = True
            joined = level[:-1] == level[1:]
        else:
            seed += 1
            left = _coin(level, seed)
            forth, back = inner & left[:-1] & ~left[1:], inner & ~left[:-1] & left[1:]
            joined = forth if forth.sum() >= back.sum() else back
        starts = np.flatnonzero(np.concatenate(([True], ~joined)))
        sizes = np.diff(np.concatenate((starts, [len(level)])))
        made = level[starts].copy()
        many = np.flatnonzero(sizes > 1)
        other = sizes[many] if last.blocks else level[starts[many] + 1]
        _, place = np.unique(made[many] * (int(other.max(initial=0)) + 1) + other, return_inverse=True)
        made[many] = names + place
        names += int(place.max(initial=-1)) + 1
        last.up = (np.cumsum(np.concatenate(([True], ~joined))) - 1).astype(np.int32)
        last.lo, last.hi = starts.astype(np.int32), (starts + sizes - 1).astype(np.int32)
        levels.append(Level(made))


def extensions(levels: Sequence[Level], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """For pairs of different places, how many words agree from there on: forwards (``step`` 1) or backwards (-1)."""
    x, y = i.astype(np.int64), j.astype(np.int64)
    stop = np.zeros(len(x), np.int32)
    active = np.arange(len(x))
    for k, level in enumerate(levels):
        a, b = x[active], y[active]
        same = level.symbols[a] == level.symbols[b]
        stop[active[~same]] = k
        active, a, b = active[same], a[same], b[same]
        if not len(active):
            break
        edge = level.lo if step > 0 else level.hi
        inside = (edge[level.up[a]] != a) | (edge[level.up[b]] != b)
        if level.blocks:
            end = level.hi if step > 0 else level.lo
            left_a, left_b = np.abs(end[level.up[a]] - a) + 1, np.abs(end[level.up[b]] - b) + 1
            inside |= left_a != left_b
            move = np.where(inside, np.minimum(left_a, left_b), 0)
        else:
            move = inside.astype(np.int64)
        a, b = a + step * move, b + step * move
        x[active], y[active] = a, b
        on = ~inside | (level.symbols[a] == level.symbols[b])
        stop[active[~on]] = k
        active = active[on]
        x[active], y[active] = level.up[a[on]], level.up[b[on]]
    for k in range(int(stop.max(initial=0)) - 1, -1, -1):
        level, down = levels[k], np.flatnonzero(stop > k)
        edge = level.lo if step > 0 else level.hi
        above, beside = x[down], y[down]
        a, b = edge[above].astype(np.int64), edge[beside].astype(np.int64)
        same = level.symbols[a] == level.symbols[b]
        if level.blocks:
            move = np.minimum(level.hi[above] - level.lo[above], level.hi[beside] - level.lo[beside]) + 1
        else:
            move = np.ones(len(a), np.int64)
        move = np.where(same, move, 0)
        x[down], y[down] = a + step * move, b + step * move
    return np.abs(x - i)


def _grid(sizes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, place, period)`` of the harmonic grid of texts with ``sizes`` words that begin at ``first``, in parts."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    counts = (sizes[text] - 1 - period) // ((TIMES - 1) * period) + 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n, t, p = counts[at:stop], text[at:stop], period[at:stop]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        t, p = np.repeat(t, n), np.repeat(p, n)
        yield t, first[t] + step * (TIMES - 1) * p, p
        at = stop


def runs_of(texts: Sequence[Sequence[bytes]]) -> list[np.ndarray]:
    """The runs of each text, a list of words, as rows of start, length and period by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    fences, names = len(texts) + 1, {}
    symbols = np.empty(int(sizes.sum()) + fences, np.int64)
    first = np.cumsum(sizes + 1) - sizes
    symbols[0] = 0
    for k, words in enumerate(texts):
        symbols[first[k] : first[k] + len(words)] = [names.setdefault(w, len(names) + fences) for w in words]
        symbols[first[k] + len(words)] = k + 1
    levels, found = compress(symbols, fences), []
    for text, i, p in _grid(sizes, first):
        hit = np.flatnonzero(symbols[i] == symbols[i + p])
        text, i, p = text[hit], i[hit], p[hit]
        start = i - extensions(levels, i - 1, i - 1 + p, -1)
        end = i + p + extensions(levels, i, i + p, 1)
        long = end - start >= np.maximum(LEAST, TIMES * p)
        found.append(np.stack((text[long], start[long] - first[text[long]], end[long] - start[long], p[long])))
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)  # of one stretch the smallest period
    rows = rows[:, new]
    rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    cuts = np.searchsorted(rows[0], np.arange(1, len(texts)))
    return [r.T for r in np.split(rows[1:], cuts, axis=1)]


def collapse(words: Sequence[bytes], runs: np.ndarray) -> bytes:
    """The words outside every run's repetitions, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def _parts(texts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part, held = [], 0
    for words in texts:
        if part and held + len(words) > WORDS:
            yield part
            part, held = [], 0
        part.append(words)
        held += len(words)
    if part:
        yield part


def find_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """For each row its id, its ``runs`` by start, then period, and its ``collapsed`` text without their repetitions.

    ``prepare(id, words)`` may give other words to look at in place of a text's own.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(doc_id).alias("doc_id"), document_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def words_of(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
        for k, t in zip(batch.column(0), batch.column(1)):
            words = t.as_py().encode().split()
            yield prepare(k.as_py(), words) if prepare else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _parts(words_of(batch)):
                found = runs_of(part)
                ends = np.cumsum([0] + [len(r) for r in found])
                flat = np.concatenate(found)
                struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                texts = pa.array([collapse(w, r).decode() for w, r in zip(part, found)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), texts],
                    names=["doc_id", "runs", "collapsed"],
                )
                at += len(part)

    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
