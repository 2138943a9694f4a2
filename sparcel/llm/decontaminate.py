"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with white space runs as one space. Each benchmark item is cut into windows of ``WINDOW``
characters (stride of half a window, the last one flush with the end; a shorter item is one window), so a leaked part of an item
is found too. A window of m characters with at most k = floor(``EDITS`` m) edits shares at least m + 1 - q (k + 1) q-grams with
the text, all on diagonals (text position minus window position) at most k apart. Shared q-grams are counted in overlapping
bands of diagonals, so any k + 1 neighbouring diagonals lie in one band; a band that meets the bound is verified by an alignment
inside it. k is lowered for short windows until the bound is at least one; an item of fewer than q characters must stand in the
text as it is, between spaces or ends.

Defined results: NULL and empty texts contain nothing; NULL and blank items are contained in nothing; repeated rows are judged
alike; items of equal text are all reported; an empty table on either side finds nothing; other columns are never touched. A
benchmark of at most ``MOST`` characters is held by every task; a larger one is taken in blocks of that size, a pass over the
texts for each, and what the blocks found is joined by the digest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm.common import document_text, free, fresh, written
from sparcel.session import ship

Q, WINDOW, EDITS = 8, 128, 0.1
#: Characters of a benchmark that tasks hold at a time, and of a text that are looked at together.
MOST, PIECE = 2_000_000, 1 << 18
#: Diagonals from one band's start to the next's.
STEP = 16
BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram (q a power of two): hashes of neighbours are joined until they are q long."""
    hashes, length, factor = codes.astype(np.uint64), 1, MIX
    while length < q:
        hashes = hashes[:-length] * factor + hashes[length:] if len(hashes) > length else hashes[:0]
        factor, length = np.uint64(int(factor) ** 2 & (1 << 64) - 1), length * 2
    return hashes * MIX


@dataclass
class Index:
    """Windows of the benchmark and where their q-grams are."""

    items: list[int]  # of each window
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # of each key's occurrences
    window: np.ndarray  # of each occurrence
    place: np.ndarray
    seen: np.ndarray  # which leading bits any key has
    short: list[tuple[int, str]]


def windows(item: int, text: str | None, window: int = WINDOW) -> Iterator[tuple[int, str]]:
    """An item's windows; an item shorter than a q-gram is given whole."""
    text = normal(text)
    last = max(0, len(text) - window)
    for at in sorted({*range(0, last, max(1, window // 2)), last}) if text else ():
        yield item, text[at : at + window]


def build(items: list[tuple[int, str | None]], edits: float = EDITS, window: int = WINDOW) -> Index:
    return build_windows([w for item, text in items for w in windows(item, text, window)], edits)


def build_windows(parts: list[tuple[int, str]], edits: float = EDITS) -> Index:
    owners, codes, short = [], [], []
    for item, part in parts:
        if len(part) < Q:
            short.append((item, part))
        else:
            owners.append(item)
            codes.append(points(part))
    sizes = np.array([len(c) for c in codes], np.int64)
    most = np.minimum((edits * sizes).astype(np.int64), sizes // Q - 1)
    grams = [qgrams(c) for c in codes]
    keys = np.concatenate([np.zeros(0, np.uint64), *grams])
    order = np.argsort(keys, kind="stable")
    unique, first = np.unique(keys[order], return_index=True)
    seen = np.zeros(1 << BITS, bool)
    seen[(unique >> np.uint64(64 - BITS)).astype(np.int64)] = True
    owner = np.repeat(np.arange(len(codes)), [len(g) for g in grams])[order]
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])[order]
    return Index(owners, codes, most, sizes + 1 - Q * (most + 1), unique, np.append(first, len(keys)), owner, place, seen, short)


def bands(codes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, first diagonal) of the bands with enough shared q-grams."""
    none = np.zeros(0, np.int64)
    hashes = qgrams(codes)
    at = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(at) or not len(index.keys):
        return none, none
    slot = np.searchsorted(index.keys, hashes[at])
    slot[slot == len(index.keys)] = 0
    real = index.keys[slot] == hashes[at]
    at, slot = at[real], slot[real]
    count = index.first[slot + 1] - index.first[slot]
    row = np.repeat(index.first[slot] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    window = index.window[row].astype(np.int64)
    diagonal = np.repeat(at, count) - index.place[row] + WINDOW_ROOM
    band = diagonal // STEP
    # the overlap of a band with the one before it
    again = diagonal % STEP < index.edits[window]
    key = np.concatenate((window, window[again])) << 40 | np.concatenate((band, band[again] - 1))
    key, n = np.unique(key, return_counts=True)
    key = key[n >= index.bound[key >> 40]]
    return key >> 40, (key & (1 << 40) - 1) * STEP - WINDOW_ROOM


#: Keeps diagonals positive; a window is never longer.
WINDOW_ROOM = 1 << 16


def align(codes: np.ndarray, window: np.ndarray, start: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each window to a part of the text whose path stays inside its band, and that part's end.

    All bands are aligned together, a row of the window at a time; cell c of a row stands on diagonal ``start + c``.
    """
    width = STEP + int(index.edits[window].max())
    sizes = np.array([len(index.codes[w]) for w in window])
    pattern = np.full((len(window), int(sizes.max())), 0xFFFFFFFE, np.uint32)
    for i, w in enumerate(window):
        pattern[i, : sizes[i]] = index.codes[w]
    cells = np.arange(width)
    cost = np.zeros((len(window), width), np.int64)
    best, end = np.full(len(window), 1 << 30), np.zeros(len(window), np.int64)
    for i in range(pattern.shape[1]):
        place = start[:, None] + i + cells[None, :]
        inside = (place >= 0) & (place < len(codes))
        other = (pattern[:, i : i + 1] != codes[np.clip(place, 0, len(codes) - 1)]) | ~inside
        skip = np.concatenate((cost[:, 1:] + 1, np.full((len(window), 1), 1 << 30)), axis=1)
        cost = np.minimum(cost + other, skip)
        cost = np.minimum.accumulate(cost - cells, axis=1) + cells
        done = sizes == i + 1
        if done.any():
            cell = cost[done].argmin(axis=1)
            best[done] = cost[done][np.arange(len(cell)), cell]
            end[done] = np.minimum(start[done] + i + 1 + cell, len(codes))
    return best, end


def matches(texts: list[str | None], index: Index) -> list[dict[int, tuple[int, int]]]:
    """For each text the items found in it: least distance of a window, and where it ends in the normalised text."""
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    longest = max(map(len, index.codes), default=0)
    # no window reaches over the gap between two texts within its edits
    gap = "\0" * (int(index.edits.max(initial=0)) + 1)
    pieces, size = [], 0

    def look():
        if not pieces:
            return
        starts = np.cumsum([0] + [len(p) + len(gap) for _, _, p in pieces])
        codes = points(gap.join(p for _, _, p in pieces))
        window, diagonal = bands(codes, index)
        for at in range(0, len(window), 1024):
            w, d = window[at : at + 1024], diagonal[at : at + 1024]
            cost, end = align(codes, w, d, index)
            for j in np.flatnonzero(cost <= index.edits[w]):
                k = int(np.searchsorted(starts, max(0, end[j] - 1), "right")) - 1
                doc, offset, _ = pieces[k]
                item, hit = index.items[w[j]], (int(cost[j]), offset + int(end[j] - starts[k]))
                found[doc][item] = min(hit, found[doc].get(item, hit))
        pieces.clear()

    for doc, text in enumerate(texts):
        text = normal(text)
        for item, short in index.short:
            if (at := f" {text} ".find(f" {short} ")) >= 0:
                found[doc][item] = (0, at + len(short))
        for at in range(0, max(1, len(text)), PIECE):
            piece = text[max(0, at - 2 * longest) : at + PIECE]
            pieces.append((doc, max(0, at - 2 * longest), piece))
            size += len(piece)
            if size >= PIECE:
                look()
                size = 0
    look()
    return found


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items with id and text, and their characters."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    return rows, rows.agg(F.sum(F.length("text"))).first()[0] or 0


def read_benchmark(benchmark: DataFrame) -> Index:
    """The index of a benchmark of at most ``MOST`` characters."""
    rows, size = _items(benchmark)
    if size > MOST:
        raise ValueError(f"the benchmark has {size} characters; tasks hold {MOST} at most")
    return build([(r["item_id"], r["text"]) for r in rows.collect()])


def read_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of at most ``MOST`` characters (a window at least) that hold all windows of a benchmark; the driver holds one at a time."""
    parts, size = [], 0
    for row in _items(benchmark)[0].toLocalIterator():
        for k, (item, part) in enumerate(windows(row["item_id"], row["text"])):
            new = len(part) if k == 0 else min(len(part), WINDOW // 2)
            if parts and size + new > MOST:
                yield build_windows(parts)
                # a block begins with a whole window
                parts, size, new = [], 0, len(part)
            parts.append((item, part))
            size += new
    yield build_windows(parts)


LEAKS = "array<struct<item_id: bigint, distance: int, end: bigint>>"


def _leaks(index: Index, text: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "distance": d, "end": e} for i, (d, e) in sorted(m.items())] for m in matches(list(texts), index)])

    return F.pandas_udf(run, LEAKS)(document_text(text))


def find_contamination(documents: DataFrame, benchmark: DataFrame, name: str = "leaks", text: str = "text") -> DataFrame:
    """``documents`` with an array ``name`` of the items found: ``item_id``, ``distance``, ``end``, by item.

    A table that has a column ``name`` already is an error.
    """
    free(documents, name)
    ship(documents.sparkSession)
    if _items(benchmark)[1] <= MOST:
        return documents.withColumn(name, _leaks(read_benchmark(benchmark), text))
    digest = F.unhex(F.sha2(document_text(text).cast("binary"), 256))
    key, of, held = (fresh(documents, x) for x in ("leak_digest", "leak_of", "leak_found"))
    found = None
    for index in read_blocks(benchmark):
        hits = documents.select(digest.alias(of), _leaks(index, text).alias("hits")).where(F.size("hits") > 0)
        hits = written(hits.dropDuplicates([of]).select(of, F.explode("hits").alias("hit")).select(of, "hit.*"), "leaks")
        found = hits if found is None else found.unionAll(hits)
    # an item may have windows in two blocks
    found = found.groupBy(of, "item_id").agg(F.min(F.struct("distance", "end")).alias("least"))
    found = found.groupBy(of).agg(F.array_sort(F.collect_list(F.struct("item_id", "least.distance", "least.end"))).cast(LEAKS).alias(held))
    rows = documents.withColumn(key, digest).join(found, F.col(key) == F.col(of), "left")
    return rows.withColumn(name, F.coalesce(held, F.array().cast(LEAKS))).drop(key, of, held)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` in which no item is found."""
    mark = fresh(documents, "leaks")
    return find_contamination(documents, benchmark, mark, text).where(F.size(mark) == 0).drop(mark)
