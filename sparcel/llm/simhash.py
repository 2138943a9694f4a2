"""Near-duplicates by SimHash fingerprints, compared in vertical bit planes.

A fingerprint has 64 bits; two documents are linked if their fingerprints differ in at most ``radius`` bits. Fingerprints that
differ in so few bits agree on at least one of ``radius + 1`` bit ranges, so each range with its value is a bucket and only
fingerprints of one bucket are compared. Inside a bucket the fingerprints stand in 64-lane words, one word for each bit plane;
a query's bit is xored with a whole word, and the differences of 64 lanes at a time are added up in carry-save counters. Words
in which every lane has exceeded the radius are abandoned as the planes go by.

Defined results: a NULL text is an empty one; a text without words has fingerprint zero and is linked like any other; equal
fingerprints are one node; a NULL id has a fingerprint but never names a component unless no other id is in it; repeated rows
keep their rows; an empty table gives an empty result; other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm.common import document_text, fresh
from sparcel.llm.components import connected_components
from sparcel.session import ship, written

BITS = 64
#: Shingles hashed at a time in one document, so that a very long one needs no more memory.
SLICE = 1 << 16
#: Rows of a bucket compared in one piece; larger buckets are dealt out in pairs of pieces.
PIECE = 4096
#: Fingerprints gathered before a comparison, and (query, word) pairs compared at a time.
ROWS, PAIRS = 1 << 15, 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text, as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, counts = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    for at in range(0, total, SLICE):
        part = words[at : at + SLICE + shingle - 1] if total > 1 else words
        shingles = zip(*(part[i:] for i in range(shingle))) if total > 1 else [part]
        digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, shingles), repeat(42)))  # highest bit first
        counts += np.add.reduce(np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS), axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def with_fingerprint(documents: DataFrame, name: str, shingle: int = 4, text: str = "text") -> DataFrame:
    """``documents`` with the fingerprint of the whole text in a new column ``name``."""
    ship(documents.sparkSession)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return documents.withColumn(name, F.pandas_udf(run, "bigint")(document_text(text)))


def _buckets(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``radius + 1`` ranges that cover the 64 bits."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _planes(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of groups whose lanes begin at a word of their own: (64, words), each word's lanes, first word of each group."""
    words = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(words)))
    lanes = np.full(int(first[-1]) * 64, -1, np.int64)
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    lanes[np.repeat(first[:-1] * 64 - starts, sizes) + rows] = rows
    values = np.where(lanes >= 0, prints[lanes], np.uint64(0))
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lanes x 64
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # 64 x words
    return planes, lanes, first


def near_lanes(planes: np.ndarray, query_bits: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (query, word) pairs with a lane inside the radius, and a mask of those lanes.

    ``query_bits`` has all-ones or zero for each query and plane. The counters c[0], c[1], ... hold the bits of 64 running
    distances; a carry out of the last marks a lane that is beyond any radius they can hold.
    """
    depth = max(1, radius.bit_length())
    alive = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    beyond = np.zeros(len(query), np.uint64)
    for plane in range(BITS):
        carry = planes[plane][word[alive]] ^ query_bits[plane][query[alive]]
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        beyond |= carry
        if plane % 8 == 7:
            over, equal = beyond.copy(), ~np.uint64(0)
            for k in range(depth - 1, -1, -1):  # counter > radius, from the highest bit
                if radius >> k & 1:
                    equal = equal & counters[k]
                else:
                    over |= equal & counters[k]
                    equal = equal & ~counters[k]
            keep = over != ~np.uint64(0)
            if not keep.all():
                alive, beyond = alive[keep], beyond[keep]
                counters = [c[keep] for c in counters]
                over = over[keep]
            if not len(alive):
                break
    else:
        return query[alive], word[alive], ~over
    return query[:0], word[:0], np.zeros(0, np.uint64)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def links_in_groups(prints: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group of rows; rows of a group stand together.

    ``side`` 2: the row is a query and a lane; 0: a query only; 1: a lane only (a pair of pieces of a large bucket).
    """
    order = np.lexsort((side != 0, group))  # the lanes of a group stand behind its pure queries
    prints, group, side = prints[order], group[order], side[order]
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((cut, [len(group)])))
    pure = np.add.reduceat((side == 0).astype(np.int64), cut)
    if (sizes == pure).all():
        return prints[:0], prints[:0]
    planes, lanes, first = _planes(prints, cut + pure, sizes - pure)
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64) * ~np.uint64(0)
    place = np.repeat(np.arange(len(cut)), sizes)
    queries = np.flatnonzero(side != 1)
    words = (first[1:] - first[:-1])[place[queries]]
    found_a, found_b = [], []
    ends = np.cumsum(words)
    at = 0
    while at < len(queries):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        part, count = queries[at:stop], words[at:stop]
        q = np.repeat(part, count)
        w = np.repeat(first[place[part]], count) + (np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count))
        q, w, near = near_lanes(planes, bits, q, w, radius)
        if len(q):
            hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            a, b = q[row], lanes[w[row] * 64 + lane]
            real = (b >= 0) & (a != b)
            a, b = _spanning(a[real], b[real], len(prints)) if real.any() else (a[:0], b[:0])
            found_a.append(a)
            found_b.append(b)
        at = stop
    if not found_a:
        return prints[:0], prints[:0]
    a, b = _spanning(np.concatenate(found_a), np.concatenate(found_b), len(prints))
    return prints[a], prints[b]


def near_links(prints: DataFrame, fp: str = "fp", radius: int = 4, piece: int = PIECE) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that differ in at most ``radius`` bits.

    The links of a bucket are given as a spanning forest: no all-pairs output, and every component whole. A bucket of more than
    ``piece`` rows is dealt out as pairs of pieces, so no task ever holds more than two of them at a time.
    """
    ship(prints.sparkSession)
    value = F.col(fp)
    ranges = F.array(*[
        F.lit(i << 58).bitwiseOR(F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << width) - 1))) if radius else value
        for i, (lo, width) in enumerate(_buckets(radius))
    ])
    rows = prints.select(value.alias("fp"), F.explode(ranges).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "bucket").withColumn("s", F.ceil(F.col("n") / piece).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.select(
        "bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("r"), "fp",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
    )
    rows = rows.repartition("bucket", "p", "r").sortWithinPartitions("bucket", "p", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def links(part):
            if not len(part[0]):
                return
            new = np.concatenate(([False], (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]) | (part[2][1:] != part[2][:-1])))
            a, b = links_in_groups(part[3].view(np.uint64), np.cumsum(new), part[4], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, batch.columns)]
            if len(held[0]) < ROWS:
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            yield from links([h[:cut] for h in held])
            held = [h[cut:] for h in held]
        yield from links(held)

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_components(prints: DataFrame, fp: str = "fp", radius: int = 4) -> DataFrame:
    """``(fp, root)`` for every fingerprint with a near one of another value."""
    distinct = written(prints.select(F.col(fp).alias("fp")).distinct(), "fingerprints")
    return connected_components(near_links(distinct, "fp", radius)).select(F.col("node").alias("fp"), "root")


def simhash_groups(documents: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``fingerprint`` (hex) and ``component_id``, the smallest id that can be reached."""
    prints = with_fingerprint(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "fp", shingle).drop("text")
    prints = written(prints, "prints")
    grouped = _rooted(prints, near_components(prints, "fp", radius))
    # written, so that the join below can split a large group
    names = written(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    return grouped.join(names, "root").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def _rooted(prints: DataFrame, components: DataFrame) -> DataFrame:
    return prints.join(components, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(documents: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each group: the one with the smallest id (NULL last), one of equal rows.

    Only ids and fingerprints are gathered to find out which rows stay; the texts move once, to leave out the others.
    """
    mark, row = fresh(documents, "fp"), fresh(documents, "row")
    marked = with_fingerprint(documents, mark, shingle, text)
    # a hash leaves NULLs out, so each column says whether it is one
    rows = F.xxhash64(*[x for c in documents.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])
    prints = written(marked.select(F.col(doc_id).alias("id"), rows.alias("row"), F.col(mark).alias("fp")), "prints")
    grouped = _rooted(prints, near_components(prints, "fp", radius))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stays = grouped.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.id").alias("id"), F.col("best.row").alias("row"))
    times = prints.groupBy("id", "row").agg(F.count("*").alias("times"))
    both = stays.alias("s").join(times.alias("t"), F.expr("s.row = t.row AND s.id <=> t.id"))
    left = written(both.select(F.col("t.id").alias("_id"), F.col("t.row").alias("_row"), "times"), "stays")
    named = documents.withColumn(row, rows)

    def kept(some: DataFrame) -> DataFrame:
        same = named[doc_id].eqNullSafe(some["_id"]) & (named[row] == some["_row"])
        return named.join(some, same, "left_semi").drop(row)

    # rows that are there several times are few ids, whatever their number of rows
    return kept(left.where("times = 1")).union(kept(left.where("times > 1")).distinct())
