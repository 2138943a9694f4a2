"""Near-duplicate vectors through a product-quantised inverted index.

Unit vectors are put in the list of the nearest of ``lists`` centroids, and the rest of each is cut into ``SUBSPACES`` parts, each
coded by the nearest of 256 codewords; the code's error is kept beside it. A vector asks its own list and every list whose
centroid is nearer than the bisector test allows: a vector within the chord ``r`` lies in list ``j`` only if it crosses the plane
between both centroids, ``(d_j^2 - d_i^2) / (2 |c_i - c_j|) <= r``. In ``n`` dimensions a step of length ``r`` in any direction goes
about ``r / sqrt(n)`` that way, so ``SPREAD`` times that is enough; ``spread = sqrt(n)`` is the exact bound, with every link found.
Inside a list, distances to codes are sums of looked-up table entries (asymmetric: the asking vector is not coded). By the triangle
inequality a linked vector's code is no farther than ``r`` plus its kept error, so looking up loses nothing; what passes is
compared by exact cosine.

Centroids and codewords are fitted on at most ``SAMPLE`` distinct vectors, chosen by a hash; every vector is indexed. A list of more
than ``PIECE`` vectors is dealt out in pieces and those who ask it in streams of ``ASKERS``, so no task holds more than a piece and a
batch, and no pair leaves a task: only numbers of links and a spanning forest do. Equal vectors are one with a number of copies.

Defined results: a vector that is NULL, zero, empty or holds NULL or non-finite components links with nothing; vectors of different
lengths never link; equal rows are different vectors that link; a NULL id keeps its row and names a component only if there is no
other id in it; an empty table gives an empty result; only the named columns are read and returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm.components import connected_components
from sparcel.session import ship, written

SUBSPACES, CODES = 8, 256
SAMPLE, MOST_LISTS, SPREAD = 1 << 15, 2048, 3.0
PIECE, ASKERS = 1 << 12, 1 << 16
#: Distances looked up at a time.
CELLS = 1 << 20
#: What rounding may add to a chord.
SLACK = 1e-4


@dataclass
class Index:
    """Centroids (lists x dim) and codewords (subspaces x codes x dim / subspaces) of unit vectors with ``dim`` components."""

    centroids: np.ndarray
    codewords: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` means of the rows of ``x``, begun at evenly spaced rows; a mean without rows moves to the row farthest from its own."""
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        far = np.empty(len(x))
        for at in range(0, len(x), 4096):
            d = _squares(x[at : at + 4096], centre)
            near[at : at + 4096], far[at : at + 4096] = d.argmin(1), d.min(1)
        counts = np.bincount(near, minlength=len(centre))
        sums = np.stack([np.bincount(near, x[:, d], len(centre)) for d in range(x.shape[1])], axis=1)
        full = counts > 0
        centre[full] = sums[full] / counts[full, None]
        centre[~full] = x[np.argsort(-far, kind="stable")[: int((~full).sum())]]
    return centre


def _units(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as unit rows of ``dim`` components, shorter ones filled with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, row = np.zeros((len(sizes), dim)), np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit_index(vectors: pa.ListArray, dim: int, lists: int) -> Index:
    """Centroids and codewords of a sample of vectors."""
    dim = -(-dim // SUBSPACES) * SUBSPACES
    x = _units(vectors, dim)
    centroids = _means(x, lists)
    rest = x - centroids[_squares(x, centroids).argmin(1)]
    part = dim // SUBSPACES
    return Index(centroids, np.stack([_means(rest[:, s * part : (s + 1) * part], CODES) for s in range(SUBSPACES)]))


def encode(index: Index, x: np.ndarray, spread: float, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Home list, codes and their error of unit rows, and the other lists each asks."""
    d = _squares(x, index.centroids)
    home = d.argmin(1)
    rest, part = x - index.centroids[home], index.dim // SUBSPACES
    codes = np.empty((len(x), SUBSPACES), np.uint8)
    for s in range(SUBSPACES):
        own = rest[:, s * part : (s + 1) * part]
        codes[:, s] = _squares(own, index.codewords[s]).argmin(1)
        rest[:, s * part : (s + 1) * part] -= index.codewords[s][codes[:, s]]
    apart = np.sqrt(_squares(index.centroids, index.centroids))
    reach = chord * min(1.0, spread / math.sqrt(index.dim)) + SLACK
    asks = d - d.min(1, keepdims=True) <= 2 * reach * apart[home]
    asks[np.arange(len(x)), home] = False
    asks &= np.arange(d.shape[1])[None, :] > home[:, None]  # the link of two lists is looked for from the first of them
    return home, codes, np.linalg.norm(rest, axis=1), [np.flatnonzero(a) for a in asks]


def lookups(index: Index, centroid: int, asking: np.ndarray) -> np.ndarray:
    """Squared distances (subspace x asking x code) of each part of the asking rows to the codewords of a list."""
    rest, part = asking - index.centroids[centroid], index.dim // SUBSPACES
    return np.stack([_squares(rest[:, s * part : (s + 1) * part], index.codewords[s]) for s in range(SUBSPACES)]).astype(np.float32)


def near_pairs(index: Index, centroid: int, asking: np.ndarray, lanes: np.ndarray, codes: np.ndarray, errors: np.ndarray, cosine: float, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """(asking row, lane) pairs of unit rows with at least the cosine."""
    tables = lookups(index, centroid, asking)
    bound = ((chord + SLACK + errors) ** 2).astype(np.float32)
    found_q, found_l = [], []
    step = max(1, CELLS // max(1, len(lanes)))
    for at in range(0, len(asking), step):
        t = tables[:, at : at + step]
        far = np.take(t[0], codes[:, 0], axis=1)
        for s in range(1, SUBSPACES):
            far += np.take(t[s], codes[:, s], axis=1)
        q, lane = np.nonzero(far <= bound[None, :])
        for k in range(0, len(q), CELLS // 16):
            a, b = q[k : k + CELLS // 16] + at, lane[k : k + CELLS // 16]
            near = np.einsum("ij,ij->i", asking[a], lanes[b]) >= cosine
            found_q.append(a[near])
            found_l.append(b[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_q), np.concatenate(found_l)) if found_q else (none, none)


class _Group:
    """The lanes of one piece of a list, those asking it so far, and what was found."""

    def __init__(self, index: Index, centroid: int, cosine: float):
        self.index, self.centroid, self.cosine, self.chord = index, centroid, cosine, math.sqrt(max(0.0, 2 - 2 * cosine))
        self.lanes, self.ids, self.copies, self.codes, self.errors = [], [], [], [], []
        self.links: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []
        self.ready = False

    def hold(self, ids, copies, x, codes, errors) -> None:
        for to, part in zip((self.ids, self.copies, self.lanes, self.codes, self.errors), (ids, copies, x, codes, errors)):
            to.append(part)

    def settle(self, alone: bool) -> None:
        """All lanes are there; ``alone``: compare them with one another, too."""
        if self.ready:
            return
        self.ready = True
        self.ids, self.copies, self.lanes, self.codes, self.errors = (np.concatenate(p) for p in (self.ids, self.copies, self.lanes, self.codes, self.errors))
        self.sums, self.root = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        if alone:
            for at in range(0, len(self.ids), 512):  # a lane asks the lanes behind it
                part = slice(at, at + 512)
                q, lane = near_pairs(self.index, self.centroid, self.lanes[part], self.lanes[at:], self.codes[at:], self.errors[at:], self.cosine, self.chord)
                behind = lane > q
                q, lane = q[behind] + at, lane[behind] + at
                np.add.at(self.sums, q, self.copies[lane])
                np.add.at(self.sums, lane, self.copies[q])
                self._join(q, lane)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Lanes that are linked point to the smallest of their component."""
        while True:
            ra, rb = self.root[a], self.root[b]
            low = np.minimum(ra, rb)
            if (ra == rb).all():
                return
            np.minimum.at(self.root, ra, low)
            np.minimum.at(self.root, rb, low)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def ask(self, ids, copies, x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(node, root, links)`` of asking vectors that link with a lane."""
        q, lane = near_pairs(self.index, self.centroid, x, self.lanes, self.codes, self.errors, self.cosine, self.chord)
        np.add.at(self.sums, lane, copies[q])
        asked, start = np.unique(q, return_index=True)
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, q, self.copies[lane])
        self._join(lane[start].repeat(np.diff(np.append(start, len(q)))), lane)
        return ids[asked], self.ids[lane[start]], counts[asked]

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = (self.sums > 0) | (self.root != np.arange(len(self.ids)))
        return self.ids[seen], self.ids[self.root[seen]], self.sums[seen]


def links(vectors: DataFrame, cosine: float = 0.95, spread: float = SPREAD, lists: int | None = None, piece: int = PIECE, askers: int = ASKERS) -> DataFrame:
    """``(node, root, links)``: for distinct ``vectors (node, copies, v)`` links found, with copies, and a forest of them.

    A node may have several rows; its links are their sum.
    """
    spark = vectors.sparkSession
    ship(spark)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    schema = "node bigint, root bigint, links bigint"
    if not size["n"]:
        return spark.createDataFrame([], schema)
    # the lists' lengths and their number grow alike
    lists = lists or max(1, min(MOST_LISTS, 1 << max(0, round(math.log2(math.sqrt(size["n"]) / 2)))))
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, max(16 * lists, 64 * CODES))).select("v").toArrow()
    index = spark.sparkContext.broadcast(fit_index(sample.column("v").combine_chunks(), size["dim"], lists))
    chord = math.sqrt(max(0.0, 2 - 2 * cosine))
    kind = vectors.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column("v"), index.value.dim)
            home, codes, error, asks = encode(index.value, x, spread, chord)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(a) for a in asks]), pa.int32()), pa.array(np.concatenate(asks).astype(np.int32)))
            columns = [pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), flat]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "v")), *columns], names=["node", "copies", "v", "home", "codes", "error", "asks"])

    coded = vectors.select("node", "copies", "v").mapInArrow(assign, f"node bigint, copies bigint, v {kind}, home int, codes binary, error double, asks array<int>")
    coded = written(coded.withColumn("dim", F.size("v")), "coded")
    own = coded.groupBy(F.col("home").alias("list"), "dim").agg(F.count("*").alias("lanes"))
    asked = coded.select("dim", F.explode("asks").alias("list")).groupBy("list", "dim").agg(F.count("*").alias("asked"))
    sizes = own.join(asked, ["list", "dim"], "left")
    sizes = sizes.select("list", "dim", F.ceil(F.col("lanes") / piece).cast("int").alias("pieces"), F.ceil((F.coalesce("asked", F.lit(0)) + F.col("lanes")) / askers).cast("int").alias("streams"))
    sizes = written(sizes, "sizes")  # a row for each list and length
    piece_of = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    stream_of = F.pmod(F.xxhash64("node", F.lit(1)), F.col("streams")).cast("int")
    at_home = coded.withColumn("list", F.col("home")).join(sizes, ["list", "dim"]).withColumn("own", piece_of).withColumn("mine", stream_of)
    # lanes go to every stream of their piece; stream 0 also compares them with one another
    lanes = at_home.select("list", "dim", F.col("own").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(0).alias("side"), "node", "copies", "v", "codes", "error")
    nothing = (F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    later = at_home.where("own + 1 < pieces").select("list", "dim", F.explode(F.sequence(F.col("own") + 1, F.col("pieces") - 1)).alias("piece"), F.col("mine").alias("stream"), F.lit(1).alias("side"), "node", "copies", "v", *nothing)
    others = coded.select("dim", F.explode("asks").alias("list"), "node", "copies", "v").join(sizes, ["list", "dim"]).withColumn("mine", stream_of)
    others = others.select("list", "dim", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("mine").alias("stream"), F.lit(1).alias("side"), "node", "copies", "v", *nothing)
    rows = lanes.unionByName(later).unionByName(others)
    by = ("list", "dim", "piece", "stream")
    rows = rows.repartition(*by).sortWithinPartitions(*by, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(f, np.int64)) for f in found], names=["node", "root", "links"])

        key, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*by, "side")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, stop in zip(cuts, cuts[1:]):
                part, now = batch.slice(at, stop - at), tuple(keys[at, :4].tolist())
                if now != key:
                    if group is not None:
                        group.settle(key[3] == 0)
                        yield out(group.close())
                    key, group = now, _Group(index.value, now[0], cosine)
                ids, copies = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies"))
                x = _units(part.column("v"), index.value.dim)
                if keys[at, 4] == 0:
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
                    group.hold(ids, copies, x, codes, part.column("error").to_numpy(zero_copy_only=False))
                else:
                    group.settle(key[3] == 0)
                    found = group.ask(ids, copies, x)
                    if len(found[0]):
                        yield out(found)
        if group is not None:
            group.settle(key[3] == 0)
            yield out(group.close())

    return rows.mapInArrow(compare, schema)


def near_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95, spread: float = SPREAD, **sizes: int) -> DataFrame:
    """One row for each vector: ``vec_id``, ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    v = F.col("v")
    sound = v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    # two hashes name a vector; rows that are not sound keep apart
    rows = rows.select("vec_id", "v", *[F.when(F.col("sound"), F.xxhash64(F.lit(k), "v")).alias(k) for k in ("h", "g")])
    ids = written(rows.drop("v"), "ids")
    distinct = rows.where("h IS NOT NULL").groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = written(links(distinct.select("node", "copies", "v"), cosine, spread, **sizes), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> root"), "node", "root")
    distinct = distinct.drop("v").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    distinct = written(distinct, "linked")
    # written, so that the join below can split a large group
    names = written(distinct.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    distinct = distinct.join(names, "root").select("h", "g", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = ids.where("h IS NOT NULL").join(distinct, ["h", "g"]).select("vec_id", "n_links", "component_id")
    whole = whole.unionByName(ids.where("h IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return whole.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
