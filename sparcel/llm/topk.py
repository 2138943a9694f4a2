"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are integers (``floor(scale * x)`` of each component). Candidates are dealt out in blocks; a block sorts its rows once in
every dimension. A query walks down all lists of a block at the same depth, from the largest values where its own component is
positive and from the smallest where it is negative. Rows met for the first time are scored in full. A row not met yet cannot
score more than the threshold, the sum over the dimensions of the query's component times the value last met there; the walk
ends when that is below the k-th score so far (an equal one could still bring a smaller id). The best of all blocks are merged.

Queries are dealt out in blocks as well, and each pair of blocks is one group of bounded size, so neither side is broadcast.

Defined results: NULL vectors and vectors with a NULL or non-finite component take no part on either side; a query is compared
with rows of its own length only, and never with a row of its own id; rows with a NULL id take no part; repeated rows are
candidates each, and a query's own repeated rows are answered once; ties go to the smaller id, equal ids and scores are told
apart by rank; fewer than k rows give all of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparcel.session import ship, written

#: Candidates and queries of a block; rows a walk meets in each list before it looks at the threshold, four times as many every time.
BLOCK, QUERIES, DEPTH = 8192, 2048, 64
#: Scores must fit a long; larger ones are an error.
LONG = 1 << 63


def quantised(vector: str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, NULL unless all are finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


class Lists:
    """The rows of a block, sorted in every dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")  # a smaller row number is a smaller id
        self.ids, self.rows = ids[order], rows[order].astype(np.int64)
        down = np.argsort(-self.rows, axis=0, kind="stable").T
        self.lists = np.stack((np.argsort(self.rows, axis=0, kind="stable").T, down)).astype(np.int32)  # direction x dimension x depth
        self.largest = float(np.abs(self.rows).max(initial=0))
        self.as_type: dict[type, np.ndarray] = {np.int64: self.rows}

    def exact(self, query: np.ndarray) -> np.ndarray:
        """The rows in the smallest type in which every score with the query is exact."""
        bound = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query))
        if bound >= LONG:
            raise OverflowError("scores beyond 63 bits")
        kind = next((t for t, most in ((np.float32, 1 << 24), (np.float64, 1 << 53)) if bound < most), np.int64)
        if kind not in self.as_type:
            self.as_type[kind] = self.rows.astype(kind)
        return self.as_type[kind]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k best rows of another id than ``own``, best first."""
        n, rows = len(self.ids), self.exact(query)
        weight = query.astype(rows.dtype)
        used = np.flatnonzero(query)  # a zero component adds nothing, whatever the row
        direction = (query[used] > 0).astype(np.int64)
        met = self.ids == own
        best_row, best = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
        at, depth = 0, DEPTH if len(used) else n
        while at < n:
            stop = min(n, at + depth)
            seen = met.copy()
            if len(used):
                seen[self.lists[direction, used, at:stop].ravel()] = True
            else:
                seen[:] = True
            new = np.flatnonzero(seen & ~met)
            met = seen
            row, score = np.concatenate((best_row, new)), np.concatenate((best, rows[new] @ weight))
            if len(score) > k:
                good = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                row, score = row[good], score[good]
            order = np.lexsort((row, -score))[:k]
            best_row, best = row[order], score[order]
            if len(best) == k and (weight[used] * rows[self.lists[direction, used, stop - 1], used]).sum() < best[-1]:
                break
            at, depth = stop, depth * 4
        return best_row, best


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query."""
    lists = Lists(ids, rows)
    found = []
    for own, query in zip(query_ids.tolist(), queries):
        row, score = lists.top(query, own, k)
        found.append((np.full(len(row), own), lists.ids[row], score.astype(np.int64)))
    parts = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` with the highest integer inner product with each query."""
    spark = vectors.sparkSession
    ship(spark)

    def rows(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("bigint").alias("id"), quantised(vector, scale).alias("v"))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull())

    candidates = written(rows(vectors), "candidates")
    wanted = written(rows(queries).dropDuplicates(["id", "v"]), "queries")
    blocks = {}
    for name, df, size in (("c", candidates, BLOCK), ("q", wanted, QUERIES)):
        blocks[name] = max(1, -(-df.count() // size))
    # by position, so equal ids and equal vectors are dealt out evenly
    dealt = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7919, F.lit(blocks["c"])).cast("int")
    asked = F.pmod(F.monotonically_increasing_id(), F.lit(blocks["q"])).cast("int")
    left = candidates.select("id", "v", dealt.alias("c"), F.lit(False).alias("asks"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks["q"] - 1))))
    right = wanted.select("id", "v", asked.alias("q"), F.lit(True).alias("asks"))
    right = right.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks["c"] - 1))))
    both = left.unionByName(right).withColumn("n", F.size("v"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        values = np.stack(group["v"].to_numpy()) if group["n"].iloc[0] else np.zeros((len(group), 0), np.int64)
        ids = group["id"].to_numpy()
        return search(ids[~asks], values[~asks], ids[asks], values[asks], k)

    found = both.groupBy("c", "q", "n").applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
