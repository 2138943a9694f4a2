"""Connected components of a graph that lies in a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.session import written


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``(node, root)`` for each node that has a link; ``root`` is the smallest node that can be reached.

    Alternating large-star and small-star steps: every step is a grouped minimum and a join on the node, so nothing is
    collected and a node with very many links is split by the skewed-join rule. Every round is written to the shared folder.
    Links with a NULL end and links from a node to itself are left out. Raises if ``rounds`` steps do not settle.
    """
    a, b = F.col(a), F.col(b)
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = written(edges.distinct(), "links")
    before = _signature(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least).distinct()
        edges = written(small, "small")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
