"""Completion by a table of prefix keys.

Every name gives the keys it may be found by: its lower-case text, and for names that are searched inside, each of its endings. The
table lies sorted by key over its files, so a prefix reads the row groups around it and no others. What may be shown to whom is part of
the key's row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, INSIDE = "start", "inside"


def prefix_keys(df: DataFrame, id_column: str, starts: Mapping[str, Column | str], inside: Mapping[str, Column | str] | None = None, public: Mapping[str, Column] | None = None) -> DataFrame:
    """``(prefix_key, kind, name, id, public)``: one row for each name, and one for each ending of a name that is searched inside."""
    public, as_col = public or {}, lambda c: F.col(c) if isinstance(c, str) else c
    cells = [
        F.struct(F.array(F.lower(as_col(c))).alias("keys"), F.lit(START).alias("kind"), F.lit(n).alias("name"), public.get(n, F.lit(True)).alias("public"))
        for n, c in starts.items()
    ]
    for n, c in (inside or {}).items():
        text = F.lower(as_col(c))
        ends = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), _ending(text)))
        cells.append(F.struct(ends.alias("keys"), F.lit(INSIDE).alias("kind"), F.lit(n).alias("name"), public.get(n, F.lit(True)).alias("public")))
    rows = df.select(F.col(id_column).alias("id"), F.inline(F.array(*cells)))
    return rows.select(F.explode("keys").alias("prefix_key"), "kind", "name", "id", F.coalesce("public", F.lit(False)).alias("public")).filter("prefix_key IS NOT NULL")


def _ending(text: Column):
    return lambda i: F.substr(text, i)


def write_prefixes(keys: DataFrame, path: str) -> None:
    """Sorted over all files by kind and key, so that equal beginnings lie together."""
    keys.repartitionByRange("kind", "prefix_key", "id").sortWithinPartitions("kind", "prefix_key").write.mode("overwrite").parquet(path)


def complete(keys: DataFrame, prefix: str, kind: str = START, only_public: bool = True) -> DataFrame:
    """``id`` of every row with a key of that beginning."""
    found = keys.filter((F.col("kind") == kind) & F.col("prefix_key").startswith(prefix.lower()))
    return (found.filter("public") if only_public else found).select("id").distinct()
