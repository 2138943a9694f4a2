"""A token index in immutable segments, brought up to date by what changed.

A refresh writes one segment: the entries of the changed texts, sorted by token, and the keys it speaks for. An entry counts unless a
later segment speaks for its key, so nothing older is rewritten. When ``FANOUT`` neighbouring segments are of one size they are merged,
which rewrites every entry a logarithmic number of times in all. The list of segments is published by one rename.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.registry.stems import NOT_WORD, stems
from sparcel.session import written
from sparcel.sinks.state import Published

FANOUT, LEAST = 4, 1024
LIST = "seq bigint, folder string, rows bigint"


class SegmentIndex(Published):
    """``(token, field, key)`` of some text columns of a table; ``stemmed`` for stems without stop words, else words as written."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: Iterable[str], stemmed: bool = True, keep: int = 2):
        super().__init__(spark, f"{path.rstrip('/')}/list", keep)
        self.data, self.key, self.fields, self.stemmed = f"{path.rstrip('/')}/segments", key, tuple(fields), stemmed

    @property
    def schema(self) -> str:
        return f"token string, field string, `{self.key}` bigint"

    def segments(self, number: int | None = None) -> list[tuple[int, str, int]]:
        """``(seq, folder, entries)``, oldest first; logarithmically many."""
        number = self.newest() if number is None else number
        if number < 0:
            return []
        return sorted(tuple(r) for r in self.spark.read.schema(LIST).parquet(f"{self.path}/snapshot-{number}").collect())

    def _tokens(self, rows: DataFrame) -> DataFrame:
        """Every token of every field of a row once."""
        words = lambda c: stems(c) if self.stemmed else F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w != "")
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(words(F.col(f))).alias("tokens")) for f in self.fields])
        rows = rows.select(F.col(self.key).cast("bigint").alias(self.key), F.inline(cells))
        return rows.select(F.explode("tokens").alias("token"), "field", self.key)

    def _write(self, entries: DataFrame, keys: DataFrame) -> tuple[str, int]:
        folder, entries = uuid.uuid4().hex, written(entries, "tokens")  # sorting by range looks at its rows twice
        entries.repartitionByRange("token", self.key).sortWithinPartitions("token").write.parquet(f"{self.data}/{folder}/entries")
        keys.write.parquet(f"{self.data}/{folder}/keys")
        return folder, self.spark.read.parquet(f"{self.data}/{folder}/entries").count()

    def _list(self, segments: list[tuple[int, str, int]], after: int) -> int:
        return self.publish(self.spark.createDataFrame(segments, LIST).coalesce(1).write.parquet, after)

    def refresh(self, changed: DataFrame, merge: bool = True) -> int:
        """Take up rows that are new or changed; a row whose texts are all NULL goes. Returns the entries written for them."""
        before = self.newest()
        segments = self.segments(before)
        folder, rows = self._write(self._tokens(changed), changed.select(F.col(self.key).cast("bigint").alias(self.key)).distinct())
        self._list([*segments, (max((s for s, _, _ in segments), default=-1) + 1, folder, rows)], before)
        while merge and self.merge():
            pass
        return rows

    def merge(self) -> bool:
        """Merge the newest ``FANOUT`` neighbours of one size, if there are as many."""
        before = self.newest()
        segments = self.segments(before)
        level = [int(math.log(max(rows, LEAST) / LEAST, FANOUT)) for _, _, rows in segments]
        for end in range(len(segments), FANOUT - 1, -1):
            if len(set(level[end - FANOUT : end])) == 1:
                break
        else:
            return False
        part = segments[end - FANOUT : end]
        keys = self._keys(part).select(self.key).distinct()
        folder, rows = self._write(self._alive(self._read(part), part).select("token", "field", self.key), keys)
        self._list([*segments[: end - FANOUT], (part[-1][0], folder, rows), *segments[end:]], before)
        return True

    def _union(self, part: list[tuple[int, str, int]], what: str, schema: str) -> DataFrame:
        found = self.spark.createDataFrame([], f"{schema}, seq bigint")
        for seq, folder, _ in part:
            found = found.unionByName(self.spark.read.schema(schema).parquet(f"{self.data}/{folder}/{what}").withColumn("seq", F.lit(seq).cast("bigint")))
        return found

    def _read(self, part: list[tuple[int, str, int]]) -> DataFrame:
        return self._union(part, "entries", self.schema)

    def _keys(self, part: list[tuple[int, str, int]]) -> DataFrame:
        return self._union(part, "keys", f"`{self.key}` bigint")

    def _alive(self, entries: DataFrame, segments: list[tuple[int, str, int]], few: bool = False) -> DataFrame:
        """Entries whose key no later segment speaks for. The keys of the oldest segment are never read; of the others only those of
        the entries are kept where these are ``few``."""
        if len(segments) < 2:
            return entries
        later = self._keys(segments[1:])
        if few:
            later = later.join(entries.select(self.key).distinct(), self.key, "left_semi")
        later = later.groupBy(self.key).agg(F.max("seq").alias("_last"))
        return entries.join(later, self.key, "left").filter(F.col("_last").isNull() | (F.col("_last") <= F.col("seq"))).drop("_last")

    def lookup(self, tokens: Iterable[str]) -> DataFrame:
        """``(token, field, key)`` of some tokens: the entries of the others are skipped, and only found keys are looked up."""
        segments = self.segments()
        return self._alive(self._read(segments).filter(F.col("token").isin(sorted(tokens))), segments, few=True).drop("seq")

    def entries(self) -> DataFrame:
        """All entries that count."""
        segments = self.segments()
        return self._alive(self._read(segments), segments).drop("seq")

    def sweep(self) -> int:
        """Remove segments that no kept list names; not while a refresh runs."""
        named = {folder for number in self.published() for _, folder, _ in self.segments(number)}
        stray = [n for n in self._names(self.data) if n not in named]
        for name in stray:
            self._fs.delete(self._path(f"{self.data}/{name}"), True)
        return len(stray)
