"""The activity log added up by minute, hour and day, for notifications of every frequency.

A bucket ``k`` of ``size`` seconds covers the time after ``(k - 1) * size`` up to and including ``k * size``, as notification windows do. An
update adds up the log from the stored mark on, at all levels, and appends its sums as one folder; counts, first and last actions
and edited properties can be put together in any order, so nothing older is rewritten. Folders and mark are published by one rename: an
update that dies is run again from the old mark. A window is made of the largest buckets inside it, and of the log itself for what is
left at its edges and after the mark.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.registry.notifications import summaries_of
from sparcel.session import written
from sparcel.sinks.state import Published

LEVELS = (60, 3600, 86_400)
#: Kind of target and its column in the log.
TARGETS = {"catalog": "target_catalog_id", "collection": "target_collection_id", "package": "target_package_id", "user": "user_id"}
SUMS = (
    "kind string, target bigint, event string, change string, actor bigint, n bigint, first struct<created_at: timestamp, id: bigint>, "
    "last_at timestamp, edited array<string>"
)
LIST = "place bigint, folder string, mark bigint"
KEYS = ("kind", "target", "event", "change", "actor")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def bucket(micros: Column, size: int) -> Column:
    return F.ceil(micros / F.lit(size * 1_000_000)).cast("bigint")


def _cells(log: DataFrame) -> DataFrame:
    """A row for each target of each action."""
    targets = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("target")) for k, c in TARGETS.items()])
    rows = log.select(
        _micros(F.col("created_at")).alias("at"), F.col("created_at").cast("timestamp").alias("created_at"), F.col("id").cast("bigint").alias("id"), F.col("event_type").alias("event"),
        F.col("change_type").alias("change"), F.col("user_id").cast("bigint").alias("actor"), "properties_edited", F.inline(targets),
    )
    return rows.filter("target IS NOT NULL")


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of sums."""
    return rows.groupBy(*by, *KEYS).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last_at").alias("last_at"), F.array_distinct(F.flatten(F.collect_set("edited"))).alias("edited")
    )


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of sums, apart by the list of edited properties: nothing is collected, which costs more than all the rest."""
    return rows.groupBy(*by, *KEYS, "edited").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last_at").alias("last_at"))


def _single(cells: DataFrame, *more: str) -> DataFrame:
    """Actions as sums of one."""
    return cells.select(
        *more, *KEYS, F.lit(1).cast("bigint").alias("n"), F.struct("created_at", "id").alias("first"), F.col("created_at").alias("last_at"),
        F.coalesce("properties_edited", F.array().cast("array<string>")).alias("edited"),
    )


class LogRollup(Published):
    """The kept sums of a log below a folder."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        super().__init__(spark, f"{path.rstrip('/')}/list", keep)
        self.data = f"{path.rstrip('/')}/sums"

    def _listed(self) -> list[tuple[int, str, int]]:
        number = self.newest()
        return [] if number < 0 else sorted(tuple(r) for r in self.spark.read.schema(LIST).parquet(f"{self.path}/snapshot-{number}").collect())

    def mark(self) -> int | None:
        """The time, in microseconds, up to which the log is added up."""
        return max((m for _, _, m in self._listed()), default=None)

    def update(self, log: DataFrame, until: dt.datetime) -> int:
        """Add up the log to the last whole minute of ``until``; returns the number of sums written."""
        before, listed = self.newest(), self._listed()
        mark = self.mark()
        stop = self.spark.range(1).select(F.floor(_micros(F.lit(until)) / 60_000_000) * 60_000_000).first()[0]
        if mark is not None and stop <= mark:
            return 0
        at = _micros(F.col("created_at"))
        some = log.filter(at <= stop) if mark is None else log.filter((at > mark) & (at <= stop))
        sums = _summed(_single(_cells(some).withColumn("slot", bucket(F.col("at"), LEVELS[0])), "slot"), "slot")
        folder = uuid.uuid4().hex
        for number, size in enumerate(LEVELS):  # hours of minutes, days of hours, each from the level that was written
            if number:
                smaller = self.spark.read.schema(f"slot bigint, {SUMS}").parquet(f"{self.data}/{folder}/level={number - 1}")
                sums = _summed(smaller.withColumn("slot", F.ceil(F.col("slot") / F.lit(size // LEVELS[number - 1])).cast("bigint")), "slot")
            sums.write.parquet(f"{self.data}/{folder}/level={number}")
        entries = [*listed, (len(listed), folder, stop)]
        self.publish(self.spark.createDataFrame(entries, LIST).coalesce(1).write.parquet, before)
        return self.spark.read.parquet(f"{self.data}/{folder}").count()

    def compact(self) -> int:
        """Put all folders in one."""
        before, listed = self.newest(), self._listed()
        folder = uuid.uuid4().hex
        _summed(self._sums(), "level", "slot").write.partitionBy("level").parquet(f"{self.data}/{folder}")
        return self.publish(self.spark.createDataFrame([(0, folder, self.mark())], LIST).coalesce(1).write.parquet, before) if listed else before

    def _sums(self) -> DataFrame:
        rows = self.spark.createDataFrame([], f"slot bigint, {SUMS}, level int")
        for _, folder, _ in self._listed():
            rows = rows.unionByName(self.spark.read.schema(f"slot bigint, {SUMS}, level int").parquet(f"{self.data}/{folder}"))
        return rows

    def counted(self, log: DataFrame, windows: DataFrame) -> DataFrame:
        """``(frequency, kind, target, event, change, actor, n, first, last_at, edited)`` of each of ``windows (frequency, window_start, window_end)``."""
        return _added(self.parts(log, windows), "frequency")

    def parts(self, log: DataFrame, windows: DataFrame) -> DataFrame:
        """The same with a row for each list of edited properties.

        Buckets are taken from the largest level down: those inside the window whose larger bucket is not inside.
        """
        mark = self.mark()
        spans = windows.select("frequency", _micros(F.col("window_start")).alias("s"), _micros(F.col("window_end")).alias("e"))
        done = F.lit(mark if mark is not None else -(1 << 62))

        def inside(slot: Column, size: int) -> Column:
            micros = size * 1_000_000
            return ((slot - 1) * micros >= F.col("s")) & (slot * micros <= F.least("e", done))

        rows, chosen = self._sums(), F.lit(False)
        for number, size in enumerate(LEVELS):
            own = inside(F.col("slot"), size)
            if number + 1 < len(LEVELS):
                larger = LEVELS[number + 1]
                own = own & ~inside(F.ceil(F.col("slot") / F.lit(larger // size)).cast("bigint"), larger)
            chosen = chosen | ((F.col("level") == number) & own)
        parts = rows.join(F.broadcast(spans), chosen).select("frequency", *KEYS, "n", "first", "last_at", "edited")
        # of the log only what no minute of the window covers; there are five frequencies at most
        at, edge = _micros(F.col("created_at")), F.lit(False)
        for s, e in {(r["s"], r["e"]) for r in spans.collect()}:
            first, last = -(-s // 60_000_000) * 60_000_000, e // 60_000_000 * 60_000_000
            last = max(first, min(last, mark)) if mark is not None else first
            edge = edge | ((at > s) & (at <= min(first, e))) | ((at > last) & (at <= e))
        raw = _cells(log.filter(edge)).join(F.broadcast(spans), (F.col("at") > F.col("s")) & (F.col("at") <= F.col("e")))
        raw = raw.filter(~inside(bucket(F.col("at"), LEVELS[0]), LEVELS[0]))
        return _summed(parts.unionByName(_single(raw, "frequency")), "frequency")


def digests(rollup: LogRollup, log: DataFrame, follows: DataFrame, packages: DataFrame, collection_packages: DataFrame, windows: DataFrame) -> DataFrame:
    """The summaries of all four kinds of follow for every frequency of ``windows``, from one look at the sums."""
    windows = windows.join(follows.select("frequency").distinct(), "frequency", "left_semi")  # five at most
    counted = written(rollup.parts(log, windows), "counted").select(
        "frequency", "kind", F.col("target").alias("_target"), F.col("event").alias("_event"), F.col("change").alias("_change"), F.col("actor").alias("actor_id"), "n", "first", "last_at", "edited"
    )
    # every kind reads them, for its totals and for its followers
    wanted = written(follows.join(windows.select("frequency"), "frequency", "left_semi").repartition("user_id"), "follows")
    return summaries_of(counted, wanted, packages, collection_packages)
