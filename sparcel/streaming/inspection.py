"""Inspecting the files of a stream set within a time budget.

Files are profiled in groups, each twice as large as the one before, so a small budget sees some files whole and a large one keeps the
cluster busy. A group is one job under a tag; when the budget is over the tag's jobs are cancelled, the groups that were done stay, their
counts are lower bounds, and no update hash is kept, so that the next run reads again.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.operators.profile import STATS, combine, number_widening, plan
from sparcel.streaming.ingest import count_precision, update_hash_after

#: Files of a group at most.
GROUP = 4096


@dataclass
class Inspection:
    """What an inspection has seen; ``finished`` unless its budget was over before the last file."""

    spark: SparkSession
    path: str
    files: list[str]
    done: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)

    @property
    def finished(self) -> bool:
        return len(self.done) == len(self.files)

    def profile(self) -> DataFrame:
        """The profile of the files that were seen whole."""
        if not self.parts:
            raise ValueError("no file was seen whole within the budget")
        rows = self.spark.read.parquet(*[f"{self.path}/{p}/profile" for p in self.parts])
        return number_widening(combine(rows.select("property", "type", *[s for s in STATS if s in rows.columns])))

    def counts(self) -> DataFrame:
        """(files, inspected_count, record_count_precision)."""
        seen = self.spark.read.schema("n bigint").parquet(*[f"{self.path}/{p}/count" for p in self.parts]) if self.parts else self.spark.createDataFrame([], "n bigint")
        return seen.agg(F.lit(len(self.done)).cast("bigint").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("inspected_count")).withColumn(
            "record_count_precision", F.lit(count_precision(self.finished))
        )

    def state(self, hashes: DataFrame) -> DataFrame:
        """``hashes (file, update_hash)`` of the stream set: kept only by a run that saw everything."""
        kept = F.col("update_hash") if update_hash_after(self.finished, "kept") else F.lit(None).cast("string")
        seen = self.spark.createDataFrame([(f,) for f in self.done], "file string")
        return hashes.join(seen, "file", "left_semi").select("file", kept.alias("update_hash"))


def inspect_files(
    spark: SparkSession, files: list[str], read: Callable[[list[str]], DataFrame], path: str, seconds: float,
    clock: Callable[[], float] = time.monotonic, alarm: Callable[[float, Callable[[], None]], threading.Timer] = threading.Timer, **options,
) -> Inspection:
    """Profile ``files`` for at most ``seconds``; ``read`` makes a table of some of them, ``options`` are those of ``profile``.

    ``clock`` tells the time between groups, ``alarm`` cancels the one that runs.
    """
    context, found = spark.sparkContext, Inspection(spark, path, list(files))
    begun, size = clock(), 1
    while not found.finished:
        left = seconds - (clock() - begun)
        if left <= 0:
            break
        group, name, tag = found.files[len(found.done) : len(found.done) + size], f"part-{len(found.parts)}-{uuid.uuid4().hex[:8]}", f"inspection-{uuid.uuid4().hex}"
        over = threading.Event()

        def stop(tag: str = tag, over: threading.Event = over) -> None:
            over.set()
            context.cancelJobsWithTag(tag)

        timer = alarm(left, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            made = plan(read(group), **options)
            wide = made.per_row.agg(F.count("*").alias("_records"), *made.aggregates)
            wide.write.parquet(f"{path}/{name}/wide")
            wide = spark.read.schema(wide.schema).parquet(f"{path}/{name}/wide")
            made.long(wide, widen=False).write.parquet(f"{path}/{name}/profile")
            wide.select(F.col("_records").alias("n")).write.parquet(f"{path}/{name}/count")
        except (Py4JJavaError, PySparkException):
            if not over.is_set():
                raise
            break
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        found.done += group
        found.parts.append(name)
        size = min(2 * size, GROUP)
    return found
