"""Positions in an ordered set of any size, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparcel.session import written


def numbered_by_id(df: DataFrame, id_column: str, by: Iterable[str] = (), name: str = "position") -> DataFrame:
    """Number rows 0, 1, 2 … in the order of an id, per ``by`` group if given; equal ids in any order.

    A range exchange sorts the rows over all tasks, whatever the ids are; each row is written with its task and its place in
    it, and the row counts of the tasks before are added. Only these counts, one row for each group and task, meet in a window.
    """
    by = list(by)
    ranged = df.repartitionByRange(*by, id_column).sortWithinPartitions(*by, id_column)
    placed = written(ranged.withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ranged")
    counts = placed.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    group = [F.col(c).alias(f"_of{i}") for i, c in enumerate(by)]
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.col("_task").alias("_at"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_task") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    return placed.join(starts, same).withColumn(name, F.col("_place") + F.col("_shift")).drop("_task", "_place", "_at", "_shift", *[f"_of{i}" for i in range(len(by))])
