"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.session import pin, written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{stem}{i or ''}" for i in range(len(taken) + 1)) if n not in taken)


def free(df: DataFrame, name: str) -> None:
    """Refuse to overwrite a column of the caller's."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already; give the result another name")


def document_text(text: str = "text") -> Column:
    """The text of a document; a missing one is empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(column: str, mod: int) -> Column:
    """``crc32`` of an id's decimal text, modulo ``mod``; NULL ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label for each ``doc_id``: the majority of its rows, 1 on a tie; rows without id or label are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(column).cast("double")) >= 0.5).cast("int").alias("label"))
    )


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, held_out: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ``(text, label)`` rows outside the held-out fold, chosen by a hash of the id.

    The ids are chosen from ``labels`` before any text is read, so the sample is bounded and the same on every run.
    Of an id that occurs in several rows the first text in order is taken, so the bound holds whatever repeats.
    """
    chosen = (
        one_label(labels, column)
        .where(~held_out)
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id")
        .limit(limit)
    )
    rows = documents.select("doc_id", document_text().alias("text")).join(written(chosen, "chosen"), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


__all__ = ["Query", "document_text", "fold", "free", "fresh", "labelled_sample", "one_label", "table", "written"]
