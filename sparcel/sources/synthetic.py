"""Seeded test records: every value depends on the record number and the seed only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.operators.sampling import uniform

# Word lists the text attributes draw from.
WORDS = {
    "animal": ("bear", "cat", "cow", "dog", "fish", "horse", "lion", "rabbit"),
    "color": ("black", "blue", "green", "grey", "orange", "red", "violet", "white"),
    "city": ("Berlin", "Cairo", "Lagos", "Lima", "Oslo", "Paris", "Quito", "Tokyo"),
    "first_name": ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo"),
    "product": ("Bike", "Chair", "Hat", "Lamp", "Mouse", "Shirt", "Shoes", "Table"),
}


def attribute(kind: str, number: Column, seed: int) -> Column:
    """A value of ``kind``: a word list, ``integer``, ``number``, ``boolean``, ``date`` or ``email``."""
    draw = uniform(seed, number)
    if kind in WORDS:
        words = F.array(*[F.lit(w) for w in WORDS[kind]])
        return F.get(words, F.floor(draw * len(WORDS[kind])).cast("int"))
    if kind == "integer":
        return F.floor(draw * 100_000).cast("bigint")
    if kind == "number":
        return F.round(draw * 1000, 2)
    if kind == "boolean":
        return draw < 0.5
    if kind == "date":
        return F.date_add(F.lit("2020-01-01").cast("date"), F.floor(draw * 1000).cast("int"))
    if kind == "email":
        return F.concat(F.lower(attribute("first_name", number, seed)), number.cast("string"), F.lit("@example.org"))
    raise ValueError(f"unknown attribute {kind}")


def synthetic_for(df: DataFrame, number: str, attributes: Mapping[str, str], seed: int = 0) -> DataFrame:
    """One synthetic record per row of ``df``, keyed by its ``number`` column."""
    n = F.col(number)
    return df.select(n, *[attribute(kind, n, seed + i).alias(name) for i, (name, kind) in enumerate(attributes.items())])


def synthetic_records(spark: SparkSession, count: int, attributes: Mapping[str, str], seed: int = 0) -> DataFrame:
    return synthetic_for(spark.range(count).withColumnRenamed("id", "_offset"), "_offset", attributes, seed)
