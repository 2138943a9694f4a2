"""The corpus pipeline: each stage calls one operator and hands whole documents to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.llm.common import table
from sparcel.llm.decontaminate import drop_contaminated
from sparcel.llm.pieces import round_trip
from sparcel.llm.secrets import redact_secrets
from sparcel.llm.simhash import drop_near_duplicates
from sparcel.llm.toxicity import drop_toxic, fit_toxicity
from sparcel.session import pin, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (4-word shingles, at most 4 bits)."""
    pin(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are blotted out."""
    pin(spark)
    return redact_secrets(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether they decode to its text."""
    pin(spark)
    encoded = round_trip(docs)
    return encoded.withColumn("round_trip", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: SQL has no 64-bit SimHash, model fitting or subword encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = pin(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
