"""File sinks: one output folder per schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.dates import iso_millis
from sparcel.operators.projection import APPEND_ONLY_LOG, CONTINUOUS, SCHEMA

EXTENSIONS = {"csv": "csv", "json": "json", "avro": "avro", "parquet": "parquet"}


def target_path(location: str, major: int, fmt: str, schema: str) -> str:
    return f"{location.rstrip('/')}/{major}/{fmt}/{schema}"


def write_mode(update_method: str, replace: bool = False) -> str:
    """Overwrite, unless records are appended and the target need not be replaced."""
    appending = update_method in (APPEND_ONLY_LOG, CONTINUOUS) and not replace
    return "append" if appending else "overwrite"


def _iso_times(df: DataFrame) -> DataFrame:
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({n: iso_millis(F.col(f"`{n}`")) for n in times})


def csv_sink(
    df: DataFrame, path: str, *, header: bool = True, quote_all: bool = True, delimiter: str = ",", mode: str = "overwrite"
) -> None:
    """Quoted text with ISO-8601 times; the header is written for full sets only."""
    _iso_times(df).write.mode(mode).csv(
        path, header=header and mode == "overwrite", quoteAll=quote_all, sep=delimiter, escape='"'
    )


def jsonl_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line."""
    _iso_times(df).write.mode(mode).json(path)


def avro_sink(shaped: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records of ``avro_shape``; needs the spark-avro package on the cluster."""
    shaped.write.format("avro").mode(mode).save(path)


def file_sink(
    df: DataFrame, location: str, schema: str, *, major: int = 1, fmt: str = "parquet",
    update_method: str = "BATCH_FULL_SET", replace: bool = False,
) -> str:
    """Write one schema and return its folder."""
    path, mode = target_path(location, major, fmt, schema), write_mode(update_method, replace)
    if fmt == "csv":
        csv_sink(df, path, mode=mode)
    elif fmt == "json":
        jsonl_sink(df, path, mode)
    else:
        df.write.format(fmt).mode(mode).save(path)
    return path


def partitioned_sink(df: DataFrame, location: str, mode: str = "append") -> None:
    """All schemas of a stream in one pass, one folder per schema."""
    df.write.mode(mode).partitionBy(SCHEMA).parquet(location)


def console_lines(df: DataFrame) -> DataFrame:
    """Every record as a line of JSON, to be written as text by the tasks that have it."""
    return df.select(F.to_json(F.struct("*")).alias("record"))


def console_sink(df: DataFrame, rows: int = 1000) -> None:
    """Print the first ``rows`` records on the driver's standard output; no more than these are brought there."""
    for row in console_lines(df).take(rows):
        print(row["record"])


def object_store_sink(df: DataFrame, bucket: str, key: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("overwrite").save(f"s3a://{bucket}/{key.lstrip('/')}")
