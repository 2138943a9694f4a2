"""Record pipelines: hide, rename, filter by offset, route, sample, measure."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Update methods and the sample size.
BATCH_FULL_SET, APPEND_ONLY_LOG, CONTINUOUS = "BATCH_FULL_SET", "APPEND_ONLY_LOG", "CONTINUOUS"
SAMPLE_SIZE = 100
SCHEMA, OFFSET = "_schema_slug", "_offset"


def exclude_properties(df: DataFrame, hidden: Iterable[str]) -> DataFrame:
    return df.drop(*hidden)


def rename_properties(df: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(titles))


def drop_bad_properties(df: DataFrame) -> DataFrame:
    """Remove columns without a name."""
    keep = [i for i, name in enumerate(df.columns) if name.strip() != ""]
    if len(keep) == len(df.columns):
        return df
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in keep])


def offset_filter(
    df: DataFrame, state: DataFrame, on: Iterable[str], offset: str = OFFSET, last: str = "stream_offset"
) -> DataFrame:
    """Keep the records without an offset, and those past the last offset of their stream.

    The state has one row per stream; the optimizer broadcasts it while it is small.
    """
    keys = list(on)
    known = state.select(*keys, F.col(last).alias("_last"))
    joined = df.join(known, keys, "left")
    return joined.filter(F.coalesce(F.col(offset) > F.col("_last"), F.lit(True))).select(*df.columns)


def after_offset(df: DataFrame, last: int | None, offset: str = OFFSET) -> DataFrame:
    """The same for a single stream, as a filter that reaches the scan."""
    if last is None:
        return df
    return df.filter(F.col(offset).isNull() | (F.col(offset) > last))


def check_known_schemas(df: DataFrame, schemas: Iterable[str], slug: str = SCHEMA) -> DataFrame:
    """Fail on records of a schema that is not described."""
    known = F.coalesce(F.col(slug).isin(list(schemas)), F.lit(False))
    error = F.raise_error(F.concat(F.lit("unknown schema "), F.coalesce(F.col(slug), F.lit("NULL")))).cast("string")
    return df.withColumn(slug, F.when(known, F.col(slug)).otherwise(error))


def route_to_folders(df: DataFrame, schemas: Iterable[str], location: str, mode: str = "append", slug: str = SCHEMA) -> None:
    """All schemas in one pass, a folder ``slug=name`` each; a record of another schema fails the write."""
    check_known_schemas(df, schemas, slug).write.mode(mode).partitionBy(slug).parquet(location)


def route_by_schema(df: DataFrame, writers: Mapping[str, Callable[[DataFrame], None]], slug: str = SCHEMA) -> None:
    """A writer of its own per schema, for targets of different kinds.

    Every writer reads ``df`` with its own filter, which columnar sources push into the scan;
    where all targets are folders, ``route_to_folders`` needs a single pass.
    """
    unknown = df.filter(~F.coalesce(F.col(slug).isin(list(writers)), F.lit(False))).select(slug).head(1)
    if unknown:
        raise ValueError(f"unknown schema {unknown[0][0]}")
    for name, write in writers.items():
        write(df.filter(F.col(slug) == name).drop(slug))


def stream_context(
    df: DataFrame, *, source_type: str, source_slug: str, stream_set: str, update_method: str,
    stream: str | Column | None = None,
) -> DataFrame:
    """Add where each record came from; the stream defaults to the name of its file."""
    name = F.col("_metadata.file_name") if stream is None else (F.lit(stream) if isinstance(stream, str) else stream)
    return df.withColumns(
        {
            "_source_type": F.lit(source_type), "_source_slug": F.lit(source_slug),
            "_stream_set": F.lit(stream_set), "_stream": name, "_update_method": F.lit(update_method),
        }
    )


def sample_records(df: DataFrame, by: str | None, order: str, limit: int = SAMPLE_SIZE) -> DataFrame:
    """The first records of each schema. Tasks keep their own first records before the shuffle."""
    if by is None:
        return df.orderBy(order).limit(limit)
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")


def new_records_available(listing: DataFrame, state: DataFrame, on: Iterable[str] = ("stream",)) -> DataFrame:
    """Streams to read again: unknown ones, and those whose update hash is new or not known."""
    keys = list(on)
    seen = state.select(*keys, F.col("update_hash").alias("_seen"))
    return (
        listing.join(seen, keys, "left")
        .filter(F.col("_seen").isNull() | F.col("update_hash").isNull() | (F.col("_seen") != F.col("update_hash")))
        .drop("_seen")
    )


def byte_counts(df: DataFrame, text: str, by: Iterable[str] = ()) -> DataFrame:
    """Records and UTF-8 bytes of a text column."""
    return df.groupBy(*by).agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")
    )


def file_byte_counts(df: DataFrame) -> DataFrame:
    """Records and bytes per file, from the scan's own file metadata."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count("*").alias("records")
    )


def record_size(schema: T.StructType) -> Column:
    """Estimated bytes of a record: text 2 per character, booleans 4, numbers 8, nested summed."""

    def size(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return F.coalesce(F.length(value) * 2, F.lit(0))
        if isinstance(dtype, T.BooleanType):
            return F.when(value.isNotNull(), 4).otherwise(0)
        if isinstance(dtype, T.StructType):
            parts = [size(value.getField(f.name), f.dataType) for f in dtype.fields]
            return sum(parts[1:], parts[0]) if parts else F.lit(0)
        if isinstance(dtype, T.ArrayType):
            return F.coalesce(
                F.aggregate(value, F.lit(0), lambda s, x: s + size(x, dtype.elementType)), F.lit(0)
            )
        if isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.when(value.isNotNull(), 8).otherwise(0)
        raise ValueError(f"no size for {dtype.simpleString()}")

    parts = [size(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields]
    return sum(parts[1:], parts[0]).cast("bigint")
