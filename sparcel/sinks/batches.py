"""Batches of a stored package: numbering, upload checks, activation, reading.

A stream is identified by STREAM; the *batches* table adds ``batch``, ``last_offset``,
``is_default`` and ``updated_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAM = ("package", "major", "source_type", "source_slug", "stream_set", "stream", "schema")


def latest_batch(batches: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Newest batch of each stream."""
    rest = [c for c in batches.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.col("batch")).alias("b")
    return batches.groupBy(*keys).agg(newest).select(*keys, "b.*")


def default_batch(batches: DataFrame) -> DataFrame:
    """The batches that are served."""
    return batches.filter("is_default")


def batch_listing(batches: DataFrame, limit: int, offset: int = 0, **stream: object) -> DataFrame:
    """History of a stream (or of everything), newest first."""
    for key, value in stream.items():
        batches = batches.filter(F.col(key) == F.lit(value))
    return batches.orderBy(F.col("updated_at").desc(), F.col("batch").desc()).offset(offset).limit(limit)


def assign_batch(incoming: DataFrame, batches: DataFrame, new_batch: bool, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Add ``batch`` and ``_last``, the offset it was left at: a new batch starts before 0."""
    latest = latest_batch(batches, keys).select(*keys, F.col("batch").alias("_batch"), F.col("last_offset").alias("_left"))
    joined = incoming.join(latest, list(keys), "left")
    fresh = F.lit(new_batch) | F.col("_batch").isNull()
    return joined.withColumns(
        {
            "batch": F.when(fresh, F.coalesce(F.col("_batch"), F.lit(0)) + 1).otherwise(F.col("_batch")),
            "_last": F.when(fresh, F.lit(-1)).otherwise(F.coalesce(F.col("_left"), F.lit(-1))).cast("bigint"),
        }
    ).drop("_batch", "_left")


def check_offsets(assigned: DataFrame, offset: str = "_offset") -> DataFrame:
    """Fail the job on a record whose offset is not past the last one saved."""
    stale = F.col(offset) <= F.col("_last")
    message = F.concat(
        F.lit("offset ("), F.col(offset).cast("string"), F.lit(") must be greater than the last saved offset ("),
        F.col("_last").cast("string"), F.lit(")"),
    )
    checked = F.when(stale, F.raise_error(message).cast("bigint")).otherwise(F.col(offset))
    return assigned.withColumn(offset, checked).drop("_last")


def repeated_offsets(incoming: DataFrame, keys: tuple[str, ...] = STREAM, offset: str = "_offset") -> DataFrame:
    """Offsets that occur more than once in a stream. Grouped by offset, so no stream is one group."""
    return incoming.groupBy(*keys, offset).agg(F.count("*").alias("n")).filter("n > 1")


def check_schemas(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(schema) of the upload that the latest version does not describe."""
    return incoming.select("schema").distinct().join(known.select("schema"), "schema", "left_anti")


def batch_rows(uploaded: DataFrame, updated_at: Column, keys: tuple[str, ...] = STREAM, offset: str = "_offset") -> DataFrame:
    """Rows of the *batches* table for what was uploaded."""
    return uploaded.groupBy(*keys, "batch").agg(
        F.max(offset).alias("last_offset"), F.lit(False).alias("is_default"), F.max(updated_at).alias("updated_at")
    )


def upload_batch(
    incoming: DataFrame, batches: DataFrame, path: str, updated_at: Column, *, upload: str, known_schemas: DataFrame | None = None,
    new_batch: bool = True, keys: tuple[str, ...] = STREAM, offset: str = "_offset",
) -> DataFrame:
    """Check records and write them to the folder of this ``upload`` below ``path``; return the new batch table.

    The same upload run again replaces its own folder, so nothing is stored twice. Unknown schemas fail before anything is
    written; offsets that are not past the last saved one fail while it is written, and repeated ones before the batch table is
    returned, so a failed upload is never listed. Only the upload's own folder is read back (keys, offset and time).
    """
    spark = incoming.sparkSession
    if known_schemas is not None:
        unknown = [r[0] for r in check_schemas(incoming, known_schemas).limit(5).collect()]
        if unknown:
            raise ValueError(f"schemas that the latest version does not describe: {unknown}")
    uploaded = check_offsets(assign_batch(incoming, batches, new_batch, keys), offset)
    own = f"{path.rstrip('/')}/upload={upload}"
    uploaded.write.mode("overwrite").partitionBy("schema", "batch").parquet(own)
    written = spark.read.schema(uploaded.schema).parquet(own)
    twice = repeated_offsets(written, keys, offset).first()
    if twice is not None:
        raise ValueError(f"offset ({twice[offset]}) occurs {twice['n']} times in the upload; offsets must rise")
    rows = batch_rows(written, updated_at, keys, offset)
    kept = batches.join(rows, [*keys, "batch"], "left_anti")
    served = batches.filter("is_default").select(*keys, "batch", F.lit(True).alias("_served"))
    again = rows.join(served, [*keys, "batch"], "left").withColumn(
        "is_default", F.coalesce("_served", F.lit(False))
    ).drop("_served")
    return kept.unionByName(again)


def activate_batches(batches: DataFrame, committed: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """Serve the committed batches: the old flag of their streams is cleared, the new one set."""
    chosen = committed.select(*keys, F.col("batch").alias("_active"))
    joined = batches.join(chosen, list(keys), "left")
    flag = F.when(F.col("_active").isNull(), F.col("is_default")).otherwise(F.col("batch") == F.col("_active"))
    return joined.withColumn("is_default", flag).drop("_active")


def activation_log(batches: DataFrame, committed: DataFrame, keys: tuple[str, ...] = STREAM) -> DataFrame:
    """(stream, batch, prior_batch) of each change of the served batch."""
    prior = default_batch(batches).select(*keys, F.col("batch").alias("prior_batch"))
    return committed.select(*keys, "batch").join(prior, list(keys), "left")


def scan_batches(
    records: DataFrame, batches: DataFrame, start: int | None = None, keys: tuple[str, ...] = STREAM, offset: str = "_offset"
) -> DataFrame:
    """Records of the served batches from offset ``start`` on.

    The offset filter reaches the scan; the join on the partition columns prunes its folders.
    """
    if start is not None:
        records = records.filter(F.col(offset) >= start)
    return records.join(default_batch(batches).select(*keys, "batch"), [*keys, "batch"], "left_semi")
