"""Continuous delivery with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sparcel.operators.profile import plan
from sparcel.operators.projection import SCHEMA, route_to_folders

# Back-off after a source ended, and the default micro-batch.
BACKOFF_FACTOR, BACKOFF_LIMIT = 10, 30.0
BATCH_RECORDS, BATCH_MILLISECONDS = 1000, 100


def back_off(uptime_seconds: float) -> float:
    """Seconds to wait before an ended stream is opened again."""
    return min(BACKOFF_FACTOR * uptime_seconds, BACKOFF_LIMIT)


def batch_options(files: int | None = None, offsets: int | None = None) -> dict[str, str]:
    """Rate limits of a streaming source."""
    options = {}
    if files is not None:
        options["maxFilesPerTrigger"] = str(files)
    if offsets is not None:
        options["maxOffsetsPerTrigger"] = str(offsets)
    return options


def trigger(available_now: bool = False, milliseconds: int = BATCH_MILLISECONDS) -> dict[str, object]:
    return {"availableNow": True} if available_now else {"processingTime": f"{milliseconds} milliseconds"}


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**batch_options(files=files_per_batch)).load(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to files; the sink's own log makes every batch count once."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger(available_now)).start()
    )


def ingest_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch to its own folder: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger(available_now)).start()
    )


def stream_route(
    stream: DataFrame, path: str, schemas: list[str], checkpoint: str, slug: str = SCHEMA, available_now: bool = True
) -> StreamingQuery:
    """A folder per batch and schema, from a single stream that carries all schemas."""

    def write(batch: DataFrame, number: int) -> None:
        route_to_folders(batch, schemas, f"{path}/batch_id={number}", "overwrite", slug)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger(available_now)).start()
    )


#: Update folders of a running profile before they are put together.
COMPACT = 20


def stream_profile(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Running profile: one streaming aggregate, whose totals the state store keeps from batch to batch.

    Every batch gives the new totals of the groups it touched (update mode; one group without ``by``), a few rows each, which are
    written to a folder of the batch's number; a batch that is run again replaces its folder. The newest row of each group,
    property and type counts. Every ``COMPACT`` batches the newest rows are put in one folder and the older folders go.
    """
    made = plan(stream, **options)
    spark, widen = stream.sparkSession, options.get("widen", True)

    def write(wide: DataFrame, number: int) -> None:
        rows = made.long(wide, widen)
        if number % COMPACT == 0 and number:
            older = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])).parquet(path).filter(F.col("batch") < number)
            rows = _newest([rows.withColumn("batch", F.lit(number).cast("bigint")), older], made.by).drop("batch")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % COMPACT == 0:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            for status in files.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith("batch=") and int(name.removeprefix("batch=")) < number:
                    files.delete(status.getPath(), True)

    return (
        made.wide().writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger(available_now)).start()
    )


def _newest(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows of the newest batch of each group; a batch gives all properties and types of the groups it touched."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    newest = F.max("batch").over(Window.partitionBy(*(by or [F.lit(0)])))
    return rows.withColumn("_newest", newest).filter("batch = _newest").drop("_newest")


def newest_profile(spark: SparkSession, path: str, by: Iterable[str] = ()) -> DataFrame:
    """The running profile, as of the last batch of each group."""
    return _newest([spark.read.parquet(path)], list(by)).drop("batch")


def run_until_stopped(start: Callable[[], StreamingQuery], runs: int, sleep: Callable[[float], None] = time.sleep) -> list[float]:
    """Open a stream again after it ended, waiting longer the longer it ran. Returns the waits."""
    waits = []
    for _ in range(runs):
        began = time.monotonic()
        start().awaitTermination()
        waits.append(back_off(time.monotonic() - began))
        sleep(waits[-1])
    return waits


def inspect_for(query: StreamingQuery, seconds: float) -> bool:
    """Let an inspection run for a time budget; False when it was cut short."""
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return bool(done)


def count_precision(finished: bool) -> str:
    return "EXACT" if finished else "GREATER_THAN"


def update_hash_after(finished: bool, update_hash: str | None) -> str | None:
    """An interrupted run keeps its data but no hash, so the next run reads again."""
    return update_hash if finished else None


PROGRESS = "query string, batch bigint, records bigint, rate double, at string"


class ProgressRows(StreamingQueryListener):
    """Appends (query, batch, records, rate, time) of every micro-batch to a table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond), p.timestamp)
        self.spark.createDataFrame([row], PROGRESS).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """A row for each batch; one that ran again counts with its last run."""
        rows = self.spark.read.schema(PROGRESS).parquet(self.path)
        newest = F.max_by(F.struct("records", "rate", "at"), "at").alias("p")
        return rows.groupBy("query", "batch").agg(newest).select("query", "batch", "p.*")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress_rows(query: StreamingQuery) -> list[dict[str, float]]:
    """(batch, records, seconds) of the micro-batches that a query reports; it keeps the newest 100 itself, a ``ProgressRows`` table all."""
    return [
        {"batch": p["batchId"], "records": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000}
        for p in query.recentProgress
    ]


def delivery_progress(df: DataFrame, by: list[str], seconds: float, expected_records: str, byte_count) -> DataFrame:
    """Records, bytes, rate, percent and seconds left of a delivery, per ``by``."""
    counted = df.groupBy(*by).agg(
        F.count("*").alias("records"), F.sum(byte_count).cast("bigint").alias("bytes"),
        F.max(expected_records).alias("expected"),
    )
    rate = F.col("records") / F.lit(float(seconds))
    return counted.select(
        *by, "records", "bytes", F.round(rate, 2).alias("records_per_second"),
        F.round(100.0 * F.col("records") / F.col("expected"), 2).alias("percent"),
        F.round((F.col("expected") - F.col("records")) / rate, 1).alias("seconds_left"),
    )
