"""Continuous delivery, run to the end of what is there and compared with the batch result."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from sparcel.checks.base import register, table
from sparcel.operators import profile as P
from sparcel.operators.projection import SCHEMA, after_offset
from sparcel.session import scratch
from sparcel.sinks import state as D
from sparcel.sources.files import list_files
from sparcel.streaming import ingest as S
from sparcel.streaming.inspection import inspect_files


def _event_files(spark, sf):
    """The events as several files, and the schema to read them with."""
    path, events = scratch(spark, "events"), table(spark, sf, "events")
    events.repartitionByRange(4, "event_id").write.parquet(path)
    return path, events.schema


def _stream(spark, sf, files_per_batch=1):
    path, schema = _event_files(spark, sf)
    return S.read_files(spark, path, schema, files_per_batch=files_per_batch)


@register("continuous_ingest", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def continuous_ingest(spark, sf):
    stream, target = _stream(spark, sf), scratch(spark, "ingested")
    S.ingest(stream, target, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target)


@register("micro_batching", "SELECT event_type, count(*) AS n, TRUE AS several_batches FROM events GROUP BY 1")
def micro_batching(spark, sf):
    stream, target = _stream(spark, sf), scratch(spark, "batches")
    S.ingest_batches(stream, target, scratch(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(target)
    several = rows.select("batch_id").distinct().count() > 1
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("several_batches", F.lit(several))


@register("resume_offsets", "SELECT event_id, event_type FROM events")
def resume_offsets(spark, sf):
    """Two runs of one delivery: the second only brings what the first had not seen."""
    path, schema = _event_files(spark, sf)
    target, checkpoint = scratch(spark, "resumed"), scratch(spark, "checkpoint")
    late = scratch(spark, "late")
    rows = spark.read.schema(schema).parquet(path)
    middle = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    rows.filter(F.col("event_id") <= middle).write.parquet(late)
    S.ingest_batches(S.read_files(spark, late, schema), target, checkpoint).awaitTermination()
    rows.filter(F.col("event_id") > middle).write.mode("append").parquet(late)
    S.ingest_batches(S.read_files(spark, late, schema), target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("event_id", "event_type")


DELIVERED = "stream string, stream_offset bigint, update_hash string, updated_at timestamp"


def _deliver(store, available, state_of=None):
    last = store.state().agg(F.max("stream_offset")).first()[0]
    batch = after_offset(available, last, "event_id").select("event_id", "event_type", "ts", "props")
    store.deliver(batch, state_of or (lambda rows: D.state_of_delivery(
        rows.withColumn("stream", F.lit("events")), ("stream",), "event_id", F.col("ts").cast("timestamp"), complete=True, update_hash=F.col("props"))))


def _dies(rows):
    raise InterruptedError("between the rows and their offsets")


@register("incremental_delivery", "SELECT event_id, event_type FROM events")
def incremental_delivery(spark, sf):
    """Rows and offsets published together: a run that dies after its rows were written is run again, and none is there twice."""
    events = table(spark, sf, "events")
    store = D.Delivery(spark, scratch(spark, "delivered"), "event_id bigint, event_type string, ts timestamp, props string", DELIVERED, ("stream",))
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    _deliver(store, events.filter(F.col("event_id") <= middle))
    with contextlib.suppress(InterruptedError):
        _deliver(store, events, _dies)
    _deliver(store, events)
    _deliver(store, events)
    store.compact()
    return store.read().select("event_id", "event_type")


@register("stream_route", "SELECT event_type AS schema, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def stream_route(spark, sf):
    names = ["view", "click", "purchase", "signup", "error"]
    stream, target = _stream(spark, sf, files_per_batch=2).withColumnRenamed("event_type", SCHEMA), scratch(spark, "routed")
    S.stream_route(stream, target, names, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target).groupBy(F.col(SCHEMA).alias("schema")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


_SEEN = ", ".join(f"strftime({f}(ts), '%Y-%m-%d %H:%M:%S.%f') AS {n}_seen" for f, n in (("min", "first"), ("max", "last")))


@register(
    "stream_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS property, '{kind}' AS type, count({c}) AS n, {low} AS low, {high} AS high, {shortest} AS shortest, {longest} AS longest, {_SEEN} FROM events WHERE {where}"
        for c, kind, low, high, shortest, longest, where in (
            *[(c, k, f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", "NULL", "NULL", "TRUE") for c, k in (("event_id", "integer"), ("user_id", "integer"), ("value", "number"))],
            *[(c, "string", "NULL", "NULL", f"min(length({c}))", f"max(length({c}))", "TRUE") for c in ("event_type", "props")],
            ("stamp", "date-time", "CAST(min(epoch_us(ts)) / 1e6 AS DOUBLE)", "CAST(max(epoch_us(ts)) / 1e6 AS DOUBLE)", "NULL", "NULL", "date_trunc('day', ts) <> ts"),
        )
    ).replace("count(stamp)", "count(ts)"),
)
def stream_profile(spark, sf):
    """All six columns of a stream that is stopped in the middle and goes on; the totals live in the state store."""
    path, schema = _event_files(spark, sf)
    files, late = spark.read.schema(schema).parquet(path), scratch(spark, "late")
    target, checkpoint = scratch(spark, "profile"), scratch(spark, "checkpoint")
    middle = files.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        files.filter(part).write.mode("append").parquet(late)
        stream = S.read_files(spark, late, schema, files_per_batch=1).withColumn("stamp", F.col("ts"))
        S.stream_profile(stream, target, checkpoint, received="ts").awaitTermination()
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return S.newest_profile(spark, target).filter("property <> 'stamp' OR type = 'date-time'").select(
        "property", "type", F.col("record_count").alias("n"), F.coalesce("number_min", seconds("date_min")).alias("low"), F.coalesce("number_max", seconds("date_max")).alias("high"),
        F.col("string_min_length").alias("shortest"), F.col("string_max_length").alias("longest"), F.date_format("first_seen", form).alias("first_seen"), F.date_format("last_seen", form).alias("last_seen"),
    )


def _lineitem_files(spark, sf):
    """``lineitem`` as eight files, with the hash of each."""
    path = scratch(spark, "lineitem")
    table(spark, sf, "lineitem").repartitionByRange(8, "l_orderkey").write.parquet(path)
    listing = list_files(spark, path).filter(F.col("name").endswith(".parquet")).select("file", "update_hash")
    return listing, sorted(r["file"] for r in listing.collect()), table(spark, sf, "lineitem").schema


class _Silent:
    """An alarm that never goes off."""

    def __init__(self, *_):
        pass

    def start(self):
        pass

    cancel = start


def _ticks():
    """A clock that goes one second a look, so a budget is a number of groups on any machine."""
    now = iter(range(1_000_000))
    return {"clock": lambda: next(now), "alarm": _Silent}


@register(
    "stop_early",
    """WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT run, precision, hashes, fewer, CASE WHEN run = 2 THEN n END AS n FROM n,
      (VALUES (1, 'GREATER_THAN', 0, TRUE), (2, 'EXACT', 8, FALSE)) v(run, precision, hashes, fewer)""",
)
def stop_early(spark, sf):
    """A run whose budget is over after three groups of files keeps what it saw and no hash; the next one reads everything."""
    listing, files, schema = _lineitem_files(spark, sf)
    total, out = spark.read.schema(schema).parquet(*files).count(), None
    for run, budget in ((1, 3.5), (2, 1e6)):
        state_path = scratch(spark, f"run-{run}")
        seen = inspect_files(spark, files, lambda some: spark.read.schema(schema).parquet(*some), state_path, budget, **_ticks(), columns=["l_quantity"])
        hashes = seen.state(listing).filter("update_hash IS NOT NULL").count()
        row = seen.counts().select(
            F.lit(run).alias("run"), F.col("record_count_precision").alias("precision"), F.lit(hashes).alias("hashes"), (F.col("inspected_count") < total).alias("fewer"),
            F.when(F.lit(run == 2), F.col("inspected_count")).alias("n"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@register("inspection_cut", "SELECT 'lineitem' AS stream, 'GREATER_THAN' AS precision, TRUE AS within FROM lineitem LIMIT 1")
def inspection_cut(spark, sf):
    """An inspection that is cut short has seen some records, but fewer than there are."""
    _, files, schema = _lineitem_files(spark, sf)
    seen = inspect_files(spark, files, lambda some: spark.read.schema(schema).parquet(*some), scratch(spark, "cut"), 2.5, **_ticks(), columns=["l_quantity"])
    n, total = F.col("inspected_count"), spark.read.schema(schema).parquet(*files).count()
    return seen.counts().select(F.lit("lineitem").alias("stream"), F.col("record_count_precision").alias("precision"), ((n > 0) & (n < total)).alias("within"))


@register(
    "inspection_profile",
    """SELECT 'l_quantity' AS property, count(l_quantity) AS n, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem
    UNION ALL SELECT 'l_orderkey', count(l_orderkey), CAST(min(l_orderkey) AS DOUBLE), CAST(max(l_orderkey) AS DOUBLE) FROM lineitem""",
)
def inspection_profile(spark, sf):
    """The groups' profiles put together are the profile of the whole."""
    _, files, schema = _lineitem_files(spark, sf)
    seen = inspect_files(spark, files, lambda some: spark.read.schema(schema).parquet(*some), scratch(spark, "run"), 3600, columns=["l_quantity", "l_orderkey"])
    return seen.profile().select("property", F.col("record_count").alias("n"), F.col("number_min").alias("low"), F.col("number_max").alias("high"))


@register("inspection_budget", "SELECT 'events' AS stream, count(*) AS inspected_count, 'EXACT' AS precision FROM events")
def inspection_budget(spark, sf):
    """An inspection that ends within its budget counts exactly."""
    target = scratch(spark, "inspected")
    query = S.ingest(_stream(spark, sf, files_per_batch=4), target, scratch(spark, "checkpoint"))
    finished = S.inspect_for(query, 600)
    return spark.read.parquet(target).agg(F.count("*").alias("inspected_count")).select(
        F.lit("events").alias("stream"), "inspected_count", F.lit(S.count_precision(finished)).alias("precision")
    )


@register(
    "delivery_progress",
    """SELECT event_type, count(*) AS records, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, 100.0 AS percent, 0.0 AS seconds_left, TRUE AS moving,
      (SELECT count(*) FROM events) AS reported FROM events GROUP BY 1""",
)
def delivery_progress(spark, sf):
    """Progress of a delivery that ran: its seconds and records come from the running stream's reports."""
    target = scratch(spark, "delivered")
    query = S.ingest(_stream(spark, sf), target, scratch(spark, "checkpoint"))
    query.awaitTermination()
    reports = S.progress_rows(query)
    seconds = max(0.001, sum(r["seconds"] for r in reports))
    expected = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("expected"))
    delivered = spark.read.parquet(target).join(expected, "event_type")
    rows = S.delivery_progress(delivered, ["event_type"], seconds, "expected", F.octet_length("props"))
    return rows.select(
        "event_type", "records", "bytes", "percent", "seconds_left", (F.col("records_per_second") > 0).alias("moving"),
        F.lit(sum(r["records"] for r in reports)).cast("bigint").alias("reported"),
    )


@register("stream_batch_profile_equal", "SELECT 0 AS differing, count(*) > 0 AS profiled FROM events")
def stream_batch_profile_equal(spark, sf):
    """The running profile of a stream is the profile of the whole."""
    target = scratch(spark, "profile")
    columns = ["event_id", "ts", "user_id", "value", "event_type", "props"]
    S.stream_profile(_stream(spark, sf), target, scratch(spark, "checkpoint"), columns=columns).awaitTermination()
    streamed, whole = S.newest_profile(spark, target), P.profile(table(spark, sf, "events"), columns=columns)
    differing = streamed.exceptAll(whole).unionByName(whole.exceptAll(streamed))
    return differing.agg(F.count("*").cast("int").alias("differing")).withColumn("profiled", F.lit(whole.count() > 0))


