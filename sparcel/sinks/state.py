"""Delivery state: how far each stream of a package has been written to a sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_KEY = ("catalog_slug", "package_slug", "major_version", "stream_set", "stream", "schema")


def upsert_state(state: DataFrame, changes: DataFrame, keys: tuple[str, ...] = STATE_KEY) -> DataFrame:
    """Newest row per key by ``updated_at``; a change wins over an older row of the same time."""
    rest = [c for c in state.columns if c not in keys]
    both = state.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "_side")).alias("s")
    return both.groupBy(*keys).agg(newest).select(*keys, "s.*")


def read_state(state: DataFrame, catalog: str, package: str, major: int) -> DataFrame:
    return state.filter(
        (F.col("catalog_slug") == catalog) & (F.col("package_slug") == package) & (F.col("major_version") == major)
    )


def state_of_delivery(
    delivered: DataFrame, by: tuple[str, ...], offset: str, received: Column, complete: bool, update_hash: Column | None = None
) -> DataFrame:
    """State rows for the records that were written. An interrupted run keeps no update hash."""
    hash_value = F.max(update_hash) if complete and update_hash is not None else F.lit(None).cast("string")
    return delivered.groupBy(*by).agg(
        F.max(offset).alias("stream_offset"), hash_value.alias("update_hash"), F.max(received).alias("updated_at")
    )


def state_from_batches(batches: DataFrame) -> DataFrame:
    """Per stream: the largest offset and the offset of each schema, with the earliest update.

    The list has one entry per schema of the stream, which its description bounds.
    """
    per_schema = batches.groupBy("stream_set", "stream", "schema").agg(
        F.max_by("last_offset", "updated_at").alias("last_offset"), F.max("last_offset").alias("top"),
        F.min("updated_at").alias("updated_at"),
    )
    return per_schema.groupBy("stream_set", "stream").agg(
        F.max("top").alias("stream_offset"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("schema", "last_offset")))).alias("schema_offsets"),
        F.min("updated_at").alias("updated_at"),
    )


class Published:
    """Numbered snapshots below a folder, published one after the other.

    A commit writes the whole next snapshot to a folder that readers do not look at, and publishes it by renaming it to its
    number, which fails if there is one. So neither a job that dies half-way nor two that commit at once show anything but whole
    snapshots. Older ones than the last ``keep`` are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def published(self) -> list[int]:
        """Numbers of the published snapshots; there are a few at most."""
        return sorted(int(n.removeprefix("snapshot-")) for n in self._names(self.path) if n.startswith("snapshot-"))

    def newest(self) -> int:
        return max(self.published(), default=-1)

    def publish(self, write: Callable[[str], None], after: int) -> int:
        """Publish what ``write`` puts in a folder as the snapshot after ``after``; fails if another writer was faster."""
        number, staged = after + 1, f"{self.path}/_staged-{uuid.uuid4().hex}"
        write(staged)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if number <= self.newest():
                raise ConcurrentCommit(f"snapshot {number} of {self.path} was published by another writer")
            context.rename(self._path(staged), self._path(f"{self.path}/snapshot-{number}"), options)
        except Py4JJavaError as error:
            self._fs.delete(self._path(staged), True)
            if "FileAlreadyExists" in str(error.java_exception):
                raise ConcurrentCommit(f"snapshot {number} of {self.path} was published by another writer") from error
            raise
        except ConcurrentCommit:
            self._fs.delete(self._path(staged), True)
            raise
        for old in self.published()[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/snapshot-{old}"), True)
        return number


class StateTable(Published):
    """Snapshots of the state below a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        super().__init__(spark, path, keep)
        self.schema = schema

    def read(self) -> DataFrame:
        number = self.newest()
        if number < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot-{number}")

    def commit(self, state: DataFrame, after: int | None = None) -> int:
        """Publish ``state`` as the snapshot after ``after`` (the newest)."""
        return self.publish(state.write.parquet, self.newest() if after is None else after)

    def upsert(self, changes: DataFrame, keys: tuple[str, ...], tries: int = 5) -> int:
        """Merge changes into the newest snapshot; merged again if another writer published one meanwhile."""
        for left in range(tries - 1, -1, -1):
            before = self.newest()
            try:
                return self.commit(upsert_state(self.read(), changes, keys), before)
            except ConcurrentCommit:
                if not left:
                    raise
        raise AssertionError("not reached")


class Delivery(Published):
    """Delivered rows and the state of their delivery, published together.

    Rows are written to a folder of their own first. A snapshot names the folders that count and holds the state, so one rename makes
    rows and offsets visible at once: a run that dies before it leaves a folder nobody reads, and the next run, which begins
    at the published offsets, delivers the same rows again. Readers go by the newest snapshot only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, state_schema: str, keys: tuple[str, ...] = STATE_KEY, keep: int = 2):
        super().__init__(spark, f"{path.rstrip('/')}/manifest", keep)
        self.data, self.schema, self.state_schema, self.keys = f"{path.rstrip('/')}/data", schema, state_schema, keys

    def _part(self, part: str, schema: str, number: int | None = None) -> DataFrame:
        number = self.newest() if number is None else number
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/snapshot-{number}/{part}")

    def state(self) -> DataFrame:
        return self._part("state", self.state_schema)

    def folders(self, number: int | None = None) -> list[str]:
        """The folders of a snapshot, in the order of their delivery; ``compact`` keeps them few."""
        return [r["folder"] for r in self._part("folders", "place bigint, folder string", number).orderBy("place").collect()]

    def read(self) -> DataFrame:
        """The delivered rows."""
        folders = self.folders()
        return self.spark.read.schema(self.schema).parquet(*[f"{self.data}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def _commit(self, folders: list[str], state: DataFrame, after: int) -> int:
        named = self.spark.createDataFrame(list(enumerate(folders)), "place bigint, folder string")

        def write(staged: str) -> None:
            named.coalesce(1).write.parquet(f"{staged}/folders")
            state.write.parquet(f"{staged}/state")

        return self.publish(write, after)

    def deliver(self, rows: DataFrame, state_of: Callable[[DataFrame], DataFrame], replace: bool = False) -> int:
        """Write ``rows`` and publish them with the state that ``state_of`` finds in what was written.

        ``replace`` starts the set anew, else the rows are added. Fails if another delivery was published meanwhile; nothing of
        this one is seen then.
        """
        before, folder = self.newest(), uuid.uuid4().hex
        rows.write.parquet(f"{self.data}/{folder}")
        changes = state_of(self.spark.read.schema(self.schema).parquet(f"{self.data}/{folder}"))
        return self._commit([folder] if replace else [*self.folders(before), folder], upsert_state(self.state(), changes, self.keys), before)

    def compact(self) -> int:
        """Put all delivered rows in one folder; the state stays."""
        before, folder = self.newest(), uuid.uuid4().hex
        self.read().write.parquet(f"{self.data}/{folder}")
        return self._commit([folder], self.state(), before)

    def sweep(self) -> int:
        """Remove folders that no kept snapshot names; not while a delivery runs."""
        named = {f for number in self.published() for f in self.folders(number)}
        stray = [n for n in self._names(self.data) if n not in named]
        for name in stray:
            self._fs.delete(self._path(f"{self.data}/{name}"), True)
        return len(stray)


class ConcurrentCommit(RuntimeError):
    """Another writer published the snapshot first."""
