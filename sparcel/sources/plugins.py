"""Sources by name and by address.

``SyntheticSource`` is a data source of its own: batch and stream readers with partitions, offsets and pushed-down ranges, that any
``spark.read.format`` or ``readStream.format`` finds after ``register``. ``Sources`` tells from an address which source reads it, as the
scans of this package do for files, tables and synthetic records; others can be added.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from sparcel.session import ship
from sparcel.sources.delimited import scan_csv
from sparcel.sources.nested import scan_json
from sparcel.sources.synthetic import WORDS

#: Records of a partition and of a micro-batch, and rows a reader makes at a time.
PARTITION, BATCH, ROWS = 1 << 20, 100_000, 10_000
TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "date": "date"}


def attribute_value(kind: str, number: int, seed: int) -> object:
    """The value that ``synthetic.attribute`` gives a record."""
    draw = int(hashlib.md5(f"{seed}-{number}".encode()).hexdigest()[:8], 16) / 2.0**32
    if kind in WORDS:
        return WORDS[kind][int(draw * len(WORDS[kind]))]
    if kind == "integer":
        return int(draw * 100_000)
    if kind == "number":
        return float(Decimal(repr(draw * 1000)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    if kind == "boolean":
        return draw < 0.5
    if kind == "date":
        return dt.date(2020, 1, 1) + dt.timedelta(days=int(draw * 1000))
    if kind == "email":
        return f"{str(attribute_value('first_name', number, seed)).lower()}{number}@example.org"
    raise ValueError(f"unknown attribute {kind}")


@dataclass
class Span(InputPartition):
    """Records from ``first`` up to, not including, ``stop``."""

    first: int
    stop: int


def _spans(first: int, stop: int, size: int) -> list[Span]:
    return [Span(at, min(at + size, stop)) for at in range(first, stop, size)]


class SyntheticSource(DataSource):
    """Seeded records 0 to ``count``: options ``count``, ``attributes`` (``home=city,amount=integer``), ``seed``, ``partition`` and, for
    streams, ``batch`` (records of a micro-batch at most) and ``batches``: all records take no more micro-batches than that, so that
    those of a large ``count`` are larger than ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "sparcel_synthetic"

    def attributes(self) -> dict[str, str]:
        return dict(x.strip().split("=", 1) for x in self.options.get("attributes", "").split(",") if x.strip())

    def number(self, option: str, default: int) -> int:
        value = int(self.options.get(option, default))
        if value < 0 or (value == 0 and option != "count" and option != "seed"):
            raise ValueError(f"{option} must be positive")
        return value

    def schema(self) -> str:
        for name, kind in self.attributes().items():
            if kind not in WORDS and kind not in TYPES and kind != "email":
                raise ValueError(f"unknown attribute {kind} of {name}")
        return ", ".join(["_offset bigint", *[f"`{n}` {TYPES.get(k, 'string')}" for n, k in self.attributes().items()]])

    def reader(self, schema) -> DataSourceReader:
        return SyntheticReader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SyntheticStream(self)

    def rows(self, span: Span) -> Iterator[pa.RecordBatch]:
        kinds, seed = self.attributes(), self.number("seed", 0)
        types = {"integer": pa.int64(), "number": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}
        for at in range(span.first, span.stop, ROWS):
            numbers = range(at, min(at + ROWS, span.stop))
            columns = [pa.array(numbers, pa.int64())]
            columns += [pa.array([attribute_value(k, n, seed + i) for n in numbers], types.get(k, pa.string())) for i, k in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["_offset", *kinds])


class SyntheticReader(DataSourceReader):
    """Ranges of offsets are pushed down, so records outside them are never made."""

    def __init__(self, source: SyntheticSource):
        self.source, self.first, self.stop = source, 0, source.number("count", 0)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("_offset",) or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.stop = max(self.first, value), min(self.stop, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.stop = min(self.stop, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Span]:
        return _spans(self.first, self.stop, self.source.number("partition", PARTITION)) or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition)


class SyntheticStream(DataSourceStreamReader):
    """Offsets are record numbers; a micro-batch goes on where the last one ended, after a restart too."""

    def __init__(self, source: SyntheticSource):
        self.source, self.seen = source, 0
        self.size = source.number("batch", BATCH)
        if "batches" in source.options:
            self.size = max(self.size, -(-source.number("count", 0) // source.number("batches", 1)))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        self.seen = min(self.seen + self.size, self.source.number("count", 0))
        return {"next": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.seen = max(self.seen, end["next"])
        return _spans(start["next"], end["next"], self.source.number("partition", PARTITION))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.source.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make the sources known by their names, and let them see filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SyntheticSource)


@dataclass(frozen=True)
class Description:
    """A kind of source: its name, the addresses it reads, and how."""

    kind: str
    display_name: str
    address: str
    open: Callable[..., DataFrame]

    def supports(self, uri: str) -> bool:
        return re.search(self.address, uri, re.IGNORECASE) is not None


def _synthetic(spark: SparkSession, uri: str, **options: object) -> DataFrame:
    register(spark)
    given = re.fullmatch(r"synthetic://(\d+)(?:\?(.*))?", uri)
    if not given:
        raise ValueError(f"no number of records in {uri}")
    pairs: Mapping[str, str] = dict(x.split("=", 1) for x in (given[2] or "").split("&") if x)
    return spark.read.format(SyntheticSource.name()).options(count=given[1], attributes=",".join(f"{k}={v}" for k, v in pairs.items()), **options).load()


_PACKED = r"(?:\.(?:gz|bz2|zst))?/?$"
BUILT_IN = (
    Description("synthetic", "Synthetic records", r"^synthetic://", _synthetic),
    Description("table", "Catalog table", r"^table://", lambda spark, uri, **options: spark.read.options(**options).table(uri.removeprefix("table://"))),
    Description("csv", "Delimited text", r"\.(?:csv|tsv|psv|tab)" + _PACKED, lambda spark, uri, **options: scan_csv(spark, uri, **options)),
    Description("json", "JSON", r"\.json" + _PACKED, lambda spark, uri, **options: scan_json(spark, uri, **options)),
    Description("jsonl", "JSON lines", r"\.(?:jsonl|ndjson)" + _PACKED, lambda spark, uri, **options: scan_json(spark, uri, lines=True, **options)),
    Description("parquet", "Parquet", r"\.parquet/?$", lambda spark, uri, **options: spark.read.options(**options).parquet(uri)),
)


class Sources:
    """Descriptions in the order they are asked; added ones come first."""

    def __init__(self, *added: Description):
        self.known = [*added, *BUILT_IN]

    def add(self, description: Description) -> None:
        self.known.insert(0, description)

    def of(self, uri: str) -> Description:
        for description in self.known:
            if description.supports(uri):
                return description
        raise ValueError(f"no source reads {uri}")

    def open(self, spark: SparkSession, uri: str, **options: object) -> DataFrame:
        return self.of(uri).open(spark, uri, **options)
