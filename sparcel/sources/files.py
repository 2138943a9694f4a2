"""File sets: listing, format by file, names, per-file streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parser by extension, first match wins.
EXTENSIONS = (
    ("gzip", r"\.(?:gz|gzip)$"),
    ("bzip2", r"\.(?:bz2|bzip2)$"),
    ("zip", r"\.zip$"),
    ("tar", r"\.tar$"),
    ("csv", r"\.(?:csv|tsv|psv|tab)$"),
    ("json", r"\.(?:json|jsonl|ndjson)$"),
    ("xml", r"\.xml$"),
    ("avro", r"\.avro$"),
    ("xlsx", r"\.(?:xlsx|xls)$"),
    ("parquet", r"\.parquet$"),
)
# Leading bytes of the formats that have any.
MAGIC = (
    ("gzip", "1F8B"), ("bzip2", "425A68"), ("zip", "504B0304"), ("avro", "4F626A01"), ("parquet", "50415231"),
    ("xml", "3C3F786D6C"),
)


def format_by_name(name: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in EXTENSIONS:
        chain = chain.when(name.rlike("(?i)" + pattern), kind)
    return chain


def format_by_content(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, magic in MAGIC:
        chain = chain.when(head.startswith(magic), kind)
    return chain


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, directory, bytes, update_hash): one stream per file. No content is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return listing.select(
        F.col("path").alias("file"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.regexp_replace("path", "/[^/]*$", "").alias("directory"),
        F.col("length").alias("bytes"),
        F.concat_ws("-", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string")).alias("update_hash"),
    )


def route_files(spark: SparkSession, paths: str | list[str], sniff: bool = False) -> DataFrame:
    """The listing with a ``format`` per file; ``sniff`` looks into files without a known name."""
    listing = list_files(spark, paths).withColumn("format", format_by_name(F.col("name")))
    if not sniff:
        return listing
    # the reader drops the files with a known name by their path, before it opens any
    known = "|".join(pattern for _, pattern in EXTENSIONS)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = contents.filter(~F.col("_metadata.file_name").rlike(f"(?i)(?:{known})"))
    kinds = found.select(F.col("path").alias("file"), format_by_content(F.col("content")).alias("_sniffed"))
    return listing.join(kinds, "file", "left").withColumn("format", F.coalesce("format", "_sniffed")).drop("_sniffed")


def stream_set_names(listing: DataFrame, extensions: Iterable[str] = ("csv", "tsv", "json", "xml", "parquet")) -> DataFrame:
    """Name of the file set in each directory: what its file names have in common.

    Names are compared with the first one position by position; only the positions that
    differ are grouped, so no list of names is ever collected.
    """
    bare = F.col("name")
    for extension in extensions:
        bare = F.regexp_replace(bare, rf"(?i)\.{extension}$", "")
    names = listing.select("directory", bare.alias("bare")).distinct()
    first = names.groupBy("directory").agg(F.min_by("bare", F.struct(F.lower("bare"), "bare")).alias("first"))
    pairs = names.join(first, "directory")
    shared = F.least(F.length("bare"), F.length("first"))
    positions = F.filter(
        F.sequence(F.lit(1), F.greatest(shared, F.lit(1))),
        lambda i: F.substr("bare", i, F.lit(1)) != F.substr("first", i, F.lit(1)),
    )
    differing = (
        pairs.select("directory", F.explode(positions).alias("i")).distinct()
        .groupBy("directory").agg(F.collect_set("i").alias("at"))
    )
    starred = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("first"), F.lit(1))),
            lambda i: F.when(F.array_contains("at", i), "*").otherwise(F.substr("first", i, F.lit(1))),
        ),
        "",
    )
    one_star_less = F.regexp_replace(F.regexp_replace(starred, r"^([^*]*)\*", "$1"), r"^(?i)[^a-z0-9]*", "")
    return (
        first.join(differing, "directory", "left")
        .withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
        .select("directory", F.regexp_replace(one_star_less, r"(?i)[^a-z0-9]*$", "").alias("stream_set"))
    )


def multi_file_scan(read: Callable[[], DataFrame]) -> DataFrame:
    """A file scan with each file as one stream: its name, size and update hash."""
    df = read()
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("_stream"),
        F.col("_metadata.file_size").alias("_bytes"),
        F.concat_ws(
            "-", F.col("_metadata.file_size").cast("string"),
            F.unix_millis("_metadata.file_modification_time").cast("string"),
        ).alias("_update_hash"),
    )


def object_store_url(bucket: str, key: str) -> str:
    return f"s3a://{bucket}/{key.lstrip('/')}"
