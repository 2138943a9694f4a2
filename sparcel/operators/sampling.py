"""Content labels from a sample of the values that thins out as more of them have been tested.

Of every property and type the first ``FIRST`` values are tested; after ``t`` tests each further value is tested with a chance of
``1 / (t - FIRST + 2)``, so about ``sqrt(2 n)`` of ``n`` values are. The wait for the next test depends on the number of tests alone, so
the ranks to test are a schedule of gaps that can be drawn before any value is looked at. Values are ranked by counts of blocks of
``BLOCK`` records; only blocks that hold a scheduled rank are ranked record by record, and only scheduled values meet the detectors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.infer import possible_types
from sparcel.operators.labels import THRESHOLD, VALUE_DETECTORS, name_labels, typed_text
from sparcel.operators.profile import fields
from sparcel.session import written

# Fixed value: how many values are tested before the chance begins to fall.
FIRST = 101
BLOCK, CHUNK = 1024, 4096


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts only, so that a retried task draws the same."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def schedule(counts: DataFrame, seed: int = 0) -> DataFrame:
    """``(pair, rank, test)``: the ranks below ``n`` to test, for each of ``(pair, property, type, n)``.

    The k-th wait is geometric with chance ``1 / (k - FIRST + 2)``. Twice the square root of ``2 n`` waits nearly always pass ``n``;
    where they do not, as many more are drawn.
    """
    factor = 2
    while True:
        tests = F.lit(FIRST) + F.ceil(factor * F.sqrt(2 * F.greatest(F.col("n") - FIRST, F.lit(0)))) + 64 * factor
        drawn = counts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), tests)).alias("test"))
        chance = F.lit(1.0) / (F.col("test") - (FIRST - 2))
        wait = 1 + F.floor(F.log(1 - uniform(seed, F.col("property"), F.col("type"), F.col("test"))) / F.log(1 - chance))
        drawn = drawn.withColumn("wait", F.when(F.col("test") < FIRST, 1).otherwise(wait).cast("bigint"))
        order = Window.partitionBy("pair").orderBy("test").rowsBetween(Window.unboundedPreceding, 0)
        drawn = written(drawn.select("pair", "n", "test", (F.sum("wait").over(order) - 1).alias("rank")), "schedule")
        if drawn.groupBy("pair", "n").agg(F.max("rank").alias("last")).where("last < n").isEmpty():
            return drawn.where("rank < n").select("pair", "rank", "test")
        factor *= 2


def sampled_values(
    df: DataFrame, position: str, *, raw: Iterable[str] = (), columns: Iterable[str] | None = None, seed: int = 0
) -> DataFrame:
    """``(property, type, rank, test, position, value)``: the values to test, in the order of ``position`` (record numbers).

    A record without a position is not tested. Equal positions are in the order of their values.
    """
    spark = df.sparkSession
    names = [f for f in df.schema.fields if f.name != position and (columns is None or f.name in set(columns))]
    pairs: list[tuple[str, str, Column]] = []
    for field in fields(T.StructType(names), raw):
        if field.elements or isinstance(field.dtype, (T.StructType, T.ArrayType, T.MapType, T.NullType)):
            continue
        for kind in ("string", "integer", "number", "date") if field.raw else possible_types(field.dtype):
            pairs.append((field.name, kind, typed_text(field.column, field.dtype, field.raw, kind)))
    df = df.where(F.col(position).isNotNull())
    known = spark.createDataFrame([(i, p, k) for i, (p, k, _) in enumerate(pairs)], "pair int, property string, type string")
    block = F.floor(F.col(position) / BLOCK).alias("block")
    wide = df.groupBy(block).agg(*[F.count(text).alias(f"c{i}") for i, (_, _, text) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"c{i}").alias("n")) for i in range(len(pairs))])
    blocks = written(wide.select("block", F.inline(cells)).where("n > 0"), "blocks")
    # ranks before a block: of the chunks before its own, and of the blocks before it in its chunk
    blocks = blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = blocks.groupBy("pair", "chunk").agg(F.sum("n").alias("n"))
    chunks = chunks.select("pair", "chunk", before(Window.partitionBy("pair").orderBy("chunk")).alias("base"))
    blocks = blocks.withColumn("first", before(Window.partitionBy("pair", "chunk").orderBy("block")))
    blocks = blocks.join(chunks, ["pair", "chunk"]).select("pair", "block", "n", (F.col("first") + F.col("base")).alias("first"))
    totals = blocks.groupBy("pair").agg(F.sum("n").alias("n")).join(known, "pair")
    due = schedule(totals, seed).withColumn("span", F.floor(F.col("rank") / BLOCK))
    spans = F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))
    due = blocks.withColumn("span", F.explode(spans)).join(due, ["pair", "span"]).where("rank >= first AND rank < first + n")
    due = written(due.select("pair", "block", (F.col("rank") - F.col("first")).alias("place"), "rank", "test"), "due")
    rows = df.withColumn("_block", block).join(due.select(F.col("block").alias("_block")).distinct(), "_block", "left_semi")
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), text.alias("value")) for i, (_, _, text) in enumerate(pairs)])
    rows = rows.select(F.col("_block").alias("block"), F.col(position).alias("position"), F.inline(cells)).where("value IS NOT NULL")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("pair", "block").orderBy("position", "value")) - 1)
    return rows.join(due, ["pair", "block", "place"]).join(known, "pair").select("property", "type", "rank", "test", "position", "value")


def sample_content_labels(
    df: DataFrame, position: str, *, raw: Iterable[str] = (), columns: Iterable[str] | None = None, labels: Iterable[str] | None = None, seed: int = 0
) -> DataFrame:
    """``scan_content_labels`` on the sampled values: (property, type, label, counts, applied)."""
    chosen = [d for d in VALUE_DETECTORS if labels is None or d.label in set(labels)]
    values = sampled_values(df, position, raw=raw, columns=columns, seed=seed)
    hits = [F.count_if(F.col("type").isin(*d.types) & d.hit(F.col("value"))).alias(d.label) for d in chosen]
    found = values.groupBy("property", "type").agg(F.count("*").alias("tested"), *hits)
    named = [(n, k, x) for n, k in {(f.name, k) for f in fields(df.schema, raw) for k in ("string", "integer", "number", "date")} for x in name_labels(n, k) if labels is None or x in set(labels)]
    rows = F.array(*[F.struct(F.lit(d.label).alias("label"), F.col(d.label).alias("occurrence_count"), F.col("tested").alias("tested_count"), (F.col(d.label) / F.col("tested") > THRESHOLD).alias("applied")) for d in chosen])
    out = found.select("property", "type", F.inline(rows)).where("occurrence_count > 0")
    if named:
        by_name = df.sparkSession.createDataFrame(named, "property string, type string, label string")
        by_name = found.select("property", "type").join(by_name, ["property", "type"])
        out = out.unionByName(by_name.select("*", F.lit(1).cast("bigint").alias("occurrence_count"), F.lit(0).cast("bigint").alias("tested_count"), F.lit(True).alias("applied")))
    return out.select("property", "type", "label", "occurrence_count", "tested_count", "applied")
