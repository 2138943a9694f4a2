"""Delimited text to text cells with the record's offset in its file."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.text import WS
from sparcel.session import written

# Delimiter by file extension.
DELIMITERS = {"csv": ",", "tsv": "\t", "psv": "|", "tab": "\t"}


def delimiter_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    for suffix in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(suffix)
    return DELIMITERS.get(name.rsplit(".", 1)[-1], ",")


def header_names(cells: Iterable[str]) -> list[str]:
    """Trimmed column names; blank ones are numbered and repeated ones are told apart."""
    names: list[str] = []
    for number, cell in enumerate(cells):
        name = cell.replace("\ufeff", "").strip() or f"Column{number}"
        names.append(name if name not in names else f"{name}_{number}")
    return names


def _cells(record: str, delimiter: str, quote: str) -> list[str]:
    return next(csv.reader(io.StringIO(record.lstrip("﻿")), delimiter=delimiter, quotechar=quote, skipinitialspace=True), [])


class _Grammar:
    """How cells are told apart: a quote opens a cell only at its start (after white space), and two of them inside stand for one."""

    def __init__(self, delimiter: str, quote: str):
        self.quote, q, d = quote, re.escape(quote), re.escape(delimiter)
        self.delimiter = delimiter
        inside, start = rf"(?:[^{q}]++|{q}{q})*+", rf"{WS}*+(?={q})" if delimiter not in "\t " else ""
        quoted, plain = rf"{start}{q}{inside}{q}[^{d}]*+", rf"(?!{start}{q})[^{d}]*+"
        self.cell = rf"(?:^|(?<={d}))(?:{quoted}|{plain})(?={d}|$)"
        self.done = rf"^(?:(?:{quoted}|{plain}){d})*+"
        self.open = rf"^{start}{q}{inside}$"
        self.close, self.tail = rf"^{inside}{q}", rf"^{inside}{q}[^{d}]*+(?:{d}|$)"

    def count(self, text: Column) -> Column:
        """Number of cells of a record; only records with quotes need more than counting delimiters."""
        plain = F.length(text) - F.length(F.replace(text, F.lit(self.delimiter), F.lit(""))) + 1
        return F.when(F.contains(text, F.lit(self.quote)), F.regexp_count(text, F.lit(f"(?s){self.cell}"))).otherwise(plain)

    def ends_inside(self, line: Column, begun_inside: bool) -> Column:
        """Whether a line that begins outside (or inside) a quoted cell ends inside one."""
        if not begun_inside:
            return F.contains(line, F.lit(self.quote)) & F.regexp_replace(line, self.done, "").rlike(self.open)
        rest = self.ends_inside(F.regexp_replace(line, self.tail, ""), False)
        return ~F.contains(line, F.lit(self.quote)) | ~line.rlike(self.close) | rest


def _lines(spark: SparkSession, paths: list[str], ending: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("lineSep", ending) if ending else reader).text(paths)
    text = F.when(F.startswith("value", F.lit("﻿")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    return lines.select(text.alias("_text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


#: Splits of a scan that are few enough to be sent to every executor (about 100 bytes each).
FEW_SPLITS = 200_000


def _on_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with what is known of their split, one small row for each."""
    splits = splits.withColumnsRenamed({"_file": "_of", "_block": "_split"})
    if splits.count() <= FEW_SPLITS:
        splits = F.broadcast(splits)
    return df.join(splits, (F.col("_file") == F.col("_of")) & (F.col("_block") == F.col("_split"))).drop("_of", "_split")


def _starts(df: DataFrame, place: str, *more: Column) -> DataFrame:
    """For each split with rows: ``_shift``, from places in the task to places in the file, and further aggregates."""
    splits = df.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min(place).alias("_first"), *more)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return written(splits.withColumn("_shift", F.col("_before") - F.col("_first")).drop("_n", "_first"), "splits")


def _without_preamble(lines: DataFrame, header_row: int | None) -> DataFrame:
    if not header_row:
        return lines
    lines = lines.withColumn("_line", F.monotonically_increasing_id())
    return _on_split(lines, _starts(lines, "_line").drop("_before")).where(F.col("_line") + F.col("_shift") >= header_row).drop("_line", "_shift")


BLANK = f"^{WS}*$"


def _line_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every line a record: ``(_file, _at, _text)`` and the first record of each file.

    A scan deals out its splits alike whenever it is run, so the places that a first, counting pass saw hold in the second.
    """
    rows = lines.where(~F.col("_text").rlike(BLANK)).withColumn("_place", F.monotonically_increasing_id())
    splits = _starts(rows, "_place", F.min_by("_text", "_place").alias("_head"))
    heads = splits.where("_before = 0").select("_file", "_head")
    return _on_split(rows, splits.select("_file", "_block", "_shift")).select("_file", (F.col("_place") + F.col("_shift")).alias("_at"), "_text"), heads


def _quoted_records(lines: DataFrame, grammar: _Grammar) -> tuple[DataFrame, DataFrame]:
    """Records of one or more lines: ``(_file, _at, _text)`` and the first record of each file.

    A line turns "inside a quoted cell or not" at its beginning into the same at its end: a function of two values, kept as its two
    results. Chains of such functions are again one, so each split is one function, a file's splits are put together in order, and
    every split then knows how it begins and how many records were begun before it. Lines of records that go on are glued by their
    record's number; records of one line stay as they are. The first pass moves a few bytes for each line, the second the lines.
    """
    lines = lines.withColumn("_place", F.monotonically_increasing_id())
    blank = F.col("_text").rlike(BLANK)
    facts = lines.select("_file", "_block", "_place", "_text", blank.alias("_blank"), *[grammar.ends_inside(F.col("_text"), b).cast("int").alias(f"_{k}") for k, b in (("out", False), ("in", True))])
    whole = Window.partitionBy("_file", "_block").orderBy("_place")

    def states(rows: DataFrame, order: Window, begin: dict[str, Column]) -> DataFrame:
        """For each way to begin, the state before and after each row, from the functions (``_out``, ``_in``) in order."""
        upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
        swap = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("int")
        rows = rows.withColumn("_turns", F.bit_xor(swap).over(upto))
        fixed = F.when(F.col("_out") == F.col("_in"), F.col("_out").bitwiseXOR(F.col("_turns")))
        rows = rows.withColumn("_fixed", fixed)
        for name, first in begin.items():
            earlier = F.coalesce(F.last("_fixed", ignorenulls=True).over(before), first).bitwiseXOR(F.coalesce(F.bit_xor(swap).over(before), F.lit(0)))
            rows = rows.withColumn(f"_from{name}", earlier)
        for name, first in begin.items():
            rows = rows.withColumn(f"_to{name}", F.coalesce(F.last("_fixed", ignorenulls=True).over(upto), first).bitwiseXOR(F.col("_turns")))
        return rows.drop("_turns", "_fixed")

    begins = [((F.col(f"_from{k}") == 0) & ~F.col("_blank")).cast("int") for k in (0, 1)]
    narrow = states(facts.drop("_text"), whole, {"0": F.lit(0), "1": F.lit(1)})
    splits = narrow.groupBy("_file", "_block").agg(
        *[F.sum(b).alias(f"_n{k}") for k, b in enumerate(begins)], F.max_by("_to0", "_place").alias("_out"), F.max_by("_to1", "_place").alias("_in")
    )
    splits = states(splits, Window.partitionBy("_file").orderBy("_block"), {"": F.lit(0)})
    count = F.when(F.col("_from") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum(count).over(earlier), F.lit(0))).withColumn("_last", F.lead("_block").over(Window.partitionBy("_file").orderBy("_block")).isNull())
    splits = written(splits.select("_file", "_block", F.col("_from").alias("_init"), F.col("_to").alias("_end"), "_before", "_last"), "splits")
    open_file = splits.where("_last AND _end = 1").agg(F.min("_file")).first()[0]
    if open_file is not None:
        raise ValueError(f"a quote is never closed in {open_file}")

    def records(some: DataFrame) -> DataFrame:
        rows = states(_on_split(facts, some.select("_file", "_block", "_init", "_before")), whole, {"": F.col("_init")})
        begun = ((F.col("_from") == 0) & ~F.col("_blank")).cast("int")
        rows = rows.withColumn("_at", F.col("_before") + F.sum(begun).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        alone = (F.col("_from") == 0) & (F.col("_to") == 0)
        several = rows.where(~alone).groupBy("_file", "_at").agg(F.array_sort(F.collect_list(F.struct("_block", "_place", "_text"))).alias("_parts"))
        several = several.select("_file", "_at", F.array_join(F.transform("_parts", lambda x: x["_text"]), "\n").alias("_text"))
        return rows.where(alone & ~F.col("_blank")).select("_file", "_at", "_text").unionByName(several).withColumn("_text", F.regexp_replace("_text", "\r$", ""))

    # only splits before which at most one record began can hold a line of the first
    heads = records(splits.where("_before <= 1")).where("_at = 0").select("_file", F.col("_text").alias("_head"))
    return records(splits), heads


def scan_csv(
    spark: SparkSession,
    paths: str | list[str],
    *,
    delimiter: str | None = None,
    header_row: int | None = 0,
    quote: str = '"',
    multi_line: bool = False,
    offsets: bool = True,
) -> DataFrame:
    """Read delimited files as one stream set.

    Every cell is trimmed text (blank becomes NULL), ready for ``infer_string_type``. Lines before ``header_row`` are dropped, and
    so are blank ones between records; ``None`` means no header. Each file has its own header: columns are put together by name,
    so files may have them in another order or lack some. A row with more cells than its header is an error. ``multi_line``
    allows line breaks (``\\n`` or ``\\r\\n``) inside quoted cells; a quote that is never closed is an error then. Every split of a file is
    read by a task of its own, with and without it, and nothing is written but a row for each split. Adds ``_file`` and ``_offset``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if delimiter is None:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        first = listing.filter(F.col("length") > 0).agg(F.min("path")).first()[0]
        if first is None:
            raise ValueError(f"no data in {paths}")
        delimiter = delimiter_of(first)
    grammar = _Grammar(delimiter, quote)
    lines = _without_preamble(_lines(spark, paths, "\n" if multi_line else None), header_row)
    rows, heads = _quoted_records(lines, grammar) if multi_line else _line_records(lines)
    count = grammar.count(F.col("_text"))
    if header_row is None:
        # the widest row, wherever it stands
        widest = rows.agg(F.max(count)).first()[0]
        layouts = {} if widest is None else {"": [f"Column{i}" for i in range(widest)]}
    else:
        heads = written(heads, "heads")
        layouts = {r[0]: header_names(_cells(r[0], delimiter, quote)) for r in heads.select("_head").distinct().toLocalIterator()}
    names = list(dict.fromkeys(n for h in sorted(layouts) for n in layouts[h]))
    options = {"sep": delimiter, "quote": quote, "escape": quote, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names) + 1))}
    row_type = T.StructType([T.StructField(f"n{j}", T.StringType()) for j in range(len(names))])

    def trimmed(cell: Column) -> Column:
        # few cells have anything to trim, which their ends tell; ``$`` also stands before a last line end
        ends = F.concat(F.left(cell, F.lit(1)), F.right(cell, F.lit(1)))
        return F.when(ends.rlike(rf"{WS}|\x{{85}}"), F.regexp_replace(cell, f"^{WS}+|{WS}+$", "")).otherwise(cell)

    def row_of(rows: DataFrame, width: int, own: Column, cell: Callable[[Column, int], Column]) -> DataFrame:
        """Rows with their cells by name: parsed once, to ``width`` cells, of which the row's own header has ``own``."""
        schema = ", ".join(f"c{i} string" for i in range(width))
        rows = rows.select("*", F.from_csv("_text", schema, options).alias("_parsed"), count.alias("_count"))
        rows = rows.select("*", *[cell(F.col("_parsed"), j).alias(f"_cell{j}") for j in range(len(names))])
        message = F.concat(F.lit("a row has more than the "), own.cast("string"), F.lit(" cells of its header in "), F.col("_file"))
        row = F.struct(*[F.nullif(trimmed(F.col(f"_cell{j}")), F.lit("")).alias(f"n{j}") for j in range(len(names))])
        return rows.withColumn("_row", F.when(F.col("_count") > own, F.raise_error(message).cast(row_type)).otherwise(row))

    if not layouts:
        empty = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_offset", T.LongType())])
        return spark.createDataFrame([], empty if offsets else T.StructType(empty.fields[:1]))
    if header_row is not None:
        rows = rows.filter("_at > 0")
    if len(layouts) == 1 or header_row is None:
        rows = row_of(rows, len(names), F.lit(len(names)), lambda parsed, j: parsed[f"c{j}"])
    else:
        # where each file has each name, found once a file
        known = spark.createDataFrame(list(layouts.items()), "_known string, _own array<string>")
        places = F.transform(F.array(*map(F.lit, names)), lambda n: (F.array_position("_own", n) - 1).cast("int"))
        heads = heads.join(known, F.col("_head") == F.col("_known")).select(F.col("_file").alias("_of"), F.size("_own").alias("_width"), places.alias("_places"))
        rows = rows.join(heads, F.col("_file") == F.col("_of"))
        widest = max(map(len, layouts.values()))
        rows = row_of(rows, widest, F.col("_width"), lambda parsed, j: F.get(F.array(*[parsed[f"c{i}"] for i in range(widest)]), F.col("_places")[j]))
    shift = 0 if header_row is None else 1
    out = rows.select("_row", "_file", (F.col("_at") - shift).alias("_offset"))
    extra = ["_file", "_offset"] if offsets else ["_file"]
    return out.select(*[F.col(f"_row.n{j}").alias(n) for j, n in enumerate(names)], *extra)


def data_columns(df: DataFrame) -> list[str]:
    """The columns of a scan that hold data, not where it came from."""
    return [c for c in df.columns if not c.startswith("_")]


def text_lines(spark: SparkSession, paths: str | list[str], skip: int = 0) -> DataFrame:
    """Lines of text files with their number in the file; the first ``skip`` are left out."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")
    )
    lines = _on_split(lines, _starts(lines, "_place").select("_file", "_block", "_shift"))
    numbered = lines.select("value", "_file", (F.col("_place") + F.col("_shift")).alias("_line"))
    return numbered.filter(F.col("_line") >= skip) if skip else numbered


def skip_bytes(spark: SparkSession, paths: str | list[str], skip: int) -> DataFrame:
    """Content of each file without its first ``skip`` bytes."""
    return spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("_file"), F.substring("content", skip + 1, 2**31 - 1).alias("content")
    )


def requote_csv(spark: SparkSession, source: str, target: str) -> None:
    """Write a comma file again with every field quoted."""
    spark.read.csv(source, header=False, quote='"', escape='"').write.mode("overwrite").csv(
        target, quoteAll=True, escape='"'
    )

