"""JSON and XML records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.sources.documents import array_pieces


def _steps(json_path: str) -> list[str]:
    """Pieces of a JSONPath between the places where an array is opened (``[*]``)."""
    if not re.fullmatch(r"\$(?:\.[^.\[\]]+|\[\d+\]|\[\*\]|\.\*)*", json_path):
        raise ValueError(f"unsupported JSONPath {json_path}")
    return json_path.removeprefix("$").replace(".*", "[*]").split("[*]")


def _items(df: DataFrame, steps: list[str]) -> DataFrame:
    """Every item of the array in VARIANT ``record``, then of the arrays at the further steps."""
    others = [c for c in df.columns if c != "record"]
    for step in steps:
        items = F.try_variant_get(F.col("record"), "$", "array<variant>")
        df = df.select(*others, F.explode(items).alias("record"))
        if step:
            df = df.withColumn("record", F.try_variant_get("record", f"${step}", "variant"))
    return df.filter(F.col("record").isNotNull())


def json_records(df: DataFrame, text: str, json_path: str = "$") -> DataFrame:
    """One row per match of ``json_path`` in a JSON text column, as VARIANT ``record``.

    Text that is no JSON gives no record. The other columns are kept.
    """
    first, *rest = _steps(json_path)
    others = [c for c in df.columns if c != text]
    out = df.select(*others, F.try_parse_json(F.col(text)).alias("record"))
    if first:
        out = out.withColumn("record", F.try_variant_get("record", f"${first}", "variant"))
    return _items(out, rest)


def scan_json(spark: SparkSession, paths: str | list[str], json_path: str = "$", lines: bool = False) -> DataFrame:
    """Records of JSON documents (one per file) or of JSON lines.

    A path that opens an array below names (``$[*]``, ``$.a.b[*].c``) is followed by all tasks at once, whatever the document's
    size; each of that array's elements is one value. Other paths take a document as one value.
    """
    first, *rest = _steps(json_path)
    if lines or not rest or not re.fullmatch(r"(?:\.[^\[\]}\"\\]+)*", first):
        text = spark.read.text(paths, wholetext=not lines).withColumnRenamed("value", "_text")
        return json_records(text.select("_text", F.col("_metadata.file_path").alias("_file")), "_text", json_path)
    pieces = array_pieces(spark, paths, first.split(".")[1:])
    return _items(pieces.select("_file", F.try_parse_json("_text").alias("record")), rest)


def flatten_columns(schema: T.StructType, sizes: dict[str, int] | None = None) -> list[Column]:
    """Leaves of nested columns under dotted names.

    Attributes (``_name``) lose their prefix and path, element text (``_VALUE``) takes the
    name of its parent, repeated elements are numbered from 0 up to their size in ``sizes``.
    """
    sizes = sizes or {}
    out: dict[str, Column] = {}

    def walk(path: str, value: Column, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for child in dtype.fields:
                if child.name == "_VALUE":
                    name = path
                elif child.name.startswith("_"):
                    name = child.name[1:]
                else:
                    name = f"{path}.{child.name}" if path else child.name
                walk(name, value.getField(child.name), child.dataType)
        elif isinstance(dtype, T.ArrayType):
            for i in range(sizes.get(path, 0)):
                walk(f"{path}.{i}", F.get(value, F.lit(i)), dtype.elementType)
        else:
            out[path] = value.cast("string") if path not in out else F.coalesce(out[path], value.cast("string"))

    for field in schema.fields:
        if field.name.startswith("_"):
            walk(field.name.removeprefix("_VALUE") or "text" if field.name == "_VALUE" else field.name[1:], F.col(f"`{field.name}`"), field.dataType)
        else:
            walk(field.name, F.col(f"`{field.name}`"), field.dataType)
    return [value.alias(name) for name, value in out.items()]


def _array_sizes(df: DataFrame) -> dict[str, int]:
    """Longest repetition of each repeated element, in one aggregate."""
    found: dict[str, Column] = {}

    def walk(path: str, value: Column, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for child in dtype.fields:
                walk(f"{path}.{child.name}" if path else child.name, value.getField(child.name), child.dataType)
        elif isinstance(dtype, T.ArrayType):
            found[path] = F.max(F.size(value))

    for field in df.schema.fields:
        walk(field.name, F.col(f"`{field.name}`"), field.dataType)
    if not found:
        return {}
    row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(found.values())]).first()
    return {path: max(row[i] or 0, 0) for i, path in enumerate(found)}


def _below(reader: DataFrameReader, paths: str | list[str], steps: list[str], schema: T.StructType | None) -> DataFrame:
    """Rows of the last step of a path, reached from the elements of its second step."""
    inner = steps[2:]
    if schema is not None:
        for step in reversed(inner):
            schema = T.StructType([T.StructField(step, T.ArrayType(schema))])
        reader = reader.schema(schema)
    rows = reader.load(paths)
    for step in inner:
        if step not in rows.columns:
            raise ValueError(f"no element {step} on the path /{'/'.join(steps)}")
        kind = rows.schema[step].dataType
        several = isinstance(kind, T.ArrayType)
        rows = rows.select((F.explode(F.col(f"`{step}`")) if several else F.col(f"`{step}`")).alias("_row")).filter("_row IS NOT NULL")
        leaf = kind.elementType if several else kind
        rows = rows.select("_row.*") if isinstance(leaf, T.StructType) else rows.withColumnRenamed("_row", "_VALUE")
    return rows


def scan_xml(spark: SparkSession, paths: str | list[str], row_path: str, schema: T.StructType | None = None) -> DataFrame:
    """Records at an element path, flattened; every leaf is text for ``infer_string_type``.

    The path counts from its second step on: elements of that name are read as rows (wherever they are in the document, as the
    reader splits large files there), and the steps after it are followed inside them.
    """
    steps = row_path.strip("/").split("/")
    reader = spark.read.format("xml").option("inferSchema", "false").option("rowTag", steps[min(1, len(steps) - 1)])
    rows = _below(reader, paths, steps, schema)
    return rows.select(*flatten_columns(rows.schema, _array_sizes(rows)))
