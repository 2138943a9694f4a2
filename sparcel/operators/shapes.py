"""Shape records for strongly typed targets: one column per type, target names and types."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.dates import iso_millis
from sparcel.functions.infer import convert_value, infer_string_type, to_timestamp
from sparcel.functions.names import sanitized

Types = Mapping[str, list[str]]

# Column types of the targets.
RELATIONAL = {
    "boolean": "boolean", "number": "double precision", "integer": "bigint", "date": "date",
    "date-time": "timestamp", "string": "text", "object": "json", "array": "json",
}
WAREHOUSE = {
    "boolean": "BOOLEAN", "number": "FLOAT64", "integer": "INTEGER", "date": "DATE",
    "date-time": "DATETIME", "string": "STRING",
}
DOCUMENT = {
    "boolean": "Boolean", "number": "Number", "integer": "Number", "date": "Date",
    "date-time": "Date", "string": "String",
}
COLUMNAR = {
    "string": "string", "integer": "int", "number": "double", "boolean": "bool",
    "date-time": "datetime64", "object": "string", "array": "string",
}
SPARK = {
    "boolean": "boolean", "number": "double", "integer": "bigint", "date": "date", "date-time": "timestamp",
    "string": "string", "object": "string", "array": "string",
}
COLUMNAR_BATCH = 100
DECIMAL_PRECISION = 31
RECEIVE_TIME = "receive_time"


def value_types(kinds: Iterable[str]) -> list[str]:
    return [k for k in kinds if k != "null"]


def _read(df: DataFrame, name: str, kind: str) -> Column:
    """A column as ``kind``: raw text is converted, typed columns are cast."""
    column, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return _apart(column, lambda c: convert_value(c, kind))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.try_cast(SPARK[kind])


def _apart(column: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` on a value by a function of its own: one projection of many long rules would be too large to be compiled."""
    return F.get(F.transform(F.array(column), work), F.lit(0))


def _split(df: DataFrame, types: Types, joint: str, rename) -> tuple[DataFrame, list[tuple[str, str, Column]]]:
    """The prepared rows, and (name, type, value) of every target column.

    "" is NULL and integers join numbers. The type of a mixed value and its time are worked
    out once per row, in a step of their own.
    """
    out: list[tuple[str, str, Column]] = []
    ready: dict[str, Column] = {}
    times: dict[str, Column] = {}
    for number, (name, kinds) in enumerate(types.items()):
        kinds = value_types(kinds)
        raw = isinstance(df.schema[name].dataType, T.StringType)
        column = F.nullif(F.col(f"`{name}`"), F.lit("")) if raw else F.col(f"`{name}`")
        if len(kinds) == 1:
            out.append((rename(name), kinds[0], F.when(column.isNotNull(), _read(df, name, kinds[0]))))
            continue
        found = _apart(column, infer_string_type)
        ready[f"_kind{number}"] = F.when(found == "integer", "number").otherwise(found) if "number" in kinds else found
        if {"date", "date-time"} & set(kinds):
            times[f"_time{number}"] = F.when(F.col(f"_kind{number}").isin("date", "date-time"), _apart(column, to_timestamp))
        for kind in kinds:
            value = _read(df, name, kind)
            if kind in ("date", "date-time"):
                value = F.col(f"_time{number}").cast("date" if kind == "date" else "timestamp")
            out.append((f"{rename(name)}{joint}{kind}", kind, F.when(F.col(f"_kind{number}") == kind, value)))
    df = df.withColumns(ready) if ready else df
    return df.withColumns(times) if times else df, out


def relational_shape(df: DataFrame, types: Types) -> DataFrame:
    """Rows for a table: ``name-type`` columns where a property has several types."""
    prepared, shaped = _split(df, types, "-", lambda n: sanitized(n, "column"))
    return prepared.select(*[value.alias(name) for name, _, value in shaped])


def relational_ddl(types: Types) -> str:
    """Column list of the table that ``relational_shape`` fills."""
    parts = []
    for name, kinds in types.items():
        kinds = value_types(kinds)
        for kind in kinds:
            suffix = f"-{kind}" if len(kinds) > 1 else ""
            parts.append(f'"{sanitized(name, "column")}{suffix}" {RELATIONAL[kind]}')
    return ", ".join(parts)


def avro_shape(df: DataFrame, types: Types) -> DataFrame:
    """Strongly typed records: bare names, numbers as double, times as epoch milliseconds."""
    columns = []
    for name, kinds in types.items():
        kinds = value_types(kinds)
        kind = "number" if "number" in kinds else "integer" if "integer" in kinds else kinds[0]
        value = _read(df, name, kind)
        if kind == "number":
            value = F.coalesce(value, F.lit(0.0))
        elif kind == "integer":
            value = F.coalesce(value, F.lit(0)).try_cast("int")
        elif kind == "date-time":
            value = F.unix_millis(value.cast("timestamp"))
        elif kind == "date":
            value = F.date_format(value, "yyyy-MM-dd")
        elif kind == "string":
            value = F.coalesce(value, F.lit(""))
        columns.append(value.alias(sanitized(name, "avro")))
    return df.select(*columns)


def warehouse_shape(df: DataFrame, types: Types, prefix: str) -> DataFrame:
    """Prefixed, sanitised columns; nested types are refused."""
    _refuse_nested(types)
    prepared, shaped = _split(df, types, "-", lambda n: n)
    return prepared.select(*[v.alias(f"{prefix}_{_bare(n)}") for n, _, v in shaped])


def warehouse_schema(types: Types, prefix: str) -> list[dict[str, str]]:
    _refuse_nested(types)
    fields = []
    for name, kinds in types.items():
        kinds = value_types(kinds)
        for kind in kinds:
            full = f"{name}-{kind}" if len(kinds) > 1 else name
            fields.append({"name": f"{prefix}_{_bare(full)}", "type": WAREHOUSE[kind]})
    return fields


def _bare(name: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name)


def _refuse_nested(types: Types) -> None:
    for name, kinds in types.items():
        if {"object", "array"} & set(kinds):
            raise ValueError(f"nested property {name} is not supported by this target")


def document_shape(df: DataFrame, types: Types) -> DataFrame:
    """``name_type`` fields where a property has several types; an undeclared type is an error."""
    _refuse_nested(types)
    prepared, shaped = _split(df, types, "_", lambda n: n)
    for number, (name, kinds) in enumerate(types.items()):
        kinds, kind = value_types(kinds), f"_kind{number}"
        if len(kinds) > 1:
            error = F.raise_error(F.concat(F.lit(f"value type not declared for {name}: "), F.col(kind))).cast("string")
            prepared = prepared.withColumn(kind, F.when(F.col(kind).isin([*kinds, "null"]), F.col(kind)).otherwise(error))
    return prepared.select(*[value.alias(name) for name, _, value in shaped])


def document_schema(types: Types) -> dict[str, str]:
    _refuse_nested(types)
    return {
        (f"{n}_{k}" if len(value_types(kinds)) > 1 else n): DOCUMENT[k]
        for n, kinds in types.items() for k in value_types(kinds)
    }


def columnar_type(kinds: Iterable[str]) -> str:
    kinds = value_types(kinds)
    if len(kinds) > 1:
        if "string" in kinds:
            return "string"
        raise ValueError(f"more than one type: {kinds}")
    return COLUMNAR[kinds[0]] if kinds else "string"


def columnar_shape(df: DataFrame, hidden: Iterable[str] = ()) -> DataFrame:
    """Visible columns without NULLs: "" instead, JSON text for nested values, " " for ``{}``."""
    hidden = set(hidden)
    columns = []
    for field in df.schema.fields:
        if field.name in hidden:
            continue
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            json = F.to_json(value)
            value = F.when(json == "{}", " ").otherwise(json)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = iso_millis(value)
        columns.append(F.coalesce(value.cast("string"), F.lit("")).alias(field.name))
    return df.select(*columns)


def columnar_payload(df: DataFrame, order: str, hidden: Iterable[str] = (), batch: int = COLUMNAR_BATCH, by: Iterable[str] = ()) -> DataFrame:
    """One JSON body ``{columns, data}`` per ``batch`` consecutive values of the offset ``order``, for each stream ``by`` names.

    Offsets are those of one stream, so each range of offsets is one body; one with more than ``batch`` records, whose offsets
    repeat, goes on in further bodies (``part``). Records without an offset make the batch NULL of their stream.
    """
    by = list(by)
    if {"batch", "part", "n", "body"} & set(by):
        raise ValueError("a stream column may not be called batch, part, n or body")
    shaped = columnar_shape(df, {*hidden, order} if order in set(hidden) else hidden)
    row = F.array(*[_columnar_value(df, c) for c in shaped.columns])
    numbered = df.select(*by, F.floor(F.col(order) / batch).alias("batch"), F.col(order).alias("_o"), row.alias("row"))
    place = F.row_number().over(Window.partitionBy(*by, "batch").orderBy("_o", "row")) - 1
    numbered = numbered.withColumn("_p", place).withColumn("part", F.floor(F.col("_p") / batch).cast("int"))
    return (
        numbered.groupBy(*by, "batch", "part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "row"))), lambda x: x["row"]).alias("data"))
        .select(
            *by, "batch", "part", F.size("data").alias("n"),
            F.to_json(F.struct(F.array(*[F.lit(c) for c in shaped.columns]).alias("columns"), "data")).alias("body"),
        )
    )


def _columnar_value(df: DataFrame, name: str) -> Column:
    value, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        json = F.to_json(value)
        value = F.when(json == "{}", " ").otherwise(json)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        value = iso_millis(value)
    return F.coalesce(value.cast("string"), F.lit(""))


def stream_table_type(dtype: T.DataType, scale: int = 0) -> str:
    """Column type of a stream table for a Spark type; objects become ROWs."""
    if isinstance(dtype, T.StringType):
        return "STRING"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, T.IntegralType):
        return "BIGINT"
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({DECIMAL_PRECISION},{dtype.scale})"
    if isinstance(dtype, T.FractionalType):
        return f"DECIMAL({DECIMAL_PRECISION},{scale})"
    if isinstance(dtype, T.DateType):
        return "DATE"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP_LTZ(3)"
    if isinstance(dtype, T.ArrayType):
        return f"ARRAY<{stream_table_type(dtype.elementType, scale)}>"
    if isinstance(dtype, T.StructType):
        return "ROW(" + ", ".join(f"{f.name} {stream_table_type(f.dataType, scale)}" for f in dtype.fields) + ")"
    raise ValueError(f"unsupported type {dtype.simpleString()}")


def stream_table_schema(schema: T.StructType, scales: Mapping[str, int] | None = None, receive_time: bool = False) -> list[dict[str, str]]:
    scales = scales or {}
    fields = [{"name": f.name, "type": stream_table_type(f.dataType, scales.get(f.name, 0))} for f in schema.fields]
    return [*fields, {"name": RECEIVE_TIME, "type": "TIMESTAMP_LTZ(3)"}] if receive_time else fields


def stream_table_shape(df: DataFrame, scales: Mapping[str, int] | None = None, receive_time: Column | None = None) -> DataFrame:
    """Numbers as decimals of the profiled scale, times as ISO text, missing values as NULL."""
    scales = scales or {}
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.FractionalType) and not isinstance(field.dataType, T.DecimalType):
            value = value.try_cast(f"decimal({DECIMAL_PRECISION},{scales.get(field.name, 0)})")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = iso_millis(value)
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        columns.append(value.alias(field.name))
    if receive_time is not None:
        columns.append(iso_millis(receive_time).alias(RECEIVE_TIME))
    return df.select(*columns)


def event_time(df: DataFrame, column: str | None, delay: str = "0 seconds") -> DataFrame:
    """Watermark on the chosen date-time property, or on the time of receipt."""
    if column is None:
        return df.withColumn(RECEIVE_TIME, F.current_timestamp()).withWatermark(RECEIVE_TIME, delay)
    if isinstance(df.schema[column].dataType, T.StringType):
        df = df.withColumn(column, to_timestamp(F.col(column)))
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def kafka_value(df: DataFrame, topic: str, schema_title: str) -> DataFrame:
    """(topic, value): the record as JSON, no key; ``{schemaTitle}`` in the topic is filled in."""
    return df.select(
        F.lit(topic.replace("{schemaTitle}", schema_title)).alias("topic"),
        F.to_json(F.struct("*")).alias("value"),
    )
