"""Column profiles: one wide aggregate per scan, unpivoted to (property, type) rows.

Every statistic is a partial aggregate, so a scan of any size shuffles one small row per task
(and per schema when profiled by schema). Nested fields are reached by dotted paths, array
elements by ``name[]`` with higher-order functions, so no row is ever exploded.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.infer import (
    infer_string_type, infer_value_type, possible_types, to_boolean, to_number, to_timestamp,
)
from sparcel.functions.text import trimmed

# Limits of the profile.
DEPTH = 10
OPTION_COUNT = 50
OPTION_LENGTH = 50
RAW_TYPES = ("string", "integer", "number", "boolean", "date", "date-time")

#: statistic -> (Spark type, how two parts of it combine)
STATS: dict[str, tuple[str, str]] = {
    "record_count": ("bigint", "sum"),
    "string_min_length": ("bigint", "min"),
    "string_max_length": ("bigint", "max"),
    "number_min": ("double", "min"),
    "number_max": ("double", "max"),
    "number_max_precision": ("bigint", "max"),
    "number_max_scale": ("bigint", "max"),
    "integer_min": ("decimal(38,0)", "min"),
    "integer_max": ("decimal(38,0)", "max"),
    "true_count": ("bigint", "sum"),
    "false_count": ("bigint", "sum"),
    "date_min": ("timestamp", "min"),
    "date_max": ("timestamp", "max"),
    "date_max_subsecond": ("bigint", "max"),
    "array_min_length": ("bigint", "min"),
    "array_max_length": ("bigint", "max"),
    "first_seen": ("timestamp", "min"),
    "last_seen": ("timestamp", "max"),
    "distinct_sketch": ("binary", "union"),
}
COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "union": lambda c: F.theta_union_agg(c, SKETCH)}
#: Statistics that are kept only when asked for.
ON_REQUEST = {"distinct_sketch"}
#: Sketches of 2^8 hashes: up to as many values they count exactly, which is beyond the number of options of interest.
SKETCH = 8


@dataclass(frozen=True)
class Field:
    """A profiled path: a column, or the elements of an array column, as SQL text."""

    name: str
    sql: str
    dtype: T.DataType
    elements: bool = False
    raw: bool = False

    @property
    def column(self) -> Column:
        return F.expr(self.sql)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fields(schema: T.StructType, raw: Iterable[str] = (), depth: int = DEPTH) -> list[Field]:
    """All dotted paths of a schema, at most ``depth`` levels deep."""
    raw = set(raw)
    found: list[Field] = []

    def add(name: str, sql: str, dtype: T.DataType, elements: bool, level: int) -> None:
        found.append(Field(name, sql, dtype, elements, name in raw))
        if level >= depth:
            return
        if isinstance(dtype, T.StructType):
            for child in dtype.fields:
                add(f"{name}.{child.name}", f"{sql}.{quoted(child.name)}", child.dataType, elements, level + 1)
        elif isinstance(dtype, T.ArrayType):
            add(f"{name}[]", f"flatten({sql})" if elements else sql, dtype.elementType, True, level + 1)

    for top in schema.fields:
        add(top.name, quoted(top.name), top.dataType, False, 1)
    return found


# Generated expressions are SQL text: a profile has hundreds of them, and the driver parses
# one text far faster than it assembles the same expression call by call.


def scale_sql(x: str) -> str:
    """Digits after the point of a double's plain text.

    Up to six digits are found by arithmetic; the text form decides the rare rest.
    """
    arithmetic = " ".join(
        f"WHEN abs({x}) < 1e9D AND rint({x} * 1e{d}D) / 1e{d}D = {x} THEN {d}" for d in range(1, 7)
    )
    return f"CASE WHEN rint({x}) = {x} THEN 0 {arithmetic} WHEN {x} IS NOT NULL THEN {text_scale_sql(x)} END"


def text_scale_sql(x: str) -> str:
    """The same from the text form, which also suits single-precision numbers."""
    plain = f"cast(abs({x}) AS string)"
    fraction = f"rtrim('0', split_part(split_part({plain}, 'E', 1), '.', 2))"
    exponent = f"coalesce(try_cast(split_part({plain}, 'E', 2) AS int), 0)"
    return f"greatest(length({fraction}) - {exponent}, 0)"


def scale_of(x: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.FloatType):
        return f"CASE WHEN {x} IS NOT NULL THEN {text_scale_sql(x)} END"
    return scale_sql(f"cast({x} AS double)")


def whole_digits_sql(x: str) -> str:
    """Digits before the point of a number's plain text."""
    steps = " ".join(f"WHEN abs({x}) < 1e{d}D THEN {d}" for d in range(1, 10))
    whole = f"WHEN abs({x}) < 9e18D THEN length(cast(floor(abs({x})) AS string))"  # from there on doubles are whole anyway
    plain = f"try_cast(abs({x}) AS decimal(38,0))"
    return f"CASE {steps} {whole} WHEN {plain} IS NOT NULL THEN length(cast({plain} AS string)) WHEN {x} IS NOT NULL THEN cast(floor(log10(abs({x}))) AS int) + 1 END"


def _integers(kind: str, on: str | None, value: str) -> list[Aggregate]:
    """Exact extremes beside those of the doubles."""
    return [(kind, "integer_min", f"min({value}){_where(on)}"), (kind, "integer_max", f"max({value}){_where(on)}")]


def micros_sql(x: str) -> str:
    return f"unix_micros(cast({x} AS timestamp))"


def midnight_sql(micros: str) -> str:
    """Midnight UTC at millisecond precision."""
    return f"pmod({micros}, 86400000000) < 1000"


def subsecond_sql(micros: str) -> str:
    """Digits of the fraction of a second, without trailing zeros."""
    steps = " ".join(f"WHEN {micros} % {10 ** (6 - d)} = 0 THEN {d}" for d in range(0, 6))
    return f"CASE {steps} WHEN {micros} IS NOT NULL THEN 6 END"


#: aggregate of one statistic: (type, statistic, SQL over the prepared columns)
Aggregate = tuple[str, str, str]


def _where(on: str | None) -> str:
    return f" FILTER (WHERE {on})" if on else ""


def _numbers(kind: str, on: str | None, value: str, scale: str | None) -> list[Aggregate]:
    where = _where(on)
    out = [(kind, "number_min", f"min({value}){where}"), (kind, "number_max", f"max({value}){where}")]
    if scale is None:
        # The longest integer is the one furthest from zero.
        out.append((kind, "number_max_precision", whole_digits_sql(f"max(abs({value})){where}")))
        out.append((kind, "number_max_scale", f"CASE WHEN count({value}){where} > 0 THEN 0 END"))
    else:
        out.append((kind, "number_max_precision", f"max({whole_digits_sql(value)} + {scale}){where}"))
        out.append((kind, "number_max_scale", f"max({scale}){where}"))
    return out


def _stamps(kind: str, on: str | None, micros: str) -> list[Aggregate]:
    where = _where(on)
    return [
        (kind, "date_min", f"timestamp_micros(min({micros}){where})"),
        (kind, "date_max", f"timestamp_micros(max({micros}){where})"),
        (kind, "date_max_subsecond", f"max({subsecond_sql(micros)}){where}"),
    ]


def _range(kind: str, stat: str, value: str, on: str | None = None) -> list[Aggregate]:
    return [
        (kind, f"{stat}_min_length", f"min({value}){_where(on)}"),
        (kind, f"{stat}_max_length", f"max({value}){_where(on)}"),
    ]


def _distinct(kind: str, value: str, on: str | None = None) -> list[Aggregate]:
    return [(kind, "distinct_sketch", f"theta_sketch_agg({value}, {SKETCH}){_where(on)}")]


def _booleans(kind: str, value: str) -> list[Aggregate]:
    return [(kind, "true_count", f"count_if({value})"), (kind, "false_count", f"count_if(NOT {value})")]


def _raw(field: Field, key: str) -> tuple[dict[str, Column], list[Aggregate]]:
    value = field.column
    kind = infer_string_type(value)
    ready = {
        f"{key}_k": kind,
        f"{key}_v": to_number(value),
        f"{key}_i": F.when(kind == "integer", trimmed(value).try_cast("decimal(38,0)")),
        f"{key}_t": F.when(kind.isin("date", "date-time"), F.unix_micros(to_timestamp(value))),
        f"{key}_b": F.when(kind == "boolean", to_boolean(value)),
        f"{key}_l": F.length(value),
        f"{key}_x": value,
    }

    def on(name: str) -> str:
        return f"{key}_k = '{name}'"

    aggs = [(k, "record_count", f"count_if({on(k)})") for k in (*RAW_TYPES, "null")]
    aggs += [a for k in RAW_TYPES for a in _distinct(k, f"{key}_x", on(k))]
    aggs += _range("string", "string", f"{key}_l", on("string"))
    aggs += _numbers("integer", on("integer"), f"{key}_v", None) + _integers("integer", None, f"{key}_i")
    aggs += _numbers("number", on("number"), f"{key}_v", scale_sql(f"{key}_v"))
    aggs += _booleans("boolean", f"{key}_b")
    return ready, aggs + _stamps("date", on("date"), f"{key}_t") + _stamps("date-time", on("date-time"), f"{key}_t")


def _scalar(field: Field, key: str, widen: bool) -> tuple[dict[str, Column], list[Aggregate]]:
    """Columns to prepare once per row, and the aggregates over them."""
    if field.raw:
        return _raw(field, key)
    x, v, kinds = field.sql, f"{key}_v", possible_types(field.dtype)
    nulls = ("null", "record_count", f"count_if({v} IS NULL)")
    if kinds == ("integer", "number"):
        scale = f"{key}_s"
        ready = {v: F.expr(f"cast({x} AS double)"), scale: F.expr(scale_of(x, field.dtype))}
        whole, decimal = f"{scale} = 0", f"{scale} > 0"
        if not widen:
            aggs = [nulls, *[(k, "record_count", f"count_if({on})") for k, on in (("integer", whole), ("number", decimal))]]
            aggs += _distinct("integer", v, whole) + _distinct("number", v, decimal)
            return ready, aggs + _numbers("integer", whole, v, scale) + _numbers("number", decimal, v, scale)
        # Integers count as numbers once there are decimals, so one set of aggregates does.
        aggs = [nulls]
        for kind, chosen in (("integer", f"count_if({decimal}) = 0"), ("number", f"count_if({decimal}) > 0")):
            aggs.append((kind, "record_count", f"CASE WHEN {chosen} THEN count({v}) ELSE 0 END"))
            aggs += [(kind, stat, f"CASE WHEN {chosen} THEN {a} END") for _, stat, a in _numbers(kind, None, v, scale) + _distinct(kind, v)]
        return ready, aggs
    if kinds == ("date", "date-time"):
        midnight = midnight_sql(v)
        aggs = [nulls, ("date", "record_count", f"count_if({midnight})"), ("date-time", "record_count", f"count_if(NOT {midnight})")]
        aggs += _distinct("date", v, midnight) + _distinct("date-time", v, f"NOT {midnight}")
        return {v: F.expr(micros_sql(x))}, aggs + _stamps("date", midnight, v) + _stamps("date-time", f"NOT {midnight}", v)
    kind = kinds[0]
    aggs = [nulls, (kind, "record_count", f"count({v})")]
    ready, more = {
        "string": lambda: (f"length({x})", _range(kind, "string", v)),
        "integer": lambda: (f"cast({x} AS double)", _numbers(kind, None, v, None) + _integers(kind, None, f"{key}_i")),
        "boolean": lambda: (x, _booleans(kind, v)),
        "date": lambda: (micros_sql(x), _stamps(kind, None, v)),
        "array": lambda: (f"CASE WHEN {x} IS NOT NULL THEN size({x}) END", _range(kind, "array", v)),
        "object": lambda: (f"CASE WHEN {x} IS NOT NULL THEN true END", []),
    }[kind]()
    exact = {f"{key}_i": F.expr(f"cast({x} AS decimal(38,0))")} if kind == "integer" else {}
    plain = {"string": x, "boolean": f"cast({x} AS int)", "date": v, "integer": f"cast({x} AS {'bigint' if isinstance(field.dtype, T.IntegralType) else 'string'})"}.get(kind)
    if plain:
        more += _distinct(kind, f"{key}_x")
        exact[f"{key}_x"] = F.expr(plain if kind != "date" else ready)
    return {v: F.expr(ready), **exact}, aggs + more


def _type_sql(dtype: T.DataType, kind: str) -> str:
    """Test that an array element ``v`` is of type ``kind``."""
    kinds = possible_types(dtype)
    if len(kinds) == 1:
        return "v IS NOT NULL"
    if kinds == ("integer", "number"):
        same = "rint(cast(v AS double)) = cast(v AS double)"
        return same if kind == "integer" else f"NOT ({same})"
    midnight = midnight_sql(micros_sql("v"))
    return midnight if kind == "date" else f"NOT ({midnight})"


def _elements(field: Field, key: str) -> tuple[dict[str, Column], list[Aggregate]]:
    """The same for the elements of an array: folded per row, then aggregated."""
    ready: dict[str, Column] = {}
    aggs: list[Aggregate] = []

    def folded(kind: str, stat: str, how: str, values: str) -> None:
        name = f"{key}_{len(ready)}"
        fold = {"min": "array_min", "max": "array_max", "sum": "size"}[how]
        ready[name] = F.expr(f"{fold}({values})")
        aggs.append((kind, stat, f"coalesce(sum(greatest({name}, 0)), 0)" if how == "sum" else f"{how}({name})"))

    folded("null", "record_count", "sum", f"filter({field.sql}, v -> v IS NULL)")
    for kind in possible_types(field.dtype):
        some = f"filter({field.sql}, v -> {_type_sql(field.dtype, kind)})"
        each = {
            "string": [("string_min_length", "min", "length(v)"), ("string_max_length", "max", "length(v)")],
            "boolean": [],
            "array": [("array_min_length", "min", "size(v)"), ("array_max_length", "max", "size(v)")],
            "object": [],
        }
        number = "cast(v AS double)"
        numbers = [
            ("number_min", "min", number), ("number_max", "max", number),
            ("number_max_precision", "max", f"{whole_digits_sql(number)} + {scale_of('v', field.dtype)}"),
            ("number_max_scale", "max", scale_of("v", field.dtype)),
        ]
        stamps = [
            ("date_min", "min", "cast(v AS timestamp)"), ("date_max", "max", "cast(v AS timestamp)"),
            ("date_max_subsecond", "max", subsecond_sql(micros_sql("v"))),
        ]
        folded(kind, "record_count", "sum", some)
        if kind == "boolean":
            folded(kind, "true_count", "sum", f"filter({some}, v -> v)")
            folded(kind, "false_count", "sum", f"filter({some}, v -> NOT v)")
        wanted = each.get(kind, numbers if kind in ("integer", "number") else stamps)
        for stat, how, item in wanted:
            folded(kind, stat, how, f"transform({some}, v -> {item})")
    return ready, aggs


@dataclass
class Plan:
    """One wide aggregate over prepared columns, and the text that turns its row into (property, type) rows."""

    per_row: DataFrame
    aggregates: list[Column]
    rows: str
    by: list[str]
    mixed: bool

    def wide(self) -> DataFrame:
        """One row, or one for each ``by`` group; of a stream, the totals so far."""
        return self.per_row.groupBy(*self.by).agg(*self.aggregates)

    def long(self, wide: DataFrame, widen: bool = True) -> DataFrame:
        rows = wide.select(*self.by, F.expr(self.rows)).filter("record_count > 0")
        return number_widening(rows, self.by) if widen and self.mixed else rows


def plan(
    df: DataFrame, *, raw: Iterable[str] = (), by: Iterable[str] = (), columns: Iterable[str] | None = None, received: str | None = None,
    stats: Iterable[str] | None = None, widen: bool = True, depth: int = DEPTH,
) -> Plan:
    """The aggregate behind ``profile``, for a table or a stream."""
    by, raw = list(by), set(raw)
    chosen = [c for c in (df.columns if columns is None else columns) if c not in by and c != received]
    schema = T.StructType([df.schema[c] for c in chosen])
    keep = {*stats, "record_count"} if stats is not None else set(STATS) - ON_REQUEST

    prepared: dict[str, Column] = {}
    aggregates: list[Column] = []
    rows: list[str] = []
    found = fields(schema, raw, depth)
    for number, field in enumerate(found):
        if isinstance(field.dtype, T.NullType):
            continue
        key = f"p{number}"
        ready, aggs = _elements(field, key) if field.elements else _scalar(field, key, widen)
        if received is not None and not field.elements:
            seen = f"{key}_seen"
            ready[seen] = F.expr(f"CASE WHEN {field.sql} IS NOT NULL THEN {micros_sql(quoted(received))} END")
            for kind in dict.fromkeys(k for k, _, _ in aggs if k != "null"):
                aggs.append((kind, "first_seen", f"timestamp_micros(min({seen}))"))
                aggs.append((kind, "last_seen", f"timestamp_micros(max({seen}))"))
        aggs = [a for a in aggs if a[1] in keep]
        used = " ".join(a[2] for a in aggs)
        prepared.update({n: c for n, c in ready.items() if n in used})
        by_type: dict[str, dict[str, str]] = {}
        for position, (kind, stat, agg) in enumerate(aggs):
            alias = f"a{number}_{position}"
            aggregates.append(F.expr(f"{agg} AS {alias}"))
            by_type.setdefault(kind, {})[stat] = alias
        for kind, aliases in by_type.items():
            values = ", ".join(
                f"'{stat}', cast({aliases.get(stat, 'NULL')} AS {dtype})"
                for stat, (dtype, _) in STATS.items() if stat in keep
            )
            rows.append(f"named_struct('property', {text_literal(field.name)}, 'type', '{kind}', {values})")
    names = ", ".join(["property", "type", *[s for s in STATS if s in keep]])
    mixed = bool(raw) or any(f.elements and possible_types(f.dtype) == ("integer", "number") for f in found if not isinstance(f.dtype, T.NullType))
    per_row = df.select(*by, *[c.alias(n) for n, c in prepared.items()])
    return Plan(per_row, aggregates, f"inline(array({', '.join(rows)})) AS ({names})", by, mixed)


def profile(
    df: DataFrame,
    *,
    raw: Iterable[str] = (),
    by: Iterable[str] = (),
    columns: Iterable[str] | None = None,
    received: str | None = None,
    stats: Iterable[str] | None = None,
    widen: bool = True,
    columns_per_scan: int | None = None,
    depth: int = DEPTH,
) -> DataFrame:
    """Profile ``df``: one row per property and observed type.

    ``raw`` columns hold text whose type is inferred value by value; ``by`` names columns to
    profile separately (a schema slug, say); ``received`` is the receive time behind first
    and last seen; ``stats`` restricts the statistics, and so the columns computed.

    One scan, whatever the number of columns. ``columns_per_scan`` profiles so many at a time
    instead: a columnar source still reads every column once, and each generated loop stays small
    enough to be compiled; any other source is read or recomputed for every group. Fields deeper
    than ``depth`` levels are left out.
    """
    by, raw = list(by), set(raw)
    chosen = [c for c in (df.columns if columns is None else columns) if c not in by and c != received]
    if columns_per_scan and len(chosen) > columns_per_scan:
        parts = [
            profile(df, raw=raw, by=by, columns=chosen[i : i + columns_per_scan], received=received, stats=stats, widen=widen, depth=depth)
            for i in range(0, len(chosen), columns_per_scan)
        ]
        return reduce(DataFrame.union, parts)
    made = plan(df, raw=raw, by=by, columns=chosen, received=received, stats=stats, widen=widen, depth=depth)
    return made.long(made.wide(), widen)


def combine(rows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Add up profile rows of the same property and type."""
    present = [s for s in STATS if s in rows.columns]
    return rows.groupBy(*by, "property", "type").agg(
        *[COMBINE[STATS[s][1]](s).alias(s) for s in present]
    )


def number_widening(rows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Count integers as numbers in properties that also hold decimals."""
    per_property = Window.partitionBy(*by, "property")
    has_number = F.max(F.col("type") == "number").over(per_property)
    kind = F.when((F.col("type") == "integer") & has_number, "number").otherwise(F.col("type"))
    return combine(rows.withColumn("_kind", kind).drop("type").withColumnRenamed("_kind", "type"), by)


def merge_profiles(existing: DataFrame, new: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """One profile out of two profiles of the same schema."""
    both = existing.unionByName(new, allowMissingColumns=True)
    return number_widening(combine(both, by), by)


def merge_schema_row(existing: DataFrame, new: DataFrame, sum_counts: bool = False) -> DataFrame:
    """Schema rows (schema, record_count, inspected_count, description, unit, hidden) merged by title.

    The record count of the new side wins; inspected counts add up; the first known text stays.
    """
    e, n = existing.alias("e"), new.alias("n")
    joined = e.join(n, "schema", "full_outer")
    total = F.coalesce(F.col("e.record_count") + F.col("n.record_count"), F.col("n.record_count"), F.col("e.record_count"))
    latest = F.coalesce(F.col("n.record_count"), F.col("e.record_count"))
    inspected = F.when(
        F.col("e.inspected_count").isNotNull() | F.col("n.inspected_count").isNotNull(),
        F.coalesce(F.col("e.inspected_count"), F.lit(0)) + F.coalesce(F.col("n.inspected_count"), F.lit(0)),
    )
    hidden = F.coalesce(F.col("e.hidden"), F.lit(False)) | F.coalesce(F.col("n.hidden"), F.lit(False))
    return joined.select(
        "schema",
        (total if sum_counts else latest).alias("record_count"),
        inspected.alias("inspected_count"),
        F.coalesce("e.description", "n.description").alias("description"),
        F.coalesce("e.unit", "n.unit").alias("unit"),
        hidden.alias("hidden"),
    )


def merge_samples(existing: DataFrame, new: DataFrame, order: str, schema: str, limit: int = 100) -> DataFrame:
    """Alternate the records of two samples, existing first, up to ``limit`` per schema."""

    def ranked(side: DataFrame, number: int) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(schema).orderBy(order))
        return side.withColumn("_turn", turn).filter(F.col("_turn") <= limit).withColumn("_side", F.lit(number))

    both = ranked(existing, 0).unionByName(ranked(new, 1))
    place = F.row_number().over(Window.partitionBy(schema).orderBy("_turn", "_side"))
    return both.withColumn("sample_no", place).filter(F.col("sample_no") <= limit).drop("_turn", "_side")


def option_profile(df: DataFrame, columns: Iterable[str] | None = None, raw: Iterable[str] = (), by: Iterable[str] = ()) -> DataFrame:
    """The part of a profile that tells which properties and types have few, short values; it is merged like any profile."""
    names = [
        f.name for f in df.schema.fields
        if f.name not in set(by) and (columns is None or f.name in set(columns))
        and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType, T.NullType))
    ]
    return profile(df, raw=raw, by=by, columns=names, stats=["string_max_length", "distinct_sketch"], widen=False)


def with_few_options(rows: DataFrame) -> DataFrame:
    """Profile rows of a property and type with at most 50 values of at most 50 characters."""
    short = F.coalesce(F.col("string_max_length"), F.lit(0)) <= OPTION_LENGTH  # other types are never longer
    return rows.filter((F.col("type") != "null") & short & (F.theta_sketch_estimate("distinct_sketch") <= OPTION_COUNT))


def value_options(df: DataFrame, columns: Iterable[str] | None = None, raw: Iterable[str] = ()) -> DataFrame:
    """Histogram (property, type, value, n) of every property and type with few, short values.

    The rule holds for each type by itself, so the integers among long texts keep their options. One wide aggregate finds the
    longest value and a sketch of the values of each property and type, without a row for each cell; only the columns that
    pass are counted value by value.
    """
    raw = set(raw)
    # one row for each property and type, of which a schema has a bounded number
    chosen = [(r["property"], r["type"]) for r in with_few_options(option_profile(df, columns, raw)).select("property", "type").collect()]
    entries = []
    for f in df.schema.fields:
        kinds = [k for p, k in chosen if p == f.name]
        if kinds:
            value = F.col(quoted(f.name))
            kind = infer_string_type(value) if f.name in raw else infer_value_type(value, f.dataType)
            text = F.when(kind.isin(*kinds), value.cast("string"))
            entries.append(F.struct(F.lit(f.name).alias("property"), kind.alias("type"), text.alias("value")))
    if not entries:
        return df.sparkSession.createDataFrame([], "property string, type string, value string, n bigint")
    values = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
    return few_options(values.groupBy("property", "type", "value").agg(F.count("*").alias("n")))


def few_options(counts: DataFrame) -> DataFrame:
    """Keep the options of a property and type while there are at most 50 of them."""
    sizes = F.count("*").over(Window.partitionBy("property", "type"))
    return counts.withColumn("_k", sizes).filter(F.col("_k") <= OPTION_COUNT).drop("_k")


def merge_options(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add up two option histograms; a side without options leaves the other as it is."""
    return (
        existing.unionByName(new).groupBy("property", "type", "value").agg(F.sum("n").alias("n"))
    )


def type_share(rows: DataFrame, record_count: Column | None = None) -> DataFrame:
    """Add the percentage of the records that each type makes up."""
    total = record_count
    if total is None:
        total = F.sum("record_count").over(Window.partitionBy("property"))
    return rows.withColumn("share", F.round(100.0 * F.col("record_count") / total, 2))


def human_count(count: Column, precision: Column | None = None) -> Column:
    """``1,234`` or ``1.2 m``, with ``~`` or ``>`` when the count is not exact."""
    big = (
        F.when(count >= 10**12, F.concat(F.format_number(count / F.lit(1e12), 1), F.lit(" t")))
        .when(count >= 10**9, F.concat(F.format_number(count / F.lit(1e9), 1), F.lit(" b")))
        .otherwise(F.concat(F.format_number(count / F.lit(1e6), 1), F.lit(" m")))
    )
    text = F.when(count > 1_000_000, big).otherwise(F.format_number(count, 0))
    if precision is None:
        return text
    sign = F.when(precision == "APPROXIMATE", "~").when(precision == "GREATER_THAN", ">").otherwise("")
    return F.concat(sign, text)


# Count precisions, from most to least precise.
PRECISIONS = ("EXACT", "APPROXIMATE", "GREATER_THAN")


def least_precise(precision: Column) -> Column:
    """Aggregate: the least precise of several precisions."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECISIONS]), precision)
    return F.element_at(F.array(*[F.lit(p) for p in PRECISIONS]), F.max(rank).cast("int"))


def expected_total(part: Column) -> Column:
    """Aggregate: the sum, unknown while any part is unknown."""
    return F.when(F.count(part) == F.count("*"), F.sum(part))


def stream_stats(
    df: DataFrame, byte_count: Column, by: Iterable[str] = (), end_reached: bool = True,
    expected_bytes: Column | None = None,
) -> DataFrame:
    """Records inspected and bytes seen, with how precise the totals are."""
    lower = F.lit(None).cast("bigint") if expected_bytes is None else F.max(expected_bytes).cast("bigint")
    seen_bytes = F.sum(byte_count).cast("bigint")
    return df.groupBy(*by).agg(
        F.count("*").alias("inspected_count"),
        F.count("*").alias("record_count"),
        F.lit("EXACT" if end_reached else "GREATER_THAN").alias("record_count_precision"),
        F.coalesce(lower, seen_bytes).alias("byte_count"),
        (F.when(lower.isNotNull(), "EXACT").otherwise("EXACT" if end_reached else "GREATER_THAN")).alias(
            "byte_count_precision"
        ),
    )
