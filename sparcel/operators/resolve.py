"""Properties with several types: which resolutions are allowed, and applying them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.functions.dates import iso_millis
from sparcel.functions.infer import (
    infer_string_type, round_half_up, to_boolean, to_integer, to_number, to_timestamp,
)

# The ways to resolve a conflict.
BOOLEAN, INTEGER, DOUBLE = "CAST_TO_BOOLEAN", "CAST_TO_INTEGER", "CAST_TO_DOUBLE"
DATE, DATE_TIME, STRING = "CAST_TO_DATE", "CAST_TO_DATE_TIME", "CAST_TO_STRING"
NULL, SKIP, ALL = "CAST_TO_NULL", "SKIP", "ALL"

# Allowed resolutions per pair of types (sorted).
ALLOWED = {
    "boolean,date": (STRING, ALL),
    "boolean,integer": (BOOLEAN, INTEGER, ALL),
    "boolean,number": (BOOLEAN, DOUBLE, ALL),
    "boolean,string": (STRING, NULL, SKIP, ALL),
    "date,date-time": (DATE_TIME, DATE, ALL),
    "date-time,integer": (DATE_TIME, INTEGER, ALL),
    "date-time,number": (DATE_TIME, DOUBLE, ALL),
    "date-time,string": (DATE_TIME, STRING, ALL),
    "date,integer": (INTEGER, DATE, STRING, ALL),
    "date,number": (STRING, ALL),
    "date,string": (STRING, NULL, SKIP),
    "integer,number": (DOUBLE, STRING, ALL),
    "integer,string": (STRING, NULL, SKIP, ALL),
    "number,string": (STRING, NULL, SKIP, ALL),
    "array,object": (STRING,),
}
MANY_TYPES = (STRING, ALL)
RESULT_TYPE = {
    BOOLEAN: "boolean", INTEGER: "integer", DOUBLE: "number", DATE: "date", DATE_TIME: "date-time", STRING: "string",
}


def type_conflicts(profile: DataFrame) -> DataFrame:
    """(property, types) of the properties with more than one type, NULL aside."""
    return (
        profile.filter(F.col("type") != "null")
        .groupBy("property").agg(F.sort_array(F.collect_set("type")).alias("types"))
        .filter(F.size("types") > 1)
    )


def conflict_options(conflicts: DataFrame) -> DataFrame:
    """Add the allowed resolutions; a pair without any is an error."""
    pair = F.array_join("types", ",")
    table = F.create_map(
        *[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))]
    )
    unknown = F.raise_error(F.concat(F.lit("no resolution for types: "), pair)).cast("array<string>")
    options = F.when(F.size("types") > 2, F.array(*[F.lit(o) for o in MANY_TYPES])).otherwise(
        F.coalesce(F.try_element_at(table, pair), unknown)
    )
    return conflicts.withColumn("options", options)


def _from_millis(text: Column) -> Column:
    return F.timestamp_millis(to_integer(text))


def resolve_value(text: Column, option: str, kind: Column | None = None) -> Column:
    """Raw text resolved by one cast; a type the cast does not cover becomes NULL.

    ``kind`` is the type of the text where it is already known.
    """
    kind = infer_string_type(text) if kind is None else kind
    if option == BOOLEAN:
        return F.when(kind.isin("boolean", "string"), to_boolean(text)).when(
            kind.isin("integer", "number"), to_number(text) > 0
        )
    if option == INTEGER:
        return (
            F.when(kind.isin("integer", "string"), to_integer(text))
            .when(kind == "number", round_half_up(to_number(text)))
            .when(kind == "boolean", to_boolean(text).cast("bigint"))
            .when(kind == "date", F.unix_millis(to_timestamp(text)))
        )
    if option == DOUBLE:
        return F.when(kind.isin("number", "integer", "string"), to_number(text)).when(
            kind == "boolean", to_boolean(text).cast("double")
        )
    if option in (DATE, DATE_TIME):
        stamp = F.when(kind.isin("date", "date-time", "string"), to_timestamp(text)).when(
            kind == "integer", _from_millis(text)
        )
        return stamp.cast("date") if option == DATE else stamp
    if option == STRING:
        return (
            F.when(kind == "boolean", to_boolean(text).cast("string"))
            .when(kind.isin("date", "date-time"), F.coalesce(iso_millis(to_timestamp(text)), text))
            .when(kind != "null", text)
        )
    if option == NULL:
        return F.when(~kind.isin("string", "null"), text)
    if option in (SKIP, ALL):
        return F.when(kind != "null", text)
    raise ValueError(f"unknown resolution {option}")


def resolve_conflicts(df: DataFrame, options: Mapping[str, str]) -> DataFrame:
    """Resolve raw-text columns; SKIP drops the records whose value is of string type.

    The type of each value is worked out once per row, in a step of its own.
    """
    kinds = {name: f"_kind{i}" for i, name in enumerate(options)}
    df = df.withColumns({kind: infer_string_type(F.col(f"`{name}`")) for name, kind in kinds.items()})
    for name, option in options.items():
        if option == SKIP:
            df = df.filter(F.col(kinds[name]) != "string")
    resolved = {n: resolve_value(F.col(f"`{n}`"), o, F.col(kinds[n])) for n, o in options.items()}
    return df.withColumns(resolved).drop(*kinds.values())


def apply_resolution(types: Mapping[str, list[str]], options: Mapping[str, str]) -> dict[str, list[str]]:
    """Types of each property after the resolutions; one type each unless all are kept."""
    result = {name: list(kinds) for name, kinds in types.items()}
    for name, option in options.items():
        if name not in result:
            raise ValueError(f"no property {name}")
        if option == ALL:
            continue
        if option in (SKIP, NULL):
            others = [k for k in result[name] if k not in ("null", "string")]
            if len(others) != 1:
                raise ValueError(f"{option} needs exactly one type besides string in {name}, found {others}")
            result[name] = others
        else:
            result[name] = [RESULT_TYPE[option]]
    return result


def types_of(profile: DataFrame) -> dict[str, list[str]]:
    """Property -> observed types; one row per column and type, so it fits the driver."""
    found: dict[str, list[str]] = {}
    for row in profile.select("property", "type").orderBy("property", "type").toLocalIterator():
        found.setdefault(row["property"], []).append(row["type"])
    return found
