"""Type names of values, and conversion of values to a type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.dates import is_date, is_date_time, iso_millis, parse_utc_timestamp
from sparcel.functions.text import WS, trimmed, whole

# The type names a value can have.
TYPE_NAMES = (
    "null", "boolean", "integer", "number", "date", "date-time", "string", "object", "array",
)
BOOLEAN_WORDS = ("true", "false", "yes", "no")
INTEGER_TEXT = r"[-+]?[1-9]\d*|0"
NUMBER_TEXT = r"[-+]?(?:[1-9]\d*|0)\.\d+"
NUMERIC_TEXT = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _finite(text: Column) -> Column:
    """Numeric text within the range of a double; beyond it, digits are only text."""
    return F.abs(trimmed(text).try_cast("double")) < F.lit(float("inf"))


def infer_string_type(text: Column) -> Column:
    """Type name of raw text."""
    words = "|".join(BOOLEAN_WORDS)
    return (
        F.when(text.isNull() | (text == "null") | text.rlike(f"^{WS}*$"), F.lit("null"))
        .when(text.rlike("(?i)" + whole(words)), F.lit("boolean"))
        .when(text.rlike(whole(NUMBER_TEXT)) & _finite(text), F.lit("number"))
        .when(text.rlike(whole(INTEGER_TEXT)) & _finite(text), F.lit("integer"))
        .when(is_date_time(text), F.lit("date-time"))
        .when(is_date(text), F.lit("date"))
        .otherwise(F.lit("string"))
    )


def possible_types(dtype: T.DataType) -> tuple[str, ...]:
    """Type names a column of this Spark type can hold, NULL aside."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return ("string",)
    if isinstance(dtype, T.BooleanType):
        return ("boolean",)
    if isinstance(dtype, T.IntegralType):
        return ("integer",)
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return ("integer", "number")
    if isinstance(dtype, T.DateType):
        return ("date",)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return ("date", "date-time")
    if isinstance(dtype, T.ArrayType):
        return ("array",)
    if isinstance(dtype, (T.StructType, T.MapType)):
        return ("object",)
    raise ValueError(f"no type name for {dtype.simpleString()}")


def is_midnight(stamp: Column) -> Column:
    """Midnight UTC at millisecond precision."""
    return F.date_trunc("MILLISECOND", stamp) == F.date_trunc("DAY", stamp)


def infer_value_type(value: Column, dtype: T.DataType) -> Column:
    """Type name of a typed value; doubles and timestamps are judged value by value."""
    kinds = possible_types(dtype)
    if kinds == ("integer", "number"):
        known = F.when(F.rint(value.cast("double")) == value.cast("double"), "integer").otherwise("number")
    elif kinds == ("date", "date-time"):
        known = F.when(is_midnight(value), "date").otherwise("date-time")
    else:
        known = F.lit(kinds[0])
    return F.when(value.isNull(), F.lit("null")).otherwise(known)


def numeric_text(text: Column) -> Column:
    """Text as a double, NULL when it is not a plain number."""
    return F.when(text.rlike(whole(NUMERIC_TEXT)), trimmed(text).try_cast("double"))


def round_half_up(number: Column) -> Column:
    return F.floor(number + F.lit(0.5))


def to_boolean(text: Column) -> Column:
    number = numeric_text(text)
    return (
        F.when(text.isNull() | (text == "null"), F.lit(None).cast("boolean"))
        .when(number.isNotNull(), F.signum(number) * F.floor(F.abs(number)) > 0)
        .otherwise(F.lower(trimmed(text)).isin("true", "yes"))
    )


def to_number(text: Column) -> Column:
    return F.when(text != "null", numeric_text(text))


def to_integer(text: Column) -> Column:
    """Exact for integer text of any 64-bit size, otherwise the nearest integer."""
    exact = F.when(text.rlike(whole(INTEGER_TEXT)), trimmed(text).try_cast("bigint"))
    number = numeric_text(text)
    fits = F.abs(number) < F.lit(9.2e18)
    return F.when(text != "null", F.coalesce(exact, F.when(fits, round_half_up(number))))


def to_timestamp(text: Column) -> Column:
    return F.when(text != "null", parse_utc_timestamp(text))


def convert_value(text: Column, kind: str) -> Column:
    """Raw text as a value of type ``kind``; text that does not fit becomes NULL."""
    if kind == "null":
        return F.lit(None).cast("string")
    if kind in ("string", "object", "array"):
        return F.when(text != "null", text)
    if kind == "boolean":
        return to_boolean(text)
    if kind == "number":
        return to_number(text)
    if kind == "integer":
        return to_integer(text)
    if kind == "date-time":
        return to_timestamp(text)
    if kind == "date":
        return to_timestamp(text).cast("date")
    raise ValueError(f"cannot convert to {kind}")


__all__ = [
    "TYPE_NAMES", "convert_value", "infer_string_type", "infer_value_type", "is_midnight",
    "iso_millis", "numeric_text", "possible_types", "round_half_up", "to_boolean",
    "to_integer", "to_number", "to_timestamp",
]
