"""Sensitive-content labels: pattern detectors on values, name detectors on columns.

All pattern detectors of all columns are counted in a single aggregate over one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.infer import infer_string_type, possible_types
from sparcel.functions.text import NON_WS, WORD_EDGE, trimmed
from sparcel.operators.profile import Field, fields

THRESHOLD = 0.66
LONG_TEXT = 40

# Value patterns. ``\b`` stands for an ASCII word boundary.
SSN = r"\b(?!666|000|9\d{2})\d{3}-?(?!00)\d{2}-?(?!0{4})\d{4}\b"
CREDIT_CARD = (
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|[25][1-7][0-9]{14}|6(?:011|5[0-9][0-9])[0-9]{12}|3[47][0-9]{13}"
    r"|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:2131|1800|35\d{3})\d{11})\b"
)
PHONE = r"\b(?:\+?(\d{1,3})[-. (]+)?(\d{3})[-. )]+(\d{3})[-. ]+(\d{4})(?: *x(\d+))?\b"
EMAIL = r"\S+@\S+\.\S{1,10}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
IPV6 = (
    r"([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}"
    r"|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})|:((:[0-9a-fA-F]{1,4}){1,7}|:)|fe80:(:[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}"
    r"|::(ffff(:0{1,4}){0,1}:){0,1}((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])"
    r"|([0-9a-fA-F]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])"
)

# Column-name patterns.
NAME_PATTERNS = {
    "gender": (("string",), r"gender|sex"),
    "birthdate": (("string", "date"), r"dob|date[-_\s]?Of[-_\s]?birth|birth[-_\s]?(?:date|day)"),
    "drivers_license": (("string", "integer"), r"drivers?[-_\s]?license|^dl$"),
    "age": (("integer",), r"^age$"),
    "username": (("string",), r"user(?:[-_\s]name)?"),
    "ethnicity": (("string",), r"ethnicity|race"),
    "secret": (("string",), r"^pass$|password|secret"),
    "passport": (("string", "integer"), r"pass[-_\s]?port"),
    "national_provider_id": (("string", "integer"), r"^npi$|national[-_\s]?provider[-_\s]?id"),
    "geo_latitude": (("number",), r"^lat$|latitude"),
    "geo_longitude": (("number",), r"^long$|longitude"),
}


@dataclass(frozen=True)
class ValueDetector:
    """``must_contain`` is a cheap test that every match passes."""

    label: str
    types: tuple[str, ...]
    pattern: str
    must_contain: str | None = None

    def hit(self, text: Column) -> Column:
        pattern = self.pattern.replace(r"\S", NON_WS)
        if pattern.startswith(r"\b"):
            # Every such match starts with a digit or a plus sign, and ends with a digit.
            pattern = r"(?=[+\d])" + WORD_EDGE + pattern.removeprefix(r"\b").removesuffix(r"\b") + "(?![0-9A-Za-z_])"
        found = text.rlike(pattern)
        return text.contains(self.must_contain) & found if self.must_contain else found


VALUE_DETECTORS = (
    ValueDetector("social_security_number", ("string", "integer"), SSN),
    ValueDetector("credit_card_number", ("string", "integer"), CREDIT_CARD),
    ValueDetector("ip_v6_address", ("string",), IPV6, ":"),
    ValueDetector("ip_v4_address", ("string",), r"(?=\d)" + IPV4, "."),
    ValueDetector("phone_number", ("string",), PHONE),
    ValueDetector("email_address", ("string",), EMAIL, "@"),
)
BY_LABEL = {d.label: d for d in VALUE_DETECTORS}

LABEL_COLUMNS = "property string, type string, label string, occurrence_count bigint, tested_count bigint, applied boolean"


def detect(text: Column, label: str) -> Column:
    """True where a value matches the pattern of ``label``."""
    return F.coalesce(BY_LABEL[label].hit(text), F.lit(False))


def name_labels(name: str, kind: str) -> list[str]:
    """Labels that the name of a column of type ``kind`` gives it."""
    leaf = name.replace("[]", "").split(".")[-1]
    return [
        label for label, (kinds, pattern) in NAME_PATTERNS.items()
        if kind in kinds and re.search(pattern, leaf, re.IGNORECASE)
    ]


def typed_text(value: Column, dtype: T.DataType, raw: bool, kind: str) -> Column:
    """Values of one type as text, NULL elsewhere."""
    if raw:
        return F.when(infer_string_type(value) == kind, value)
    if kind == "integer" and not isinstance(dtype, T.IntegralType):
        number = value.cast("double")
        fits = F.abs(number) < F.lit(9.2e18)
        return F.when(fits & (F.rint(number) == number), value.try_cast("bigint").cast("string"))
    if kind == "number" and not isinstance(dtype, T.IntegralType):
        return F.when(F.rint(value.cast("double")) != value.cast("double"), value.cast("string"))
    return value.cast("string")


def scan_content_labels(
    df: DataFrame, *, raw: Iterable[str] = (), columns: Iterable[str] | None = None,
    labels: Iterable[str] | None = None, by: Iterable[str] = (),
) -> DataFrame:
    """Count every detector on every column: (property, type, label, counts, applied).

    Labels without any occurrence are left out. A value label is applied above a share of
    0.66 of the tested values; a name label always.
    """
    by = list(by)
    chosen = [d for d in VALUE_DETECTORS if labels is None or d.label in set(labels)]
    names = [f for f in df.schema.fields if f.name not in by and (columns is None or f.name in set(columns))]
    aggregates: list[Column] = []
    rows: list[Column] = []
    for field in fields(T.StructType(names), raw):
        if isinstance(field.dtype, (T.StructType, T.ArrayType, T.MapType, T.NullType)):
            continue
        kinds = ("string", "integer", "number", "date") if field.raw else possible_types(field.dtype)
        for kind in kinds:
            text = _array_text(field, kind) if field.elements else typed_text(field.column, field.dtype, field.raw, kind)
            detectors = [d for d in chosen if kind in d.types]
            by_name = [n for n in name_labels(field.name, kind) if labels is None or n in set(labels)]
            if not detectors and not by_name:
                continue
            key = f"t{len(aggregates)}"
            aggregates.append(_tested(text, field).alias(key))
            for d in detectors:
                alias = f"h{len(aggregates)}"
                aggregates.append(_hits(text, field, d).alias(alias))
                hits = F.col(alias)
                rows.append(_row(field.name, kind, d.label, hits, F.col(key), hits / F.nullif(F.col(key), F.lit(0)) > THRESHOLD))
            for label in by_name:
                found = F.when(F.col(key) > 0, F.lit(1)).otherwise(F.lit(0))
                rows.append(_row(field.name, kind, label, found, F.lit(0), F.lit(True)))
    if not rows:
        return df.sparkSession.createDataFrame([], LABEL_COLUMNS)
    wide = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return wide.select(*by, F.inline(F.array(*rows))).filter(F.col("occurrence_count") > 0)


def _row(name: str, kind: str, label: str, hits: Column, tested: Column, applied: Column) -> Column:
    return F.struct(
        F.lit(name).alias("property"), F.lit(kind).alias("type"), F.lit(label).alias("label"),
        hits.cast("bigint").alias("occurrence_count"), tested.cast("bigint").alias("tested_count"),
        F.coalesce(applied, F.lit(False)).alias("applied"),
    )


def _array_text(field: Field, kind: str) -> Column:
    def one(value: Column) -> Column:
        return typed_text(value, field.dtype, field.raw, kind)

    return F.filter(F.transform(field.column, one), lambda v: v.isNotNull())


def _tested(text: Column, field: Field) -> Column:
    return F.sum(F.coalesce(F.size(text), F.lit(0))) if field.elements else F.count(text)


def _hits(text: Column, field: Field, detector: ValueDetector) -> Column:
    if field.elements:
        return F.sum(F.coalesce(F.size(F.filter(text, detector.hit)), F.lit(0)))
    return F.count_if(detector.hit(text))


def detect_person_names(df: DataFrame, columns: Iterable[str], names: DataFrame) -> DataFrame:
    """Count the values that are, or contain, a name of the user's ``names(name)`` table.

    Values of up to 40 characters must be a name, word by word; longer ones must contain one.
    The names table is left to the optimizer, which broadcasts it only while its measured size
    allows; words that are no names are gone before the values are grouped.
    """
    columns = list(columns)
    known = names.select(F.lower(F.trim("name")).alias("word")).distinct()
    entries = [
        F.struct(F.lit(c).alias("property"), F.col(f"`{c}`").alias("value")) for c in columns
    ]
    # every record is one of its own, whatever its cells repeat
    values = df.select(F.monotonically_increasing_id().alias("_key"), *columns).select("_key", F.inline(F.array(*entries))).filter("value is not null")
    words = F.filter(F.split(F.lower("value"), r"[^\p{L}'-]+"), lambda w: w != "")
    short = F.length(trimmed(F.col("value"))) <= LONG_TEXT
    # Only short values, which have few words, need each word once.
    split = values.select("_key", "property", short.alias("short"), words.alias("words")).select(
        "_key", "property", "short", F.when(F.col("short"), F.array_distinct("words")).otherwise(F.col("words")).alias("words")
    )
    tokens = split.select(
        "_key", "property", "short", F.when(F.col("short"), F.size("words")).alias("n_words"), F.explode("words").alias("word")
    )
    per_value = (
        tokens.join(known, "word", "left_semi")
        .groupBy("property", "_key", "short", "n_words").agg(F.count("*").alias("n"))
        .filter(~F.col("short") | (F.col("n") == F.col("n_words")))
    )
    hits = per_value.groupBy("property").agg(F.count("*").alias("occurrence_count"))
    tested = values.groupBy("property").agg(F.count("*").alias("tested_count"))
    return tested.join(hits, "property", "left").select(
        "property", F.lit("string").alias("type"), F.lit("person_name").alias("label"),
        F.coalesce("occurrence_count", F.lit(0)).cast("bigint").alias("occurrence_count"), "tested_count",
        (F.coalesce("occurrence_count", F.lit(0)) / F.col("tested_count") > THRESHOLD).alias("applied"),
    )


def merge_labels(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Keep old labels and their hidden flag, add new ones, add up the counts."""
    keys = ["property", "type", "label"]
    joined = existing.alias("e").join(new.alias("n"), keys, "full_outer")

    def total(name: str) -> Column:
        e, n = F.col(f"e.{name}"), F.col(f"n.{name}")
        return F.when(e.isNotNull() | n.isNotNull(), F.coalesce(e, F.lit(0)) + F.coalesce(n, F.lit(0))).alias(name)

    hidden = F.coalesce(F.col("e.hidden"), F.lit(False)) | F.coalesce(F.col("n.hidden"), F.lit(False))
    return joined.select(*keys, total("occurrence_count"), total("tested_count"), hidden.alias("hidden"))
