"""Names: sanitising, slugs, file names, identifier rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparcel.functions.text import trimmed

# Identifier rules.
SLUG_LENGTH = 38
USERNAME_LENGTH = 39
COLLECTION_SLUG_LENGTH = 100
DESCRIPTION_LENGTHS = (3, 256)
DISPLAY_NAME_LENGTHS = (3, 128)
PACKAGE_SLUG = r"^[a-z0-9]+(?:(?:(?:[._]|__|[-]*)[a-z0-9]+)+)?$"
CATALOG_SLUG = r"(?i)^[a-z\d](?:[a-z\d]|-(?=[a-z\d])){0,38}$"
DISPLAY_NAME = r"^[a-zA-Z][a-zA-z0-9 _\-%*\\+]+$"
EMAIL = (
    r"(?i)^(?=[A-Z0-9][A-Z0-9@._%+-]{5,253}$)[A-Z0-9._%+-]{1,64}@"
    r"(?:(?=[A-Z0-9-]{1,63}\.)[A-Z0-9]+(?:-[A-Z0-9]+)*\.){1,8}[A-Z]{2,63}$"
)
VERSION = r"^\d+\.\d+\.\d+$"


def sanitize_name(text: Column, rule: str) -> Column:
    """``avro`` keeps letters, digits, ``_`` and ``/``; ``column`` turns dots into ``_``; ``table`` into ``-``."""
    if rule == "avro":
        return F.regexp_replace(text, "[^a-zA-Z0-9_/]", "")
    return F.regexp_replace(text, r"\.", {"column": "_", "table": "-"}[rule])


def sanitized(name: str, rule: str) -> str:
    """The same for a column name on the driver."""
    if rule == "avro":
        return "".join(c for c in name if c.isascii() and (c.isalnum() or c in "_/"))
    return name.replace(".", {"column": "_", "table": "-"}[rule])


def slugify(text: Column) -> Column:
    edges = r"^[-|_]+|[-|_]+$"
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^0-9A-Za-z_]+", "-"), edges, "")
    return F.regexp_replace(F.substring(dashed, 1, SLUG_LENGTH), edges, "")


def title_case_words(text: Column) -> Column:
    spaced = F.regexp_replace(text, "([A-Z])", " $1")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2**31 - 1))


def file_name_of(url: Column) -> Column:
    """Last path segment (the one before a trailing slash), without the query."""
    parts = F.split(url, "/")
    last = F.when(url.endswith("/"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    return F.split_part(last, F.lit("?"), F.lit(1))


def _required(text: Column) -> Column:
    return text.isNull() | (text == "")


def validate(text: Column, rule: str) -> Column:
    """Error code of an identifier, NULL when it is valid."""
    if rule == "username":
        return (
            F.when(_required(text), "USERNAME_REQUIRED")
            .when(F.length(text) > USERNAME_LENGTH, "USERNAME_TOO_LONG")
            .when(~text.rlike(CATALOG_SLUG), "INVALID_CHARACTERS")
        )
    if rule in ("catalog_slug", "package_slug", "collection_slug"):
        code = rule.upper()
        limit = COLLECTION_SLUG_LENGTH if rule == "collection_slug" else SLUG_LENGTH
        pattern = PACKAGE_SLUG if rule == "package_slug" else CATALOG_SLUG
        return (
            F.when(_required(text), f"{code}_REQUIRED")
            .when(F.length(text) > limit, f"{code}_TOO_LONG")
            .when(~text.rlike(pattern), f"{code}_INVALID")
        )
    if rule == "password":
        return (
            F.when(_required(text), "PASSWORD_REQUIRED")
            .when(F.length(text) > 99, "PASSWORD_TOO_LONG")
            .when(F.length(text) < 8, "PASSWORD_TOO_SHORT")
            .when((F.length(text) < 16) & ~text.rlike("[0-9@#$%!]"), "INVALID_CHARACTERS")
        )
    if rule == "email":
        return (
            F.when(text.isNull() | (trimmed(text) == ""), "REQUIRED")
            .when(F.length(text) > 254, "TOO_LONG")
            .when(~text.rlike(EMAIL), "INVALID_EMAIL_ADDRESS_FORMAT")
        )
    if rule == "username_or_email":
        return F.when(text.contains("@"), validate(text, "email")).otherwise(validate(text, "username"))
    if rule == "description":
        low, high = DESCRIPTION_LENGTHS
        return (
            F.when(text.isNull(), "REQUIRED")
            .when(F.length(text) < low, "TOO_SHORT")
            .when(F.length(text) > high, "TOO_LONG")
        )
    if rule == "display_name":
        low, high = DISPLAY_NAME_LENGTHS
        return (
            F.when(text.isNull(), "REQUIRED")
            .when(~text.rlike(DISPLAY_NAME), "INVALID_CHARACTERS")
            .when(F.length(text) < low, "TOO_SHORT")
            .when(F.length(text) > high, "TOO_LONG")
        )
    if rule == "version":
        return F.when(_required(text), "VERSION_REQUIRED").when(~text.rlike(VERSION), "VERSION_INVALID")
    raise ValueError(f"unknown rule {rule}")
