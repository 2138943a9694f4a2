"""Semantic versions as comparable structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much a change breaks, from least to most.
LEVELS = ("identical", "minor", "compatible", "breaking")


def version_parse(text: Column) -> Column:
    """``struct(major, minor, patch)``; struct order is version order. NULL if malformed; a part beyond 64 bits is an error."""
    ok = text.rlike(r"^\d+\.\d+\.\d+$")
    part = [F.when(ok, F.split_part(text, F.lit("."), F.lit(i))).cast("bigint") for i in (1, 2, 3)]
    return F.when(
        ok, F.struct(part[0].alias("major"), part[1].alias("minor"), part[2].alias("patch"))
    )


def version_text(version: Column) -> Column:
    return F.concat_ws(".", version["major"], version["minor"], version["patch"])


def version_struct(major: Column, minor: Column, patch: Column) -> Column:
    return F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch"))


def next_version(version: Column, level: Column) -> Column:
    """Smallest version allowed after a change of ``level`` (a position in LEVELS)."""
    zero = F.lit(0)
    major, minor, patch = version["major"], version["minor"], version["patch"]
    return (
        F.when(level == 3, version_struct(major + 1, zero, zero))
        .when(level == 2, version_struct(major, minor + 1, zero))
        .when(level == 1, version_struct(major, minor, patch + 1))
        .otherwise(version_struct(major, minor, patch))
    )


def change_kind(prior: Column, proposed: Column) -> Column:
    """Which part of the version moved: first, major, minor, patch or trivial."""
    return (
        F.when(prior.isNull(), "first")
        .when(proposed["major"] != prior["major"], "major")
        .when(proposed["minor"] != prior["minor"], "minor")
        .when(proposed["patch"] != prior["patch"], "patch")
        .otherwise("trivial")
    )
