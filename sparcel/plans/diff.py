"""Structural comparison of two descriptions, as joins of their tables.

Properties are rows ``(schema, path array<string>, types array<string>, hidden, unit,
description)``, a nested property having a longer path. ``keys`` (a package, a pair of
versions) let one job compare any number of descriptions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.functions.versions import LEVELS

# How much each kind of difference breaks.
BREAKING = (
    "REMOVE_PROPERTY", "REMOVE_SCHEMA", "CHANGE_PROPERTY_FORMAT", "CHANGE_PROPERTY_TYPE", "HIDE_PROPERTY",
)
COMPATIBLE = ("ADD_PROPERTY", "ADD_SCHEMA", "UNHIDE_PROPERTY")
MINOR = (
    "CHANGE_SOURCE", "CHANGE_SOURCE_CONFIGURATION", "CHANGE_SOURCE_CONNECTION", "CHANGE_SOURCE_CREDENTIALS",
    "REMOVE_HIDDEN_PROPERTY", "REMOVE_HIDDEN_SCHEMA", "CHANGE_VERSION", "REMOVE_SOURCE", "REMOVE_STREAM_SET",
    "CHANGE_PROPERTY_UNIT", "CHANGE_PACKAGE_DESCRIPTION", "CHANGE_PACKAGE_DISPLAY_NAME",
    "CHANGE_PROPERTY_DESCRIPTION", "CHANGE_README_MARKDOWN", "CHANGE_LICENSE_MARKDOWN", "CHANGE_WEBSITE",
    "CHANGE_CONTACT_EMAIL",
)
IDENTICAL = (
    "CHANGE_STREAM_UPDATE_HASH", "CHANGE_STREAM_STATS", "CHANGE_GENERATED_BY", "CHANGE_UPDATED_DATE",
    "CHANGE_README_FILE", "CHANGE_LICENSE_FILE", "CHANGE_STREAM_UPDATE_METHOD",
)
LEVEL_OF = {d: level for level, group in enumerate((IDENTICAL, MINOR, COMPATIBLE, BREAKING)) for d in group}

# Difference per descriptive field of a package.
PACKAGE_FIELDS = {
    "description": "CHANGE_PACKAGE_DESCRIPTION",
    "display_name": "CHANGE_PACKAGE_DISPLAY_NAME",
    "version": "CHANGE_VERSION",
    "readme_file": "CHANGE_README_FILE",
    "website": "CHANGE_WEBSITE",
    "contact_email": "CHANGE_CONTACT_EMAIL",
    "readme_markdown": "CHANGE_README_MARKDOWN",
    "license_file": "CHANGE_LICENSE_FILE",
    "license_markdown": "CHANGE_LICENSE_MARKDOWN",
    "generated_by": "CHANGE_GENERATED_BY",
    "updated_date": "CHANGE_UPDATED_DATE",
}

# The sentence of each difference.
SENTENCES = {
    "REMOVE_SCHEMA": "Removed Schema", "REMOVE_HIDDEN_SCHEMA": "Removed Hidden Schema", "ADD_SCHEMA": "Added Schema",
    "REMOVE_SOURCE": "Removed Source", "REMOVE_STREAM_SET": "Removed Stream Set", "CHANGE_SOURCE": "Changed Source",
    "CHANGE_SOURCE_CONNECTION": "Changed Source Connection Configuration",
    "CHANGE_SOURCE_CREDENTIALS": "Changed Source Credentials",
    "CHANGE_SOURCE_CONFIGURATION": "Changed Source Configuration",
    "CHANGE_PACKAGE_DISPLAY_NAME": "Changed Package Display Name", "CHANGE_PACKAGE_DESCRIPTION": "Changed Package Description",
    "CHANGE_STREAM_STATS": "Changed Stream Stats", "CHANGE_STREAM_UPDATE_HASH": "Changed Stream Update Hash",
    "CHANGE_STREAM_UPDATE_METHOD": "Changed Source Update Method", "ADD_PROPERTY": "Added Property",
    "HIDE_PROPERTY": "Property Hidden", "UNHIDE_PROPERTY": "Property Unhidden", "REMOVE_PROPERTY": "Removed Property",
    "REMOVE_HIDDEN_PROPERTY": "Removed Hidden Property", "CHANGE_PROPERTY_TYPE": "Changed Property Type",
    "CHANGE_PROPERTY_FORMAT": "Changed Property Format", "CHANGE_PROPERTY_UNIT": "Changed Property Unit",
    "CHANGE_PROPERTY_DESCRIPTION": "Changed Property Description", "CHANGE_GENERATED_BY": "Changed Generated By",
    "CHANGE_UPDATED_DATE": "Changed Updated Date", "CHANGE_VERSION": "Changed Version",
    "CHANGE_README_MARKDOWN": "Changed Readme Markdown", "CHANGE_LICENSE_MARKDOWN": "Changed License Markdown",
    "CHANGE_README_FILE": "Changed Readme File", "CHANGE_LICENSE_FILE": "Changed License File",
    "CHANGE_WEBSITE": "Changed Website", "CHANGE_CONTACT_EMAIL": "Changed Contact Email",
}

_HERE = "#"


def _found(*tests: tuple[str, Column]) -> Column:
    """Array of the differences whose test holds."""
    marks = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests])
    return F.array_compact(marks)


def _side(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(prefix))


def _pointer(schema: Column, path: Column) -> Column:
    steps = F.array_join(F.transform(path, lambda p: F.concat(F.lit("/properties/"), p)), "")
    return F.concat(F.lit("#/"), schema, steps)


def diff_properties(prior: DataFrame, new: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, difference, pointer) between properties of the same schema.

    A nested property counts only while every property above it is an object on both sides.
    """
    keys = list(keys)
    join_keys = [*keys, "schema", "path"]
    both = _side(prior, join_keys, "p").join(_side(new, join_keys, "n"), join_keys, "full_outer")
    opened = F.array_contains("p.types", "object") & F.array_contains("n.types", "object")
    state = both.withColumn("_open", F.coalesce(F.col("p").isNotNull() & F.col("n").isNotNull() & opened, F.lit(False)))

    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i))
    nested = state.filter(F.size("path") > 1).select(*join_keys, F.explode(above).alias("_above"))
    closed = state.filter(~F.col("_open")).select(*keys, "schema", F.col("path").alias("_above"))
    covered = nested.join(closed, [*keys, "schema", "_above"], "left_semi").select(*join_keys).distinct()

    hidden_p, hidden_n = F.coalesce("p.hidden", F.lit(False)), F.coalesce("n.hidden", F.lit(False))
    gone, added = F.col("n").isNull(), F.col("p").isNull()
    here = ~gone & ~added
    found = _found(
        ("REMOVE_HIDDEN_PROPERTY", gone & hidden_p),
        ("REMOVE_PROPERTY", gone & ~hidden_p),
        ("CHANGE_PROPERTY_DESCRIPTION", here & ~F.col("p.description").eqNullSafe(F.col("n.description"))),
        ("CHANGE_PROPERTY_TYPE", here & ~F.array_sort(F.col("p.types")).eqNullSafe(F.array_sort(F.col("n.types")))),
        ("HIDE_PROPERTY", here & ~hidden_p & hidden_n),
        ("UNHIDE_PROPERTY", here & hidden_p & ~hidden_n),
        ("CHANGE_PROPERTY_UNIT", here & ~F.col("p.unit").eqNullSafe(F.col("n.unit"))),
        ("ADD_PROPERTY", added),
    )
    return (
        state.join(covered, join_keys, "left_anti")
        .select(*keys, _pointer(F.col("schema"), F.col("path")).alias("pointer"), F.explode(found).alias("difference"))
        .select(*keys, "difference", "pointer")
    )


def diff_schemas(
    prior: DataFrame, new: DataFrame, prior_properties: DataFrame, new_properties: DataFrame,
    keys: Iterable[str] = (), report_added: bool = False,
) -> DataFrame:
    """Schemas ``(keys, schema, hidden)`` by title, and the properties of those on both sides."""
    keys = list(keys)
    on = [*keys, "schema"]
    removed = prior.join(new, on, "left_anti").select(
        *keys,
        F.when(F.coalesce("hidden", F.lit(False)), "REMOVE_HIDDEN_SCHEMA").otherwise("REMOVE_SCHEMA").alias("difference"),
        F.lit("").alias("pointer"),
    )
    shared = prior.join(new, on, "left_semi").select(*on)
    changed = diff_properties(
        prior_properties.join(shared, on, "left_semi"), new_properties.join(shared, on, "left_semi"), keys
    )
    result = removed.unionByName(changed)
    if report_added:
        added = new.join(prior, on, "left_anti")
        result = result.unionByName(added.select(*keys, F.lit("ADD_SCHEMA").alias("difference"), F.lit("").alias("pointer")))
    return result


def canonical_json(text: Column) -> Column:
    """JSON text with its keys in order, so that equal objects have equal text."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def diff_streams(prior: DataFrame, new: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Stream sets ``(keys, source, stream_set, update_methods, inspected_count, update_hash)`` of shared sources."""
    keys = list(keys)
    on = [*keys, "source", "stream_set"]
    both = _side(prior, on, "p").join(_side(new, on, "n"), on, "left")
    gone = F.col("n").isNull()
    found = _found(
        ("REMOVE_STREAM_SET", gone),
        ("CHANGE_STREAM_UPDATE_METHOD", ~gone & ~F.col("p.update_methods").eqNullSafe(F.col("n.update_methods"))),
        ("CHANGE_STREAM_STATS", ~gone & ~F.col("p.inspected_count").eqNullSafe(F.col("n.inspected_count"))),
        (
            "CHANGE_STREAM_UPDATE_HASH",
            ~gone & F.col("p.update_hash").isNotNull() & ~F.col("p.update_hash").eqNullSafe(F.col("n.update_hash")),
        ),
    )
    return both.select(*keys, F.explode(found).alias("difference"), F.lit(_HERE).alias("pointer"))


def diff_sources(
    prior: DataFrame, new: DataFrame, prior_sets: DataFrame, new_sets: DataFrame, keys: Iterable[str] = ()
) -> DataFrame:
    """Sources ``(keys, source, type, configuration, connection, credentials)`` and their stream sets."""
    keys = list(keys)
    on = [*keys, "source"]
    both = _side(prior, on, "p").join(_side(new, on, "n"), on, "left")
    gone, here = F.col("n").isNull(), F.col("n").isNotNull()
    same_type = F.col("p.type").eqNullSafe(F.col("n.type"))

    def differs(name: str) -> Column:
        return here & same_type & ~canonical_json(F.col(f"p.{name}")).eqNullSafe(canonical_json(F.col(f"n.{name}")))

    found = _found(
        ("REMOVE_SOURCE", gone),
        ("CHANGE_SOURCE", here & ~same_type),
        ("CHANGE_SOURCE_CONFIGURATION", differs("configuration")),
        ("CHANGE_SOURCE_CONNECTION", differs("connection")),
        ("CHANGE_SOURCE_CREDENTIALS", here & same_type & ~F.col("p.credentials").eqNullSafe(F.col("n.credentials"))),
    )
    sources = both.select(
        *keys, F.explode(found).alias("difference"),
    ).withColumn("pointer", F.when(F.col("difference") == "REMOVE_SOURCE", "").otherwise(_HERE))
    shared = prior.join(new, on, "left_semi").select(*on)
    return sources.unionByName(diff_streams(prior_sets.join(shared, on, "left_semi"), new_sets, keys))


def diff_descriptions(prior: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Descriptive fields of the packages on both sides."""
    keys = list(keys)
    both = _side(prior, keys, "p").join(_side(new, keys, "n"), keys)
    present = [f for f in PACKAGE_FIELDS if f in prior.columns and f in new.columns]
    found = _found(*[(PACKAGE_FIELDS[f], ~F.col(f"p.{f}").eqNullSafe(F.col(f"n.{f}"))) for f in present])
    return both.select(*keys, F.explode(found).alias("difference"), F.lit(_HERE).alias("pointer"))


def diff_packages(prior: dict[str, DataFrame], new: dict[str, DataFrame], keys: Iterable[str]) -> DataFrame:
    """All differences between two sets of tables ``packages, schemas, properties, sources, stream_sets``."""
    keys = list(keys)
    return (
        diff_descriptions(prior["packages"], new["packages"], keys)
        .unionByName(diff_schemas(prior["schemas"], new["schemas"], prior["properties"], new["properties"], keys))
        .unionByName(diff_sources(prior["sources"], new["sources"], prior["stream_sets"], new["stream_sets"], keys))
    )


def level_of(difference: Column) -> Column:
    """Position of a difference in LEVELS; an unknown one is an error."""
    table = F.create_map(*[x for d, level in LEVEL_OF.items() for x in (F.lit(d), F.lit(level))])
    error = F.raise_error(F.concat(F.lit("difference not mapped: "), difference)).cast("int")
    return F.coalesce(F.try_element_at(table, difference), error)


def diff_compatibility(diffs: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """The worst level per key. Without any difference there is no row: identical."""
    worst = F.max(level_of(F.col("difference")))
    names = F.array(*[F.lit(x) for x in LEVELS])
    return diffs.groupBy(*keys).agg(worst.alias("level")).withColumn(
        "compatibility", F.get(names, F.coalesce(F.col("level"), F.lit(0)))
    )


def describe_diff(difference: Column, pointer: Column) -> Column:
    """Difference as a sentence, with the property path or the last part of the pointer."""
    table = F.create_map(*[x for d, text in SENTENCES.items() for x in (F.lit(d), F.lit(text))])
    last = F.element_at(F.split(pointer, "/"), -1)
    inner = F.regexp_extract(pointer, r".*/properties/(.*)", 1)
    place = F.when(difference.contains("_PROPERTY") & (inner != ""), inner).otherwise(last)
    text = F.try_element_at(table, difference)
    return F.when(place != "", F.concat_ws(" ", text, place)).otherwise(text)
