"""Descriptor files of older formats, brought to the current one file by file.

The work is spread by Spark over many descriptor files; the steps on one descriptor are
small dictionary edits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.session import written

Descriptor = dict[str, Any]

# Format versions in order.
FORMATS = ("0.1.0", "0.2.0", "0.3.0", "0.4.0", "0.5.0", "0.6.0", "0.7.0", "0.8.0", "0.8.1", "0.9.0", "0.31.5", "0.32.1")
CURRENT = FORMATS[-1]
SCHEMA_NAME = "package-file-schema-v{}.json"


def format_of(descriptor: Descriptor) -> str:
    """Format version in the name of the schema; descriptors without any are the first format."""
    name = descriptor.get("$schema")
    if name is None:
        return FORMATS[0]
    found = re.search(r"v(\d+\.\d+\.\d+)\.json$", name)
    if not found or found.group(1) not in FORMATS:
        raise ValueError(f"unknown descriptor format {name}")
    return found.group(1)


def _schemas(d: Descriptor) -> list[Descriptor]:
    return d.get("schemas") or []


def _properties(d: Descriptor) -> Iterator[Descriptor]:
    for schema in _schemas(d):
        yield from (schema.get("properties") or {}).values()


def _count_precision(d: Descriptor) -> None:
    for schema in _schemas(d):
        approximate = schema.pop("recordCountApproximate", None)
        schema["recordsInspectedCount"] = schema.get("recordCount")
        schema["recordCountPrecision"] = "APPROXIMATE" if approximate is True else "EXACT"


def _sources(d: Descriptor) -> None:
    """Sources move out of the schemas, one for each schema that has any."""
    for schema in _schemas(d):
        source = schema.pop("source", None)
        if not source:
            continue
        stats = {
            "inspectedCount": schema.get("recordsInspectedCount") or 0,
            **{k: schema.get(k) for k in ("byteCount", "byteCountPrecision", "recordCount", "recordCountPrecision")},
        }
        stream_set = {
            "slug": source.get("uri"), "configuration": {}, "schemaTitles": [schema.get("title")],
            "lastUpdateHash": source.get("lastUpdateHash"), "streamStats": stats,
        }
        d.setdefault("sources", []).append({
            "slug": source.get("uri"), "type": source.get("type"), "uris": [source.get("uri")],
            "configuration": source.get("configuration"), "streamSets": [stream_set],
        })


def _number(text: str) -> float | int | None:
    found = re.match(r"\s*[-+]?\d+(?:\.\d*)?", text)
    if not found:
        return None
    return float(found.group()) if "." in text else int(found.group())


def _value_statistics(d: Descriptor) -> None:
    for prop in _properties(d):
        for stats in (prop.get("valueTypes") or {}).values():
            for key in ("dateMaxValue", "dateMinValue"):
                if key in stats and stats[key] is None:
                    del stats[key]
            for key in ("numberMaxValue", "numberMinValue"):
                if isinstance(stats.get(key), str):
                    stats[key] = _number(stats[key])
                    if stats[key] is None:
                        del stats[key]


def _uris(d: Descriptor) -> None:
    for source in d.get("sources") or []:
        source["configuration"] = {**(source.get("configuration") or {}), "uris": source.get("uris")}


def _connections(d: Descriptor) -> None:
    for source in d.get("sources") or []:
        source["connectionConfiguration"] = dict(source.get("configuration") or {})


def _publish_methods(d: Descriptor) -> None:
    for registry in d.get("registries") or []:
        registry["publishMethod"] = "SCHEMA_ONLY"


def _canonical(d: Descriptor) -> None:
    if d.get("canonical") is None:
        d["canonical"] = True


def _update_methods(d: Descriptor) -> None:
    for source in d.get("sources") or []:
        for stream_set in source.get("streamSets") or []:
            if stream_set.get("updateMethods") is None:
                stream_set["updateMethods"] = []


def _types(d: Descriptor) -> None:
    for source in d.get("sources") or []:
        configuration = source.get("configuration") or {}
        if configuration.get("filePattern") is not None:
            configuration["fileRegex"] = configuration.pop("filePattern")
    for prop in _properties(d):
        prop["types"] = prop.pop("valueTypes", None) or {}


def _nested(d: Descriptor) -> None:
    def move(properties: dict[str, Descriptor]) -> None:
        for prop in properties.values():
            inner = prop.get("properties")
            if inner is not None and (prop.get("types") or {}).get("object") is not None:
                del prop["properties"]
                prop["types"]["object"] = {**prop["types"]["object"], "objectProperties": inner}
                move(inner)

    for schema in _schemas(d):
        move(schema.get("properties") or {})


def _texts(d: Descriptor) -> None:
    for name, missing in (("readme", None), ("license", "No license defined")):
        file_key, text_key = f"{name}File", f"{name}Markdown"
        if d.get(file_key) is not None and d.get(text_key) is not None:
            del d[file_key]
        if d.get(file_key) is None and d.get(text_key) is None:
            title = d.get("displayName") or d.get("packageSlug")
            d[text_key] = missing or f"# {title}\n\n No readme defined"


STEPS: dict[str, Callable[[Descriptor], None]] = {
    "0.1.0": _count_precision, "0.2.0": _sources, "0.3.0": _value_statistics, "0.4.0": _uris, "0.5.0": _connections,
    "0.6.0": _publish_methods, "0.7.0": _canonical, "0.8.0": _update_methods, "0.8.1": _types, "0.9.0": _nested,
    "0.31.5": _texts,
}


def upgrade(descriptor: Descriptor) -> Descriptor:
    """Apply every step from the descriptor's format to the current one."""
    start = format_of(descriptor)
    for version in FORMATS[FORMATS.index(start) : -1]:
        STEPS[version](descriptor)
    name = descriptor.get("$schema") or SCHEMA_NAME.format(start)
    descriptor["$schema"] = name.replace(start, CURRENT)
    return descriptor


def upgrade_descriptors(df: DataFrame, text: str = "value") -> DataFrame:
    """Add ``from_format``, ``descriptor`` (upgraded JSON) and ``error`` to rows of descriptor text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for value in part[text]:
                try:
                    descriptor = json.loads(value)
                    rows.append((format_of(descriptor), json.dumps(upgrade(descriptor), ensure_ascii=False), None))
                except (ValueError, TypeError, KeyError, AttributeError) as error:
                    rows.append((None, None, str(error)))
            yield part.assign(**dict(zip(("from_format", "descriptor", "error"), map(list, zip(*rows)))) if rows else {"from_format": [], "descriptor": [], "error": []})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{columns}, from_format string, descriptor string, error string")


def _property_rows(descriptor: Descriptor) -> Iterator[tuple]:
    """(schema, path, types, hidden, unit, description) of every property, nested ones included."""

    def walk(schema: str, above: list[str], properties: dict[str, Descriptor]) -> Iterator[tuple]:
        for name, prop in properties.items():
            path, types = [*above, name], prop.get("types") or {}
            yield schema, path, sorted(types), prop.get("hidden"), prop.get("unit"), prop.get("description")
            inner = (types.get("object") or {}).get("objectProperties")
            if inner:
                yield from walk(schema, path, inner)

    for schema in _schemas(descriptor):
        yield from walk(schema.get("title"), [], schema.get("properties") or {})


def descriptor_properties(df: DataFrame, key: str = "package", text: str = "descriptor") -> DataFrame:
    """Property rows of current-format descriptors, ready for comparison."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *row) for k, value in zip(part[key], part[text]) if value for row in _property_rows(json.loads(value))]
            yield pd.DataFrame(rows, columns=[key, "schema", "path", "types", "hidden", "unit", "description"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(
        run, f"`{key}` {kind}, schema string, path array<string>, types array<string>, hidden boolean, unit string, description string"
    )


def descriptor_tables(df: DataFrame, key: str = "package", text: str = "descriptor") -> dict[str, DataFrame]:
    """Tables of current-format descriptors, for comparison: packages, schemas, properties, sources, stream sets.

    The descriptors are written once to the shared folder, as every table reads them.
    """
    df = written(df.select(key, text), "descriptors")
    shape = (
        "displayName string, description string, version string, updatedDate string, website string, contactEmail string, "
        "readmeMarkdown string, licenseMarkdown string, readmeFile string, licenseFile string, generatedBy string, "
        "schemas array<struct<title:string, hidden:boolean>>, "
        "sources array<struct<slug:string, type:string, configuration:variant, connectionConfiguration:variant, "
        "credentialsIdentifier:string, streamSets:array<struct<slug:string, updateMethods:array<string>, "
        "lastUpdateHash:string, streamStats:struct<inspectedCount:bigint>>>>>"
    )
    d = df.select(key, F.from_json(text, shape).alias("d")).select(key, "d.*")
    packages = d.select(
        key, F.col("displayName").alias("display_name"), "description", "version", "website",
        F.col("contactEmail").alias("contact_email"), F.col("readmeMarkdown").alias("readme_markdown"),
        F.col("licenseMarkdown").alias("license_markdown"), F.col("readmeFile").alias("readme_file"),
        F.col("licenseFile").alias("license_file"), F.col("generatedBy").alias("generated_by"),
        F.col("updatedDate").alias("updated_date"),
    )
    schemas = d.select(key, F.explode("schemas").alias("s")).select(key, F.col("s.title").alias("schema"), "s.hidden")
    source = d.select(key, F.explode("sources").alias("s"))
    sources = source.select(
        key, F.col("s.slug").alias("source"), "s.type", F.to_json("s.configuration").alias("configuration"),
        F.to_json("s.connectionConfiguration").alias("connection"), F.col("s.credentialsIdentifier").alias("credentials"),
    )
    sets = source.select(key, F.col("s.slug").alias("source"), F.explode("s.streamSets").alias("t")).select(
        key, "source", F.col("t.slug").alias("stream_set"), F.col("t.updateMethods").alias("update_methods"),
        F.col("t.streamStats.inspectedCount").alias("inspected_count"), F.col("t.lastUpdateHash").alias("update_hash"),
    )
    properties = descriptor_properties(df, key, text)
    return {"packages": packages, "schemas": schemas, "properties": properties, "sources": sources, "stream_sets": sets}
