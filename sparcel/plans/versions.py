"""Versions over time: chains of differences, publishing, refreshing, what is served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparcel.functions.versions import next_version, version_parse, version_text
from sparcel.operators.profile import merge_profiles
from sparcel.plans.diff import diff_properties, level_of

PUBLISH_METHODS = ("SCHEMA_ONLY", "SCHEMA_AND_DATA", "SCHEMA_PROXY_DATA")


def version_pairs(versions: DataFrame, package: str = "package", version: str = "version") -> DataFrame:
    """(package, version, prior): each version with the one before it. Only keys are sorted."""
    order = Window.partitionBy(package).orderBy(version_parse(F.col(version)))
    keys = versions.select(package, version).distinct()
    return keys.withColumn("prior", F.lag(version).over(order)).filter(F.col("prior").isNotNull())


def version_chain_diffs(versions: DataFrame, properties: DataFrame) -> DataFrame:
    """Differences of each version with its predecessor, over any number of packages.

    ``properties`` has ``package`` and ``version`` besides the property columns.
    """
    pairs = version_pairs(versions)
    new = properties.join(pairs, ["package", "version"])
    prior = properties.withColumnRenamed("version", "prior").join(pairs, ["package", "prior"])
    keys = ["package", "prior", "version"]
    columns = [*keys, *[c for c in properties.columns if c not in ("package", "version")]]
    return diff_properties(prior.select(*columns), new.select(*columns), keys)


def publish_check(proposed: DataFrame, latest: DataFrame, diffs: DataFrame) -> DataFrame:
    """May the proposed version be published? One row per package.

    ``proposed`` and ``latest`` are (package, version); ``diffs`` is (package, difference).
    A first version always may; no difference that matters leaves the version as it is.
    """
    level = diffs.groupBy("package").agg(F.max(level_of(F.col("difference"))).alias("_level"))
    joined = (
        proposed.select("package", F.col("version").alias("proposed"))
        .join(latest.select("package", F.col("version").alias("latest")), "package", "left")
        .join(level, "package", "left")
        .withColumn("_level", F.coalesce("_level", F.lit(0)))
    )
    minimum = next_version(version_parse(F.col("latest")), F.col("_level"))
    names = ["VERSION_TRIVIAL_CHANGE", "VERSION_PATCH_CHANGE", "VERSION_MINOR_CHANGE", "VERSION_MAJOR_CHANGE"]
    kind = F.when(F.col("latest").isNull(), "VERSION_FIRST_VERSION").otherwise(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("_level"))
    )
    allowed = F.col("latest").isNull() | (F.col("_level") == 0) | (version_parse(F.col("proposed")) >= minimum)
    return joined.select(
        "package", "latest", "proposed",
        F.when(F.col("latest").isNotNull(), version_text(minimum)).alias("minimum"),
        kind.alias("change_type"), allowed.alias("accepted"),
    )


def refresh_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """New schema rows with the texts people wrote; schemas no longer seen are dropped."""
    kept = [c for c in ("hidden", "description", "unit", "derived_from", "derived_from_description") if c in old.columns]
    texts = old.select("schema", *[F.col(c).alias(f"_old_{c}") for c in kept])
    joined = new.drop(*kept).join(texts, "schema")
    return joined.select(*[c for c in new.columns if c not in kept], *[F.col(f"_old_{c}").alias(c) for c in kept])


def refresh_profiles(old: DataFrame, new: DataFrame, schemas: DataFrame) -> DataFrame:
    """Profiles by schema: replaced by the new ones, or merged where the schema is CONTINUOUS.

    ``schemas`` is (schema, update_methods) of the new inspection.
    """
    live = schemas.filter(F.array_contains("update_methods", "CONTINUOUS")).select("schema")
    known = old.select("schema").distinct()
    current = new.join(known, "schema", "left_semi")
    merged = merge_profiles(
        old.join(live, "schema", "left_semi"), current.join(live, "schema", "left_semi"), by=["schema"]
    )
    replaced = current.join(live, "schema", "left_anti")
    return merged.unionByName(replaced, allowMissingColumns=True)


def overlay_configuration(configuration: Column, update: Column) -> Column:
    """Source configuration with the update configuration on top (both maps)."""
    own = F.map_filter(configuration, lambda k, _: ~F.map_contains_key(update, k))
    return F.map_concat(own, update)


def strip_update_configuration(configuration: Column, update: Column) -> Column:
    """The configuration to save: keys only used while updating are removed."""
    return F.map_filter(configuration, lambda k, _: ~F.map_contains_key(update, k))


def publish_view(packages: DataFrame, schemas: DataFrame, stream_sets: DataFrame, registry_url: str) -> DataFrame:
    """Sources as served: (package, source, type, connection, configuration, stream_set, schemas, update_methods, canonical).

    ``packages``: (package, catalog, major, publish_method); ``schemas``: (package, schema);
    ``stream_sets``: (package, source, type, stream_set, schema_titles, update_methods).
    Stored data is served per schema with the update methods of every stream set that has it.
    """
    methods = F.coalesce("publish_method", F.lit("SCHEMA_ONLY"))
    known = packages.select("package", "catalog", "major", methods.alias("publish_method"))
    connection = F.to_json(F.struct(F.lit(registry_url).alias("url")))
    carried = stream_sets.select("package", F.explode("schema_titles").alias("schema"), "update_methods")
    per_schema = (
        carried.select("package", "schema", F.explode_outer("update_methods").alias("m"))
        .groupBy("package", "schema").agg(F.array_sort(F.collect_set("m")).alias("update_methods"))
    )
    stored = (
        schemas.join(known.filter("publish_method = 'SCHEMA_AND_DATA'"), "package")
        .join(per_schema, ["package", "schema"], "left")
        .select(
            "package", F.col("schema").alias("source"), F.lit("registry").alias("type"), connection.alias("connection"),
            F.to_json(F.struct(F.col("catalog").alias("catalogSlug"), F.col("package").alias("packageSlug"), F.col("major").alias("version"))).alias("configuration"),
            F.col("schema").alias("stream_set"), F.array("schema").alias("schema_titles"),
            F.coalesce("update_methods", F.array().cast("array<string>")).alias("update_methods"),
            F.lit(False).alias("canonical"),
        )
    )
    rest = stream_sets.join(known.filter("publish_method <> 'SCHEMA_AND_DATA'"), "package")
    proxied = F.col("publish_method") == "SCHEMA_PROXY_DATA"
    own = rest.select(
        "package", "source", F.when(proxied, "registryProxy").otherwise(F.col("type")).alias("type"),
        F.when(proxied, connection).alias("connection"),
        F.when(proxied, F.to_json(F.struct(F.col("catalog").alias("catalogSlug"), F.col("package").alias("packageSlug"), F.col("source").alias("sourceSlug")))).alias("configuration"),
        "stream_set", "schema_titles", "update_methods", (~proxied).alias("canonical"),
    )
    return stored.unionByName(own)
