"""Comparison of descriptions, versions, publishing.

Descriptions come from the orders table: a schema per priority, an object per status, a
property per customer; the prior version describes the earlier orders, the new one the later.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparcel.checks.base import dealt, register, spark_sql, standin, table
from sparcel.functions.versions import next_version, version_parse, version_text
from sparcel.operators import profile as P
from sparcel.plans import diff as X
from sparcel.plans import upgrade as U
from sparcel.plans import versions as V
from sparcel.session import written

# A property with one order is an integer, with two a number as well, with more a text.
CHILD = """SELECT schema, is_prior, parent || '/' || child AS p, CASE WHEN n = 1 THEN 'integer' WHEN n = 2 THEN 'integer,number' ELSE 'string' END AS types,
  hidden, CASE WHEN n > 1 THEN 'eur' ELSE 'usd' END AS unit, CAST(extract(month FROM latest) AS @TEXT) AS description FROM {property_rows} r"""
PARENT = "SELECT DISTINCT schema, is_prior, parent AS p, 'object' AS types, FALSE AS hidden, 'none' AS unit, 'group' AS description FROM {property_rows} r"
PROPERTIES = f"{CHILD} UNION ALL {PARENT}"

TESTS = """unnest(list_filter([CASE WHEN n.p IS NULL AND o.hidden THEN 'REMOVE_HIDDEN_PROPERTY' END, CASE WHEN n.p IS NULL AND NOT o.hidden THEN 'REMOVE_PROPERTY' END,
  CASE WHEN o.p IS NULL THEN 'ADD_PROPERTY' END, CASE WHEN o.description <> n.description THEN 'CHANGE_PROPERTY_DESCRIPTION' END,
  CASE WHEN o.types <> n.types THEN 'CHANGE_PROPERTY_TYPE' END, CASE WHEN NOT o.hidden AND n.hidden THEN 'HIDE_PROPERTY' END,
  CASE WHEN o.hidden AND NOT n.hidden THEN 'UNHIDE_PROPERTY' END, CASE WHEN o.unit <> n.unit THEN 'CHANGE_PROPERTY_UNIT' END], lambda x: x IS NOT NULL)) AS difference"""
DIFFS = f"""SELECT coalesce(o.schema, n.schema) AS schema, {TESTS}, '#/' || coalesce(o.schema, n.schema) || '/properties/' || replace(coalesce(o.p, n.p), '/', '/properties/') AS pointer
  FROM (SELECT * FROM ({PROPERTIES}) x WHERE is_prior) o FULL JOIN (SELECT * FROM ({PROPERTIES}) y WHERE NOT is_prior) n ON o.schema = n.schema AND o.p = n.p"""


def _properties(spark, sf, prior=None):
    df = spark_sql(spark, sf, f"SELECT * FROM ({PROPERTIES}) x")
    if prior is not None:
        df = df.filter(F.col("is_prior") == prior).drop("is_prior")
    return df.withColumns({"path": F.split("p", "/"), "types": F.split("types", ",")}).drop("p")


@register("diff_properties", f"SELECT difference, pointer FROM ({DIFFS})")
def diff_properties(spark, sf):
    return X.diff_properties(_properties(spark, sf, True), _properties(spark, sf, False))


# Schemas: the customers' market segments by nation; a nation is hidden or missing by its balances.
SCHEMAS = """SELECT n_name AS schema, min(c_acctbal) < -900 AS hidden, max(c_acctbal) > 9900 AS in_new FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name"""
NATION_PROPERTIES = "SELECT n_name AS schema, c_mktsegment AS p, CASE WHEN max(c_acctbal) > 9500 THEN 'number' ELSE 'integer' END AS types FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY 1, 2"


@register(
    "diff_schemas",
    f"""SELECT CASE WHEN hidden THEN 'REMOVE_HIDDEN_SCHEMA' ELSE 'REMOVE_SCHEMA' END AS difference, '' AS pointer FROM ({SCHEMAS}) s WHERE NOT in_new
    UNION ALL SELECT 'CHANGE_PROPERTY_TYPE', '#/' || p.schema || '/properties/' || p.p FROM ({NATION_PROPERTIES}) p JOIN ({SCHEMAS}) s ON s.schema = p.schema WHERE in_new AND types <> 'integer'""",
)
def diff_schemas(spark, sf):
    schemas = spark_sql(spark, sf, SCHEMAS)
    new = spark_sql(spark, sf, NATION_PROPERTIES).select(
        "schema", F.array("p").alias("path"), F.array("types").alias("types"), F.lit(False).alias("hidden"), F.lit("u").alias("unit"), F.lit("d").alias("description")
    )
    prior = new.withColumn("types", F.array(F.lit("integer")))
    return X.diff_schemas(schemas.drop("in_new"), schemas.filter("in_new").drop("in_new"), prior, new)


SOURCES = """SELECT c_mktsegment || '-' || CAST(c_nationkey AS @TEXT) AS source, CASE WHEN count(*) > 12 THEN 'file' ELSE 'http' END AS type,
  chr(123) || '"a": ' || CAST(count(*) AS @TEXT) || ', "b": 1' || chr(125) AS configuration, chr(123) || '"b": 1, "a": ' || CAST(count(*) AS @TEXT) || chr(125) AS reordered,
  CAST(max(c_nationkey) AS @TEXT) AS credentials, min(c_acctbal) > -800 AS in_new, max(c_custkey) AS top, count(*) AS n FROM {customer} GROUP BY c_mktsegment, c_nationkey"""


def _sources(spark, sf):
    df = spark_sql(spark, sf, SOURCES)
    prior = df.select("source", "type", "configuration", F.col("configuration").alias("connection"), "credentials")
    new = df.filter("in_new").select(
        "source", F.when(F.col("n") == 14, "ftp").otherwise(F.col("type")).alias("type"), F.col("reordered").alias("configuration"),
        F.when(F.col("n") == 13, "{}").otherwise(F.col("reordered")).alias("connection"), F.when(F.col("n") < 10, "other").otherwise(F.col("credentials")).alias("credentials"),
    )
    return prior, new


def _stream_sets(spark, sf):
    df = spark_sql(spark, sf, SOURCES)
    prior = df.select(
        "source", F.lit("s").alias("stream_set"), F.array(F.lit("BATCH_FULL_SET")).alias("update_methods"), F.col("n").alias("inspected_count"),
        F.when(F.col("n") > 9, F.col("top").cast("string")).alias("update_hash"),
    )
    new = df.filter("in_new").select(
        "source", F.when(F.col("n") == 11, "t").otherwise("s").alias("stream_set"),
        F.array(F.when(F.col("n") == 12, "CONTINUOUS").otherwise("BATCH_FULL_SET")).alias("update_methods"), (F.col("n") + (F.col("n") > 15).cast("int")).alias("inspected_count"),
        F.when(F.col("n") < 12, "h").otherwise(F.col("top").cast("string")).alias("update_hash"),
    )
    return prior, new


SOURCE_DIFFS = f"""SELECT 'REMOVE_SOURCE' AS difference, '' AS pointer FROM ({SOURCES}) s WHERE NOT in_new
  UNION ALL SELECT 'CHANGE_SOURCE', '#' FROM ({SOURCES}) s WHERE in_new AND n = 14
  UNION ALL SELECT 'CHANGE_SOURCE_CONNECTION', '#' FROM ({SOURCES}) s WHERE in_new AND n = 13
  UNION ALL SELECT 'CHANGE_SOURCE_CREDENTIALS', '#' FROM ({SOURCES}) s WHERE in_new AND n < 10"""
STREAM_DIFFS = f"""SELECT 'REMOVE_STREAM_SET' AS difference, '#' AS pointer FROM ({SOURCES}) s WHERE in_new AND n = 11
  UNION ALL SELECT 'CHANGE_STREAM_UPDATE_METHOD', '#' FROM ({SOURCES}) s WHERE in_new AND n = 12
  UNION ALL SELECT 'CHANGE_STREAM_STATS', '#' FROM ({SOURCES}) s WHERE in_new AND n > 15
  UNION ALL SELECT 'CHANGE_STREAM_UPDATE_HASH', '#' FROM ({SOURCES}) s WHERE in_new AND n > 9 AND n < 11"""


@register("diff_sources", f"{SOURCE_DIFFS} UNION ALL {STREAM_DIFFS}")
def diff_sources(spark, sf):
    return X.diff_sources(*_sources(spark, sf), *_stream_sets(spark, sf))


@register("diff_streams", STREAM_DIFFS)
def diff_streams(spark, sf):
    prior, new = _stream_sets(spark, sf)
    return X.diff_streams(prior.join(new, "source", "left_semi"), new)


# Packages: every customer is one, described by a text, an address and a version.
PACKAGES = "SELECT c_custkey AS package, c_name AS display_name, c_mktsegment AS description, '1.0.' || CAST(c_nationkey AS @TEXT) AS version, c_acctbal FROM {customer}"
PACKAGE_DIFFS = f"""SELECT package, 'CHANGE_PACKAGE_DESCRIPTION' AS difference FROM ({PACKAGES}) p WHERE c_acctbal < 0
  UNION ALL SELECT package, 'CHANGE_VERSION' FROM ({PACKAGES}) p WHERE c_acctbal > 9000
  UNION ALL SELECT package, 'CHANGE_README_FILE' FROM ({PACKAGES}) p WHERE c_acctbal > 8000
  UNION ALL SELECT package, 'REMOVE_SCHEMA' FROM ({PACKAGES}) p WHERE c_acctbal > 9700
  UNION ALL SELECT package, 'ADD_PROPERTY' FROM ({PACKAGES}) p WHERE c_acctbal BETWEEN 5000 AND 9700"""


def _package_tables(spark, sf):
    packages = spark_sql(spark, sf, PACKAGES)
    prior = {"packages": packages.select("package", "display_name", "description", "version", F.lit("a.md").alias("readme_file"))}
    bal = F.col("c_acctbal")
    new = {"packages": packages.select(
        "package", "display_name", F.when(bal < 0, "changed").otherwise(F.col("description")).alias("description"),
        F.when(bal > 9000, "9.9.9").otherwise(F.col("version")).alias("version"), F.when(bal > 8000, "b.md").otherwise("a.md").alias("readme_file"),
    )}
    schema = packages.select("package", F.lit("main").alias("schema"), F.lit(False).alias("hidden"), "c_acctbal")
    prior["schemas"] = schema.drop("c_acctbal")
    new["schemas"] = schema.filter(bal <= 9700).drop("c_acctbal")

    def prop(df, name):
        return df.select("package", F.lit("main").alias("schema"), F.array(F.lit(name)).alias("path"), F.array(F.lit("string")).alias("types"),
                         F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("description"))

    prior["properties"] = prop(packages, "id")
    new["properties"] = prop(packages, "id").unionByName(prop(packages.filter(bal >= 5000), "extra"))
    for side in (prior, new):
        side["sources"] = packages.select("package", F.lit("s").alias("source"), F.lit("file").alias("type"), F.lit("{}").alias("configuration"),
                                          F.lit("{}").alias("connection"), F.lit(None).cast("string").alias("credentials"))
        side["stream_sets"] = packages.select("package", F.lit("s").alias("source"), F.lit("t").alias("stream_set"), F.array(F.lit("CONTINUOUS")).alias("update_methods"),
                                              F.lit(1).alias("inspected_count"), F.lit("h").alias("update_hash"))
    return prior, new


@register("diff_packages", PACKAGE_DIFFS)
def diff_packages(spark, sf):
    return X.diff_packages(*_package_tables(spark, sf), keys=["package"]).select("package", "difference")


LEVEL = "CASE WHEN difference = 'REMOVE_SCHEMA' THEN 3 WHEN difference = 'ADD_PROPERTY' THEN 2 WHEN difference IN ('CHANGE_PACKAGE_DESCRIPTION', 'CHANGE_VERSION') THEN 1 ELSE 0 END"


@register(
    "diff_compatibility",
    f"SELECT package, max({LEVEL}) AS level, ['identical', 'minor', 'compatible', 'breaking'][max({LEVEL}) + 1] AS compatibility FROM ({PACKAGE_DIFFS}) GROUP BY 1",
)
def diff_compatibility(spark, sf):
    diffs = X.diff_packages(*_package_tables(spark, sf), keys=["package"])
    return X.diff_compatibility(diffs, ["package"])


NEXT = "CASE level WHEN 3 THEN (major + 1) || '.0.0' WHEN 2 THEN major || '.' || (minor + 1) || '.0' WHEN 1 THEN major || '.' || minor || '.' || (patch + 1) ELSE major || '.' || minor || '.' || patch END"


@register("next_version", f"SELECT patch AS id, {NEXT} AS next FROM (SELECT major, minor, patch, CAST(patch % 4 AS INTEGER) AS level FROM {{versions}} v)")
def next_version_query(spark, sf):
    versions = standin(spark, sf, "versions")
    return versions.select(F.col("patch").alias("id"), version_text(next_version(F.struct("major", "minor", "patch"), F.col("patch") % 4)).alias("next"))


@register(
    "describe_diff",
    f"""SELECT CASE difference WHEN 'ADD_PROPERTY' THEN 'Added Property' WHEN 'REMOVE_PROPERTY' THEN 'Removed Property' WHEN 'REMOVE_HIDDEN_PROPERTY' THEN 'Removed Hidden Property'
      WHEN 'CHANGE_PROPERTY_TYPE' THEN 'Changed Property Type' WHEN 'HIDE_PROPERTY' THEN 'Property Hidden' WHEN 'UNHIDE_PROPERTY' THEN 'Property Unhidden'
      WHEN 'CHANGE_PROPERTY_UNIT' THEN 'Changed Property Unit' ELSE 'Changed Property Description' END || ' ' || regexp_extract(pointer, '.*/properties/(.*)', 1) AS sentence FROM ({DIFFS})""",
)
def describe_diff(spark, sf):
    return diff_properties(spark, sf).select(X.describe_diff(F.col("difference"), F.col("pointer")).alias("sentence"))


# Versions: a package per customer, a version per year of orders, its property types by the orders' priority.
CHAIN = """SELECT o_custkey AS package, CAST(extract(year FROM o_orderdate) AS @TEXT) || '.0.0' AS version, o_orderpriority AS p,
  CASE WHEN max(o_totalprice) > 300000 THEN 'number' ELSE 'integer' END AS types FROM {orders} GROUP BY 1, 2, 3"""


@register(
    "version_chain_diffs",
    f"""WITH c AS ({CHAIN}), v AS (SELECT DISTINCT package, version FROM c),
    pairs AS (SELECT package, version, lag(version) OVER (PARTITION BY package ORDER BY version) AS prior FROM v),
    o AS (SELECT pairs.package, pairs.version, pairs.prior, c.p, c.types FROM pairs JOIN c ON c.package = pairs.package AND c.version = pairs.prior),
    n AS (SELECT pairs.package, pairs.version, pairs.prior, c.p, c.types FROM pairs JOIN c ON c.package = pairs.package AND c.version = pairs.version WHERE pairs.prior IS NOT NULL)
    SELECT coalesce(o.package, n.package) AS package, coalesce(o.prior, n.prior) AS prior, coalesce(o.version, n.version) AS version,
      CASE WHEN n.p IS NULL THEN 'REMOVE_PROPERTY' WHEN o.p IS NULL THEN 'ADD_PROPERTY' ELSE 'CHANGE_PROPERTY_TYPE' END AS difference, '#/main/properties/' || coalesce(o.p, n.p) AS pointer
    FROM o FULL JOIN n ON o.package = n.package AND o.version = n.version AND o.p = n.p WHERE n.p IS NULL OR o.p IS NULL OR o.types <> n.types""",
)
def version_chain_diffs(spark, sf):
    properties = spark_sql(spark, sf, CHAIN).select(
        "package", "version", F.lit("main").alias("schema"), F.array("p").alias("path"), F.array("types").alias("types"),
        F.lit(False).alias("hidden"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("description"),
    )
    return V.version_chain_diffs(properties.select("package", "version"), properties)


@register(
    "publish_check",
    f"""WITH l AS (SELECT package, max({LEVEL}) AS level FROM ({PACKAGE_DIFFS}) GROUP BY 1),
    p AS (SELECT package, version AS latest, CASE WHEN c_acctbal > 9800 THEN '2.0.0' WHEN c_acctbal > 4000 THEN '1.1.0' ELSE '1.0.1' END AS proposed,
      CAST(split_part(version, '.', 3) AS INTEGER) AS patch, c_acctbal FROM ({PACKAGES}) x),
    j AS (SELECT p.*, coalesce(level, 0) AS level FROM p LEFT JOIN l USING (package))
    SELECT package, latest, proposed, CASE level WHEN 3 THEN '2.0.0' WHEN 2 THEN '1.1.0' WHEN 1 THEN '1.0.' || (patch + 1) ELSE latest END AS minimum,
      ['VERSION_TRIVIAL_CHANGE', 'VERSION_PATCH_CHANGE', 'VERSION_MINOR_CHANGE', 'VERSION_MAJOR_CHANGE'][level + 1] AS change_type,
      CASE level WHEN 0 THEN TRUE WHEN 3 THEN proposed = '2.0.0' WHEN 2 THEN proposed <> '1.0.1' ELSE proposed <> '1.0.1' OR patch = 0 END AS accepted FROM j""",
)
def publish_check(spark, sf):
    packages = spark_sql(spark, sf, PACKAGES)
    proposed = F.expr("CASE WHEN c_acctbal > 9800 THEN '2.0.0' WHEN c_acctbal > 4000 THEN '1.1.0' ELSE '1.0.1' END")
    diffs = X.diff_packages(*_package_tables(spark, sf), keys=["package"])
    return V.publish_check(packages.select("package", proposed.alias("version")), packages, diffs)


@register(
    "refresh_schema",
    """SELECT o_orderpriority AS schema, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS record_count,
      max(o_orderstatus) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS description, FALSE AS hidden FROM orders GROUP BY 1
      HAVING count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') > 0 AND count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') > 0""",
)
def refresh_schema(spark, sf):
    orders, cut = table(spark, sf, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")

    def rows(df):
        return df.groupBy(F.col("o_orderpriority").alias("schema")).agg(
            F.count("*").alias("record_count"), F.max("o_orderstatus").alias("description"), F.lit(False).alias("hidden")
        )

    return V.refresh_schemas(rows(orders.filter(F.col("o_orderdate") < cut)), rows(orders.filter(F.col("o_orderdate") >= cut)))


@register(
    "refresh_profiles",
    """SELECT o_orderpriority AS schema, 'o_orderkey' AS property, 'integer' AS type,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN count(*) ELSE count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') END AS n,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN max(o_orderkey) ELSE max(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') END AS high
    FROM orders GROUP BY 1""",
)
def refresh_profiles(spark, sf):
    orders, cut = table(spark, sf, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")

    def rows(df):
        return P.profile(df.withColumnRenamed("o_orderpriority", "schema"), columns=["o_orderkey"], by=["schema"])

    live = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "CONTINUOUS").otherwise("BATCH_FULL_SET")
    schemas = orders.select(F.col("o_orderpriority").alias("schema"), F.array(live).alias("update_methods")).distinct()
    merged = V.refresh_profiles(rows(orders.filter(F.col("o_orderdate") < cut)), rows(orders.filter(F.col("o_orderdate") >= cut)), schemas)
    return merged.select("schema", "property", "type", F.col("record_count").alias("n"), F.col("number_max").cast("bigint").alias("high"))


@register(
    "strip_update_config",
    """SELECT c_custkey, 'limit=' || CASE WHEN c_acctbal > 0 THEN '10' ELSE c_nationkey || '' END || ',name=' || c_name AS used, CASE WHEN c_acctbal > 0 THEN 'name=' || c_name ELSE 'limit=' || c_nationkey || ',name=' || c_name END AS saved FROM customer""",
)
def strip_update_config(spark, sf):
    config = F.create_map(F.lit("limit"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("c_name"))
    update = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("limit"), F.lit("10"))).otherwise(F.create_map().cast("map<string,string>"))
    used = V.overlay_configuration(config, update)
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf, "customer").select("c_custkey", text(used).alias("used"), text(V.strip_update_configuration(used, update)).alias("saved"))


@register(
    "publish_view",
    """WITH p AS (SELECT n_nationkey AS package, CASE n_regionkey WHEN 0 THEN 'SCHEMA_ONLY' WHEN 1 THEN 'SCHEMA_PROXY_DATA' ELSE 'SCHEMA_AND_DATA' END AS m FROM nation),
    s AS (SELECT DISTINCT c_nationkey AS package, c_mktsegment AS schema, CASE WHEN c_acctbal > 5000 THEN 'CONTINUOUS' ELSE 'BATCH_FULL_SET' END AS u FROM customer)
    SELECT p.package, schema AS source, CASE m WHEN 'SCHEMA_ONLY' THEN 'file' WHEN 'SCHEMA_PROXY_DATA' THEN 'registryProxy' ELSE 'registry' END AS type, schema AS stream_set,
      string_agg(u, ',' ORDER BY u) AS update_methods, m = 'SCHEMA_ONLY' AS canonical FROM s JOIN p ON p.package = s.package GROUP BY 1, 2, 3, 4, 6""",
)
def publish_view(spark, sf):
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    method = F.expr("CASE n_regionkey WHEN 0 THEN 'SCHEMA_ONLY' WHEN 1 THEN 'SCHEMA_PROXY_DATA' ELSE 'SCHEMA_AND_DATA' END")
    packages = nation.select(F.col("n_nationkey").alias("package"), F.col("n_name").alias("catalog"), F.lit(1).alias("major"), method.alias("publish_method"))
    update = F.when(F.col("c_acctbal") > 5000, "CONTINUOUS").otherwise("BATCH_FULL_SET")
    sets = customer.groupBy(F.col("c_nationkey").alias("package"), F.col("c_mktsegment").alias("source")).agg(F.array_sort(F.collect_set(update)).alias("update_methods"))
    sets = sets.select("package", "source", F.lit("file").alias("type"), F.col("source").alias("stream_set"), F.array("source").alias("schema_titles"), "update_methods")
    schemas = sets.select("package", F.col("source").alias("schema"))
    served = V.publish_view(packages, schemas, sets, "https://registry.example.org")
    return served.select("package", "source", "type", "stream_set", F.array_join("update_methods", ",").alias("update_methods"), "canonical")


FORMAT_OF = "['0.2.0', '0.8.1', '0.9.0', '0.32.1'][c_nationkey % 4 + 1]"


def _descriptor(kind):
    """Descriptor text of a customer in one of four formats."""
    types = "types" if kind in ("0.9.0", "0.32.1") else "valueTypes"
    base = {"$schema": f"https://example.org/docs/package-file-schema-v{kind}.json", "packageSlug": "@NAME", "displayName": "@NAME", "version": "1.0.0",
            "schemas": [{"title": "main", "properties": {"@SEGMENT": {"title": "x", types: {"string": {"recordCount": 3}}}}}]}
    if kind == "0.2.0":
        base["schemas"][0]["source"] = {"uri": "file:///@NAME", "type": "file", "configuration": {}}
        base["schemas"][0]["recordCount"] = 3
    else:
        base["sources"] = [{"slug": "s", "type": "file", "configuration": {"filePattern": "x"}, "streamSets": [{"slug": "t"}]}]
    return json.dumps(base)


@register(
    "upgrade_descriptors",
    f"""SELECT c_custkey AS package, {FORMAT_OF} AS from_format, 'https://example.org/docs/package-file-schema-v0.32.1.json' AS to_schema, c_mktsegment AS property, 'string' AS types,
      CASE WHEN c_nationkey % 4 = 0 THEN 'file:///' || c_name ELSE 's' END AS source, TRUE AS upgraded FROM customer""",
)
def upgrade_descriptors(spark, sf):
    texts = F.array(*[F.lit(_descriptor(k)) for k in ("0.2.0", "0.8.1", "0.9.0", "0.32.1")])
    text = F.get(texts, F.col("c_nationkey") % 4)
    filled = F.replace(F.replace(text, F.lit("@NAME"), F.col("c_name")), F.lit("@SEGMENT"), F.col("c_mktsegment"))
    texts = dealt(table(spark, sf, "customer")).select(F.col("c_custkey").alias("package"), filled.alias("value"))
    done = written(U.upgrade_descriptors(texts), "upgraded")
    tables = U.descriptor_tables(done)
    properties = tables["properties"].select("package", F.element_at("path", -1).alias("property"), F.array_join("types", ",").alias("types"))
    sources = tables["sources"].select("package", "source")
    return (
        done.select("package", "from_format", F.get_json_object("descriptor", "$['$schema']").alias("to_schema"), F.col("error").isNull().alias("upgraded"))
        .join(properties, "package").join(sources, "package")
    )
