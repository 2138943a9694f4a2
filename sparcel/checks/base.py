"""Shared pieces of the registered queries: tables, and stand-ins written once for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparcel.session import pin

Query = Callable[[SparkSession, str], DataFrame]
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores. Each given table is one row group, which the reader cannot split; the queries with costly
    work on each row ask for this, whatever the size. The library itself never does."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its DuckDB equivalent."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return query

    return add


# Notation shared by both engines: (pattern, Spark, DuckDB).
_NOTATION = (
    (r"@K\b", "cast(get_json_object(props, '$.k') AS bigint)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    (r"@ARR\(", "array(", "list_value("),
    (r"@DAY\((\w+)\)", r"date_format(\1, 'yyyy-MM-dd')", r"strftime(\1, '%Y-%m-%d')"),
    (r"@SEC\((\w+)\)", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss')", r"strftime(\1, '%Y-%m-%d %H:%M:%S')"),
    (r"@ISO\((\w+)\)", r"date_format(\1, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")".replace("\\\"", '"'), r"strftime(\1, '%Y-%m-%dT%H:%M:%S.%gZ')"),
    (r"@TEXT\b", "string", "VARCHAR"),
)

# Stand-ins for tables the test data does not have, derived from whole given tables.
STANDINS = {
    "activity": """
        SELECT event_id AS id, ts AS created_at, user_id,
          CASE event_type WHEN 'view' THEN 'PACKAGE_VIEWED' WHEN 'click' THEN 'COLLECTION_VIEWED'
            WHEN 'purchase' THEN 'VERSION_CREATED' WHEN 'signup' THEN 'PACKAGE_EDIT' ELSE 'PACKAGE_ISSUE_CREATED' END AS event_type,
          CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'VERSION_MAJOR_CHANGE'
            WHEN 1 THEN 'VERSION_MINOR_CHANGE' ELSE 'VERSION_PATCH_CHANGE' END END AS change_type,
          CASE WHEN event_type <> 'click' THEN @K END AS target_package_id,
          CASE WHEN event_type = 'signup' THEN @K % 25 END AS target_catalog_id,
          CASE WHEN event_type = 'click' THEN @K % 60 END AS target_collection_id,
          CASE WHEN event_type = 'error' THEN event_id END AS target_package_issue_id,
          CASE WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN @ARR('description')
            WHEN 1 THEN @ARR('description', 'slug') ELSE @ARR('readme') END END AS properties_edited
        FROM {events}""",
    "packages": """
        SELECT p_partkey AS package_id, p_partkey % 25 AS catalog_id, p_size % 5 <> 0 AS is_public,
          replace(p_name, ' ', '-') || '-' || cast(p_partkey AS @TEXT) AS slug, p_name AS display_name,
          'nation_' || cast(p_partkey % 25 AS @TEXT) AS catalog_slug, p_type || ' ' || p_brand AS description,
          p_brand || ' by ' || p_type AS readme, p_partkey % 150 AS creator_id, p_retailprice AS price
        FROM {part}""",
    "collections": """
        SELECT cast(p_size AS bigint) AS collection_id, cast(p_size AS bigint) % 4 <> 0 AS is_public,
          max(p_partkey) AS updated_at, max(p_name) AS name, min(p_type) AS description
        FROM {part} GROUP BY p_size""",
    "collection_packages": "SELECT cast(p_size AS bigint) AS collection_id, p_partkey AS package_id FROM {part}",
    "users": """
        SELECT c_custkey AS user_id, lower(replace(c_name, '#', '-')) AS username, c_name AS first_name,
          c_mktsegment AS last_name, lower(c_mktsegment) || cast(c_custkey AS @TEXT) || '@example.org' AS email,
          c_nationkey % 2 = 0 AS name_is_public, c_acctbal > 0 AS email_is_public, c_name AS display_name
        FROM {customer}""",
    "follows": """
        SELECT f.*, c_custkey AS user_id, c_custkey * 60 AS created_at,
          @ARR('PACKAGE_VIEWED', 'COLLECTION_VIEWED', 'VERSION_CREATED', 'PACKAGE_EDIT', 'PACKAGE_ISSUE_CREATED') AS event_types,
          CASE WHEN c_acctbal > 5000 THEN @ARR('VERSION_MAJOR_CHANGE') ELSE @ARR('VERSION_MAJOR_CHANGE', 'VERSION_MINOR_CHANGE') END AS change_types,
          c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS follow_all_packages,
          c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS follow_all_package_issues,
          CASE c_nationkey % 3 WHEN 0 THEN 'DAILY' WHEN 1 THEN 'WEEKLY' ELSE 'INSTANT' END AS frequency
        FROM (
          SELECT c_custkey AS follower, (c_custkey * 7 + 1) % 150 AS target_user_id, cast(NULL AS bigint) AS target_collection_id,
            cast(NULL AS bigint) AS target_catalog_id, cast(NULL AS bigint) AS target_package_issue_id, cast(NULL AS bigint) AS target_package_id FROM {customer}
          UNION ALL SELECT c_custkey, NULL, (c_custkey * 3) % 60, NULL, NULL, NULL FROM {customer}
          UNION ALL SELECT c_custkey, NULL, NULL, cast(c_nationkey AS bigint), NULL, NULL FROM {customer}
          UNION ALL SELECT c_custkey, NULL, NULL, NULL, c_custkey * 5 + 1, NULL FROM {customer}
          UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, (c_custkey * 11) % 100 FROM {customer}
        ) f JOIN {customer} c ON c.c_custkey = f.follower""",
    "user_catalog": """
        SELECT c_custkey AS user_id, cast(c_nationkey AS bigint) AS catalog_id,
          CASE WHEN c_acctbal > 2000 THEN @ARR('VIEW', 'EDIT') ELSE @ARR('VIEW') END AS permissions,
          CASE WHEN c_custkey % 2 = 1 THEN @ARR('VIEW') ELSE @ARR('EDIT') END AS catalog_permissions FROM {customer}""",
    "user_package": """
        SELECT s_suppkey % 150 AS user_id, s_suppkey * 3 AS package_id,
          CASE WHEN s_acctbal > 2000 THEN @ARR('VIEW', 'EDIT') ELSE @ARR('EDIT') END AS permissions FROM {supplier}""",
    "group_user": "SELECT c_custkey % 10 AS group_id, c_custkey AS user_id FROM {customer}",
    "group_package": "SELECT s_suppkey % 10 AS group_id, s_suppkey * 5 AS package_id, @ARR('VIEW') AS permissions FROM {supplier}",
    "group_catalog": "SELECT cast(n_regionkey AS bigint) AS group_id, cast(n_nationkey AS bigint) AS catalog_id, @ARR('VIEW', 'EDIT') AS permissions, CASE WHEN n_nationkey % 4 = 2 THEN @ARR('VIEW') ELSE @ARR('EDIT') END AS catalog_permissions FROM {nation}",
    "catalogs": "SELECT cast(n_nationkey AS bigint) AS catalog_id, lower(n_name) AS slug, n_name AS display_name, r_name AS description, n_nationkey % 3 = 0 AS is_public FROM {nation} JOIN {region} ON r_regionkey = n_regionkey",
    "user_collection": "SELECT c_custkey AS user_id, c_custkey % 50 + 1 AS collection_id, @ARR('VIEW') AS permissions FROM {customer}",
    "group_collection": "SELECT cast(n_regionkey AS bigint) AS group_id, cast(n_nationkey * 2 AS bigint) AS collection_id, @ARR('VIEW') AS permissions FROM {nation}",
    "versions": """
        SELECT o_custkey AS package_id, cast(o_orderkey % 4 AS int) AS major, cast(o_orderkey % 10 AS int) AS minor,
          cast(o_orderkey AS int) AS patch, o_orderpriority AS note FROM {orders}""",
    "issues": """
        SELECT o_orderkey AS issue_id, o_custkey AS package_id, CASE o_orderstatus WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status,
          o_orderdate AS created_at, o_orderpriority AS subject FROM {orders}""",
    "records": """
        SELECT 'pkg' AS package, 1 AS major, 'stream' AS source_type, 'events' AS source_slug, event_type AS stream_set,
          'user-' || cast(user_id % 10 AS @TEXT) AS stream, 'event' AS schema,
          cast(floor(value / 100) AS bigint) + 1 AS batch, event_id AS _offset, user_id, value, ts AS received_at FROM {events}""",
    "batches": """
        SELECT package, major, source_type, source_slug, stream_set, stream, schema, batch, max(_offset) AS last_offset,
          batch = 2 AS is_default, max(received_at) AS updated_at
        FROM ({records}) r GROUP BY package, major, source_type, source_slug, stream_set, stream, schema, batch""",
    # One column of five types and plain text.
    "mixed": """
        SELECT event_id, event_type, user_id, ts, CASE event_type WHEN 'view' THEN cast(user_id AS @TEXT) WHEN 'click' THEN cast(value AS @TEXT)
          WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'true' ELSE 'No' END WHEN 'signup' THEN @DAY(ts)
          ELSE CASE WHEN value > 80 THEN props WHEN value > 20 THEN @SEC(ts) WHEN value > 2 THEN '' END END AS mixed
        FROM {events}""",
    # Two inspections of the same packages: the orders of an earlier and of a later period.
    "property_rows": """
        SELECT o_orderpriority AS schema, o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS is_prior, o_orderstatus AS parent,
          'c' || cast(o_custkey AS @TEXT) AS child, count(*) AS n, max(o_totalprice) > 490000 AS hidden,
          max(o_orderdate) AS latest
        FROM {orders} GROUP BY o_orderpriority, o_orderdate < TIMESTAMP '1998-01-01 00:00:00', o_orderstatus, o_custkey""",
}


def _translate(sql: str, engine: int) -> str:
    for pattern, *forms in _NOTATION:
        sql = re.sub(pattern, forms[engine], sql)
    return sql


def duck(sql: str) -> str:
    """Fill in the notation, the stand-ins ``{name}`` and the given tables for DuckDB."""
    while True:
        names = set(re.findall(r"\{([a-z_]+)\}", sql))
        if not names:
            return _translate(sql, 1)
        for name in names:
            sql = sql.replace("{" + name + "}", f"({STANDINS[name]})" if name in STANDINS else name)


def spark_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    sql = _translate(sql, 0)
    while set(re.findall(r"\{([a-z_]+)\}", sql)) & set(STANDINS):
        for name in set(re.findall(r"\{([a-z_]+)\}", sql)) & set(STANDINS):
            sql = sql.replace("{" + name + "}", f"({_translate(STANDINS[name], 0)})")
    frames = {name: table(spark, sf, name) for name in set(re.findall(r"\{([a-z_]+)\}", sql))}
    return spark.sql(sql, **frames)


def standin(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark_sql(spark, sf, STANDINS[name])
    return df.drop("follower") if name == "follows" else df


# DuckDB's regular expressions know no look-around and no back-references.
# Fixed values, written out again: the text forms that count as a date-time.
_FORMS = "|".join((
    r"[A-Za-z0-9_]{3}, [0-9]{2} [A-Za-z0-9_]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} GMT",
    r"[A-Za-z0-9_]{3} [A-Za-z0-9_]{3} [0-9]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} GMT[-+][0-9]{4}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3,6}Z", r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} UTC",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2})?[-+][0-9]{4}", r"[0-9]{1,2}[\\/-][0-9]{1,2}[\\/-][0-9]{4} [0-9]{1,2}:[0-9]{1,2}",
    r"[0-9]{4}[\\/-][0-9]{1,2}[\\/-][0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}",
))
_MDY = "|".join(rf"^(?:0?[1-9]|1[0-2]){s}(?:0?[1-9]|[12]\d|3[01]){s}\d{{4}}$" for s in ("/", "-", r"\."))
_YMD = "|".join(rf"^\d{{4}}{s}\d{{1,2}}{s}\d{{1,2}}$" for s in ("/", "-", r"\."))
_OTHER = r"^\d{4}\s*[^\x00-\x7F]\s*\d{1,2}\s*[^\x00-\x7F]\s*\d{1,2}\s*[^\x00-\x7F]$|^\w{3} \w{3} \d{2} \d{4}$"


def duck_is_date_time(x: str) -> str:
    return rf"regexp_matches({x}, '(?m)(?:\A\s*|^)(?:{_FORMS})')"


def duck_is_date(x: str) -> str:
    return rf"regexp_matches(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '{_YMD}|{_MDY}|{_OTHER}')"


def duck_type(x: str) -> str:
    return rf"""CASE WHEN {x} IS NULL OR {x} = 'null' OR regexp_matches({x}, '^\s*$') THEN 'null'
        WHEN regexp_matches({x}, '(?i)^\s*(?:true|false|yes|no)\s*$') THEN 'boolean'
        WHEN regexp_matches({x}, '^\s*[-+]?(?:[1-9]\d*|0)\.\d+\s*$') THEN 'number'
        WHEN regexp_matches({x}, '^\s*(?:[-+]?[1-9]\d*|0)\s*$') THEN 'integer'
        WHEN {duck_is_date_time(x)} THEN 'date-time' WHEN {duck_is_date(x)} THEN 'date' ELSE 'string' END"""
