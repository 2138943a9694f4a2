"""Scalar functions: type inference, dates, conversion, names, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.checks.base import duck_is_date, duck_is_date_time, duck_type, register, spark_sql, standin, table
from sparcel.functions import dates, infer, names, versions

# Dates of events in several notations, and text that is none.
STAMPS = """
    SELECT event_id, ts, CASE event_type
      WHEN 'view' THEN @SEC(ts) || ' UTC'
      WHEN 'click' THEN cast(extract(month FROM ts) AS @TEXT) || '/' || cast(extract(day FROM ts) AS @TEXT) || '/' || cast(extract(year FROM ts) AS @TEXT) || ' ' || cast(extract(hour FROM ts) AS @TEXT) || ':' || cast(extract(minute FROM ts) AS @TEXT)
      WHEN 'purchase' THEN @DAY(ts)
      WHEN 'signup' THEN cast(extract(month FROM ts) AS @TEXT) || '.' || cast(extract(day FROM ts) AS @TEXT) || '.' || cast(extract(year FROM ts) AS @TEXT)
      ELSE props END AS t
    FROM {events}"""


@register(
    "infer_string_type",
    " UNION ALL ".join(
        f"SELECT '{name}' AS source, {duck_type(column)} AS type, count(*) AS n FROM {source} GROUP BY 2"
        for name, column, source in (
            ("documents.text", "text", "documents"), ("pages.url", "url", "pages"), ("events.props", "props", "events"),
            ("events.mixed", "mixed", "{mixed}"), ("conversations.text", "text", "conversations"), ("benchmark.text", "text", "benchmark"),
        )
    ),
)
def infer_string_type(spark, sf):
    parts = [
        ("documents.text", table(spark, sf, "documents"), "text"), ("pages.url", table(spark, sf, "pages"), "url"),
        ("events.props", table(spark, sf, "events"), "props"), ("events.mixed", standin(spark, sf, "mixed"), "mixed"),
        ("conversations.text", table(spark, sf, "conversations"), "text"), ("benchmark.text", table(spark, sf, "benchmark"), "text"),
    ]
    out = None
    for name, df, column in parts:
        counts = df.select(column).groupBy(infer.infer_string_type(F.col(column)).alias("type")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("source", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


@register(
    "infer_value_type",
    """SELECT 'o_totalprice' AS property, CASE WHEN o_totalprice = round(o_totalprice) THEN 'integer' ELSE 'number' END AS type, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderdate', CASE WHEN date_trunc('millisecond', o_orderdate) = date_trunc('day', o_orderdate) THEN 'date' ELSE 'date-time' END, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', 'string', count(*) FROM orders
    UNION ALL SELECT 'l_quantity', CASE WHEN l_quantity = round(l_quantity) THEN 'integer' ELSE 'number' END, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_tax', CASE WHEN l_tax = round(l_tax) THEN 'integer' ELSE 'number' END, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'ts', CASE WHEN date_trunc('millisecond', ts) = date_trunc('day', ts) THEN 'date' ELSE 'date-time' END, count(*) FROM events GROUP BY 2""",
)
def infer_value_type(spark, sf):
    out = None
    for source, columns in (("orders", ["o_totalprice", "o_orderdate", "o_orderstatus"]), ("lineitem", ["l_quantity", "l_tax"]), ("events", ["ts"])):
        df = table(spark, sf, source)
        for c in columns:
            kind = infer.infer_value_type(F.col(c), df.schema[c].dataType)
            counts = df.groupBy(kind.alias("type")).agg(F.count("*").alias("n")).withColumn("property", F.lit(c))
            out = counts if out is None else out.unionByName(counts)
    return out


@register("is_date", f"SELECT event_id, {duck_is_date('t')} AS is_date FROM ({STAMPS}) s")
def is_date(spark, sf):
    return spark_sql(spark, sf, STAMPS).select("event_id", dates.is_date(F.col("t")).alias("is_date"))


@register("is_date_time", f"SELECT event_id, {duck_is_date_time('t')} AS is_date_time FROM ({STAMPS}) s")
def is_date_time(spark, sf):
    return spark_sql(spark, sf, STAMPS).select("event_id", dates.is_date_time(F.col("t")).alias("is_date_time"))


PARSED = """coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S UTC'), try_strptime(t, '%m/%d/%Y %H:%M'), try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%m.%d.%Y'))"""


@register("parse_utc_timestamp", f"SELECT event_id, strftime({PARSED}, '%Y-%m-%d %H:%M:%S') AS stamp FROM ({STAMPS}) s")
def parse_utc_timestamp(spark, sf):
    stamp = dates.parse_utc_timestamp(F.col("t"))
    return spark_sql(spark, sf, STAMPS).select("event_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@register("normalize_date", f"SELECT event_id, strftime({PARSED}, '%Y-%m-%d') AS day FROM ({STAMPS}) s")
def normalize_date(spark, sf):
    return spark_sql(spark, sf, STAMPS).select("event_id", dates.normalize_date(F.col("t")).alias("day"))


@register(
    "normalize_time",
    """SELECT event_id, lpad(CAST(extract(hour FROM ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(extract(minute FROM ts) AS VARCHAR), 2, '0') || ':00' AS clock FROM events""",
)
def normalize_time(spark, sf):
    text = F.concat_ws(":", F.hour("ts"), F.minute("ts"))
    return table(spark, sf, "events").select("event_id", dates.normalize_time(text).alias("clock"))


@register(
    "normalize_date_time",
    f"""SELECT event_id, CASE WHEN {duck_is_date_time('t')} THEN strftime({PARSED}, '%Y-%m-%d %H:%M:%S') ELSE '' END AS stamp FROM ({STAMPS}) s""",
)
def normalize_date_time(spark, sf):
    return spark_sql(spark, sf, STAMPS).select("event_id", dates.normalize_date_time(F.col("t")).alias("stamp"))


def duck_number(x):
    return rf"CASE WHEN regexp_matches({x}, '^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


@register(
    "convert_value",
    f"""SELECT event_id,
      CASE WHEN mixed IS NULL THEN NULL WHEN ({duck_number('mixed')}) IS NOT NULL THEN floor({duck_number('mixed')}) > 0
        ELSE lower(trim(mixed)) IN ('true', 'yes') END AS as_boolean,
      {duck_number('mixed')} AS as_number,
      CAST(floor({duck_number('mixed')} + 0.5) AS BIGINT) AS as_integer,
      strftime(coalesce(try_strptime(mixed, '%Y-%m-%d %H:%M:%S'), try_strptime(mixed, '%Y-%m-%d')), '%Y-%m-%d') AS as_date
    FROM {{mixed}} m""",
)
def convert_value(spark, sf):
    c = F.col("mixed")
    day = F.date_format(infer.convert_value(c, "date"), "yyyy-MM-dd")
    return standin(spark, sf, "mixed").select(
        "event_id", infer.convert_value(c, "boolean").alias("as_boolean"), infer.convert_value(c, "number").alias("as_number"),
        infer.convert_value(c, "integer").alias("as_integer"), F.when(~c.rlike(r"^\d+$"), day).alias("as_date"),
    )


@register(
    "sanitize_name",
    r"""SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_/]', '', 'g') AS avro_name, replace(url, '.', '_') AS column_name, replace(url, '.', '-') AS table_name FROM pages""",
)
def sanitize_name(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", names.sanitize_name(u, "avro").alias("avro_name"), names.sanitize_name(u, "column").alias("column_name"),
        names.sanitize_name(u, "table").alias("table_name"),
    )


@register(
    "slugify",
    r"""WITH d AS (SELECT 's' || s_suppkey AS id, s_name AS x FROM supplier UNION ALL SELECT 'd' || doc_id, text FROM documents)
    SELECT id, regexp_replace(substr(regexp_replace(regexp_replace(lower(x), '[^0-9A-Za-z_]+', '-', 'g'), '^[-|_]+|[-|_]+$', '', 'g'), 1, 38), '^[-|_]+|[-|_]+$', '', 'g') AS slug FROM d""",
)
def slugify(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("x"))
    documents = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("x"))
    return suppliers.unionByName(documents).select("id", names.slugify(F.col("x")).alias("slug"))


@register(
    "validate_identifiers",
    r"""SELECT p_partkey,
      CASE WHEN p_name = '' THEN 'PACKAGE_SLUG_REQUIRED' WHEN length(p_name) > 38 THEN 'PACKAGE_SLUG_TOO_LONG'
        WHEN NOT regexp_matches(p_name, '^[a-z0-9]+(?:(?:(?:[._]|__|[-]*)[a-z0-9]+)+)?$') THEN 'PACKAGE_SLUG_INVALID' ELSE 'ok' END AS package_slug,
      CASE WHEN NOT regexp_matches(p_brand, '^[a-zA-Z][a-zA-z0-9 _\-%*\\+]+$') THEN 'INVALID_CHARACTERS' WHEN length(p_brand) < 3 THEN 'TOO_SHORT' ELSE 'ok' END AS display_name,
      CASE WHEN NOT regexp_matches(lower(p_type), '^[a-z\d](?:[a-z\d]|-[a-z\d]){0,38}$') THEN 'INVALID_CHARACTERS' ELSE 'ok' END AS username,
      CASE WHEN length(p_type) < 3 THEN 'TOO_SHORT' WHEN length(p_type) > 256 THEN 'TOO_LONG' ELSE 'ok' END AS description
    FROM part""",
)
def validate_identifiers(spark, sf):
    rules = {"package_slug": "p_name", "display_name": "p_brand", "username": "p_type", "description": "p_type"}
    return table(spark, sf, "part").select(
        "p_partkey",
        *[F.coalesce(names.validate(F.col(c), rule), F.lit("ok")).alias(rule) for rule, c in rules.items()],
    )


@register(
    "title_case_words",
    r"""WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(substr(text, 1, length(text)), '[A-Z][a-z]+'), '') AS x FROM documents)
    SELECT doc_id, upper(substr(regexp_replace(x, '([A-Z])', ' \1', 'g'), 1, 1)) || substr(regexp_replace(x, '([A-Z])', ' \1', 'g'), 2) AS title FROM w""",
)
def title_case_words(spark, sf):
    words = F.array_join(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), F.lit(1)), "")
    return table(spark, sf, "documents").select("doc_id", names.title_case_words(words).alias("title"))


@register(
    "file_name_of",
    """SELECT page_id, split_part(CASE WHEN url LIKE '%/' THEN split_part(url, '/', -2) ELSE split_part(url, '/', -1) END, '?', 1) AS file_name FROM pages""",
)
def file_name_of(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.file_name_of(F.col("url")).alias("file_name"))


@register(
    "format_duration",
    """SELECT o_orderkey, CASE WHEN o_custkey < 60 THEN o_custkey || ' seconds'
      WHEN o_custkey < 3600 THEN (o_custkey // 60) % 60 || ' minutes ' || o_custkey % 60 || ' seconds'
      ELSE (o_custkey // 3600) % 24 || ' hours ' || (o_custkey // 60) % 60 || ' minutes ' || o_custkey % 60 || ' seconds' END AS duration FROM orders""",
)
def format_duration(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.format_duration(F.col("o_custkey")).alias("duration"))


VERSION_TEXT = "cast(major AS @TEXT) || '.' || cast(minor AS @TEXT) || '.' || cast(patch AS @TEXT)"


@register("version_parse", f"SELECT package_id, {VERSION_TEXT} AS version, major, minor, patch FROM {{versions}} v")
def version_parse(spark, sf):
    df = spark_sql(spark, sf, f"SELECT package_id, {VERSION_TEXT} AS version FROM {{versions}} v")
    v = versions.version_parse(F.col("version"))
    return df.select("package_id", "version", v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"))


@register(
    "version_order",
    f"""SELECT package_id, arg_max(version, major * 1e14 + minor * 1e12 + patch) AS newest, arg_min(version, major * 1e14 + minor * 1e12 + patch) AS oldest
    FROM (SELECT *, {VERSION_TEXT} AS version FROM {{versions}} v) GROUP BY package_id""",
)
def version_order(spark, sf):
    df = spark_sql(spark, sf, f"SELECT package_id, {VERSION_TEXT} AS version FROM {{versions}} v")
    order = versions.version_parse(F.col("version"))
    return df.groupBy("package_id").agg(
        F.max_by("version", order).alias("newest"), F.min_by("version", order).alias("oldest")
    )
