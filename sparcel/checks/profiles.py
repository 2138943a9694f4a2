"""Profiles, options, merging, shares, precisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.checks.base import duck_type, register, spark_sql, standin, table
from sparcel.operators import profile as P

NUMERIC = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "orders": ("o_totalprice",)}


def _one_type(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS property, '{t}' AS type, count({c}) AS n FROM {source}" for c, t in columns.items())


@register(
    "profile_counts",
    _one_type("orders", {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_orderpriority": "string"})
    + """ UNION ALL SELECT 'o_orderdate', CASE WHEN date_trunc('millisecond', o_orderdate) = date_trunc('day', o_orderdate) THEN 'date' ELSE 'date-time' END, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_totalprice', 'number', count(*) FROM orders
    UNION ALL """ + _one_type("events", {"event_id": "integer", "user_id": "integer", "event_type": "string", "props": "string"})
    + """ UNION ALL SELECT 'value', 'number', count(*) FROM events
    UNION ALL SELECT 'ts', CASE WHEN date_trunc('millisecond', ts) = date_trunc('day', ts) THEN 'date' ELSE 'date-time' END, count(*) FROM events GROUP BY 2""",
)
def profile_counts(spark, sf):
    parts = [P.profile(table(spark, sf, t), stats=["record_count"]) for t in ("orders", "events")]
    return parts[0].unionByName(parts[1]).withColumnRenamed("record_count", "n")


@register(
    "profile_raw_counts",
    f"""SELECT 'mixed' AS property, CASE WHEN {duck_type('mixed')} = 'integer' THEN 'number' ELSE {duck_type('mixed')} END AS type, count(*) AS n FROM {{mixed}} m GROUP BY 2""",
)
def profile_raw_counts(spark, sf):
    rows = P.profile(standin(spark, sf, "mixed"), columns=["mixed"], raw=["mixed"], stats=["record_count"])
    return rows.withColumnRenamed("record_count", "n")


TEXTS = {"documents": ("text", "lang", "source"), "pages": ("url", "html"), "conversations": ("role", "text"), "benchmark": ("text",)}


@register(
    "profile_strings",
    " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS property, count({c}) AS n, min(length({c})) AS min_length, max(length({c})) AS max_length FROM {t}"
        for t, cs in TEXTS.items() for c in cs
    ),
)
def profile_strings(spark, sf):
    out = None
    for t, columns in TEXTS.items():
        rows = P.profile(table(spark, sf, t), columns=columns, stats=["string_min_length", "string_max_length"]).select(
            F.concat(F.lit(f"{t}."), "property").alias("property"), F.col("record_count").alias("n"),
            F.col("string_min_length").alias("min_length"), F.col("string_max_length").alias("max_length"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _duck_numbers(source: str, column: str) -> str:
    text = f"CASE WHEN {column} = floor({column}) THEN CAST(CAST(abs({column}) AS BIGINT) AS VARCHAR) ELSE CAST(abs({column}) AS VARCHAR) END"
    scale = f"CASE WHEN {column} = floor({column}) THEN 0 ELSE length(split_part({text}, '.', 2)) END"
    return f"""SELECT '{column}' AS property, CASE WHEN count(*) FILTER (WHERE {column} <> floor({column})) > 0 THEN 'number' ELSE 'integer' END AS type,
      count({column}) AS n, min({column}) AS low, max({column}) AS high,
      CAST(max(length(split_part({text}, '.', 1)) + {scale}) AS BIGINT) AS max_precision, CAST(max({scale}) AS BIGINT) AS max_scale FROM {source}"""


def _numbers(rows):
    return rows.select(
        "property", "type", F.col("record_count").alias("n"), F.col("number_min").alias("low"), F.col("number_max").alias("high"),
        F.col("number_max_precision").alias("max_precision"), F.col("number_max_scale").alias("max_scale"),
    )


@register("profile_numbers", " UNION ALL ".join(_duck_numbers(t, c) for t, cs in NUMERIC.items() for c in cs))
def profile_numbers(spark, sf):
    parts = [P.profile(table(spark, sf, t), columns=cs) for t, cs in NUMERIC.items()]
    return _numbers(parts[0].unionByName(parts[1]))


@register(
    "profile_booleans",
    """SELECT 'quality' AS property, count(*) FILTER (WHERE quality = 1) AS true_count, count(*) FILTER (WHERE quality = 0) AS false_count FROM labels
    UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic = 1), count(*) FILTER (WHERE toxic = 0) FROM labels""",
)
def profile_booleans(spark, sf):
    flags = table(spark, sf, "labels").select(F.col("quality").cast("boolean"), F.col("toxic").cast("boolean"))
    return P.profile(flags).filter("type = 'boolean'").select("property", "true_count", "false_count")


def _duck_dates(source: str, column: str) -> str:
    midnight = f"date_trunc('millisecond', {column}) = date_trunc('day', {column})"
    fraction = f"length(rtrim(strftime({column}, '%f'), '0'))"
    return f"""SELECT '{column}' AS property, CASE WHEN {midnight} THEN 'date' ELSE 'date-time' END AS type, count(*) AS n,
      strftime(min({column}), '%Y-%m-%d %H:%M:%S.%f') AS earliest, strftime(max({column}), '%Y-%m-%d %H:%M:%S.%f') AS latest,
      max({fraction}) AS subsecond_digits FROM {source} GROUP BY 2"""


def _dates(rows):
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rows.filter("type in ('date', 'date-time')").select(
        "property", "type", F.col("record_count").alias("n"), F.date_format("date_min", form).alias("earliest"),
        F.date_format("date_max", form).alias("latest"), F.col("date_max_subsecond").alias("subsecond_digits"),
    )


@register("profile_dates", " UNION ALL ".join(_duck_dates(*x) for x in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))))
def profile_dates(spark, sf):
    out = None
    for source, column in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        rows = _dates(P.profile(table(spark, sf, source), columns=[column]))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "profile_arrays",
    """SELECT 'embedding' AS property, 'array' AS type, count(*) AS n, min(len(embedding)) AS low, max(len(embedding)) AS high FROM embeddings
    UNION ALL SELECT 'embedding[]', CASE WHEN count(*) FILTER (WHERE x <> floor(x)) > 0 THEN 'number' ELSE 'integer' END, count(*), NULL, NULL
    FROM (SELECT unnest(embedding) AS x FROM embeddings)""",
)
def profile_arrays(spark, sf):
    return P.profile(table(spark, sf, "embeddings"), columns=["embedding"]).select(
        "property", "type", F.col("record_count").alias("n"), F.col("array_min_length").alias("low"), F.col("array_max_length").alias("high")
    )


@register(
    "profile_objects",
    """SELECT 'p' AS property, 'object' AS type, count(*) AS n, NULL AS low, NULL AS high FROM events
    UNION ALL SELECT 'p.k', 'integer', count(@K), CAST(min(@K) AS DOUBLE), CAST(max(@K) AS DOUBLE) FROM events
    UNION ALL SELECT 'p.inner', 'object', count(*), NULL, NULL FROM events
    UNION ALL SELECT 'p.inner.kind', 'string', count(event_type), NULL, NULL FROM events
    UNION ALL SELECT 'p.inner.user', 'integer', count(user_id), min(user_id), max(user_id) FROM events""",
)
def profile_objects(spark, sf):
    nested = table(spark, sf, "events").select(
        F.struct(
            F.from_json("props", "k bigint")["k"].alias("k"),
            F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")).alias("inner"),
        ).alias("p")
    )
    return P.profile(nested).select(
        "property", "type", F.col("record_count").alias("n"), F.col("number_min").alias("low"), F.col("number_max").alias("high")
    )


@register(
    "profile_table",
    " UNION ALL ".join(
        [_duck_numbers("lineitem", c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [f"SELECT '{c}', 'string', count(*), min(length({c})), max(length({c})), NULL, NULL FROM lineitem" for c in ("l_returnflag", "l_linestatus")]
        + ["""SELECT 'l_shipdate', CASE WHEN date_trunc('millisecond', l_shipdate) = date_trunc('day', l_shipdate) THEN 'date' ELSE 'date-time' END, count(*),
            epoch(min(l_shipdate)), epoch(max(l_shipdate)), NULL, NULL FROM lineitem GROUP BY 2"""]
    ),
)
def profile_table(spark, sf):
    rows = P.profile(table(spark, sf, "lineitem"), columns_per_scan=4)
    epoch = lambda c: F.unix_micros(c) / F.lit(1e6)
    return rows.select(
        "property", "type", F.col("record_count").alias("n"),
        F.coalesce("number_min", F.col("string_min_length").cast("double"), epoch("date_min")).alias("low"),
        F.coalesce("number_max", F.col("string_max_length").cast("double"), epoch("date_max")).alias("high"),
        F.col("number_max_precision").alias("max_precision"), F.col("number_max_scale").alias("max_scale"),
    )


def _duck_options(source: str, column: str, kind: str, text: str | None = None) -> str:
    text = text or f"CAST({column} AS VARCHAR)"
    return f"""SELECT '{column}' AS property, type, value, n FROM (
      SELECT {kind} AS type, {text} AS value, count(*) AS n, count(*) OVER (PARTITION BY {kind}) AS k, max(length({text})) OVER (PARTITION BY {kind}) AS m
      FROM {source} WHERE {column} IS NOT NULL GROUP BY 1, 2) WHERE k <= 50 AND m <= 50"""


_NUMERIC_KIND = "CASE WHEN {c} = floor({c}) THEN 'integer' ELSE 'number' END"


@register(
    "value_options",
    " UNION ALL ".join(
        [_duck_options("lineitem", c, "'string'") for c in ("l_returnflag", "l_linestatus")]
        + [_duck_options("lineitem", c, "'integer'") for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")]
        + [_duck_options("lineitem", c, _NUMERIC_KIND.replace("{c}", c)) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")]
        + [_duck_options("lineitem", "l_shipdate", "CASE WHEN date_trunc('day', l_shipdate) = l_shipdate THEN 'date' ELSE 'date-time' END")]
    ),
)
def value_options(spark, sf):
    return P.value_options(table(spark, sf, "lineitem"))


@register(
    "value_options_mixed",
    f"""WITH m AS (SELECT CASE WHEN event_type = 'error' THEN mixed || repeat('x', 60) ELSE mixed END AS mixed FROM {{mixed}} a)
    SELECT 'mixed' AS property, type, value, n FROM (SELECT {duck_type('mixed')} AS type, mixed AS value, count(*) AS n, count(*) OVER (PARTITION BY {duck_type('mixed')}) AS k,
      max(length(mixed)) OVER (PARTITION BY {duck_type('mixed')}) AS m FROM m GROUP BY 1, 2) WHERE k <= 50 AND m <= 50 AND type <> 'null'""",
)
def value_options_mixed(spark, sf):
    """One column of long texts, numbers, truth values and dates: the short types keep their options."""
    long = F.concat("mixed", F.repeat(F.lit("x"), 60))
    df = standin(spark, sf, "mixed").select(F.when(F.col("event_type") == "error", long).otherwise(F.col("mixed")).alias("mixed"))
    return P.value_options(df, raw=["mixed"])


@register(
    "number_widening",
    """SELECT 'value' AS property, 'number' AS type, count(*) AS n, min(value) AS low, max(value) AS high FROM events
    UNION ALL SELECT 'l_quantity', 'integer', count(*), min(l_quantity), max(l_quantity) FROM lineitem""",
)
def number_widening(spark, sf):
    narrow = [P.profile(table(spark, sf, t), columns=[c], widen=False) for t, c in (("events", "value"), ("lineitem", "l_quantity"))]
    rows = P.number_widening(narrow[0].unionByName(narrow[1]))
    return rows.select("property", "type", F.col("record_count").alias("n"), F.col("number_min").alias("low"), F.col("number_max").alias("high"))


@register(
    "first_last_seen",
    """SELECT 'mixed' AS property, strftime(min(ts) FILTER (WHERE mixed IS NOT NULL), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
      strftime(max(ts) FILTER (WHERE mixed IS NOT NULL), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM {mixed} m
    UNION ALL SELECT 'user_id', strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events""",
)
def first_last_seen(spark, sf):
    rows = P.profile(standin(spark, sf, "mixed"), columns=["mixed", "user_id"], received="ts")
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rows.filter("type <> 'null'").select(
        "property", F.date_format("first_seen", form).alias("first_seen"), F.date_format("last_seen", form).alias("last_seen")
    )


@register(
    "stream_stats",
    """SELECT event_type AS stream, count(*) AS inspected_count, count(*) AS record_count, 'EXACT' AS record_count_precision,
      CAST(sum(octet_length(encode(props))) AS BIGINT) AS byte_count, 'EXACT' AS byte_count_precision FROM events GROUP BY 1""",
)
def stream_stats(spark, sf):
    df = table(spark, sf, "events").withColumnRenamed("event_type", "stream")
    return P.stream_stats(df, F.octet_length("props"), ["stream"])


@register(
    "least_precise",
    """SELECT l_returnflag, CASE max(CASE WHEN l_linestatus = 'O' AND l_quantity > 49 THEN 3 WHEN l_quantity > 25 THEN 2 ELSE 1 END)
      WHEN 3 THEN 'GREATER_THAN' WHEN 2 THEN 'APPROXIMATE' ELSE 'EXACT' END AS precision FROM lineitem GROUP BY 1""",
)
def least_precise(spark, sf):
    precision = F.expr("CASE WHEN l_linestatus = 'O' AND l_quantity > 49 THEN 'GREATER_THAN' WHEN l_quantity > 25 THEN 'APPROXIMATE' ELSE 'EXACT' END")
    return table(spark, sf, "lineitem").withColumn("p", precision).groupBy("l_returnflag").agg(P.least_precise(F.col("p")).alias("precision"))


@register(
    "type_share",
    f"""SELECT type, n, round(100.0 * n / sum(n) OVER (), 2) AS share,
      CASE WHEN n > 999 THEN (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS shown
    FROM (SELECT CASE WHEN {duck_type('mixed')} = 'integer' THEN 'number' ELSE {duck_type('mixed')} END AS type, count(*) AS n FROM {{mixed}} m GROUP BY 1)""",
)
def type_share(spark, sf):
    rows = P.profile(standin(spark, sf, "mixed"), columns=["mixed"], raw=["mixed"], stats=["record_count"])
    return P.type_share(rows).select(
        "type", F.col("record_count").alias("n"), "share", P.human_count(F.col("record_count"), F.lit("EXACT")).alias("shown")
    )


@register(
    "expected_totals",
    """SELECT event_type, CASE WHEN count(mixed) = count(*) THEN CAST(sum(length(mixed)) AS BIGINT) END AS expected FROM {mixed} m GROUP BY 1""",
)
def expected_totals(spark, sf):
    return standin(spark, sf, "mixed").groupBy("event_type").agg(P.expected_total(F.length("mixed")).cast("bigint").alias("expected"))


@register("merge_profiles", _duck_numbers("orders", "o_totalprice") + " UNION ALL " + _duck_numbers("orders", "o_orderkey") + " UNION ALL " + _duck_numbers("orders", "o_custkey"))
def merge_profiles(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    halves = [P.profile(orders.filter(f"o_orderstatus {op} 'F'").drop("o_orderstatus")) for op in ("=", "<>")]
    return _numbers(P.merge_profiles(*halves))


@register(
    "merge_options",
    """SELECT 'o_orderpriority' AS property, 'string' AS type, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 3""",
)
def merge_options(spark, sf):
    orders = table(spark, sf, "orders")
    halves = [P.value_options(orders.filter(f"o_orderstatus {op} 'F'"), ["o_orderpriority"]) for op in ("=", "<>")]
    return P.merge_options(*halves)


@register(
    "merge_samples",
    """WITH s AS (SELECT o_orderpriority, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS side FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, side ORDER BY o_orderkey) AS turn FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, side) AS sample_no FROM r WHERE turn <= 100)
    SELECT o_orderpriority, o_orderkey, sample_no FROM p WHERE sample_no <= 100""",
)
def merge_samples(spark, sf):
    orders = table(spark, sf, "orders")
    columns = ["o_orderpriority", "o_orderkey"]
    existing, new = [orders.filter(f"o_orderstatus {op} 'F'").select(*columns) for op in ("=", "<>")]
    return P.merge_samples(existing, new, "o_orderkey", "o_orderpriority")


@register(
    "merge_schema_rows",
    """SELECT l_returnflag AS schema, count(*) FILTER (WHERE l_linestatus = 'O') AS record_count, count(*) AS inspected_count,
      'first' AS description, 'piece' AS unit, max(l_quantity) > 49 AS hidden FROM lineitem GROUP BY 1""",
)
def merge_schema_rows(spark, sf):
    def side(status, description, unit):
        return table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status).groupBy(F.col("l_returnflag").alias("schema")).agg(
            F.count("*").alias("record_count"), F.count("*").alias("inspected_count"), F.lit(description).cast("string").alias("description"),
            F.lit(unit).cast("string").alias("unit"), (F.max("l_quantity") > 49).alias("hidden"),
        )

    return P.merge_schema_row(side("F", "first", None), side("O", "second", "piece"))
