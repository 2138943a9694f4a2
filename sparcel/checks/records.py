"""Conflict resolution, target shapes, record pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.checks.base import duck_type, register, standin, table
from sparcel.checks.scalars import duck_number
from sparcel.operators import profile as P
from sparcel.operators import projection as R
from sparcel.operators import resolve as C
from sparcel.operators import shapes as S
from sparcel.session import scratch
from sparcel.sinks import files as W

TYPE = duck_type("mixed")
NUMBER = duck_number("mixed")
STAMP = "coalesce(try_strptime(mixed, '%Y-%m-%d %H:%M:%S'), try_strptime(mixed, '%Y-%m-%d'))"
TRUTH = "lower(trim(mixed)) IN ('true', 'yes')"
ISO = f"strftime({STAMP}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _mixed(spark, sf):
    return standin(spark, sf, "mixed")


def _conflicts(spark, sf):
    return C.type_conflicts(P.profile(_mixed(spark, sf), raw=["mixed"], columns=["mixed", "event_type"], stats=["record_count"]))


@register(
    "type_conflicts",
    f"""SELECT 'mixed' AS property, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (SELECT CASE WHEN {TYPE} = 'integer' THEN 'number' ELSE {TYPE} END AS t FROM {{mixed}} m) WHERE t <> 'null'""",
)
def type_conflicts(spark, sf):
    return _conflicts(spark, sf).select("property", F.array_join("types", ",").alias("types"))


def _pair_options():
    # Fixed values, written out again: what may be done about two types.
    cases = " ".join(f"WHEN '{pair}' THEN '{options}'" for pair, options in {
        "boolean,date": "CAST_TO_STRING,ALL", "boolean,integer": "CAST_TO_BOOLEAN,CAST_TO_INTEGER,ALL", "boolean,number": "CAST_TO_BOOLEAN,CAST_TO_DOUBLE,ALL",
        "boolean,string": "CAST_TO_STRING,CAST_TO_NULL,SKIP,ALL", "date,date-time": "CAST_TO_DATE_TIME,CAST_TO_DATE,ALL", "date-time,integer": "CAST_TO_DATE_TIME,CAST_TO_INTEGER,ALL",
        "date-time,number": "CAST_TO_DATE_TIME,CAST_TO_DOUBLE,ALL", "date-time,string": "CAST_TO_DATE_TIME,CAST_TO_STRING,ALL", "date,integer": "CAST_TO_INTEGER,CAST_TO_DATE,CAST_TO_STRING,ALL",
        "date,number": "CAST_TO_STRING,ALL", "date,string": "CAST_TO_STRING,CAST_TO_NULL,SKIP", "integer,number": "CAST_TO_DOUBLE,CAST_TO_STRING,ALL",
        "integer,string": "CAST_TO_STRING,CAST_TO_NULL,SKIP,ALL", "number,string": "CAST_TO_STRING,CAST_TO_NULL,SKIP,ALL",
    }.items())
    return f"""SELECT event_pair, types, CASE WHEN len(string_split(types, ',')) > 2 THEN 'CAST_TO_STRING,ALL' ELSE CASE types {cases} END END AS options FROM (
      SELECT event_pair, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (
        SELECT CASE WHEN event_type IN ('view', 'click') THEN 'numbers' WHEN event_type IN ('purchase', 'signup') THEN 'flags' ELSE 'rest' END AS event_pair,
          {TYPE} AS t FROM {{mixed}} m) WHERE t <> 'null' GROUP BY 1)"""


@register("conflict_options", _pair_options())
def conflict_options(spark, sf):
    pair = F.expr("CASE WHEN event_type IN ('view', 'click') THEN 'numbers' WHEN event_type IN ('purchase', 'signup') THEN 'flags' ELSE 'rest' END")
    rows = P.profile(_mixed(spark, sf).withColumn("event_pair", pair), raw=["mixed"], columns=["mixed"], by=["event_pair"], stats=["record_count"], widen=False)
    conflicts = C.type_conflicts(rows.drop("property").withColumnRenamed("event_pair", "property"))
    return C.conflict_options(conflicts).select(
        F.col("property").alias("event_pair"), F.array_join("types", ",").alias("types"), F.array_join("options", ",").alias("options")
    )


CASTS = {
    "cast_to_boolean": (C.BOOLEAN, f"CASE WHEN {TYPE} IN ('integer', 'number') THEN {NUMBER} > 0 WHEN {TYPE} IN ('boolean', 'string') THEN {TRUTH} END"),
    "cast_to_integer": (C.INTEGER, f"""CASE WHEN {TYPE} IN ('integer', 'number', 'string') THEN CAST(floor({NUMBER} + 0.5) AS BIGINT)
        WHEN {TYPE} = 'boolean' THEN CAST({TRUTH} AS BIGINT) WHEN {TYPE} = 'date' THEN epoch_ms({STAMP}) END"""),
    "cast_to_double": (C.DOUBLE, f"CASE WHEN {TYPE} IN ('integer', 'number', 'string') THEN {NUMBER} WHEN {TYPE} = 'boolean' THEN CAST({TRUTH} AS DOUBLE) END"),
    "cast_to_date": (C.DATE, f"""CASE WHEN {TYPE} IN ('date', 'date-time') THEN strftime({STAMP}, '%Y-%m-%d') WHEN {TYPE} = 'integer' THEN strftime(epoch_ms(CAST({NUMBER} AS BIGINT)), '%Y-%m-%d') END"""),
    "cast_to_date_time": (C.DATE_TIME, f"""CASE WHEN {TYPE} IN ('date', 'date-time') THEN {ISO} WHEN {TYPE} = 'integer' THEN strftime(epoch_ms(CAST({NUMBER} AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') END"""),
    "cast_to_string": (C.STRING, f"""CASE WHEN {TYPE} = 'boolean' THEN CAST({TRUTH} AS VARCHAR) WHEN {TYPE} IN ('date', 'date-time') THEN {ISO} WHEN {TYPE} <> 'null' THEN mixed END"""),
    "cast_to_null": (C.NULL, f"CASE WHEN {TYPE} NOT IN ('string', 'null') THEN mixed END"),
    "keep_all_types": (C.ALL, f"CASE WHEN {TYPE} <> 'null' THEN mixed END"),
}


def _register_cast(key, option, sql):
    @register(key, f"SELECT event_id, {sql} AS value FROM {{mixed}} m")
    def query(spark, sf):
        rows = C.resolve_conflicts(_mixed(spark, sf).select("event_id", "mixed"), {"mixed": option})
        value = F.col("mixed")
        if option == C.DATE:
            value = F.date_format(value, "yyyy-MM-dd")
        elif option == C.DATE_TIME:
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return rows.select("event_id", value.alias("value"))


for _key, (_option, _sql) in CASTS.items():
    _register_cast(_key, _option, _sql)


@register("skip_conflicting", f"SELECT event_id, nullif(mixed, '') AS mixed FROM {{mixed}} m WHERE {TYPE} <> 'string'")
def skip_conflicting(spark, sf):
    return C.resolve_conflicts(_mixed(spark, sf).select("event_id", "mixed"), {"mixed": C.SKIP})


@register(
    "apply_resolution_to_schema",
    """SELECT 'mixed' AS property, 'string' AS types UNION ALL SELECT 'event_type', 'string'""",
)
def apply_resolution_to_schema(spark, sf):
    """Types of the delivered column, as measured after the resolution."""
    resolved = C.resolve_conflicts(_mixed(spark, sf).select("mixed", "event_type"), {"mixed": C.STRING})
    observed = C.types_of(P.profile(_mixed(spark, sf), raw=["mixed"], columns=["mixed", "event_type"], stats=["record_count"]))
    after = C.apply_resolution(observed, {"mixed": C.STRING})
    rows = P.profile(resolved, stats=["record_count"]).filter("type <> 'null'")
    expected = F.create_map(*[x for k, v in after.items() for x in (F.lit(k), F.lit(",".join(t for t in v if t != "null")))])
    return rows.filter(F.col("type") == F.try_element_at(expected, F.col("property"))).select("property", F.col("type").alias("types"))


MIXED_TYPES = {"event_id": ["integer"], "mixed": ["boolean", "date", "date-time", "number", "string"]}


@register(
    "relational_shape",
    f"""SELECT event_id, CASE WHEN {TYPE} = 'boolean' THEN {TRUTH} END AS "mixed-boolean", CASE WHEN {TYPE} = 'date' THEN strftime({STAMP}, '%Y-%m-%d') END AS "mixed-date",
      CASE WHEN {TYPE} = 'date-time' THEN {ISO} END AS "mixed-date-time", CASE WHEN {TYPE} IN ('integer', 'number') THEN {NUMBER} END AS "mixed-number",
      CASE WHEN {TYPE} = 'string' THEN mixed END AS "mixed-string" FROM {{mixed}} m""",
)
def relational_shape(spark, sf):
    return _texts(S.relational_shape(_mixed(spark, sf), MIXED_TYPES), "mixed-date", "mixed-date-time")


def _texts(df, day, stamp):
    return df.withColumns({
        day: F.date_format(F.col(f"`{day}`"), "yyyy-MM-dd"), stamp: F.date_format(F.col(f"`{stamp}`"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    })


@register(
    "relational_ddl",
    """SELECT '"event_id" bigint, "mixed-boolean" boolean, "mixed-date" date, "mixed-date-time" timestamp, "mixed-number" double precision, "mixed-string" text' AS ddl, count(*) AS n FROM events""",
)
def relational_ddl(spark, sf):
    df = _mixed(spark, sf)
    types = C.types_of(P.profile(df, raw=["mixed"], columns=["event_id", "mixed"], stats=["record_count"]))
    return df.agg(F.lit(S.relational_ddl(types)).alias("ddl"), F.count("*").alias("n"))


@register(
    "document_shape",
    f"""SELECT event_id, CASE WHEN {TYPE} = 'boolean' THEN {TRUTH} END AS mixed_boolean, CASE WHEN {TYPE} = 'date' THEN strftime({STAMP}, '%Y-%m-%d') END AS mixed_date,
      CASE WHEN {TYPE} = 'date-time' THEN {ISO} END AS "mixed_date-time", CASE WHEN {TYPE} IN ('integer', 'number') THEN {NUMBER} END AS mixed_number,
      CASE WHEN {TYPE} = 'string' THEN mixed END AS mixed_string FROM {{mixed}} m""",
)
def document_shape(spark, sf):
    return _texts(S.document_shape(_mixed(spark, sf), MIXED_TYPES), "mixed_date", "mixed_date-time")


@register(
    "warehouse_shape_prefixed",
    f"""SELECT event_id AS dp_event_id, CASE WHEN {TYPE} = 'boolean' THEN {TRUTH} END AS dp_mixed_boolean, CASE WHEN {TYPE} = 'date' THEN strftime({STAMP}, '%Y-%m-%d') END AS dp_mixed_date,
      CASE WHEN {TYPE} = 'date-time' THEN {ISO} END AS dp_mixed_date_time, CASE WHEN {TYPE} IN ('integer', 'number') THEN {NUMBER} END AS dp_mixed_number,
      CASE WHEN {TYPE} = 'string' THEN mixed END AS dp_mixed_string FROM {{mixed}} m""",
)
def warehouse_shape_prefixed(spark, sf):
    return _texts(S.warehouse_shape(_mixed(spark, sf), MIXED_TYPES, "dp"), "dp_mixed_date", "dp_mixed_date_time")


@register(
    "avro_sink",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice, epoch_ms(o_orderdate) AS o_orderdate,
      o_orderpriority AS priority FROM orders""",
)
def avro_sink(spark, sf):
    types = {"o_orderkey": ["integer"], "o_custkey": ["integer", "null"], "o_orderstatus": ["string"], "o_totalprice": ["number"],
             "o_orderdate": ["date-time"], "priority!?": ["string"]}
    return S.avro_shape(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority!?"), types)


@register(
    "kafka_sink",
    """SELECT 'nations-demo' AS topic, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation
    UNION ALL SELECT 'customers-demo', '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer""",
)
def kafka_sink(spark, sf):
    return S.kafka_value(table(spark, sf, "nation"), "{schemaTitle}-demo", "nations").unionByName(
        S.kafka_value(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "{schemaTitle}-demo", "customers")
    )


@register(
    "columnar_payload_shape",
    """SELECT event_type, CAST(floor(event_id / 100) AS BIGINT) AS batch, 0 AS part, count(*) AS n,
      '{"columns":["event_id","user_id","event_type","at"],"data":[' || string_agg('["' || event_id || '","' || user_id || '","' || event_type || '","' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '"]', ',' ORDER BY event_id) || ']}' AS body
    FROM events GROUP BY event_type, batch""",
)
def columnar_payload_shape(spark, sf):
    """Bodies of each stream by itself."""
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("at"), "props")
    return S.columnar_payload(df, "event_id", hidden=["props"], by=["event_type"])


@register(
    "columnar_shape",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(mixed, '') AS mixed, '{"kind":"' || event_type || '"}' AS nested FROM {mixed} m""",
)
def columnar_shape(spark, sf):
    df = _mixed(spark, sf).select("event_id", "mixed", F.struct(F.col("event_type").alias("kind")).alias("nested"), "user_id")
    return S.columnar_shape(df, hidden=["user_id"])


@register(
    "stream_table_shape",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(31, 2)) AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS o_orderdate,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS receive_time,
      'o_orderkey BIGINT,o_totalprice DECIMAL(31,2),o_orderdate TIMESTAMP_LTZ(3),receive_time TIMESTAMP_LTZ(3)' AS columns FROM orders""",
)
def stream_table_shape(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    scale = P.profile(df, columns=["o_totalprice"], stats=["number_max_scale"]).agg(F.max("number_max_scale")).first()[0]
    scales = {"o_totalprice": scale}
    columns = ",".join(f"{c['name']} {c['type']}" for c in S.stream_table_schema(df.schema, scales, receive_time=True))
    shaped = S.stream_table_shape(df, scales, F.col("o_orderdate"))
    return shaped.withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("columns", F.lit(columns))


# Record pipelines


@register("exclude_properties", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def exclude_properties(spark, sf):
    return R.exclude_properties(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"])


@register("rename_properties", 'SELECT c_custkey AS id, c_name AS "Customer Name", c_nationkey, c_acctbal, c_mktsegment FROM customer')
def rename_properties(spark, sf):
    return R.rename_properties(table(spark, sf, "customer"), {"c_custkey": "id", "c_name": "Customer Name"})


@register("drop_bad_properties", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def drop_bad_properties(spark, sf):
    return R.drop_bad_properties(table(spark, sf, "supplier").toDF("s_suppkey", "s_name", "", "s_acctbal"))




@register(
    "offset_filter",
    "SELECT e.event_id, e.event_type FROM events e LEFT JOIN (SELECT event_type, CAST(floor(avg(event_id)) AS BIGINT) AS o FROM events WHERE event_type <> 'view' GROUP BY 1) s USING (event_type) WHERE coalesce(e.event_id > s.o, TRUE)",
)
def offset_filter(spark, sf):
    events = table(spark, sf, "events")
    state = events.filter("event_type <> 'view'").groupBy("event_type").agg(F.floor(F.avg("event_id")).alias("stream_offset"))
    return R.offset_filter(events, state, ["event_type"], "event_id").select("event_id", "event_type")


@register("route_by_schema", "SELECT event_type AS schema, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def route_by_schema(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_type", R.SCHEMA)
    location = scratch(spark, "routed")
    R.route_to_folders(events, ["view", "click", "purchase", "signup", "error"], location)
    return spark.read.parquet(location).groupBy(F.col(R.SCHEMA).alias("schema")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("total")
    )


@register("route_by_schema_writers", "SELECT CASE n_regionkey WHEN 0 THEN 'africa' ELSE 'rest' END AS schema, count(*) AS n FROM nation GROUP BY 1")
def route_by_schema_writers(spark, sf):
    slug = F.when(F.col("n_regionkey") == 0, "africa").otherwise("rest")
    nation, location = table(spark, sf, "nation").withColumn(R.SCHEMA, slug), scratch(spark, "writers")
    R.route_by_schema(nation, {"africa": lambda df: W.csv_sink(df, f"{location}/africa"), "rest": lambda df: W.jsonl_sink(df, f"{location}/rest")})
    counts = [
        read.agg(F.count("*").alias("n")).withColumn("schema", F.lit(name))
        for name, read in (("africa", spark.read.csv(f"{location}/africa", header=True)), ("rest", spark.read.json(f"{location}/rest")))
    ]
    return counts[0].unionByName(counts[1])


@register(
    "stream_context",
    """SELECT event_id, 'parquet' AS _source_type, 'events' AS _source_slug, 'events' AS _stream_set, 'events.parquet' AS _stream, 'APPEND_ONLY_LOG' AS _update_method FROM events""",
)
def stream_context(spark, sf):
    return R.stream_context(
        table(spark, sf, "events"), source_type="parquet", source_slug="events", stream_set="events", update_method=R.APPEND_ONLY_LOG
    ).drop("ts", "user_id", "event_type", "value", "props")


@register(
    "sample_records",
    """SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 100""",
)
def sample_records(spark, sf):
    return R.sample_records(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey").select("o_orderpriority", "o_orderkey")


@register(
    "new_records_available",
    """WITH l AS (SELECT 'user-' || user_id AS stream, count(*) || '-' || max(event_id) AS h FROM events GROUP BY 1),
    s AS (SELECT 'user-' || user_id AS stream, count(*) || '-' || max(event_id) AS seen FROM events WHERE event_type <> 'signup' OR value < 100 GROUP BY 1)
    SELECT stream, h AS update_hash FROM l LEFT JOIN s USING (stream) WHERE seen IS NULL OR seen <> h""",
)
def new_records_available(spark, sf):
    events = table(spark, sf, "events").withColumn("stream", F.concat(F.lit("user-"), "user_id"))

    def listing(df):
        return df.groupBy("stream").agg(F.concat_ws("-", F.count("*"), F.max("event_id")).alias("update_hash"))

    return R.new_records_available(listing(events), listing(events.filter("event_type <> 'signup' OR value < 100")))


@register(
    "byte_counts",
    "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS records, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1",
)
def byte_counts(spark, sf):
    pages = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    return R.byte_counts(pages, "html", ["host"])


@register(
    "record_size",
    "SELECT p_partkey, CAST(8 + 2 * length(p_name) + 2 * length(p_brand) + 2 * length(p_type) + 8 + 8 AS BIGINT) AS size FROM part",
)
def record_size(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", R.record_size(df.schema).alias("size"))


@register(
    "event_time_choice",
    "SELECT o_orderpriority, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS newest FROM orders GROUP BY 1",
)
def event_time_choice(spark, sf):
    timed = S.event_time(table(spark, sf, "orders"), "o_orderdate")
    return timed.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))


