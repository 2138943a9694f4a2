"""Sources, sinks, batches and delivery state."""

from __future__ import annotations

import contextlib
import io
import tarfile
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparcel.checks.base import dealt, duck_type, register, spark_sql, standin, table
from sparcel.functions.infer import infer_string_type
from sparcel.operators.projection import after_offset
from sparcel.session import scratch
from sparcel.sinks import batches as B
from sparcel.sinks import files as W
from sparcel.sinks import state as D
from sparcel.sinks import tables as DB
from sparcel.sources import containers, delimited, feeds, files, nested, plugins, synthetic, tables

CUSTOMER = "CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment"


@register(
    "csv_typed_scan",
    f"SELECT {CUSTOMER}, {duck_type('CAST(c_custkey AS VARCHAR)')} AS key_type, {duck_type('CAST(c_acctbal AS VARCHAR)')} AS balance_type, {duck_type('c_name')} AS name_type FROM customer",
)
def csv_typed_scan(spark, sf):
    path = scratch(spark, "customer")
    W.csv_sink(table(spark, sf, "customer"), path)
    cells = delimited.scan_csv(spark, path).drop("_file", "_offset")
    return cells.select(
        "*", infer_string_type(F.col("c_custkey")).alias("key_type"), infer_string_type(F.col("c_acctbal")).alias("balance_type"),
        infer_string_type(F.col("c_name")).alias("name_type"),
    )


@register("csv_offsets", "SELECT o_orderkey, TRUE AS in_order FROM orders")
def csv_offsets(spark, sf):
    """Files of ascending keys: each record's offset is the number of smaller keys in its file."""
    path = scratch(spark, "orders")
    W.csv_sink(table(spark, sf, "orders").select("o_orderkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path)
    cells = delimited.scan_csv(spark, path).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "_file", "_offset")
    first = cells.filter("_offset = 0").select("_file", F.col("o_orderkey").alias("_least"))
    place = F.row_number().over(Window.partitionBy("_file").orderBy("o_orderkey")) - 1
    return cells.join(first, "_file").select("o_orderkey", ((place == F.col("_offset")) & (F.col("o_orderkey") >= F.col("_least"))).alias("in_order"))


@register(
    "csv_layouts",
    """SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation""",
)
def csv_layouts(spark, sf):
    """Files with columns in another order, and without one of them."""
    path, nation = scratch(spark, "layouts"), table(spark, sf, "nation")
    W.csv_sink(nation.filter("n_nationkey % 2 = 0").select("n_regionkey", "n_name", "n_nationkey"), f"{path}/a")
    W.csv_sink(nation.filter("n_nationkey % 2 = 1").select("n_nationkey", "n_name"), f"{path}/b")
    return delimited.scan_csv(spark, path, delimiter=",").select("n_nationkey", "n_name", "n_regionkey")


@register(
    "csv_line_breaks",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') AS text, CASE WHEN doc_id % 3 <> 1 THEN source END AS source FROM documents",
)
def csv_line_breaks(spark, sf):
    """Files of three layouts whose cells hold line breaks and quotes; a task reads a split, not a file."""
    path, docs = scratch(spark, "breaks"), table(spark, sf, "documents")
    for kind, columns in enumerate((("doc_id", "text", "source"), ("text", "doc_id"), ("source", "doc_id", "text"))):
        W.csv_sink(docs.filter(F.col("doc_id") % 3 == kind).select(*columns), f"{path}/{kind}", quote_all=kind == 0)
    return delimited.scan_csv(spark, path, delimiter=",", multi_line=True).select("doc_id", "text", "source")


@register("csv_sink", f"SELECT {CUSTOMER}, strftime(TIMESTAMP '2020-02-01 11:53:00', '%Y-%m-%dT%H:%M:%S.%gZ') AS seen FROM customer")
def csv_sink(spark, sf):
    path = scratch(spark, "customer")
    W.csv_sink(table(spark, sf, "customer").withColumn("seen", F.lit("2020-02-01 11:53:00").cast("timestamp")), path)
    return spark.read.csv(path, header=True, escape='"')


@register("jsonl_sink", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_sink(spark, sf):
    path = scratch(spark, "documents")
    documents = table(spark, sf, "documents")
    W.jsonl_sink(documents, path)
    return spark.read.schema(documents.schema).json(path)


@register("file_sink", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def file_sink(spark, sf):
    location, supplier = scratch(spark, "files"), table(spark, sf, "supplier")
    path = W.file_sink(supplier, location, "supplier")
    W.file_sink(supplier.filter("s_acctbal > 5000"), location, "supplier", update_method="APPEND_ONLY_LOG")
    return spark.read.parquet(path)


@register("json_path_scan", "SELECT event_id, @K AS k FROM events")
def json_path_scan(spark, sf):
    records = nested.json_records(table(spark, sf, "events").select("event_id", "props"), "props", "$.k")
    return records.select("event_id", F.variant_get("record", "$", "bigint").alias("k"))


@register("json_array_scan", "SELECT o_custkey, l_orderkey, l_linenumber * s AS l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (VALUES (1), (-1)) v(s)")
def json_array_scan(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    def line(sign):
        return F.struct(F.col("l_orderkey"), (F.col("l_linenumber") * sign).alias("l_linenumber"))

    documents = lines.select(
        "o_custkey", F.to_json(F.struct(F.struct(F.array(line(1), line(-1)).alias("lines")).alias("order"))).alias("text")
    )
    records = nested.json_records(documents, "text", "$.order.lines[*]")
    get = lambda name, kind: F.variant_get("record", f"$.{name}", kind).alias(name)
    return records.select("o_custkey", get("l_orderkey", "bigint"), get("l_linenumber", "int"))


def _one_document(parts):
    """Every file of the write is one JSON document, with other members around its array."""
    yield pd.DataFrame({"value": ['{"about": {"orders": [{"o_orderkey": -1}]}, "data": {"orders": [']})
    for number, part in enumerate(parts):
        yield pd.DataFrame({"value": ["," if number else "", ",\n".join(part["value"])]})
    yield pd.DataFrame({"value": ['], "end": true}, "orders": []}']})


@register("json_document_scan", "SELECT o_orderkey, o_custkey, o_orderpriority || '} \"' || o_orderstatus || '{' AS note FROM orders")
def json_document_scan(spark, sf):
    """All orders as one document for each written file, read by as many tasks as the file has splits."""
    path = scratch(spark, "document")
    note = F.concat("o_orderpriority", F.lit('} "'), "o_orderstatus", F.lit("{")).alias("note")
    rows = table(spark, sf, "orders").select(F.to_json(F.struct("o_orderkey", "o_custkey", note)).alias("value"))
    rows.mapInPandas(_one_document, "value string").write.text(path)
    found = nested.scan_json(spark, path, "$.data.orders[*]")
    return found.select(*[F.variant_get("record", f"$.{c}", t).alias(c) for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("note", "string"))])


def _with_root(parts):
    """Every file of the write is one document."""
    yield pd.DataFrame({"value": ["<suppliers>"]})
    yield from parts
    yield pd.DataFrame({"value": ["</suppliers>"]})


@register("xml_scan", 'SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS "address.nation", CAST(s_acctbal AS VARCHAR) AS balance FROM supplier')
def xml_scan(spark, sf):
    path = scratch(spark, "supplier.xml")
    text = F.format_string(
        "<supplier id=\"%s\"><name>%s</name><address><nation>%s</nation></address><balance currency=\"x\">%s</balance></supplier>",
        *[F.col(c).cast("string") for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")],
    )
    rows = table(spark, sf, "supplier").select(text.alias("value"))
    rows.mapInPandas(_with_root, "value string").write.text(path)
    return nested.scan_xml(spark, path, "/suppliers/supplier").drop("currency")


@register("compressed_scan", "SELECT p_partkey, p_name FROM part")
def compressed_scan(spark, sf):
    path = scratch(spark, "part")
    table(spark, sf, "part").select("p_partkey", "p_name").write.option("compression", "gzip").csv(path, header=True)
    return delimited.scan_csv(spark, path, offsets=False).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name")


def _archives(parts):
    """Every batch of rows as one archive of two members, zip and tar in turn."""
    for number, part in enumerate(parts):
        body, out = "\n".join(["name", *part["c_name"]]).encode(), io.BytesIO()
        if number % 2 == 0:
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr("data/names.csv", body)
                archive.writestr("data/readme.txt", "no data")
        else:
            with tarfile.open(fileobj=out, mode="w") as archive:
                info = tarfile.TarInfo("data/names.csv")
                info.size = len(body)
                archive.addfile(info, io.BytesIO(body))
        yield pd.DataFrame({"path": [f"archive-{number}"], "content": [out.getvalue()]})


@register("archive_scan", "SELECT c_name, 'names.csv' AS member FROM customer")
def archive_scan(spark, sf):
    archives = table(spark, sf, "customer").select("c_name").mapInPandas(_archives, "path string, content binary")
    lines = containers.archive_lines(archives, r"\.csv$").filter("line_no > 0")
    return lines.select(F.col("line").alias("c_name"), F.element_at(F.split("member", "/"), -1).alias("member"))


def _workbooks(parts):
    """Every batch of rows as one workbook with a sheet of names and balances."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for number, part in enumerate(parts):
        rows = [[" Name ", "Balance"], *zip(part["c_name"], part["c_acctbal"])]
        cells = lambda row: "".join(f'<c t="inlineStr"><is><t>{escape(str(c))}</t></is></c>' for c in row)
        sheet = "".join(f"<row>{cells(r)}</row>" for r in rows)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="customers" sheetId="1" r:id="r1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        yield pd.DataFrame({"path": [f"book-{number}.xlsx"], "content": [out.getvalue()]})


@register("xlsx_scan", "SELECT c_name AS name, CAST(c_acctbal AS VARCHAR) AS balance FROM customer")
def xlsx_scan(spark, sf):
    rows = table(spark, sf, "customer").select("c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    cells = containers.workbook_cells(rows.mapInPandas(_workbooks, "path string, content binary"))
    found = containers.sheet_table(cells, "customers", ["Name", "Balance"])
    return found.select(F.col("Name").alias("name"), F.col("Balance").alias("balance"))


@register("warehouse_stage_copy", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier")
def warehouse_stage_copy(spark, sf):
    path = scratch(spark, "staged")
    DB.warehouse_stage(table(spark, sf, "supplier"), {"s_suppkey": ["integer"], "s_name": ["string"], "s_acctbal": ["number"]}, path)
    return spark.read.csv(path, header=True, escape='"')


@register("requote_csv", "SELECT p_name, p_brand, p_type, TRUE AS quoted FROM part")
def requote_csv(spark, sf):
    source, target = scratch(spark, "plain"), scratch(spark, "quoted")
    table(spark, sf, "part").select("p_name", "p_brand", "p_type").write.csv(source)
    delimited.requote_csv(spark, source, target)
    cells = F.split(F.regexp_replace("value", '^"|"$', ""), '","')
    return spark.read.text(target).select(
        *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(("p_name", "p_brand", "p_type"))], F.col("value").startswith('"').alias("quoted")
    )


def _sorted_lines(spark, sf):
    """Orders as text files, every line naming its order."""
    path = scratch(spark, "lines")
    table(spark, sf, "orders").select(F.format_string("%010d", "o_orderkey").alias("value")).repartitionByRange("value").sortWithinPartitions(
        "value"
    ).write.text(path)
    return path


@register("line_offset_skip", "SELECT o_orderkey FROM orders")
def line_offset_skip(spark, sf):
    """Two deliveries of the same files: the first lines, and with the skip all the others."""
    path = _sorted_lines(spark, sf)
    rest = delimited.text_lines(spark, path, skip=10).select("value")
    first = delimited.text_lines(spark, path).filter("_line < 10").select("value")
    return first.union(rest).select(F.col("value").cast("bigint").alias("o_orderkey"))


@register("byte_offset_skip", "SELECT 8 AS dropped, CAST(count(*) * 11 AS BIGINT) AS total FROM orders")
def byte_offset_skip(spark, sf):
    path = _sorted_lines(spark, sf)
    size = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_file"), "length")
    left = delimited.skip_bytes(spark, path, 8).select("_file", F.length("content").alias("left")).join(size, "_file")
    return left.agg(F.max(F.col("length") - F.col("left")).cast("int").alias("dropped"), F.sum(F.col("left") + 8).alias("total"))


@register("record_offset_skip", "SELECT event_id FROM events WHERE event_id > 500")
def record_offset_skip(spark, sf):
    return after_offset(table(spark, sf, "events"), 500, "event_id").select("event_id")


@register("multi_file_scan", "SELECT o_orderstatus, count(*) AS n, TRUE AS every_file_known FROM orders GROUP BY 1")
def multi_file_scan(spark, sf):
    path = scratch(spark, "orders")
    table(spark, sf, "orders").repartition("o_orderstatus", "o_orderkey").write.parquet(path)
    listing = files.list_files(spark, path).select(F.col("name").alias("_stream"), F.col("update_hash").alias("listed"))
    records = files.multi_file_scan(lambda: spark.read.parquet(path)).join(listing, "_stream", "left")
    return records.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min(F.col("_update_hash") == F.col("listed")).alias("every_file_known")
    )


@register("route_files", "SELECT f.format, n_name, n_regionkey FROM nation CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) f(format)")
def route_files(spark, sf):
    path, nation = scratch(spark, "routed"), table(spark, sf, "nation").select("n_name", "n_regionkey")
    nation.write.csv(f"{path}/a", header=True)
    nation.write.json(f"{path}/b")
    nation.write.parquet(f"{path}/c")
    routed = files.route_files(spark, path)
    readers = {
        "csv": lambda p: spark.read.csv(p, header=True, schema=nation.schema), "json": lambda p: spark.read.json(p, schema=nation.schema),
        "parquet": lambda p: spark.read.parquet(*p),
    }
    out = None
    for fmt, read in readers.items():
        folders = [r[0] for r in routed.filter(F.col("format") == fmt).select("directory").distinct().toLocalIterator()]
        rows = read(folders).withColumn("format", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


@register(
    "stream_set_names",
    r"""WITH n AS (SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS directory, split_part(url, '/', -1) AS bare FROM pages),
    f AS (SELECT directory, arg_min(bare, lower(bare) || chr(1) || bare) AS first FROM n GROUP BY 1),
    d AS (SELECT DISTINCT directory, i FROM (SELECT n.directory, bare, first, unnest(range(1, least(length(bare), length(first)) + 1)) AS i FROM n JOIN f USING (directory)) WHERE substr(bare, i, 1) <> substr(first, i, 1)),
    p AS (SELECT directory, first, unnest(range(1, greatest(length(first), 1) + 1)) AS i FROM f),
    s AS (SELECT p.directory, string_agg(CASE WHEN d.i IS NOT NULL THEN '*' ELSE substr(first, p.i, 1) END, '' ORDER BY p.i) AS starred FROM p LEFT JOIN d ON d.directory = p.directory AND d.i = p.i GROUP BY 1)
    SELECT directory, regexp_replace(regexp_replace(regexp_replace(starred, '\*', ''), '^[^a-zA-Z0-9]*', ''), '[^a-zA-Z0-9]*$', '') AS stream_set FROM s""",
)
def stream_set_names(spark, sf):
    listing = table(spark, sf, "pages").select(
        F.regexp_replace("url", "/[^/]*$", "").alias("directory"), F.element_at(F.split("url", "/"), -1).alias("name")
    )
    return files.stream_set_names(listing)


@register(
    "table_or_query_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS o_orderdate FROM orders WHERE o_totalprice > 1000",
)
def table_or_query_scan(spark, sf):
    orders = table(spark, sf, "orders").withColumn("nested", F.struct("o_orderkey"))
    orders.createOrReplaceTempView("sparcel_orders")
    return tables.scan_query(spark, "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, nested FROM sparcel_orders WHERE o_totalprice > 1000")


KEYS = ", ".join(B.STREAM)


@register("batch_scan", "SELECT _offset, stream_set, stream, batch FROM {records} r WHERE batch = 2 AND _offset >= 500")
def batch_scan(spark, sf):
    path = scratch(spark, "records")
    standin(spark, sf, "records").write.partitionBy("schema", "batch").parquet(path)
    records = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))
    return B.scan_batches(records, standin(spark, sf, "batches"), start=500).select("_offset", "stream_set", "stream", "batch")


@register(
    "batch_upload",
    """SELECT b.*, stored FROM (SELECT stream_set, stream, batch, last_offset, is_default FROM {batches} b0
    UNION ALL SELECT stream_set, stream, (SELECT max(batch) FROM {batches} c WHERE c.stream_set = r.stream_set AND c.stream = r.stream) + 1, max(_offset), FALSE FROM {records} r GROUP BY 1, 2) b
    JOIN (SELECT stream_set, stream, count(*) AS stored FROM {records} r GROUP BY 1, 2) s ON s.stream_set = b.stream_set AND s.stream = b.stream""",
)
def batch_upload(spark, sf):
    incoming = standin(spark, sf, "records").drop("batch")
    path, known = scratch(spark, "upload"), incoming.select("schema").distinct()
    for _ in range(2):  # the same upload again leaves the same rows
        after = B.upload_batch(incoming, standin(spark, sf, "batches"), path, F.col("received_at"), upload="u1", known_schemas=known)
    stored = spark.read.parquet(path).groupBy("stream_set", "stream").agg(F.count("*").alias("stored"))
    after = after.join(stored, ["stream_set", "stream"])
    return after.select("stream_set", "stream", "batch", "last_offset", "is_default", "stored")


@register(
    "batch_continue",
    """WITH l AS (SELECT stream_set, stream, arg_max(last_offset, batch) AS last, max(batch) AS batch FROM {batches} b GROUP BY 1, 2)
    SELECT r.stream_set, r.stream, l.batch, max(r._offset) AS last_offset, count(*) AS n FROM {records} r JOIN l ON l.stream_set = r.stream_set AND l.stream = r.stream WHERE r._offset > l.last GROUP BY 1, 2, 3""",
)
def batch_continue(spark, sf):
    assigned = B.assign_batch(standin(spark, sf, "records").drop("batch"), standin(spark, sf, "batches"), new_batch=False)
    accepted = B.check_offsets(assigned.filter("_offset > _last"))
    return accepted.groupBy("stream_set", "stream", "batch").agg(F.max("_offset").alias("last_offset"), F.count("*").alias("n"))


@register("activate_batches", "SELECT stream_set, stream, batch, CASE WHEN stream_set = 'view' THEN batch = 2 ELSE batch = 1 END AS is_default FROM {batches} b")
def activate_batches(spark, sf):
    batches = standin(spark, sf, "batches")
    committed = batches.filter("batch = 1 AND stream_set <> 'view'").select(*B.STREAM, "batch")
    return B.activate_batches(batches, committed).select("stream_set", "stream", "batch", "is_default")


@register(
    "activation_log",
    """SELECT c.stream_set, c.stream, c.batch, p.batch AS prior_batch FROM {batches} c LEFT JOIN (SELECT * FROM {batches} x WHERE is_default) p ON p.stream_set = c.stream_set AND p.stream = c.stream WHERE c.batch = 1""",
)
def activation_log(spark, sf):
    batches = standin(spark, sf, "batches")
    return B.activation_log(batches, batches.filter("batch = 1")).select("stream_set", "stream", "batch", "prior_batch")


@register("latest_batch", "SELECT stream_set, stream, max(batch) AS batch, arg_max(last_offset, batch) AS last_offset FROM {batches} b GROUP BY 1, 2")
def latest_batch(spark, sf):
    return B.latest_batch(standin(spark, sf, "batches")).select("stream_set", "stream", "batch", "last_offset")


@register("default_batch", "SELECT stream_set, stream, batch, last_offset FROM {batches} b WHERE is_default")
def default_batch(spark, sf):
    return B.default_batch(standin(spark, sf, "batches")).select("stream_set", "stream", "batch", "last_offset")


@register("batch_listing", "SELECT stream_set, stream, batch, last_offset FROM {batches} b ORDER BY updated_at DESC, batch DESC LIMIT 20 OFFSET 5")
def batch_listing(spark, sf):
    return B.batch_listing(standin(spark, sf, "batches"), 20, 5).select("stream_set", "stream", "batch", "last_offset")


STATE_ROWS = """SELECT 'cat' AS catalog_slug, 'pkg' AS package_slug, 1 AS major_version, event_type AS stream_set, 'user-' || cast(user_id %% 10 AS @TEXT) AS stream,
  'event' AS schema, max(event_id) AS stream_offset, max(ts) AS updated_at FROM {events} WHERE value %s 50 GROUP BY 4, 5"""


@register(
    "sink_state_upsert",
    f"""SELECT stream_set, stream, arg_max(stream_offset, updated_at) AS stream_offset FROM ({STATE_ROWS % '<'} UNION ALL {STATE_ROWS % '>='}) s GROUP BY 1, 2""",
)
def sink_state_upsert(spark, sf):
    before, after = [spark_sql(spark, sf, STATE_ROWS % op) for op in ("<", ">=")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in before.schema.fields)
    store = D.StateTable(spark, scratch(spark, "state"), schema)
    store.commit(before)
    store.upsert(after, D.STATE_KEY)
    return store.read().select("stream_set", "stream", "stream_offset")


@register("sink_state_read", f"SELECT stream_set, stream, stream_offset FROM ({STATE_ROWS % '<'}) s WHERE catalog_slug = 'cat' AND package_slug = 'pkg' AND major_version = 1")
def sink_state_read(spark, sf):
    state = spark_sql(spark, sf, STATE_ROWS % "<")
    return D.read_state(state, "cat", "pkg", 1).select("stream_set", "stream", "stream_offset")


@register(
    "sink_state_from_batches",
    "SELECT stream_set, stream, max(last_offset) AS stream_offset, 'event=' || arg_max(last_offset, updated_at) AS schemas, strftime(min(updated_at), '%Y-%m-%d %H:%M:%S') AS updated FROM {batches} b WHERE is_default GROUP BY 1, 2",
)
def sink_state_from_batches(spark, sf):
    state = D.state_from_batches(B.default_batch(standin(spark, sf, "batches")))
    entries = F.transform(F.map_entries("schema_offsets"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return state.select(
        "stream_set", "stream", "stream_offset", F.array_join(entries, ",").alias("schemas"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")
    )


@register("jdbc_sink_swap", "SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def jdbc_sink_swap(spark, sf):
    import uuid

    name, nation = f"sparcel_nation_{uuid.uuid4().hex[:8]}", table(spark, sf, "nation")
    for df in (nation, nation.withColumn("n_regionkey", F.col("n_regionkey") + 1)):
        loaded = DB.swap_table(df, name, location=(location := scratch(spark, name)))
    schema = spark.table(name).schema
    spark.sql(f"DROP VIEW {name}")
    spark.sql(f"DROP TABLE {loaded}")  # the files of the last load stay at their place
    return spark.read.schema(schema).parquet(location)


@register("console_sink", """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS record FROM customer""")
def console_sink(spark, sf):
    """The lines that the sink writes, for all customers."""
    path = scratch(spark, "console")
    W.console_lines(table(spark, sf, "customer").select("c_custkey", "c_name")).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "record")


# Feeds: messages made from the given tables, normalised, compared with the tables.


@register(
    "exchange_normalize_coinbase",
    """SELECT CASE event_type WHEN 'view' THEN 'ticker' ELSE 'match' END AS schema, CAST(event_id AS VARCHAR) AS sequence, CAST(value AS VARCHAR) AS price FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
)
def exchange_normalize_coinbase(spark, sf):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'ticker' WHEN 'click' THEN 'match' WHEN 'purchase' THEN 'last_match' ELSE 'subscriptions' END")
    messages = table(spark, sf, "events").select(
        F.to_json(F.struct(kind.alias("type"), F.col("event_id").alias("sequence"), F.col("value").cast("string").alias("price"))).alias("value")
    )
    return feeds.normalize_coinbase(messages).select(
        F.col("_schema_slug").alias("schema"), F.col("record")["sequence"].alias("sequence"), F.col("record")["price"].alias("price")
    )


@register(
    "exchange_normalize_binance",
    """SELECT CASE event_type WHEN 'view' THEN '24hrTicker' WHEN 'click' THEN '24hrMiniTicker' ELSE 'bookTicker' END AS schema, CAST(event_id AS VARCHAR) AS id,
      CASE WHEN event_type IN ('view', 'click') THEN CAST(value AS VARCHAR) END AS open_price, 'U' || user_id AS symbol, CASE WHEN event_type <> 'click' THEN CAST(value + 1 AS VARCHAR) END AS ask FROM events""",
)
def exchange_normalize_binance(spark, sf):
    kind = F.expr("CASE event_type WHEN 'view' THEN '24hrTicker' WHEN 'click' THEN '24hrMiniTicker' END")
    data = F.struct(
        kind.alias("e"), F.when(kind.isNotNull(), F.col("event_id")).alias("E"), F.when(kind.isNull(), F.col("event_id")).alias("u"),
        F.concat(F.lit("U"), "user_id").alias("s"), F.col("value").cast("string").alias("o"), (F.col("value") + 1).cast("string").alias("a"),
    )
    messages = table(spark, sf, "events").select(F.to_json(F.struct(F.lit("all").alias("stream"), data.alias("data"))).alias("value"))
    get = lambda name: F.try_element_at("record", F.lit(name))
    return feeds.normalize_binance(messages, book_ticker=True).select(
        F.col("_schema_slug").alias("schema"), F.coalesce(get("eventTime"), get("orderBookUpdateId")).alias("id"), get("openPrice").alias("open_price"),
        get("symbol").alias("symbol"), get("bestAskPrice").alias("ask"),
    )


@register(
    "exchange_normalize_ftx",
    """SELECT 'trades' AS schema, 'M' || (l_orderkey % 7) AS market, CAST(l_linenumber AS VARCHAR) AS id, CAST(l_extendedprice AS VARCHAR) AS price, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem
    UNION ALL SELECT 'trades', 'M' || (l_orderkey % 7), CAST(-l_linenumber AS VARCHAR), CAST(l_tax AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'ticker', 'M' || (o_orderkey % 7), NULL, CAST(o_totalprice AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders""",
)
def exchange_normalize_ftx(spark, sf):
    def market(key):
        return F.concat(F.lit("M"), (F.col(key) % 7).cast("string")).alias("market")

    def item(sign, price):
        return F.struct((F.col("l_linenumber") * sign).alias("id"), F.col(price).cast("string").alias("price"), F.col("l_orderkey").alias("key"))

    data = F.array(item(1, "l_extendedprice"), item(-1, "l_tax")).alias("data")
    trades = dealt(table(spark, sf, "lineitem")).select(
        F.to_json(F.struct(F.lit("update").alias("type"), F.lit("trades").alias("channel"), market("l_orderkey"), data)).alias("value")
    )
    one = F.struct(F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderkey").alias("key"))
    ticker = dealt(table(spark, sf, "orders")).select(
        F.to_json(F.struct(F.lit("update").alias("type"), F.lit("ticker").alias("channel"), market("o_orderkey"), one.alias("data"))).alias("value")
    )
    control = table(spark, sf, "region").select(F.to_json(F.struct(F.lit("subscribed").alias("type"), F.lit("ticker").alias("channel"))).alias("value"))
    get = lambda name: F.try_element_at("record", F.lit(name)).alias(name)
    return feeds.normalize_ftx(trades.union(ticker).union(control)).select(
        F.col("_schema_slug").alias("schema"), get("market"), get("id"), get("price"), get("key")
    )


@register(
    "exchange_normalize_gemini",
    """SELECT CASE WHEN l_linestatus = 'O' THEN 'ticker' ELSE 'trade' END AS schema, 'BTCUSD' AS symbol, CAST(l_extendedprice AS VARCHAR) AS price, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem
    UNION ALL SELECT 'block_trade', 'BTCUSD', CAST(l_tax AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem""",
)
def exchange_normalize_gemini(spark, sf):
    def event(kind, price):
        return F.struct(kind.alias("type"), F.col(price).cast("string").alias("price"), F.col("l_orderkey").alias("key"))

    changed = F.expr("CASE WHEN l_linestatus = 'O' THEN 'change' ELSE 'trade' END")
    events = F.array(event(changed, "l_extendedprice"), event(F.lit("block_trade"), "l_tax")).alias("events")
    messages = dealt(table(spark, sf, "lineitem")).select(F.to_json(F.struct(F.lit("update").alias("type"), events)).alias("value"))
    get = lambda name: F.try_element_at("record", F.lit(name)).alias(name)
    return feeds.normalize_gemini(messages, F.lit("BTCUSD")).select(F.col("_schema_slug").alias("schema"), get("symbol"), get("price"), get("key"))


@register(
    "exchange_normalize_kraken",
    """SELECT 'trade' AS schema, 'XBT' AS pair, CAST(l_extendedprice AS VARCHAR) AS price, CAST(l_quantity AS VARCHAR) AS volume FROM lineitem
    UNION ALL SELECT 'trade', 'XBT', CAST(l_tax AS VARCHAR), CAST(l_quantity AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'ticker', 'XBT', CAST(o_totalprice AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders
    UNION ALL SELECT 'spread', NULL, CAST(value AS VARCHAR), CAST(event_id AS VARCHAR) FROM events""",
)
def exchange_normalize_kraken(spark, sf):
    def trade(price):
        return F.array(F.col(price).cast("string"), F.col("l_quantity").cast("string"), F.lit("1.5"), F.lit("b"), F.lit("l"), F.lit(""))

    wrap = lambda body, channel: F.concat(F.lit("[7,"), F.to_json(body), F.lit(f',"{channel}","XBT"]')).alias("value")
    trades = dealt(table(spark, sf, "lineitem")).select(wrap(F.array(trade("l_extendedprice"), trade("l_tax")), "trade"))
    price, key = F.col("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")
    quote = F.struct(*[F.array(price, key, F.lit("1")).alias(c) for c in "abcvptlho"])
    ticker = dealt(table(spark, sf, "orders")).select(wrap(quote, "ticker"))
    spreads = dealt(table(spark, sf, "events")).select(
        wrap(F.array(F.col("value").cast("string"), F.lit("2"), F.lit("3"), F.col("event_id").cast("string"), F.lit("5")), "spread")
    )
    get = lambda name: F.try_element_at("record", F.lit(name))
    return feeds.normalize_kraken(trades.union(ticker).union(spreads)).select(
        F.col("_schema_slug").alias("schema"), get("pair").alias("pair"), F.coalesce(get("price"), get("ask_price"), get("bid")).alias("price"),
        F.coalesce(get("volume"), get("bid_whole_lot_volume"), get("bidVolume")).alias("volume"),
    )


@register(
    "social_enrich",
    """SELECT CAST(event_id AS VARCHAR) AS id, c_name AS author, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, CASE WHEN event_type = 'view' THEN 'P' || @K END AS place FROM events JOIN customer ON c_custkey = user_id""",
)
def social_enrich(spark, sf):
    df = table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("user_id"))
    k = F.get_json_object("props", "$.k")
    place = F.when(F.col("event_type") == "view", k)
    data = F.struct(
        F.col("event_id").cast("string").alias("id"), F.lit("hello").alias("text"), F.col("user_id").cast("string").alias("author_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.struct(place.alias("place_id")).alias("geo"),
    )
    users = F.array(
        F.struct(F.lit("-1").alias("id"), F.lit("nobody").alias("name")), F.struct(F.col("user_id").cast("string").alias("id"), F.col("c_name").alias("name"))
    )
    places = F.array(F.struct(k.alias("id"), F.concat(F.lit("P"), k).alias("full_name")))
    messages = df.select(F.to_json(F.struct(data.alias("data"), F.struct(users.alias("users"), places.alias("places")).alias("includes"))).alias("value"))
    return feeds.social_enrich(messages).select(
        "id", F.col("author.name").alias("author"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), F.col("place.full_name").alias("place")
    )


@register("event_json_scan", "SELECT 'event' AS _schema_slug, event_id, user_id, event_type, @K AS k FROM events")
def event_json_scan(spark, sf):
    body = F.to_json(F.struct("event_id", "user_id", "event_type", F.from_json("props", "k bigint").alias("props")))
    rows = feeds.event_json(table(spark, sf, "events").select(body.alias("value")), "event_id bigint, user_id bigint, event_type string, props struct<k:bigint>")
    return rows.select("_schema_slug", "event_id", "user_id", "event_type", F.col("props.k").alias("k"))


def _draw(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}-' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0"


_CITIES = "[" + ", ".join(f"'{w}'" for w in synthetic.WORDS["city"]) + "]"


@register(
    "synthetic_records",
    f"""SELECT c_custkey, {_CITIES}[CAST(floor({_draw(3)} * 8) AS INTEGER) + 1] AS home, CAST(floor({_draw(4)} * 100000) AS BIGINT) AS amount, {_draw(5)} < 0.5 AS active FROM customer""",
)
def synthetic_records(spark, sf):
    return synthetic.synthetic_for(table(spark, sf, "customer"), "c_custkey", {"home": "city", "amount": "integer", "active": "boolean"}, seed=3)


_SYNTHETIC = f"""SELECT c_custkey, {_CITIES}[CAST(floor({_draw(3)} * 8) AS INTEGER) + 1] AS home, CAST(floor({_draw(4)} * 100000) AS BIGINT) AS amount, {_draw(5)} < 0.5 AS active FROM customer"""


def _plugged(spark, sf, reader, **more):
    plugins.register(spark)
    count = table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0] + 1
    return reader.format("sparcel_synthetic").options(count=count, attributes="home=city,amount=integer,active=boolean", seed=3, partition=500, batch=400, **more).load()


@register("source_plugin", _SYNTHETIC)
def source_plugin(spark, sf):
    """Records of a data source found by name, for every customer."""
    customers = table(spark, sf, "customer").select("c_custkey")
    return _plugged(spark, sf, spark.read).join(customers, F.col("_offset") == F.col("c_custkey")).drop("_offset")


@register("source_plugin_stream", _SYNTHETIC)
def source_plugin_stream(spark, sf):
    """The same records as a stream of several micro-batches, with the customers as they come.

    Every micro-batch reads the customers, so their number is bounded whatever the size of the table.
    """
    customers, path = table(spark, sf, "customer").select("c_custkey"), scratch(spark, "plugged")
    stream = _plugged(spark, sf, spark.readStream, batches=16).join(customers, F.col("_offset") == F.col("c_custkey")).drop("_offset")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "checkpoint")).start()
    query.processAllAvailable()
    query.stop()
    return spark.read.schema("home string, amount bigint, active boolean, c_custkey bigint").parquet(path)


@register("source_by_address", "SELECT 'csv' AS kind, n_name AS name FROM nation UNION ALL SELECT 'parquet', c_name FROM customer UNION ALL SELECT 'jsonl', s_name FROM supplier")
def source_by_address(spark, sf):
    """Each address is read by the source that knows it."""
    folder, sources = scratch(spark, "addresses"), plugins.Sources()
    W.csv_sink(table(spark, sf, "nation"), f"{folder}/nation.csv")
    W.jsonl_sink(table(spark, sf, "supplier"), f"{folder}/supplier.jsonl")
    out = None
    names = {f"{folder}/nation.csv": F.col("n_name"), f"{sf}/customer.parquet": F.col("c_name"), f"{folder}/supplier.jsonl": F.variant_get(F.col("record"), "$.s_name", "string")}
    for uri, name in names.items():
        rows = sources.open(spark, uri)
        rows = rows.select(F.lit(sources.of(uri).kind).alias("kind"), name.alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out
