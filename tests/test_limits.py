"""Data beyond limits that sources and functions once had."""

import contextlib
import io
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparcel.functions.dates import normalize_date_time, parse_utc_timestamp
from sparcel.functions.infer import infer_string_type
from sparcel.functions.versions import next_version, version_parse, version_text
from sparcel.operators import profile as P
from sparcel.operators.numbering import numbered_by_id
from sparcel.operators import shapes as S
from sparcel.operators.shapes import relational_shape
from sparcel.plans import upgrade as U
from sparcel.registry import search as Q
from sparcel.session import release, shared_dir, written
from sparcel.sinks import batches as B
from sparcel.sinks import files as W
from sparcel.sinks import state as D
from sparcel.sinks import tables as DB
from sparcel.sources import delimited, files, nested


ROOT = Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_date_time_in_long_text(spark):
    text = F.lit("2020-02-28 11:53:10 UTC " + "and so on " * 20)
    assert one(spark, infer_string_type(text)) == "date-time"
    assert one(spark, normalize_date_time(text)) == "2020-02-28 11:53:10"
    assert one(spark, parse_utc_timestamp(F.lit("2/28/2020 11:53 PM, " + "x" * 90))).hour == 23
    assert one(spark, parse_utc_timestamp(F.lit("x" * 90))) is None


def test_version_parts_of_any_length(spark):
    version = version_parse(F.lit("1.2345678901.3"))
    assert one(spark, version_text(next_version(version, F.lit(2)))) == "1.2345678902.0"
    assert one(spark, version_parse(F.lit("1.2"))) is None
    with pytest.raises(Exception, match="CAST_OVERFLOW|CAST_INVALID_INPUT"):
        one(spark, version_parse(F.lit("1." + "9" * 30 + ".0")))


def test_numbers_of_any_length(spark):
    assert one(spark, infer_string_type(F.lit("1" + "0" * 300))) == "integer"
    assert one(spark, infer_string_type(F.lit("1" + "0" * 400))) == "string"


def test_csv_files_of_other_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n9,8,7\n")
    (tmp_path / "c.csv").write_text('x\n"5,""6"\n')
    df = delimited.scan_csv(spark, str(tmp_path))
    got = {(r.x, r.y, r.z, r._offset) for r in df.collect()}
    assert got == {("1", "2", None, 0), ("8", "9", "7", 0), ('5,"6', None, None, 0)}


@pytest.mark.parametrize("multi_line", [False, True])
def test_csv_rows_beyond_the_header(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n3,4,5\n")
    with pytest.raises(Exception, match="more than the 2 cells"):
        delimited.scan_csv(spark, str(tmp_path / "a.csv"), multi_line=multi_line).collect()
    (tmp_path / "b.csv").write_text("x,y\n1,2\n3\n")
    assert delimited.scan_csv(spark, str(tmp_path / "b.csv"), multi_line=multi_line).count() == 2


def test_csv_source_is_read_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(f"c{i}" for i in range(20)) + "\n" + "\n".join(",".join(map(str, range(20))) for _ in range(5)))
    cells = delimited.scan_csv(spark, str(tmp_path / "a.csv"))
    columns = delimited.data_columns(cells)
    plan = P.profile(cells, columns=columns, raw=columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "a.csv" not in plan and plan.count("Aggregate") <= 4


def test_console_prints_what_was_asked_for(spark):
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        W.console_sink(spark.range(50))
        W.console_sink(spark.range(100, 150), rows=3)
    assert sorted(printed.getvalue().splitlines()) == sorted(f'{{"id":{i}}}' for i in [*range(50), 100, 101, 102])


def test_swapped_tables_are_never_missing(spark, tmp_path):
    name = "swapped_rows"
    DB.swap_table(spark.range(3), name, location=str(tmp_path / "1"))
    reader = spark.table(name)
    DB.swap_table(spark.range(5), name, location=str(tmp_path / "2"))
    assert spark.table(name).count() == 5 and reader.count() == 3
    with pytest.raises(Exception, match="boom"):
        DB.swap_table(spark.range(7).select(F.when(F.col("id") > 5, F.raise_error(F.lit("boom")).cast("long")).alias("id")), name, location=str(tmp_path / "3"))
    assert spark.table(name).count() == 5
    loaded = DB.swap_table(spark.range(2), name, location=str(tmp_path / "4"))
    assert [t.name for t in spark.catalog.listTables(pattern=f"{name}*") if t.name not in (name, loaded)] == []
    spark.sql(f"DROP VIEW {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{tmp_path / 'plain'}' AS SELECT 1 AS id")
    loaded = DB.swap_table(spark.range(4), name, location=str(tmp_path / "5"))
    assert spark.table(name).count() == 4
    spark.sql(f"DROP VIEW {name}")
    spark.sql(f"DROP TABLE {loaded}")


def test_bodies_of_several_streams_and_repeated_offsets(spark):
    rows = [("a", i % 7, str(i)) for i in range(20)] + [("b", i, str(i)) for i in range(6)] + [("b", None, "x")]
    found = S.columnar_payload(spark.createDataFrame(rows, "stream string, o long, v string"), "o", batch=5, by=["stream"]).collect()
    assert max(r.n for r in found) <= 5 and sum(r.n for r in found) == 27
    got = sorted((r.stream, cell[2]) for r in found for cell in json.loads(r.body)["data"])
    assert got == sorted((s, v) for s, _, v in rows)
    assert {(r.stream, r.batch, r.part): r.n for r in found if r.stream == "b"} == {("b", 0, 0): 5, ("b", 1, 0): 1, ("b", None, 0): 1}


def test_exact_numbers_and_digits(spark):
    big = P.profile(spark.createDataFrame([(9007199254740993,), (-3,)], "v long")).filter("type = 'integer'").first()
    assert (big["integer_min"], big["integer_max"]) == (-3, 9007199254740993)
    raw = P.profile(spark.createDataFrame([("9007199254740993",), ("4",)], "v string"), raw=["v"]).first()
    assert (raw["integer_min"], raw["integer_max"]) == (4, 9007199254740993)
    assert P.profile(spark.createDataFrame([(999999999999,)], "v long")).first()["number_max_precision"] == 12
    assert P.profile(spark.createDataFrame([(1000000000000.0,)], "v double")).first()["number_max_precision"] == 13


def test_array_elements_are_widened(spark):
    rows = P.profile(spark.createDataFrame([([1.0, 2.5],)], "v array<double>")).filter("property = 'v[]'").collect()
    assert [(r["type"], r["record_count"]) for r in rows] == [("number", 2)]


def test_depth_can_be_set(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b")).alias("a"))
    assert {r["property"] for r in P.profile(df, depth=2).collect()} == {"a", "a.b"}


def test_options_of_each_type(spark):
    values = ["0"] * 3 + ["1"] * 2 + ["x" * 60] * 3
    got = P.value_options(spark.createDataFrame([(v,) for v in values], "v string"), raw=["v"]).collect()
    assert {tuple(r) for r in got} == {("v", "integer", "0", 3), ("v", "integer", "1", 2)}


def test_numbering_without_a_single_task(spark):
    df = spark.range(0, 3000).select((F.col("id") * 1_000_003_000).alias("id"))
    got = numbered_by_id(df, "id")
    assert got.filter(F.col("position") * 1_000_003_000 != F.col("id")).count() == 0 and got.count() == 3000


def test_xml_rows_of_one_path(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><a><item><n>1</n></item><item><n>2</n></item></a><b><item><n>3</n></item></b></r>")
    assert sorted(r.n for r in nested.scan_xml(spark, str(tmp_path / "x.xml"), "/r/a/item").collect()) == ["1", "2"]


def test_jdbc_columns_are_spark_types(spark):
    shaped = relational_shape(spark.createDataFrame([(1.5, "x")], "n double, `body text` string"), {"n": ["number"], "body text": ["string"]})
    assert "body text" in shaped.columns


def test_sniffing_leaves_known_files_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b").write_bytes(b"PAR1xxxx")
    got = {r.name: r.format for r in files.route_files(spark, str(tmp_path), sniff=True).collect()}
    assert got == {"a.csv": "csv", "b": "parquet"}


def test_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


BATCH = "package string, major int, source_type string, source_slug string, stream_set string, stream string, schema string, _offset long, at timestamp"


def batch_frames(spark, offsets, schema="a"):
    import datetime as dt

    when = dt.datetime(2024, 1, 1)
    incoming = spark.createDataFrame([("p", 1, "t", "s", "set", "x", schema, o, when) for o in offsets], BATCH)
    batches = incoming.limit(0).drop("_offset", "at").selectExpr("*", "1 AS batch", "0L AS last_offset", "true AS is_default", "current_timestamp() AS updated_at")
    return incoming, batches


def test_upload_checks(spark, tmp_path):
    known = spark.createDataFrame([("a",)], "schema string")
    incoming, batches = batch_frames(spark, [1, 2, 2])
    with pytest.raises(ValueError, match="occurs 2 times"):
        B.upload_batch(incoming, batches, str(tmp_path), F.col("at"), upload="u", known_schemas=known)
    incoming, batches = batch_frames(spark, [1, 2], "b")
    with pytest.raises(ValueError, match="does not describe"):
        B.upload_batch(incoming, batches, str(tmp_path), F.col("at"), upload="u", known_schemas=known)
    incoming, batches = batch_frames(spark, [1, 2])
    for _ in range(2):
        (row,) = B.upload_batch(incoming, batches, str(tmp_path), F.col("at"), upload="u", known_schemas=known).collect()
        assert (row.batch, row.last_offset) == (1, 2)
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_state_snapshots_are_published_whole(spark, tmp_path):
    schema = "k string, v long, updated_at long"
    state = D.StateTable(spark, str(tmp_path / "state"), schema)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert state.read().count() == 0
    for i in range(4):
        assert state.upsert(frame((f"k{i}", i, i)), ("k",)) == i
    assert sorted(r.v for r in state.read().collect()) == [0, 1, 2, 3]
    assert len(list((tmp_path / "state").glob("snapshot-*"))) == 2
    with pytest.raises(D.ConcurrentCommit):
        state.commit(frame(("late", 9, 9)), after=2)
    assert not list((tmp_path / "state").glob("_staged-*"))
    frame(("half", 1, 1)).write.parquet(str(tmp_path / "state" / "_staged-half"))
    assert sorted(r.v for r in state.read().collect()) == [0, 1, 2, 3]


def test_date_marks(spark):
    assert one(spark, infer_string_type(F.lit("2020年2月28日"))) == "date"
    assert one(spark, infer_string_type(F.lit("2020-02-28."))) == "string"


def test_upgrade_keeps_every_source():
    schemas = [{"title": t, "source": {"uri": f"file:///{t}", "type": "file"}} for t in ("a", "b")]
    descriptor = {"schemas": schemas}
    U._sources(descriptor)
    assert [s["slug"] for s in descriptor["sources"]] == ["file:///a", "file:///b"]


def test_scratch_folders_are_removed(spark):
    path = written(spark.range(3), "rows").inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert Path(path).exists()
    assert release(spark) > 0
    assert not Path(path).exists()


def test_queries_run_from_another_folder(tmp_path):
    """Workers get the package, wherever the driver was started."""
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "from sparcel.session import local_session, ship\n"
        "from pyspark.sql import functions as F\n"
        "spark = local_session(2, memory='2g')\n"
        "sys.path.remove(" + repr(str(ROOT)) + ")\n"
        "print('ROWS', e.queries()['upgrade_descriptors'](spark, '/root/testdata/sf0.001').count())\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 150" in out.stdout, out.stderr[-2000:]


def test_search_through_a_kept_index(spark, tmp_path):
    texts = {1: "a red fox", 2: "fox red a", 3: "Red, fox!", 4: "blue fox", 5: "red", 6: None}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    Q.write_index(Q.text_index(df, "id", "text"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for query in ("red", '"red fox"', 'fox -"red fox"', "red fox or blue", "fox -red", '"fox red" or "blue fox"'):
        scanned = {r.id for r in Q.search(df, query, ["text"]).collect()}
        assert {r.id for r in Q.search_texts(df, index, "id", "text", query).collect()} == scanned, query
    assert "PushedFilters: [In(token" in Q.search_index(index, "id", "red fox")._jdf.queryExecution().executedPlan().toString()
