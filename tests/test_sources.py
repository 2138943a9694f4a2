import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparcel.operators import profile as P
from sparcel.sources import containers, delimited, files, nested, tables


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_csv_header_offsets_quotes(spark, tmp_path):
    for n in (1, 2):
        lines = ["id,name,when", *[f'{i}, "a, {i}" ,2/1/2020 11:53' for i in range(50)], ""]
        (tmp_path / f"part-{n}.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    df = delimited.scan_csv(spark, str(tmp_path))
    assert df.columns == ["id", "name", "when", "_file", "_offset"]
    assert df.count() == 100
    got = rows(df.filter("_offset = 49"), "id", "name")
    assert got == [("49", "a, 49")] * 2
    offsets = df.groupBy("_file").agg(F.min("_offset"), F.max("_offset"), F.count_distinct("_offset")).collect()
    assert [tuple(r)[1:] for r in offsets] == [(0, 49, 50)] * 2


def test_csv_preamble_and_no_header(spark, tmp_path):
    text = ["about,this", "", "file", "Year,Sea level"] + [f"{1900 + i},{i}.5" for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join(text))
    df = delimited.scan_csv(spark, str(tmp_path / "a.csv"), header_row=3)
    assert df.columns[:2] == ["Year", "Sea level"] and df.count() == 20
    assert rows(df.filter("_offset = 0"), "Year", "`Sea level`") == [("1900", "0.5")]
    (tmp_path / "b.tsv").write_text("1\tx\n2\t\n")
    bare = delimited.scan_csv(spark, str(tmp_path / "b.tsv"), header_row=None)
    assert sorted(rows(bare, "Column0", "Column1", "_offset")) == [("1", "x", 0), ("2", None, 1)]


def test_csv_split_file_offsets(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = delimited.scan_csv(spark, str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 5
        assert df.filter(F.col("n").cast("bigint") != F.col("_offset")).count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_and_byte_skip_and_requote(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\nc\n")
    got = rows(delimited.text_lines(spark, str(tmp_path / "t.txt"), skip=1), "value", "_line")
    assert sorted(got) == [("b", 1), ("c", 2)]
    content = delimited.skip_bytes(spark, str(tmp_path / "t.txt"), 2).first()["content"]
    assert bytes(content) == b"b\nc\n"
    (tmp_path / "q.csv").write_text("x,1\n")
    delimited.requote_csv(spark, str(tmp_path / "q.csv"), str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out")), "value") == [('"x","1"',)]


def test_all_types_profile(spark):
    values = ["1"] * 10 + ["1.5"] * 15 + ["true"] * 20 + ["2020-01-02"] * 25 + ["2/1/2020 11:53"] * 10 + ["text"] * 20 + ["", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    got = {r["type"]: r for r in P.profile(df, raw=["v"], widen=False).collect()}
    counts = {k: r["record_count"] for k, r in got.items()}
    assert counts == {"integer": 10, "number": 15, "boolean": 20, "date": 25, "date-time": 10, "string": 20, "null": 2}
    assert got["number"]["number_max_scale"] == 1 and got["boolean"]["true_count"] == 20
    wide = {r["type"]: r["record_count"] for r in P.profile(df, raw=["v"]).collect()}
    assert wide["number"] == 25 and "integer" not in wide


def test_number_digits(spark):
    numbers = [0.5, 123456.789, 1e-7, 1.25e10, 0.1 + 0.2, -42.125]
    for value, (precision, scale) in zip(numbers, [(2, 1), (9, 3), (8, 7), (11, 0), (18, 17), (5, 3)]):
        row = P.profile(spark.createDataFrame([(value,)], "v double")).first()
        assert (row["number_max_precision"], row["number_max_scale"]) == (precision, scale), value


def workbook(path):
    def sheet(rows_):
        body = ""
        for r, cells in enumerate(rows_, 1):
            body += f'<row r="{r}">' + "".join(
                f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f'<c r="{chr(65 + i)}{r}"><v>{c}</v></c>'
                for i, c in enumerate(cells) if c is not None
            ) + "</row>"
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([[" Name ", None, "Size"], ["  x ", "blank", 3], ["y", None, 4]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet([["K"], [1], [2], [3]]))


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    cells = containers.scan_xlsx(spark, str(tmp_path / "*.xlsx"))
    assert dict(rows(cells.groupBy("sheet").count(), "sheet", "count")) == {"A": 2, "B": 3}
    table = containers.sheet_table(cells, "A", ["Name", "Column 0", "Size"])
    assert sorted(rows(table, "Name", "`Column 0`", "Size")) == [("x", "blank", "3"), ("y", None, "4")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.csv", "h\n1\n2\n")
        z.writestr("d/two.txt", "no\n")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("three.csv")
        info.size = 4
        t.addfile(info, io.BytesIO(b"h\n3\n"))
    lines = containers.scan_archive(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.tar")], r"\.csv$")
    assert sorted(rows(lines, "member", "line_no", "line")) == [
        ("d/one.csv", 0, "h"), ("d/one.csv", 1, "1"), ("d/one.csv", 2, "2"), ("three.csv", 0, "h"), ("three.csv", 1, "3")]
    assert containers.compressed_inner_name("x.csv.gz") == "x.csv"


def test_stream_set_names(spark):
    listing = spark.createDataFrame([("d", f"non-profits-{i}.csv") for i in range(1, 5)] + [("e", "a.csv")], "directory string, name string")
    assert dict(rows(files.stream_set_names(listing), "directory", "stream_set")) == {"d": "non-profits", "e": "a"}


def test_route_by_content(spark, tmp_path):
    (tmp_path / "noname").write_bytes(b"\x1f\x8b\x08\x00")
    (tmp_path / "x.csv").write_text("a\n")
    got = dict(rows(files.route_files(spark, str(tmp_path), sniff=True), "name", "format"))
    assert got == {"noname": "gzip", "x.csv": "csv"}


def test_json_documents_and_xml_arrays(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"data": {"days": [{"v": 1}, {"v": 2}]}}')
    found = nested.scan_json(spark, str(tmp_path / "d.json"), "$.data.days[*]")
    assert sorted(r[0] for r in found.select(F.variant_get("record", "$.v", "int")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        nested.json_records(found, "x", "$..v")
    (tmp_path / "x.xml").write_text('<l><r id="1"><t>a</t><t>b</t></r><r id="2"><t>c</t></r></l>')
    df = nested.scan_xml(spark, str(tmp_path / "x.xml"), "/l/r")
    assert sorted(rows(df, "id", "`t.0`", "`t.1`")) == [("1", "a", "b"), ("2", "c", None)]


def test_jdbc_options():
    options = tables.jdbc_options("postgres", "h", 5432, "d", "public", "t", partition_column="id", lower=0, upper=100)
    assert options["dbtable"] == '"public"."t"' and options["numPartitions"] == "64"
    assert tables.source_tables(["a", "_sink_state"]) == ["a"]
    assert tables.unload_statement("select 'x'", "s3://b", "r").startswith("UNLOAD ('select ''x''')")


def test_csv_many_first_lines(spark, tmp_path):
    for kind in ("bare", "headed"):
        (tmp_path / kind).mkdir()
    for i in range(1005):
        (tmp_path / "bare" / f"{i}.csv").write_text(f"{i}\n{i},x,y\n")
        (tmp_path / "headed" / f"{i}.csv").write_text(("a," + " " * i + f"b\n{i},y\n") if i % 2 else ("b," + " " * i + f"a\ny,{i}\n"))
    bare = delimited.scan_csv(spark, str(tmp_path / "bare"), header_row=None)
    assert delimited.data_columns(bare) == ["Column0", "Column1", "Column2"]
    assert sorted(rows(bare, "Column0", "Column1", "Column2", "_offset"), key=repr) == sorted([(str(i), *c) for i in range(1005) for c in ((None, None, 0), ("x", "y", 1))], key=repr)
    headed = delimited.scan_csv(spark, str(tmp_path / "headed"))
    assert sorted(rows(headed, "a", "b")) == sorted((str(i), "y") for i in range(1005))
