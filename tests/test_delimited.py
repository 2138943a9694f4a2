"""Delimited files whose cells hold quotes and line breaks, split anywhere."""

import csv
import io
import random

import pytest

from sparcel.sources import delimited
from sparcel.session import shared_dir


def small_splits(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    return old


CELLS = ["a", "", "5\" pipe", "x,y", "one\ntwo", "\n", "say \"hi\"", "\"", "\"\n\"", "é\n\n,\n\"end\"", "tail\n", "a\"\"b", ",", "\n,\n"]


def write(path, rows, quote_all):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8")


@pytest.mark.parametrize("size", [60, 700, 1 << 20])
def test_line_breaks_in_cells_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for number, header in enumerate((["id", "one", "two"], ["two", "id"], ["one\nline", "id", "two"])):
        rows = [[rng.choice(CELLS) if h != "id" else f"{number}-{i}" for h in header] for i in range(120)]
        write(tmp_path / f"{number}.csv", [header, *rows], number == 1)
        for i, row in enumerate(rows):
            cells = dict(zip(header, row))
            want.append((*(cells.get(k, "").strip() or None for k in ("id", "one", "one\nline", "two")), i))
    old = small_splits(spark, size)
    try:
        df = delimited.scan_csv(spark, str(tmp_path), multi_line=True)
        if size < 1 << 20:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        got = [tuple(r) for r in df.select("id", "one", "`one\nline`", "two", "_offset").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_preamble_blank_lines_and_windows_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'about "this\r\n\r\n\xef\xbb\xbfid,"long\r\nname"\r\n\r\n1,"a\r\n\r\nb"\r\n\r\n2, " c ,d" \r\n')
    df = delimited.scan_csv(spark, str(tmp_path), multi_line=True, header_row=1)
    assert df.columns[:2] == ["id", "long\r\nname"]
    assert [tuple(r)[:2] + (r._offset,) for r in df.orderBy("_offset").collect()] == [("1", "a\r\n\r\nb", 0), ("2", "c ,d", 1)]


def test_quotes_inside_plain_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('5" pipe,6" pipe\nx,y"\n"q, ""r""", z\n')
    for multi_line in (False, True):
        df = delimited.scan_csv(spark, str(tmp_path), header_row=None, multi_line=multi_line)
        assert [tuple(r)[:2] for r in df.orderBy("_offset").collect()] == [('5" pipe', '6" pipe'), ("x", 'y"'), ('q, "r"', "z")]
    (tmp_path / "a.csv").write_text('size,name\n5" pipe,6" pipe,more\n')
    with pytest.raises(Exception, match="more than the 2 cells"):
        delimited.scan_csv(spark, str(tmp_path)).collect()


def test_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"never\nclosed,2\n')
    with pytest.raises(ValueError, match="never closed"):
        delimited.scan_csv(spark, str(tmp_path), multi_line=True)
    assert delimited.scan_csv(spark, str(tmp_path)).count() == 2


def test_long_cells(spark, tmp_path):
    cell = 'a "quoted" word,\n' * 20000
    write(tmp_path / "a.csv", [["id", "text"], ["1", cell], ["2", "x" * 300000]], False)
    old = small_splits(spark, 50000)
    try:
        got = {r.id: r.text for r in delimited.scan_csv(spark, str(tmp_path), multi_line=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {"1": cell.strip(), "2": "x" * 300000}


def test_no_copy_of_the_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "some longer text of a row,more of it\n" * 20000)
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    size = lambda: fs.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(fs).getLength()
    before = size()
    for options in ({}, {"offsets": False}, {"header_row": 1}, {"header_row": None}):
        assert delimited.scan_csv(spark, str(tmp_path), **options).count() >= 19999
    assert size() - before < 100_000


@pytest.mark.parametrize("multi_line", [False, True])
def test_a_record_is_parsed_once(spark, tmp_path, multi_line):
    """Not once for every cell of every layout; and only cells with something to trim are trimmed."""
    (tmp_path / "a.csv").write_text('a,b\n" x 　",y \x85\n ," z"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("b,c,a\n1,2 2,  3\t\n", encoding="utf-8")
    df = delimited.scan_csv(spark, str(tmp_path), multi_line=multi_line)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    got = sorted((tuple(r) for r in df.select("a", "b", "c").collect()), key=repr)
    assert got == sorted([("x", "y\x85", None), (None, "z", None), ("3", "1", "2 2")], key=repr)
