import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparcel.functions import dates, infer, names, versions


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


TYPES = {
    "-324234234": "integer", "234234234": "integer", "1": "integer", "0": "integer", " 0 ": "integer",
    "+5": "integer", "01": "string", "-7.32": "number", "7987.3907792": "number", "0.5": "number",
    "00.5": "string", ".5": "string", "1e5": "string", "1,000": "string", "-0": "string",
    "tRuE": "boolean", "FalSE": "boolean", " Yes": "boolean", "No": "boolean", "null": "null",
    " null": "string", "": "null", " \t": "null", "2020-01-12": "date", "99.99.2020": "string",
    "12.31.2020": "date", "13-31-2020": "string", "1-2.2020": "string", "2020年1月2日": "date",
    "2020 01 02 ": "string", "2016-08-30T03:01:19.543Z": "date-time", "2/1/2020 11:53": "date-time",
    "x\n2/1/2020 11:53": "date-time", "x 2/1/2020 11:53": "string", "plain words": "string",
    "9" * 308: "integer", "9" * 400: "string",
}


def test_infer_string_type(spark):
    assert dict(zip(TYPES, column(spark, list(TYPES), infer.infer_string_type))) == TYPES


def test_is_date(spark):
    yes = ["2020-01-12", "2020/01/12", "2020.01.12", "12.01.2020", "1.01.1990", "Tue Aug 30 2016", "  Tue Aug 30 2016"]
    no = ["2020\\01\\12", "2015-02-09 01:54:02", "2/1/2020 11:53", "2020-02-24 18:00:00 UTC", "05/05/2020 05:25:08 PM"]
    assert all(column(spark, yes, dates.is_date))
    assert not any(column(spark, no, dates.is_date))


def test_is_date_time(spark):
    yes = [
        "Tue, 30 Aug 2016 03:01:19 GMT", "Tue Aug 30 2016 11:02:45 GMT+0800", "2016-08-30T03:01:19.543Z",
        "2022-05-09T01:04+0000", "2022-05-09T01:04:33-0400", "2015-02-09 01:54:02", "2/1/2020 11:53",
        "2020/2/1 11:53", "2022-05-06T20:57:01.873850Z", "  Tue, 30 Aug 2016 03:01:19 GMT",
        "2020-02-24 18:00:00 UTC", "05/05/2020 05:25:08 PM",
    ]
    no = ["Tue Aug 30 2016", "Not a date 2016-08-30T03:01:19.543Z", "Not a date Tue Aug 30 2016", ""]
    assert all(column(spark, yes, dates.is_date_time))
    assert not any(column(spark, no, dates.is_date_time))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2/1/2020 11:53", dt.datetime(2020, 2, 1, 11, 53)),
        ("05/05/2020 05:25:08 PM", dt.datetime(2020, 5, 5, 17, 25, 8)),
        ("05/05/2020 5:25 pm", dt.datetime(2020, 5, 5, 17, 25)),
        ("2020-02-24 18:00:00 UTC", dt.datetime(2020, 2, 24, 18)),
        ("2022-05-06T03:05-0400", dt.datetime(2022, 5, 6, 7, 5)),
        ("2016-08-30T03:01:19.543Z", dt.datetime(2016, 8, 30, 3, 1, 19, 543000)),
        ("Tue, 30 Aug 2016 03:01:19 GMT", dt.datetime(2016, 8, 30, 3, 1, 19)),
        ("Tue Aug 30 2016 11:02:45 GMT+0800", dt.datetime(2016, 8, 30, 3, 2, 45)),
        ("Tue Aug 30 2016", dt.datetime(2016, 8, 30)),
        ("12.31.2020", dt.datetime(2020, 12, 31)),
        ("2020年1月2日", dt.datetime(2020, 1, 2)),
        ("2020-03-01T05:43:03", dt.datetime(2020, 3, 1, 5, 43, 3)),
        ("2020-02-30", None),
        ("words", None),
    ],
)
def test_parse_utc_timestamp(spark, text, expected):
    got = column(spark, [text], lambda c: dates.parse_utc_timestamp(c).cast("timestamp_ntz"))
    assert got == [expected]


def test_normalize(spark):
    assert column(spark, ["1.2.2020", "nope"], dates.normalize_date) == ["2020-01-02", None]
    assert column(spark, ["1:2", "1:2:3"], dates.normalize_time) == ["01:02:00", "01:02:03"]
    assert column(spark, ["2/1/2020 1:53", "x"], dates.normalize_date_time) == ["2020-02-01 01:53:00", ""]


def test_convert(spark):
    assert column(spark, ["12", "0", "-1230", "yes", "true", "no", "null", None], infer.to_boolean) == [
        True, False, False, True, True, False, None, None]
    assert column(spark, ["-234.234", "001234", "abc", "null"], infer.to_number) == [-234.234, 1234.0, None, None]
    assert column(spark, ["2.5", "-2.5", "9007199254740993", "x", "1e3"], infer.to_integer) == [
        3, -2, 9007199254740993, None, 1000]


def test_names(spark):
    assert column(spark, ["Hello, World!", "--a_b--", "x" * 60], names.slugify) == ["hello-world", "a_b", "x" * 38]
    assert column(spark, ["camelCase", "oneTwoThree"], names.title_case_words) == ["Camel Case", "One Two Three"]
    assert column(spark, ["http://x.org/a/b.csv?q=1", "http://x.org/a/dir/"], names.file_name_of) == ["b.csv", "dir"]
    rule = lambda name: lambda c: names.validate(c, name)
    assert column(spark, ["ok-name", "", "-bad", "x" * 40, None], rule("username")) == [
        None, "USERNAME_REQUIRED", "INVALID_CHARACTERS", "USERNAME_TOO_LONG", "USERNAME_REQUIRED"]
    assert column(spark, ["a.b_c", "a b"], rule("package_slug")) == [None, "PACKAGE_SLUG_INVALID"]
    assert column(spark, ["a@b.co", "a@b"], rule("email")) == [None, "INVALID_EMAIL_ADDRESS_FORMAT"]


def test_versions(spark):
    got = column(spark, ["1.10.0", "1.9.0", "bad"], lambda c: versions.version_parse(c)["minor"])
    assert got == [10, 9, None]
    nxt = lambda level: lambda c: versions.version_text(versions.next_version(versions.version_parse(c), F.lit(level)))
    assert [column(spark, ["1.2.3"], nxt(i))[0] for i in range(4)] == ["1.2.3", "1.2.4", "1.3.0", "2.0.0"]


def test_format_duration(spark):
    got = column(spark, ["59", "61", "3725"], lambda c: dates.format_duration(c.cast("int")))
    assert got == ["59 seconds", "1 minutes 1 seconds", "1 hours 2 minutes 5 seconds"]
