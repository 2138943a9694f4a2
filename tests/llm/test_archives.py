import gzip
import hashlib

import pytest

from sparcel.llm import archives as A

LONG = "é<p>" * 400
PAGES = [
    (1, "http://a b/\n", LONG), (5, None, LONG), (3, "", LONG), (5, "http://x/", LONG), (7, "http://y", "short"), (8, "http://y", "short"), (9, "u", None), (10, "u", ""),
    (None, "n", LONG), (None, "n", LONG + "z"), (11, "w", "WARC/1.1\r\n\r\nfiledesc://x\r\n\r\n" * 60), (12, "w", "WARC/1.1\r\n\r\nfiledesc://x\r\n\r\n" * 60),
    (13, "big", "x" * 3_000_000), (2**62, "b", "q" * 999), (14, "b", "q" * 999), (15, "c", "q" * 1000), (16, "c", "q" * 1000),
]


def expected():
    rows = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        best = max((p for p, _, h in PAGES if (h or "").encode() == body and p is not None), default=None)
        revisit = len(body) >= 1000 and page != best
        rows.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    pages = spark.createDataFrame([(p, u, h, 1) for p, u, h in PAGES], "page_id long, url string, html string, payload int")
    got = A.archive_pages(pages, version)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == expected()
    ids = {r.record_id: r for r in got.collect()}
    for r in got.where("record_type = 'revisit'").collect():
        assert ids[r.refers_to_id].record_type == "response" and ids[r.refers_to_id].payload_digest == r.payload_digest


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(version):
    content = A.arc_file("x.arc", PAGES, version)
    for data in (content, gzip.compress(content), gzip.compress(content[:500]) + gzip.compress(content[500:])):
        records = list(A.parse_arc(data))
        assert [(r[5], r[7].decode()) for r in records] == [(p, h or "") for p, _, h in PAGES]
        assert records[0][0] == "http://a%20b/" and records[1][0] == "-" and {r[4] for r in records} == {version}


def test_bad_archives():
    content = A.arc_file("x.arc", PAGES[:1], 1)
    for bad in (content[:-10], b"http://x 0.0.0.0 20240101000000 text/html 3\nabc\n", content.replace(b"\n1 0 ", b"\n3 0 ")):
        with pytest.raises(ValueError):
            list(A.parse_arc(bad))


def test_non_http_record_and_date():
    line = b"ftp://x 1.2.3.4 199701010101 text/plain 4\n\r\n\r\n\n"
    about = b"1 0 me\n" + A.V1.encode() + b"\n"
    content = b"filedesc://x 0.0.0.0 20240101000000 text/plain %d\n" % len(about) + about + b"\n" + line
    ((url, ip, date, kind, version, page, head, payload),) = A.parse_arc(content)
    assert (url, ip, date, kind, page, head, payload) == ("ftp://x", "1.2.3.4", "19970101010100", "text/plain", None, b"", b"\r\n\r\n")


def test_empty(spark):
    assert A.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
