"""Legacy web archives (ARC) converted to WARC, written and read back.

An ARC file begins with a version block ``filedesc://...`` whose second line gives the version of the header lines: version 1 has
URL, IP address, date, content type and length; version 2 puts result code, checksum, location, offset and file name before the
length. The length declares how many bytes follow, so nothing in a payload can be taken for a header. ``convert`` parses these
lines and synthesises what a WARC record needs: an identifier made from the record's own fields, the timestamp from the 14
digits, the type, and SHA-1 digests of block and payload. Records of equal payload become ``revisit`` of one ``response``.

Archives are written by Spark's text writer, whose line separator is the blank lines that end a record, compressed as a whole;
they are read as files of bounded size and cut up by ``Content-Length``, never by what a payload holds.

Defined results: NULL html is an empty payload; NULL or blank URLs are written as ``-``; white space and control characters in a
URL are percent-encoded; a NULL page id is kept and ranks below all others; rows with the largest id of their payload are all
responses, also when they repeat; an ARC record whose declared length runs past the file, or whose header line does not parse,
is an error; an empty table gives no record; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.session import scratch, ship, written

#: Payloads shorter than this are never revisits.
LEAST = 1000
#: Pages of one ARC container, and records of one WARC file.
PAGES, RECORDS = 64, 2000
DATE = "20240101000000"
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
RECORD = "url string, ip string, date string, type string, version int, page_id bigint, head binary, payload binary"
_HEX = re.compile(rb"[\x00-\x20\x7f]")


def _url(url: str | None) -> bytes:
    encoded = _HEX.sub(lambda m: b"%%%02X" % m[0][0], (url or "").strip().encode("utf-8", "surrogatepass"))
    return encoded or b"-"


def arc_file(name: str, pages: list[tuple[int | None, str | None, str | None]], version: int) -> bytes:
    """An ARC file of captured pages: the version block, then a header line and an HTTP response for each page."""
    about = f"{version} 0 sparcel\n{V1 if version == 1 else V2}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain".encode() + (b"" if version == 1 else b" 200 - - 0 " + name.encode())
    parts = [line + b" %d\n" % len(about) + about + b"\n"]
    size = len(parts[0])
    for page, url, html in pages:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"\r\n"
        body = head + (html or "").encode("utf-8", "surrogatepass")
        line = _url(url) + f" 0.0.0.0 {DATE} text/html".encode()
        if version == 2:
            line += b" 200 - - %d %s" % (size, name.encode())
        parts.append(line + b" %d\n" % len(body) + body + b"\n")
        size += len(parts[-1])
    return b"".join(parts)


def arc_containers(pages: DataFrame, version: int = 1) -> DataFrame:
    """``(path, content)``: the rows of ``pages`` as ARC files of bounded size, as the binary reader would give them."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(None if pd.isna(p) else int(p), u, h) for p, u, h in zip(frame["page_id"], frame["url"], frame["html"])]
            for at in range(0, len(rows), PAGES):
                name = f"part-{at // PAGES:05d}.arc"
                yield pd.DataFrame({"path": [name], "content": [arc_file(name, rows[at : at + PAGES], version)]})

    columns = [F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInPandas(run, "path string, content binary")


def parse_arc(content: bytes) -> Iterator[tuple]:
    """The records of an ARC file, by the header lines of its version and their declared lengths."""
    if content[:2] == b"\x1f\x8b":
        content = gunzip(content)
    at, version = 0, 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":  # the line end after a record
            at += 1
            continue
        end = content.find(b"\n", at)
        fields = content[at:end].rstrip(b"\r").split(b" ") if end >= 0 else []
        if len(fields) != (10 if version == 2 else 5) and not (at == 0 and len(fields) in (5, 10)):
            raise ValueError(f"no ARC header line at byte {at}")
        length = int(fields[-1])
        body = content[end + 1 : end + 1 + length]
        if len(body) < length or not re.fullmatch(rb"\d{12,14}", fields[2]):
            raise ValueError(f"a cut or malformed ARC record at byte {at}")
        if at == 0:
            if not fields[0].startswith(b"filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            version = int(body.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version}")
        else:
            head, gap, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
            page = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
            date = fields[2].decode().ljust(14, "0")
            kind = fields[3].decode("latin-1")
            yield fields[0].decode("utf-8", "replace"), fields[1].decode("latin-1"), date, kind, version, int(page[1]) if page else None, head + gap, payload
        at = end + 1 + length


def gunzip(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def convert(archives: DataFrame) -> DataFrame:
    """The records of ARC files ``(path, content)`` with what WARC adds: ``record_id``, ``stamp``, ``payload_digest`` (SHA-1, hex)."""
    ship(archives.sparkSession)
    names = [c.split()[0] for c in RECORD.split(", ")] + ["record_id", "stamp", "payload_digest"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for r in parse_arc(content):
                    digest = hashlib.sha1(r[7]).hexdigest()
                    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{r[0]} {r[2]} {r[5]} {digest}")
                    stamp = datetime.strptime(r[2], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                    rows.append((*r, f"<urn:uuid:{identity}>", stamp, digest))
                frame = pd.DataFrame(rows, columns=names)
                frame["page_id"] = frame["page_id"].astype("Int64")
                yield frame

    return archives.select("content").mapInPandas(run, RECORD + ", record_id string, stamp string, payload_digest string")


def with_revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` with ``record_type`` and the response a revisit refers to: ``refers_to`` (page) and ``refers_to_id``.

    Only digests that occur more than once are joined; the counts are made before any payload moves.
    """
    size = F.length("payload")
    keys = written(records.where(size >= least).select("payload_digest", size.alias("size"), "page_id", "record_id", "stamp", "url"), "payloads")
    # the largest page; among its rows any has the same identifier, as that is made from url, date, page and payload
    best = keys.groupBy("payload_digest", "size").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "record_id", "url", "stamp")).alias("best"), F.count("*").alias("n")
    )
    best = written(best.where("n > 1").select(F.col("payload_digest").alias("same"), F.col("size").alias("as_long"), "best"), "responses")
    joined = records.join(best, (F.col("payload_digest") == F.col("same")) & (size == F.col("as_long")), "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    return joined.select(
        *[F.col(c) for c in records.columns], F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        *[F.when(revisit, F.col(f"best.{c}")).alias(f"refers_to{s}") for c, s in (("page_id", ""), ("record_id", "_id"), ("url", "_url"), ("stamp", "_date"))],
    )


def warc_record() -> Column:
    """The bytes of a record up to the blank lines after it; a revisit keeps the HTTP headers and leaves the payload out."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("stamp")),
        line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("Content-Type", F.when(F.length("head") > 0, "application/http; msgtype=response").otherwise(F.col("type"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.length("payload").cast("string")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Refers-To-Target-URI", F.col("refers_to_url")), line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("X-Page-Id", F.col("page_id").cast("string")), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("Content-Length", F.length(block).cast("string")), F.lit("\r\n"),
    )
    return F.concat(header.cast("binary"), block).cast("string")


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS) -> None:
    """Write ``records`` (as ``with_revisits`` gives them) as compressed WARC files below ``path``."""
    writer = records.select(warc_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared length."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, length = end + 4, int(headers["content-length"])
        if content[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"a cut WARC record at byte {at}")
        yield headers, content[start : start + length]
        at = start + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Headers and payload figures of every record of the archives below ``path``; digests are made anew and must agree."""
    ship(spark)
    names = ("page_id", "url", "record_type", "record_id", "refers_to", "refers_to_id", "payload_bytes", "payload_digest")
    kind = "page_id bigint, url string, record_type string, record_id string, refers_to bigint, refers_to_id string, payload_bytes bigint, payload_digest string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for headers, block in parse_warc(gunzip(content)):
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if "http" in headers["content-type"] else block
                    if hashlib.sha1(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha1:") or kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the digest of {headers['warc-record-id']} does not agree")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((
                        None if page is None else int(page), headers.get("warc-target-uri"), kind, headers["warc-record-id"], None if refers is None else int(refers),
                        headers.get("warc-refers-to"), int(headers["warc-payload-length"]), digest,
                    ))
                out = pd.DataFrame(rows, columns=list(names))
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, kind)


def archive_pages(pages: DataFrame, version: int = 1, least: int = LEAST) -> DataFrame:
    """Convert pages captured as ARC to WARC in the shared folder, and read the archives back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(with_revisits(convert(arc_containers(pages, version)), least), path)
    return read_warc(spark, path)
