"""Legacy ARC archives converted to WARC, and WARC archives written and read with Spark.

parse_arc reads an ARC file of version 1 or 2: the version block says how many fields a record's
header line has, and the line declares the body's length. to_warc makes the equivalent WARC record:
an identifier, an ISO timestamp, the record's type and digests. Archives are written by Spark's text
sink, whose line separator is the blank lines that end a WARC record: a row is a whole file's records,
up to FILE_BYTES, so each file is a gzipped WARC file of bounded size in the shared folder and no task
touches a file system by itself.

Defined results: a null payload is empty, a null url becomes a urn of the page; payloads of 1000 bytes or more that
are equal are one response (largest page_id, each of them if that row is repeated) and revisits; a row
without id is carried and revisits the largest id of its payload, or is a response where no row has one; a table
without rows gives none; a payload of any length is one record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import discard, fresh_path, materialize, tune, utf8

MIN_REVISIT = 1000
#: Bytes of records that one archive file should hold; rows of the revisit table that may be broadcast.
FILE_BYTES, BROADCAST_ROWS = 16 << 20, 100_000

#: Fields of an ARC header line by the version of the archive.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes


def arc_archive(version: int, rows: list[tuple[str, str, bytes]], name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """An ARC file of rows (url, content type, body)."""
    titles = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = f"{version} 0 byteloom\n{titles[version]}\n\n".encode()
    more = "" if version == 1 else f"200 - - 0 {name} "
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(block)}\n".encode(), block, b"\n"]
    at = sum(map(len, out))
    for url, kind, body in rows:
        more = "" if version == 1 else f"200 {zlib.crc32(body):08x} - {at} {name} "
        head = f"{url} 0.0.0.0 {date} {kind} {more}{len(body)}\n".encode()
        out += [head, body, b"\n"]
        at += len(head) + len(body) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its version block.

    The length that a header line declares rules: nothing inside a body can look like a record. Raises
    ValueError for a file that is no ARC archive, or that ends within a record.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the archive ends within a header line")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(values) not in (5, 10) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line: {values[:3]}")
        size = int(values[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError("the archive ends within a record")
        at = end + 1 + size
        if not version:
            if not values[0].startswith("filedesc:"):
                raise ValueError("no version block")
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        names = ARC_FIELDS[version]
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields in a version {version} archive")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), body)


def iso_date(stamp: str) -> str:
    """14 digits, or fewer in old archives, to the form that WARC wants."""
    s = (stamp + "00000101000000"[len(stamp) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'urn:page:' + page)}>"


def to_warc(arc: ArcRecord, refers_to: str | None) -> bytes:
    """The WARC record without the blank lines that end it. refers_to: the page that this one repeats."""
    head, _, payload = arc.body.partition(b"\r\n\r\n")
    page = next((x.split(b":", 1)[1].strip().decode() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), "")
    block = arc.body if refers_to is None else head + b"\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {iso_date(arc.fields['date'])}", f"WARC-Target-URI: {arc.fields['url']}", f"WARC-IP-Address: {arc.fields['ip']}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def http_response(page: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def clean_url(url: str | None, page: int | None) -> str:
    if not url:
        return f"urn:page:{page}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def warcinfo() -> bytes:
    block = b"software: byteloom\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


@dataclass
class WarcRecord:
    type: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file; raises ValueError where one is broken."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        at = end + 4 + size
        if at > len(data):
            raise ValueError("the archive ends within a record")
        yield WarcRecord(headers["warc-type"], headers, data[end + 4 : at])


def inflate(data: bytes) -> bytes:
    """All gzip members of data."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        out.append(d.flush())
        data = d.unused_data
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages through ARC to WARC files at path. Pages with equal payloads meet by digest alone."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), utf8(html_col).alias("payload")).withColumn("digest", F.sha1("payload"))
    index = materialize(rows.select("page", "digest", F.octet_length("payload").cast("long").alias("n")), "index")
    big = index.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("copies"))
    first = materialize(big.where("copies > 1 and first is not null").select("digest", "first"), "first")
    discard(index)
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.join(first, "digest", "left").select("page", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a file: records up to FILE_BYTES (a longer one alone), behind a record about the file itself."""
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join([warcinfo(), *held])], pa.binary())], ["records"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, other = (c[k].as_py() for c in batch.columns)
                version = 1 + (page or 0) % 2
                arc = next(iter(parse_arc(arc_archive(version, [(clean_url(url, page), "text/html", http_response(page, payload))]))))
                record = to_warc(arc, None if other is None else str(other))
                if held and size + len(record) > FILE_BYTES:
                    yield out()
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield out()

    records = rows.mapInArrow(convert, "records binary").select(F.col("records").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """The records at path, one row each, with the full payload's length and digest."""
    tune(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for r in parse_warc(inflate(batch.column(0)[k].as_py())):
                    if r.type not in ("response", "revisit"):
                        continue
                    head, _, payload = r.block.partition(b"\r\n\r\n")
                    http = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                    declared = base64.b32decode(r.headers["warc-payload-digest"].partition(":")[2]).hex()
                    if r.type == "response" and (hashlib.sha1(payload).hexdigest() != declared or len(payload) != int(http["content-length"])):
                        raise ValueError(f"the payload of {r.headers['warc-record-id']} is damaged")
                    to = r.headers.get("x-refers-to-page")
                    out.append((int(http["x-page-id"]) if http["x-page-id"] else None, int(http["content-length"]), declared, r.type, int(to) if to else None, r.headers["warc-target-uri"], r.headers["warc-date"], r.headers["warc-record-id"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], NAMES)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string, record_id string")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date", "record_id"]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
