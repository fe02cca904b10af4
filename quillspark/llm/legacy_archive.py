"""Legacy archives: ARC files (version 1 and 2) read by their declared lengths and written anew as WARC.

An ARC file starts with a version block (``filedesc://``) that names the version; each record then has
one header line with 5 (version 1) or 10 (version 2) fields, the last its length. The converter makes the
WARC header that the record would have had: an identifier from its content, the timestamp, type and digests.
Of records with equal payloads of at least REVISIT_BYTES, the one with the smallest page id stays a
response; the others become revisits that refer to it.

Files hold about FILE_BYTES of records, whole ones, so reading a file is bounded by that and its largest record. Files are
gzip-compressed and written by Spark's own text sink to a folder given by the caller.

Defined results: a null html is an empty payload, which is never revisited. Rows that share a page_id and
payload are the same record twice, both responses. Rows with a null page_id keep it null; they are archived under
no page, all as responses if only they have that payload, and are never referred to before others are. A record without an HTTP head is a resource of the
type that its header names. A malformed record becomes a resource marked ``WARC-Legacy-Header: malformed``
(:func:`read_arc` gives it no date), so one bad header neither ends the job nor vanishes; only a file without a version block raises.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, salted_join, staged, tune

FILE_BYTES = 2 << 20
REVISIT_BYTES = 100
# The two ARC versions' field lists, as the formats define them.
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
MALFORMED = "malformed"
_EPOCH = datetime.datetime(2008, 1, 1)
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _http(body: bytes, page: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
    return (head + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n").encode() + body


def _url(url: str | None) -> str:
    """The url as one field of a header line."""
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~-._") or "about:blank"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 quillspark\n{_FIELDS[version]}\n".encode()
    more = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 20080101000000 text/plain {more}{len(body)}\n".encode() + body


def arc_record(version: int, page: int | None, url: str | None, body: bytes, offset: int, name: str) -> bytes:
    block = _http(body, page)
    when = (_EPOCH + datetime.timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y%m%d%H%M%S")
    more = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{_url(url)} 0.0.0.0 {when} text/html {more}{len(block)}\n".encode() + block


def _header(line: list[str], version: int) -> tuple[str, str, str] | None:
    """(url, date, mime) of a record's header line; a url may hold spaces. None: not a header of this version."""
    more = len(_FIELDS[version].split(" ")) - 1  # fields after the url
    if len(line) <= more or not re.fullmatch(r"\d{14}", line[-more:][1]):
        return None
    rest = line[-more:]
    return " ".join(line[:-more]), rest[1], rest[2]


def parse_arc(raw: bytes):
    """(url, date, mime, block) of each record after the version block; lengths are as declared.

    A record whose header line has other fields than its version's is given with the line as its url, no date and the type ``malformed``; its length
    still tells where the next one starts. What lies behind a line without a length, or is cut off, is one last such record.
    """
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at, version = 0, None
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace").rstrip("\r").split(" ")
        size = int(line[-1]) if end >= 0 and re.fullmatch(r"[0-9]{1,15}", line[-1]) else -1
        block = raw[end + 1 : end + 1 + size] if size >= 0 else b""
        if version is not None and (size < 0 or len(block) < size):
            yield " ".join(line), "", MALFORMED, raw[end + 1 :] if end >= 0 else b""
            return
        if version is None:
            if size < 0 or len(block) < size:
                raise ValueError("no whole version block")
            if not line[0].startswith("filedesc:"):
                raise ValueError("no version block")
            version = int(block.split(b" ", 1)[0])
            if version not in _FIELDS:
                raise ValueError(f"version {version}")
        else:
            head = _header(line, version)
            yield (*head, block) if head else (" ".join(line), "", MALFORMED, block)
        at = end + 1 + size


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers in lower case, raw head, body) of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, b"", block
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, head + gap, body


def record_id(page: int | None, url: str, date: str, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page}\0{url}\0{date}\0{digest}").urn


def warc_record(url: str, date: str, page: int | None, digest: str, head: bytes, body: bytes, refers_to: str | None, mime: str = "text/html") -> bytes:
    """A WARC record without its end mark: a response or, without an HTTP head, a resource of its own type."""
    block = head if refers_to else head + body
    date = date or _EPOCH.strftime("%Y%m%d%H%M%S")
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    kind = "response" if head else "resource"
    content = "application/http;msgtype=response" if head else mime if re.fullmatch(r"[\w.+-]+/[\w.+-]+", mime) else "application/octet-stream"
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers_to else kind}",
        f"WARC-Record-ID: <{record_id(page, url, date, digest)}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {_url(url)}",
        *(["WARC-Legacy-Header: malformed"] if mime == MALFORMED else []),
        "WARC-IP-Address: 0.0.0.0",
        f"Content-Type: {content}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}", "WARC-Truncated: length"] if refers_to else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(raw: bytes):
    """(headers in lower case, block) of each record."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if end < 0 or not re.fullmatch(r"WARC/\d\.\d", lines[0]):
            raise ValueError(f"no WARC header at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"a record declares {size} bytes at byte {at}; {len(block)} are left")
        if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"the block digest differs at byte {at}")
        yield headers, block
        at = end + 4 + size


def _files(parts, start: bytes, gap: bytes):
    """Records gathered to file contents of about FILE_BYTES."""
    held, size = [start] if start else [], 0
    for x in parts:
        held.append(x)
        size += len(x)
        if size >= FILE_BYTES:
            yield gap.join(held)
            held, size = [start] if start else [], 0
    if size:
        yield gap.join(held)


def _write(files: DataFrame, path: str, gap: str) -> None:
    """One file for each row."""
    files.select(F.col("_file").cast("string").alias("value")).write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", gap).option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC files of ``pages`` (page_id, url, html): version 2 for odd pages, version 1 for the rest."""
    tune(pages.sparkSession)

    def run(batches):
        def rows(version):
            for b in held:
                for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if (2 if page is not None and page % 2 else 1) == version:
                        yield arc_record(version, page, url, (html or "").encode(), 0, "pages.arc")

        for b in batches:
            held = [b]
            for version in (1, 2):
                for x in _files(rows(version), version_block(version, "pages.arc"), b"\n"):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["_file"])

    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(src.mapInArrow(run, "_file binary"), path, "\n")


_RECORD = "page_id bigint, url string, date string, head binary, body binary, n bigint, digest string"


def _binary(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_arc(spark, path: str) -> DataFrame:
    """The records of ARC files: page_id (from their own header, else null), url, date, head, body, n, digest."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows = []
                for url, date, _, block in parse_arc(raw.as_py()):
                    headers, head, body = split_http(block)
                    page = headers.get("x-page-id")
                    rows.append((int(page) if page else None, url, date, head, body, len(body), hashlib.sha256(body).hexdigest()))
                cols = list(zip(*rows)) if rows else [()] * 7
                kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "date", "head", "body", "n", "digest"])

    tune(spark)
    return _binary(spark, path).mapInArrow(run, _RECORD)


def convert(spark, arc: str, warc: str) -> None:
    """Write the ARC files of one folder as WARC files to another.

    What refers to what is settled on digests alone and goes back to each ARC file, which is then read once more:
    payloads move only as their file's compressed bytes.
    """

    def digests(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for url, date, _, block in parse_arc(raw.as_py()):
                    headers, head, body = split_http(block)
                    page = headers.get("x-page-id")
                    if head and len(body) >= REVISIT_BYTES:
                        rows.append((path, int(page) if page else None, url, date, hashlib.sha256(body).hexdigest()))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["path", "page_id", "url", "date", "digest"])

    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc).select("path", "content")
    keys = staged(files.mapInArrow(digests, "path string, page_id bigint, url string, date string, digest string"), "digests")
    first = keys.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url", "date")).alias("f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # payloads that stand once meet nothing; one that stands very often is dealt over many tasks
    again = salted_join(keys, first, ["digest"], "_n").where(F.col("f").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("f.page_id")))
    per_file = again.groupBy("path").agg(F.collect_set(F.struct("page_id", "digest", F.col("f.page_id").alias("f_page"), F.col("f.url").alias("f_url"), F.col("f.date").alias("f_date"))).alias("_again"))

    def run(batches):
        for b in batches:
            for raw, again in zip(b.column(0), b.column(1).to_pylist()):
                refers = {(x["page_id"], x["digest"]): record_id(x["f_page"], x["f_url"], x["f_date"], x["digest"]) for x in again or ()}

                def rows(raw=raw, refers=refers):
                    for url, date, mime, block in parse_arc(raw.as_py()):
                        headers, head, body = split_http(block)
                        page = int(headers["x-page-id"]) if "x-page-id" in headers else None
                        digest = hashlib.sha256(body).hexdigest()
                        yield warc_record(url, date, page, digest, head, body, refers.get((page, digest)) if head else None, mime)

                for x in _files(rows(), b"", b"\r\n\r\n"):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["_file"])

    _write(files.join(per_file, "path", "left").select("content", "_again").mapInArrow(run, "_file binary"), warc, "\r\n\r\n")


def read_warc(spark, path: str) -> DataFrame:
    """The records of WARC files: record_id, page_id, payload_bytes, payload_digest, record_type, refers_id."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows = []
                for headers, block in parse_warc(raw.as_py()):
                    http, _, body = split_http(block)
                    page = http.get("x-page-id")
                    digest = headers["warc-payload-digest"].partition(":")[2]
                    kind = headers["warc-type"]
                    if kind != "revisit" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload digest of {headers['warc-record-id']} differs")
                    size = len(body) if kind != "revisit" else int(http["content-length"])
                    rows.append((headers["warc-record-id"], int(page) if page else None, size, digest, kind, headers.get("warc-refers-to")))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_id"])

    tune(spark)
    return _binary(spark, path).mapInArrow(run, "record_id string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_id string")


def query(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    got = staged(read_warc(spark, warc), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    again = got.where("refers_id is not null")
    times = again.groupBy("refers_id").agg(F.count(F.lit(1)).alias("_n"))
    named = got.where("refers_id is null").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    kinds = staged(times.join(named.dropDuplicates(["refers_id"]), "refers_id", "left"), "referred")
    out = salted_join(again, kinds, ["refers_id"], "_n").select(*columns, "refers_to")
    return out.unionByName(got.where("refers_id is null").select(*columns, F.lit(None).cast("bigint").alias("refers_to")))  # these refer to nothing and join nothing
