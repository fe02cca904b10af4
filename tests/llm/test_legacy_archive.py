import gzip
import hashlib

import pytest
from quillspark.llm import legacy_archive as A
from quillspark.llm.common import fresh_path

BIG = "<html>" + "é" * 80 + "</html>"
ROWS = [(1, "http://a/", BIG), (2, "http://b/x y", BIG), (3, None, "small"), (4, "http://c/\n", "small"), (5, "u", None), (6, "u", ""), (7, "v", "line\r\n\r\nWARC/1.0\r\n\r\nhttp://x 1 2 3 4\n" * 9), (2, "http://b/x y", BIG), (0, "z", "x" * 100), (8, "z", "x" * 100), (9, "z", "x" * 99), (10, "z", "x" * 99), (11, "long", "ab" * 200000)]


def want(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = raw in first and first[raw] != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "d") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    assert sorted((tuple(r) for r in A.query(pages).collect()), key=str) == want(ROWS)
    assert A.query(pages.limit(0)).count() == 0


def test_arc_files_are_read_by_version_and_length(spark):
    raw = b""
    for version in (1, 2):
        raw = A.version_block(version, "f.arc") + b"\n" + b"\n".join(A.arc_record(version, p, u, (h or "").encode(), 7, "f.arc") for p, u, h in ROWS) + b"\n"
        got = list(A.parse_arc(raw))
        assert [A.split_http(block)[2] for *_, block in got] == [(h or "").encode() for _, _, h in ROWS]
        assert list(A.parse_arc(gzip.compress(raw))) == got
    assert [x[2] for x in A.parse_arc(raw[:-20])] == ["text/html"] * (len(ROWS) - 1) + [A.MALFORMED]
    with pytest.raises(ValueError):
        list(A.parse_arc(b"http://x 0.0.0.0 20080101000000 text/html 3\nabc"))
    (mixed, whole) = A.parse_arc(A.version_block(1, "f") + b"\n" + A.arc_record(2, 1, "u", b"x", 0, "f") + b"\n" + A.arc_record(1, 1, "u", b"x", 0, "f"))
    assert mixed[2] == A.MALFORMED and whole[0] == "u"


def test_bytes_that_are_not_text_survive(spark, tmp_path):
    body = bytes(range(256)) * 3
    block = A._http(body, 4)
    record = b"http://x 0.0.0.0 20010203040506 image/png " + str(len(block)).encode() + b"\n" + block
    (tmp_path / "part-old.arc").write_bytes(A.version_block(1, "f") + b"\n" + record)
    path = fresh_path(spark, "warc")
    A.convert(spark, f"file://{tmp_path}", path)
    (got,) = A.read_warc(spark, path).collect()
    assert got.payload_digest == hashlib.sha256(body).hexdigest() and got.payload_bytes == 768
    (old,) = A.read_arc(spark, f"file://{tmp_path}").collect()
    assert bytes(old.body) == body and old.page_id == 4 and old.date == "20010203040506"
    file = next(r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    (headers, _), = A.parse_warc(bytes(file))
    assert headers["warc-date"] == "2001-02-03T04:05:06Z" and headers["warc-target-uri"] == "http://x" and headers["warc-record-id"].startswith("<urn:uuid:")


def test_one_payload_on_most_pages(spark):
    rows = [(i, f"http://h/{i}", BIG if i % 4 else f"{i}" * 60) for i in range(1, 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert sorted((tuple(r) for r in A.query(pages).collect()), key=str) == want(rows)


def test_small_files(spark, monkeypatch):
    monkeypatch.setattr(A, "FILE_BYTES", 300)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in A.query(pages).collect()), key=str) == want(ROWS)


def test_odd_records(spark, tmp_path):
    """A url with spaces, a record without an HTTP head, one with a bad header, one without a length."""
    page = A._http(b"y" * 200, 5)
    records = [b"http://x/a b 0.0.0.0 20010203040506 text/html %d" % len(page), page, b"dns:x 0.0.0.0 20010203040507 text/dns 12", b"x 86400 IN A", b"http://x bad 3", b"abc", b"http://z none", b"rest"]
    (tmp_path / "part-odd.arc").write_bytes(A.version_block(1, "f") + b"\n" + b"".join(x + b"\n" for x in records))
    old = A.read_arc(spark, f"file://{tmp_path}").collect()
    assert [(r.url, r.date, r.n) for r in old] == [("http://x/a b", "20010203040506", 200), ("dns:x", "20010203040507", 12), ("http://x bad 3", "", 3), ("http://z none", "", 5)]
    path = fresh_path(spark, "warc")
    A.convert(spark, f"file://{tmp_path}", path)
    assert sorted(r.record_type for r in A.read_warc(spark, path).collect()) == ["resource"] * 3 + ["response"]
    raw = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    heads = {h["warc-target-uri"]: h for h, _ in A.parse_warc(raw)}
    assert heads["dns:x"]["content-type"] == "text/dns" and heads["dns:x"]["warc-type"] == "resource" and "warc-legacy-header" not in heads["dns:x"]
    assert heads["http://x%20bad%203"]["warc-legacy-header"] == "malformed" and "http://x/a%20b" in heads


def test_clashing_columns_and_null_ids(spark):
    pages = spark.createDataFrame([(None, "u", BIG, 1, "x"), (None, "u", BIG, 1, "x"), (4, "v", None, 2, "y")], "page_id long, url string, html string, path int, content string")
    got = sorted(((r.page_id, r.record_type) for r in A.query(pages).collect()), key=str)
    assert got == [(4, "response"), (None, "response"), (None, "response")]
