"""ARC files of both versions read and converted, WARC files read back, and pages through both against plain hashing."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tideway.llm import archives, queries
from tideway.sources import record_files

PAGES = "page_id long, url string, html string, body string, key string, record_id int"
HTML = b"HTTP/1.0 200 OK\r\nServer: x\r\nX-Page-Id: 7\r\n\r\n"


def arc(version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An archive whose records are (header line without the length, content)."""
    block = archives.ARC_LINES[version].encode()
    start = "filedesc://x.arc 0.0.0.0 19990101000000 text/plain" + (" 200 - - 0 x.arc" if version == 2 else "")
    return b"".join(f"{line} {len(body)}\n".encode() + body + b"\n" for line, body in [(start, block), *records])


def test_header_lines_by_version_and_declared_lengths():
    inner = b"http://fake/ 1.2.3.4 20010101000000 text/html 5\nhello"  # looks like a record, is content
    one = [("http://a/x y z 1.2.3.4 20010203040506 text/html", HTML + inner), ("dns:a 1.2.3.4 20010203040507 text/dns", b"a. 1 IN A 1.2.3.4"), ("ftp://a/f 1.2.3.4 20010203 no-type", b"")]
    found = list(archives.arc_records(io.BytesIO(arc(1, one))))
    assert [(r.url, r.date, r.content_type, r.body) for r in found[1:]] == [
        ("http://a/x y z", "20010203040506", "text/html", HTML + inner), ("dns:a", "20010203040507", "text/dns", b"a. 1 IN A 1.2.3.4"), ("ftp://a/f", "20010203", "no-type", b"")
    ]
    two = [("http://a/x y 1.2.3.4 20010203040506 text/html 404 abc - 77 x.arc", inner)]
    found = list(archives.arc_records(io.BytesIO(arc(2, two))))
    assert [(r.version, r.url, r.status, r.body) for r in found[1:]] == [(2, "http://a/x y", "404", inner)]
    # A line of version 2 cannot be read as one of version 1 is: the address would take the fields before.
    assert archives.header_fields(two[0][0].encode() + b" 5", 1) is None
    offsets = [r.offset for r in archives.arc_records(io.BytesIO(arc(1, one)))]
    assert all(arc(1, one)[o:].startswith(r[0].encode()) for o, r in zip(offsets[1:], one, strict=True))


def test_damaged_archives_tell_where():
    whole = arc(1, [("http://a/ 1.2.3.4 20010203040506 text/html", b"x" * 50), ("http://b/ 1.2.3.4 20010203040506 text/html", b"y" * 50)])
    found = list(archives.arc_records(io.BytesIO(whole[:-20])))
    assert [r.damage for r in found] == [None, None, "31 of 50 bytes"]
    found = list(archives.arc_records(io.BytesIO(whole.replace(b"http://b/ 1.2.3.4", b"http://b/"))))
    assert [r.damage for r in found] == [None, None, "no header line"]
    assert [list(archives.arc_records(io.BytesIO(x))) for x in (b"", b"\n\n")] == [[], []]


def test_equivalent_warc_records():
    def made(*args):
        (record,) = archives.warc_records(io.BytesIO(gzip.decompress(archives.warc_record(*args))))
        return record

    page = archives.ArcRecord(120, 1, "http://a/", "1.2.3.4", "20010203", "text/html", None, HTML + b"<p>")
    record = made("x.arc.gz", page)
    assert record.block == page.body and record.fields["warc-type"] == "response" and record.fields["warc-date"] == "2001-02-03T00:00:00Z"
    digest = base64.b32encode(hashlib.sha1(b"<p>").digest()).decode()
    assert record.fields["warc-payload-digest"] == f"sha1:{digest}" and record.fields["content-type"] == "application/http; msgtype=response"
    assert record.fields["warc-record-id"] == made("x.arc.gz", page).fields["warc-record-id"] != made("y.arc.gz", page).fields["warc-record-id"]
    again = made("x.arc.gz", page, ("x.arc.gz", 4, "http://b/", "2000"))
    assert again.block == HTML and again.fields["warc-type"] == "revisit" and again.fields["warc-refers-to-date"] == "2000-01-01T00:00:00Z"
    assert made("x", page._replace(url="dns:a", body=b"a.")).fields["content-type"] == "text/dns"
    assert made("x", page._replace(url="ftp://a", body=b"f", content_type="image/gif")).fields["warc-type"] == "resource"
    assert made("x.arc", page._replace(url="filedesc://x.arc", body=b"1 0 z")).fields["warc-filename"] == "x.warc.gz"
    assert archives.http_parts(b"HTTP/1.0 200\nA: b\n\nrest\r\n\r\n") == (b"HTTP/1.0 200\nA: b\n\n", b"rest\r\n\r\n")


def test_foreign_archives_are_converted(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    copies = [(f"http://a/{i} 1.2.3.4 2001020304050{9 - i} text/html", HTML.replace(b"7", str(i).encode()) + b"same") for i in range(3)]
    (tmp_path / "arc" / "old.arc").write_bytes(arc(1, [*copies, ("dns:a 1.2.3.4 20010203040506 text/dns", b"a.")]))
    (tmp_path / "arc" / "new.arc.gz").write_bytes(gzip.compress(arc(2, [("http://b 1.2.3.4 20000203040506 text/html 200 - - 0 x", HTML.replace(b"7", b"9") + b"same")])))
    (tmp_path / "arc" / "bare.arc").write_bytes(arc(1, []))
    (tmp_path / "arc" / "cut.arc").write_bytes(arc(1, copies)[:-3])
    archives.convert_archives(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert sorted(p.name for p in (tmp_path / "warc").iterdir()) == ["bare.warc.gz", "cut.warc.gz", "new.warc.gz", "old.warc.gz"]
    records = spark.read.format("warc").load(str(tmp_path / "warc"))
    assert {(r["type"], r["n"]) for r in records.groupBy("type").agg(F.count("*").alias("n")).collect()} == {("warcinfo", 4), ("response", 2), ("revisit", 5)}
    found = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in archives.page_records(spark, str(tmp_path / "warc")).where("page_id is not null").collect())
    assert found == [(0, "response", None), (0, "revisit", 0), (1, "revisit", 0), (1, "revisit", 0), (2, "revisit", 0), (9, "revisit", 0)]
    assert [(r["archive"], r["damage"]) for r in archives.damaged_archives(spark, str(tmp_path / "arc")).collect()] == [("cut.arc", f"{len(copies[2][1]) - 2} of {len(copies[2][1])} bytes")]


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by hashing alone."""
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if data in first else "response", first.get(data)))
        first.setdefault(data, page)
    return sorted(out, key=str)


def test_odd_pages_through_both_formats(spark, tmp_path):
    rng = random.Random(6)
    texts = ["<p>é</p>", None, "", "HTTP/1.1 200 OK\r\n\r\nX-Page-Id: 5\r\n", "\n\nWARC/1.1\r\n\r\n", "http://a/ 1.2.3.4 20010203040506 text/html 5\nhello", "퟿\u0000\x0b", "x" * 3_000_000]
    addresses = ["http://a/b", None, "", "http://a/x y\nz\t", "http://ü/%20 ", "a 1.2.3.4 20010203040506 text/html 7"]
    rows = [(i, rng.choice(addresses), rng.choice([*texts[:7], f"own {i}"])) for i in range(-40, 160)]
    rows += [(500, None, texts[7]), (499, None, texts[7]), (None, "http://n/", "own null"), (None, None, "own 3"), (7, "http://r/", "own repeat"), (7, "http://r/", "own repeat"), (2**62, "http://r/", "own repeat")]
    rows += [(1000 + i, "http://hot/", "hot page") for i in range(800)]
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op12_warc(spark, str(tmp_path)).collect()
    assert all(r["intact"] for r in found)
    assert sorted((tuple(r)[:5] for r in found), key=str) == plain(rows)


def test_small_payloads_may_stay_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    archives.write_arc(archives.page_messages(spark.createDataFrame(rows, "page_id long, url string, html string")), str(tmp_path / "a"))
    archives.convert_archives(spark, str(tmp_path / "a"), str(tmp_path / "w"), least=3)
    found = sorted((r["page_id"], r["record_type"]) for r in archives.page_records(spark, str(tmp_path / "w")).collect())
    assert found == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op12_warc(spark, str(tmp_path)).collect() == []


def test_files_of_failed_jobs_are_not_seen(spark, tmp_path):
    rows = archives.page_messages(spark.range(20).selectExpr("id as page_id", "'u' as url", "'x' as html"))
    failing = rows.withColumn("url", F.when(F.col("url") == "u", F.raise_error("stop")).otherwise(F.col("url")))
    with pytest.raises(Exception, match="stop"):
        archives.write_arc(failing, str(tmp_path))
    assert record_files.files_under(str(tmp_path), (".arc.gz",)) == []
