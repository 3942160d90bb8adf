"""Legacy archives to WARC: ARC files are parsed by their version's header lines and declared lengths, and equivalent WARC records are synthesised.

An ARC file begins with a version block (``filedesc://``) that tells how header lines are to be read: five fields in version 1, ten in version 2, taken from the
right, since old addresses may hold spaces. A record's content is as long as its header says; nothing is searched for inside it. The WARC
record that takes its place has an identifier made of the archive's name and the record's offset (so a task that runs again makes the same), the date in ISO form, a type (response where the
content is an HTTP message or a DNS answer, else resource; the version block becomes warcinfo), and SHA-1 digests of block and payload.

Of records with equal payloads one stays a response and the others revisit it. Who that is, is an aggregation over digests alone; the decisions of an archive
then go to the task that reads the archive a second time and writes its WARC file, so contents are never shuffled. Both kinds of file hold one gzip member a record and are
committed by renaming.

Defined results: a null payload is empty; a null address is ``urn:absent``, one with white space or control characters is escaped; payloads are equal if length and SHA-256 are; of
equal payloads the record with the smallest number in the ordering header stays (those without one last; then the earliest date, archive and offset), so of repeated rows one stays; a
payload below ``least`` bytes always stays; an archive that is damaged (a header line that does not parse, or less content than declared) gives its
records up to there, and ``damaged_archives`` names the place; very long payloads are held one at a time; an empty table gives an empty folder and result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideway.llm.runtime import columns, cut
from tideway.sources.record_files import CommittedWriter, batched, file_system, files_under

# The fields of ARC header lines by version, and the names that version blocks give to versions.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_LINES = {
    1: "1 0 tideway\nURL IP-address Archive-date Content-type Archive-length\n",
    2: "2 0 tideway\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
DATE = "20000101000000"  # of records made from pages, which have none
LEVEL = 1  # of gzip
LONGEST_LINE = 1 << 20


class ArcRecord(NamedTuple):
    """A record as its header line and content give it; ``damage`` says why reading ended here."""

    offset: int
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    status: str | None
    body: bytes
    damage: str | None = None


def header_fields(line: bytes, version: int) -> dict[str, str] | None:
    """The fields of a header line of a version, or None if it is not one."""
    names = ARC_FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    fields = dict(zip(names, parts, strict=False))
    good = len(parts) == len(names) and fields["url"] and re.fullmatch(r"\d{1,18}", fields["length"], re.A)
    return fields if good and re.fullmatch(r"\d{8,14}", fields["date"], re.A) else None


def arc_records(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block first. Offsets are those of the content without compression."""
    version, offset = 1, 0
    while line := stream.readline(LONGEST_LINE):
        if not line.strip():  # what parts records
            offset += len(line)
            continue
        start = line.startswith(b"filedesc://")
        fields = next((f for v in ((2, 1) if start else (version,)) if (f := header_fields(line, v))), None)
        if fields is None:
            yield ArcRecord(offset, version, "", "", "", "", None, b"", "no header line")
            return
        size = int(fields["length"])
        body = stream.read(size)
        if len(body) < size:
            yield ArcRecord(offset, version, fields["url"], fields["ip"], fields["date"], fields["content_type"], None, b"", f"{len(body)} of {size} bytes")
            return
        if start:
            version = 2 if body[:1] == b"2" else 1
        yield ArcRecord(offset, version, fields["url"], fields["ip"], fields["date"], fields["content_type"], fields.get("status"), body)
        offset += len(line) + size


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP message with the blank line that ends it, and the payload; no head where the content is none."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := body.find(mark)) >= 0]
    return (body[: min(ends)], body[min(ends) :]) if ends else (body, b"")


def http_header(head: bytes, name: str) -> str | None:
    """The first value of a header field."""
    found = re.search(rb"(?mi)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def sha1(data: bytes) -> str:
    """Upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """``2000-01-02T03:04:05Z`` of up to fourteen digits; what is missing is the start."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}').urn}>"


def file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def warc_bytes(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))] if value is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def warc_record(archive: str, record: ArcRecord, refers_to: tuple[str, int, str, str] | None = None) -> bytes:
    """The WARC record that takes an ARC record's place; a revisit if it ``refers_to`` (archive, offset, address, date) another one."""
    fields: list[tuple[str, str | None]] = [("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", iso_date(record.date))]
    if record.url.startswith("filedesc://"):
        info = f"software: tideway\r\nformat: WARC File Format 1.1\r\ndescription: version {record.version} ARC file {archive}\r\n".encode()
        return warc_bytes([("WARC-Type", "warcinfo"), *fields, ("WARC-Filename", warc_name(archive)), ("Content-Type", "application/warc-fields")], info)
    head, payload = http_parts(record.body)
    kind = "response" if head or record.url.startswith("dns:") else "resource"
    media = HTTP_RESPONSE if head else "text/dns" if record.url.startswith("dns:") else record.content_type
    ip = record.ip if record.ip not in ("-", "0.0.0.0") else None
    fields += [("WARC-Target-URI", record.url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}")]
    block = record.body
    if refers_to is not None:
        kind, block = "revisit", head
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers_to[:2]))]
        fields += [("WARC-Refers-To-Target-URI", refers_to[2]), ("WARC-Refers-To-Date", iso_date(refers_to[3]))]
    return warc_bytes([("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", media)], block)


def warc_name(archive: str) -> str:
    return f"{re.sub(r'[.]arc([.]gz)?$', '', archive)}.warc.gz"


class WarcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    block: bytes


def warc_records(stream: BinaryIO) -> Iterator[WarcRecord]:
    """The records of a WARC file; field names are lower case."""
    offset = 0
    while line := stream.readline(LONGEST_LINE):
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {start}")
        fields: dict[str, str] = {}
        while (line := stream.readline(LONGEST_LINE)).strip():
            offset += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), value.strip())
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError(f"the WARC record at {start} ends early")
        offset += len(line) + len(block)
        yield WarcRecord(start, fields, block)


def opened(path: str) -> BinaryIO:
    """A file's content, unpacked if it is gzip."""
    system, name = file_system(path)
    stream = system.open_input_stream(name, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else io.BufferedReader(stream, 1 << 20)


# --- data sources ----------------------------------------------------------------------------------------------

ARC_SCHEMA = "archive string, offset long, version int, url string, ip string, date string, content_type string, status string, body binary, damage string"
WARC_SCHEMA = (
    "file string, offset long, record_id string, type string, date string, url string, content_type string, refers_to string, profile string, "
    "digest string, head binary, payload binary, payload_bytes long, intact boolean"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _made(schema: str):
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return made


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """A file a task, as a record can only be found from the one before it."""

    endings: tuple[str, ...] = ()

    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads

    def partitions(self) -> list[_File]:
        return [_File(path) for path, _ in files_under(self.path, self.endings)] or [_File("")]


class ArcReader(_Reader):
    endings = (".arc", ".arc.gz")

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with opened(partition.path) as stream:
                rows = ((file_name(partition.path), *r) for r in arc_records(stream))
                yield from batched(rows, _made(ARC_SCHEMA), lambda r: len(r[8]))


class WarcReader(_Reader):
    endings = (".warc", ".warc.gz")

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        def row(r: WarcRecord) -> tuple:
            of, kind = r.fields.get, r.fields.get("warc-type")
            digest = (of("warc-payload-digest") or "").removeprefix("sha1:") or None
            head, payload = http_parts(r.block)
            if kind == "revisit":  # the payload is elsewhere; the head tells its size
                size = http_header(head, "Content-Length")
                size, payload, intact = int(size) if size and size.isdigit() else None, None, digest is not None
            else:
                size, found = len(payload), sha1(payload)
                digest, intact = found, digest is None or digest == found
            shown = payload if self.payloads else None
            return file_name(partition.path), r.offset, of("warc-record-id"), kind, of("warc-date"), of("warc-target-uri"), of("content-type"), of("warc-refers-to"), of("warc-profile"), digest, head, shown, size, intact

        if partition.path:
            with opened(partition.path) as stream:
                yield from batched(map(row, warc_records(stream)), _made(WARC_SCHEMA), lambda r: len(r[10]) + len(r[11] or b""))


class ArcWriter(CommittedWriter):
    """Rows ``(version, url, ip, date, content_type, status, body)`` to a file for each version in a task."""

    def opened(self, name: str, number: str) -> tuple[str, bytes]:
        final = f"v{name}-{number}.arc.gz"
        block = ARC_LINES[int(name)].encode()
        middle = "0.0.0.0 20000101000000 text/plain" + ("" if name == "1" else f" 200 - - 0 {final}")
        return final, gzip.compress(f"filedesc://{final} {middle} {len(block)}\n".encode() + block + b"\n", LEVEL, mtime=0)

    def records(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        for version, url, ip, date, kind, status, body in zip(*columns(batch, "version", "url", "ip", "date", "content_type", "status", "body"), strict=True):
            line = f"{url} {ip} {date} {kind} " + (f"{status} - - - - " if version == 2 else "") + f"{len(body)}\n"
            yield str(version), gzip.compress(line.encode() + body + b"\n", LEVEL, mtime=0)


class WarcWriter(CommittedWriter):
    """Rows ``(archive, record)`` to a file for each archive."""

    def __init__(self, path: str):
        super().__init__(path, None)

    def opened(self, name: str, number: str) -> tuple[str, bytes]:
        return warc_name(name), b""

    def records(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        yield from zip(*columns(batch, "archive", "record"), strict=True)


class ArcSource(DataSource):
    """``spark.read.format("arc").load(folder)`` and ``frame.write.format("arc").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "arc"

    def schema(self) -> str:
        return ARC_SCHEMA

    def reader(self, schema) -> ArcReader:
        return ArcReader(self.options["path"], True)

    def writer(self, schema, overwrite: bool) -> ArcWriter:
        return ArcWriter(self.options["path"])


class WarcSource(DataSource):
    """Like ``ArcSource``; payloads are checked against their digests and left out where the option ``payloads`` is false."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return WARC_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    for source in (ArcSource, WarcSource):
        spark.dataSource.register(source)
    return spark


# --- jobs ------------------------------------------------------------------------------------------------------

ORDER_HEADER = "X-Page-Id"


def page_messages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows for the ARC writer: each page as an HTTP response that names its id; half of them in version 1, half in version 2."""
    body, number = F.coalesce(F.col(html).cast("binary"), F.lit(b"")), F.col(page_id).cast("string")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.coalesce(F.concat(F.lit(f"\r\n{ORDER_HEADER}: "), number), F.lit("")),
        F.lit("\r\n\r\n"),
    )
    address = F.coalesce(F.nullif(F.col(url), F.lit("")), F.lit("urn:absent"))
    escaped = F.regexp_replace(F.regexp_replace(address, "%", "%25"), "[^!-~\\u00a1-\\uffff]", "%20")
    plain = F.when(address.rlike("[^!-~\\u00a1-\\uffff]"), escaped).otherwise(address)
    version = (F.pmod(F.xxhash64(page_id), F.lit(2)) + 1).cast("int")
    fixed = {"ip": "0.0.0.0", "date": DATE, "content_type": "text/html", "status": "200"}
    return pages.select(version.alias("version"), plain.alias("url"), *[F.lit(v).alias(n) for n, v in fixed.items()], F.concat(head.cast("binary"), body).alias("body"))


def write_arc(messages: DataFrame, folder: str) -> None:
    registered(messages.sparkSession)
    messages.write.format("arc").mode("append").save(folder)


def payload_digests(spark: SparkSession, folder: str, order_header: str = ORDER_HEADER) -> DataFrame:
    """``(archive, offset, number, date, url, payload_bytes, key)`` of all records that can be revisited or revisit; contents stay in the task."""
    records = registered(spark).read.format("arc").load(folder).where("damage is null and url not like 'filedesc://%'")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [http_parts(body) for body in columns(batch, "body")[0]]
            numbers = [int(n) if (n := http_header(head, order_header)) and re.fullmatch(r"-?\d{1,18}|-?[1-8]\d{18}", n, re.A) else None for head, _ in parts]
            arrays = [*(batch.column(n) for n in ("archive", "offset", "date", "url")), pa.array(numbers, pa.int64())]
            arrays += [pa.array([len(p) for _, p in parts], pa.int64()), pa.array([hashlib.sha256(p).digest() for _, p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["archive", "offset", "date", "url", "number", "payload_bytes", "key"])

    kinds = "archive string, offset long, date string, url string, number long, payload_bytes long, key binary"
    return records.select("archive", "offset", "date", "url", "body").mapInArrow(digested, kinds)


def revisit_decisions(digests: DataFrame, least: int = 0) -> DataFrame:
    """``(archive, offset, refers_to)``: the record of the same payload that stays, or null if it is this one."""
    order = F.struct(F.col("number").isNull().alias("unnumbered"), "number", "date", "archive", "offset", "url")
    stays = digests.where(F.col("payload_bytes") >= least).groupBy("key", "payload_bytes").agg(F.min(order).alias("stays"))
    # Dealt once more, so that a payload in a third of all records can be split where it meets its one row.
    stays = stays.repartition(F.xxhash64("key"))
    joined = digests.join(stays, ["key", "payload_bytes"], "left")
    itself = (F.col("stays.archive") == F.col("archive")) & (F.col("stays.offset") == F.col("offset"))
    return joined.select("archive", "offset", F.when(~itself, F.struct("stays.archive", "stays.offset", "stays.url", "stays.date")).alias("refers_to"))


def convert_archives(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = 0, order_header: str = ORDER_HEADER) -> None:
    """Write a WARC file for each ARC file of a folder."""
    paths = [path for path, _ in files_under(arc_folder, ArcReader.endings)]
    named = {file_name(path): path for path in paths}  # a name and a path for each file
    if len(named) < len(paths):
        raise ValueError(f"two archives below {arc_folder} have the same name")
    decisions = revisit_decisions(cut(payload_digests(spark, arc_folder, order_header)), least)
    # Each archive's version block makes a row too, so that archives without records are converted.
    starts = spark.createDataFrame([(name, -1, None) for name in named], decisions.schema)
    rows = starts.union(decisions).repartition(max(1, len(paths)), "archive").sortWithinPartitions("archive", "offset")

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Decisions of an archive follow one another in the order of its records."""

        def made() -> Iterator[tuple[str, bytes]]:
            now, records = None, iter(())
            for batch in batches:
                for archive, offset, refers_to in zip(*columns(batch, "archive", "offset", "refers_to"), strict=True):
                    if archive != now:
                        now, records = archive, arc_records(opened(named[archive]))
                    record = next(records)
                    if offset >= 0:
                        while record.offset != offset:  # further version blocks
                            yield archive, warc_record(archive, record)
                            record = next(records)
                    yield archive, warc_record(archive, record, tuple(refers_to.values()) if refers_to else None)

        yield from batched(made(), _made("archive string, record binary"), lambda r: len(r[1]))

    rows.mapInArrow(converted, "archive string, record binary").write.format("warc").mode("append").save(warc_folder)


def damaged_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(archive, offset, damage)``: where reading an archive ended early."""
    return registered(spark).read.format("arc").load(folder).where("damage is not null").select("archive", "offset", "damage")


def _header(name: str) -> Column:
    return F.regexp_extract(F.decode("head", "UTF-8"), rf"(?mi)^{name}:[ \t]*(-?[0-9]+)[ \t]*\r?$", 1)


def page_records(spark: SparkSession, warc_folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact)`` of every record, read from WARC files; references are followed to the records they name."""
    back = registered(spark).read.format("warc").option("payloads", False).load(warc_folder).where("type in ('response', 'resource', 'revisit')")
    number = F.nullif(_header(ORDER_HEADER), F.lit("")).cast("long")
    back = cut(back.select("record_id", "type", "url", "refers_to", "digest", "payload_bytes", "intact", number.alias("page_id")))
    shown = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type")]
    first = back.where("type <> 'revisit'").select(*shown, F.lit(None).cast("long").alias("refers_to"), "url", "intact")
    named = back.where("type <> 'revisit'").select(F.col("record_id").alias("named"), F.col("page_id").alias("named_page")).repartition(F.xxhash64("named"))
    again = back.where("type = 'revisit'").join(named, F.col("refers_to") == F.col("named"), "left")
    return first.union(again.select(*shown, F.col("named_page").alias("refers_to"), "url", "intact"))
