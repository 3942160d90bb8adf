"""Packet captures: trace files read over many tasks, a data source that reads and writes whole ones, and frame decoding in native columns.

A capture's records have no marks, only lengths, so a record is found from the one before it. To read a file in ranges, each range guesses its first record: the first place
from which a chain of plausible record headers goes on. It walks from there and notes where it left the range. The walks are joined to one chain: the first range starts behind the
file's header, and each next one where the one before it was left. Where a range was not walked from that place (a payload may look like records), it is walked again. That
is exact, as each round proves at least one more range of every file; usually the first round proves all.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideway.sources.record_files import CommittedWriter, batched, file_system, files_under
from tideway.storage import kept

FRAMES = "trace string, record_no long, ts double, incl_len int, orig_len int, data binary"
_BATCH = 4096

# The capture format's magic numbers, EtherTypes, extension headers and protocols.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
IPV4, IPV6, VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8)
EXTENSIONS, TRANSPORTS = (0, 43, 60), (6, 17)


class _Trace(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _opened(path: str) -> tuple[BinaryIO, struct.Struct, float]:
    """A trace behind its file header, the form of its record headers, and parts of a second."""
    system, name = file_system(path)
    stream = io.BufferedReader(system.open_input_file(name), 1 << 20)
    header = stream.read(24)
    if len(header) < 24 or header[:4] not in MAGIC:
        raise ValueError(f"{path} is not a packet capture")
    order, scale = MAGIC[header[:4]]
    return stream, struct.Struct(order + "IIII"), scale


def _records(stream: BinaryIO, record: struct.Struct, at: int, stop: int) -> Iterator[tuple[int, tuple[int, int, int, int], bytes]]:
    """``(place, header, data)`` of the records that start from ``at`` on and before ``stop``; ends where a record is cut."""
    stream.seek(at)
    while at < stop and len(head := stream.read(16)) == 16:
        fields = record.unpack(head)
        data = stream.read(fields[2])
        if len(data) < fields[2]:
            return
        yield at, fields, data
        at += 16 + fields[2]


def _frame_batches(path: str, start: int, stop: int, number: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Frames of a part of a trace, numbered from ``number``, up to number ``most``."""
    stream, record, scale = _opened(path)
    name = path.rsplit("/", 1)[-1]
    with stream:
        found = enumerate(_records(stream, record, start, stop), number)
        rows = ((name, n, h[0] + h[1] / scale, h[2], h[3], data) for n, (_, h, data) in found)
        yield from batched(rows if most is None else islice(rows, max(0, most - number)), _frames, lambda r: len(r[5]), _BATCH)


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, records: int | None = None):
        self.path, self.records = path, records

    def partitions(self) -> list[_Trace]:
        return [_Trace(path) for path, _ in files_under(self.path, ENDINGS)]

    def read(self, partition: _Trace) -> Iterator[pa.RecordBatch]:
        yield from _frame_batches(partition.path, 24, 1 << 62, 0, self.records)


def _frames(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
    names = ("trace", "record_no", "ts", "incl_len", "orig_len", "data")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class CaptureWriter(CommittedWriter):
    """A file ``<trace>-<task>-<n>.pcap`` for each trace of a task, in the order of its rows; there when the job has succeeded."""

    def __init__(self, path: str):
        super().__init__(path, None)

    def opened(self, name: str, number: str) -> tuple[str, bytes]:
        return f"{name}-{number}.pcap", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)

    def records(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        for trace, ts, whole, data in zip(*(batch.column(n).to_pylist() for n in ("trace", "ts", "orig_len", "data")), strict=True):
            micros = round(ts * 1_000_000)
            yield trace, struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(data), whole) + data


class CaptureSource(DataSource):
    """``spark.dataSource.register(CaptureSource)``, then ``spark.read.format("capture").load(path)`` gives frames.

    ``frames.write.format("capture").mode("append").save(path)`` writes them. A file whose records end early gives the records before the break. One trace file is one task;
    :func:`read_captures` reads large files in ranges. The option ``records`` gives the first so many records of each trace, and no more is decoded. (A filter on ``record_no`` is
    not pushed into the reader: in Spark 4.1 a reader keeps the filters of one query for the next one of the same table.)
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> CaptureReader:
        most = self.options.get("records")
        return CaptureReader(self.options["path"], None if most is None else int(most))

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"])


SPLIT = 64 << 20  # bytes of a range
CHAIN, LONGEST, APART = 6, 1 << 18, 86_400  # headers that make a guess, data of one record, seconds between records that follow one another
ENDINGS = (".pcap", ".cap")
TRACE_FILE = "^(.*)-([0-9]+)-([0-9]+)[.]pcap$"  # trace, task, number of the task's file


def _plausible(fields: tuple[int, int, int, int], scale: float) -> bool:
    return fields[1] < scale and 0 < fields[2] <= LONGEST and fields[3] < 1 << 31


def guessed_start(data: bytes, record: struct.Struct, scale: float, ended: bool) -> int | None:
    """The first place in ``data`` from which ``CHAIN`` plausible records follow one another, or all there are if the file ``ended``."""
    if len(data) < 16:
        return None
    four = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 4)
    words = np.ascontiguousarray(four).view("<u4" if record.format[0] == "<" else ">u4")[:, 0]
    starts = np.flatnonzero((words[4:-8] < scale) & (words[8:-4] > 0) & (words[8:-4] <= LONGEST) & (words[12:] < 1 << 31))
    for start in starts.tolist():
        at, seconds, length = start, None, 0
        while length < CHAIN and at + 16 <= len(data):
            fields = record.unpack_from(data, at)
            if not _plausible(fields, scale) or (seconds is not None and abs(fields[0] - seconds) > APART):
                break
            seconds, at, length = fields[0], at + 16 + fields[2], length + 1
        if length == CHAIN or (ended and length and at == len(data)):
            return start
    return None


_WALKS = "array<struct<entry: long, leaves: long, n: long>>"
_RANGES = f"path string, part int, start long, stop long, entry long, walks {_WALKS}"


def _walked(rows: Iterator[dict]) -> Iterator[dict]:
    """Each range with a further walk: from its ``entry``, or from a guess where that is null."""
    for row in rows:
        stream, record, scale = _opened(row["path"])
        with stream:
            size, entry, guess = stream.seek(0, io.SEEK_END), row["entry"], row["entry"] is None
            if guess:
                stream.seek(row["start"])
                data = stream.read((LONGEST + 16) * 2)
                found = guessed_start(data, record, scale, row["start"] + len(data) == size)
                entry = None if found is None else row["start"] + found
            if entry is not None:
                at, n, good = entry, 0, True
                for place, fields, _ in _records(stream, record, entry, row["stop"]):
                    good = good and (not guess or _plausible(fields, scale))
                    n, at = n + 1, place + 16 + fields[2]
                if at < row["stop"]:  # a record is cut: nothing follows
                    good, at = good and (not guess or row["stop"] == size), size
                if good:
                    row["walks"] = [*row["walks"], {"entry": entry, "leaves": at, "n": n}]
            yield row


def _chained(rows: Iterator[dict]) -> Iterator[dict]:
    """Ranges in order, each with the place where its first record is due, its number and how many there are; ``known`` is false where a walk from there is missing.

    Past a missing walk the range's guess is taken to end where the right walk will, so that all walks missing by that are found at once.
    """
    path, at, number = None, None, 0
    for row in rows:
        if row["path"] != path:
            path, at, number = row["path"], 24, 0
        walks = {w["entry"]: w for w in row["walks"]}
        guess = row["walks"][0] if row["walks"] else None
        if at is None and guess is not None:
            at = guess["entry"]
        known, n = True, 0
        if at is None or at < row["stop"]:
            known = at in walks
            taken = walks.get(at, guess)
            n = taken["n"] if taken else 0
            entry, at = at, taken["leaves"] if taken else None
        else:
            entry = at
        yield {k: row[k] for k in ("path", "part", "start", "stop", "walks")} | {"entry": entry, "n": n, "number": number, "known": known}
        number += n


def _each(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` over the rows of a partition, as they come; the rows are descriptions of ranges."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = pa.list_(pa.struct([("entry", pa.int64()), ("leaves", pa.int64()), ("n", pa.int64())]))
        kinds = {"path": pa.string(), "part": pa.int32(), "walks": walks, "known": pa.bool_()}
        names = [field.split()[0] for field in schema.replace(_WALKS, "x").split(", ")]
        fields = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from batched(function(rows), lambda found: pa.RecordBatch.from_pylist(found, fields), lambda row: 1)

    return rows.mapInArrow(applied, schema)


def capture_ranges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``(path, part, start, stop, walks, entry, n, number, known)``: the ranges of all trace files, where the first record of each is, how many start in it, and the number of the first."""
    sized = spark.createDataFrame(files_under(path, ENDINGS), "path string, size long")
    parts = sized.select("path", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / split).cast("int"))).alias("part"))
    start = F.col("part").cast("long") * split
    ranges = parts.select("path", "part", start.alias("start"), F.least(start + split, "size").alias("stop"), F.when(F.col("part") == 0, 24).cast("long").alias("entry"), F.array().cast(_WALKS).alias("walks"))
    ranges = ranges.where("start < stop")
    tasks = max(1, min(10_000, ranges.count()))
    missing, done = ranges, None
    while True:
        walked = _each(missing.repartition(tasks), _walked, _RANGES)
        ranges = walked if done is None else walked.unionByName(done.select(*missing.columns))
        ordered = ranges.repartition("path").sortWithinPartitions("path", "part")
        chained = kept(_each(ordered, _chained, f"{_RANGES}, n long, number long, known boolean"))
        missing = chained.where("not known and entry is not null").select("path", "part", "start", "stop", "entry", "walks")
        if missing.isEmpty():
            return chained
        done = chained.join(missing.select("path", "part"), ["path", "part"], "left_anti")


def numbered_through(ranges: DataFrame, form: str = TRACE_FILE) -> DataFrame:
    """The ranges with records numbered through all files of a trace, as :class:`CaptureWriter` names them for rows that were dealt by ranges: in the order of task and file.

    The driver sees nothing of it; a window goes over a row a file.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parts = [F.regexp_extract(name, form, i) for i in (1, 2, 3)]
    files = ranges.groupBy("path").agg(F.sum("n").alias("in_file"))
    before = Window.partitionBy(parts[0]).orderBy(parts[1].cast("int"), parts[2].cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("before"))
    return ranges.join(files, "path").withColumn("number", F.col("number") + F.col("before")).drop("before")


def read_captures(spark: SparkSession, path: str, split: int = SPLIT, first: int | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """The frames of all traces under ``path``, as many tasks as they have ranges of ``split`` bytes; with ``first``, of each trace only so many records, and no more is read for them.

    ``ranges`` that are known from :func:`capture_ranges` are not looked for again.
    """
    ranges = (capture_ranges(spark, path, split) if ranges is None else ranges).where("n > 0")
    if first is not None:
        ranges = ranges.where(F.col("number") < first)
    tasks = max(1, min(10_000, ranges.count()))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _frame_batches(row["path"], row["entry"], row["stop"], row["number"], first)

    return ranges.select("path", "entry", "stop", "number").repartition(tasks).mapInArrow(frames, FRAMES)


def _slice(at: Column, size: int, data: str = "data") -> Column:
    """``size`` bytes from place ``at`` (from 0)."""
    return F.col(data).substr(at + 1, F.lit(size))


def _number(at: Column, size: int) -> Column:
    """Big-endian number of ``size`` bytes from place ``at``."""
    return F.conv(F.hex(_slice(at, size)), 16, 10).cast("int")


def _repeated(start: Column, goes_on: Callable[[Column, Column], Column], step: Callable[[Column], tuple[Column, Column]], least: int) -> Column:
    """``(kind, at)`` from ``start``, moved by ``step`` as long as ``goes_on``; a step is at least ``least`` bytes long."""
    turns = F.when(goes_on(start["kind"], start["at"]), F.sequence(F.lit(1), F.floor(F.octet_length("data") / least).cast("int"))).otherwise(F.array().cast("array<int>"))

    def move(state: Column, _: Column) -> Column:
        kind, at = step(state["at"])
        return F.when(goes_on(state["kind"], state["at"]), F.struct(kind.alias("kind"), at.alias("at"))).otherwise(state)

    return F.aggregate(turns, start, move)


def decode_frames(frames: DataFrame) -> DataFrame:
    """``(trace, record_no, ts, proto, src, dst, length, accepted)``; frames that do not decode stay, not accepted.

    Ethernet with any number of tags, IPv4, IPv6 with extension headers (not fragments), TCP and UDP. A projection a layer.
    """
    size = F.octet_length("data")

    def tagged(kind: Column, at: Column) -> Column:
        return kind.isin(*VLAN) & (size >= at + 4)

    def extended(kind: Column, at: Column) -> Column:
        return kind.isin(*EXTENSIONS) & (size >= at + 8)

    ethernet = F.struct(_number(F.lit(12), 2).alias("kind"), F.lit(14).alias("at"))
    rows = frames.withColumn("link", F.when(size >= 14, _repeated(ethernet, tagged, lambda at: (_number(at + 2, 2), at + 4), 4)))
    kind, at = F.col("link.kind"), F.col("link.at")
    four, six = (kind == IPV4) & (size >= at + 20), (kind == IPV6) & (size >= at + 40)
    rows = rows.withColumns({"v": F.when(four, 4).when(six, 6), "at": at})
    v, at = F.col("v"), F.col("at")
    first = F.when(v == 4, F.struct(_number(at + 9, 1).alias("kind"), (at + _number(at, 1).bitwiseAND(F.lit(15)) * 4).alias("at"))).when(
        v == 6, F.struct(_number(at + 6, 1).alias("kind"), (at + 40).alias("at"))
    )
    ips = {"from_ip": F.when(v == 4, _slice(at + 12, 4)).when(v == 6, _slice(at + 8, 16)), "to_ip": F.when(v == 4, _slice(at + 16, 4)).when(v == 6, _slice(at + 24, 16))}
    rows = rows.withColumns({"first": first, **ips})
    last = F.when(v == 6, _repeated(F.col("first"), extended, lambda at: (_number(at, 1), at + (_number(at + 1, 1) + 1) * 8), 8)).otherwise(F.col("first"))
    rows = rows.withColumn("last", last)
    kind, at = F.col("last.kind"), F.col("last.at")
    rows = rows.withColumn("accepted", F.coalesce(kind.isin(*TRANSPORTS) & (size >= at + 4), F.lit(False)))

    def end(ip: str, place: Column) -> Column:
        return F.when(F.col("accepted"), F.struct(F.col(ip).alias("ip"), _number(place, 2).alias("port")))

    shown = [F.when(F.col("accepted"), kind).alias("proto"), end("from_ip", at).alias("src"), end("to_ip", at + 2).alias("dst"), F.col("orig_len").alias("length")]
    return rows.select("trace", "record_no", "ts", *shown, "accepted")


def first_records(frames: DataFrame, n: int) -> DataFrame:
    """The first n records of each trace."""
    return frames.where(F.col("record_no") < n)


def scan_counters(packets: DataFrame) -> DataFrame:
    """``(trace, scanned, accepted)``."""
    return packets.groupBy("trace").agg(F.count("*").alias("scanned"), F.count_if("accepted").alias("accepted"))


def counted(packets: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The packets as they are, and an observation whose ``scanned`` and ``accepted`` are known once an action has read them, without a pass of their own."""
    seen = Observation(name)
    return packets.observe(seen, F.count(F.lit(1)).alias("scanned"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted")), seen
