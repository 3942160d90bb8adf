"""Bulk-synchronous best-fit packing of token pieces into sequences.

Documents are encoded and cut where they lie. Pieces longer than half a sequence open one each; the rest wait, longest first. A
round then works on all waiting pieces and all gaps at once:

- both are range-sorted by size, gaps before pieces of the same size, and dealt to as many tasks as their number asks for. The number of
  rows of each size gives the ranges; a size with more rows than a task should have is several ranges, by hash;
- each task sweeps its range from the largest size down: a gap goes on a stack, a piece takes the gap on top, its successor
  (the smallest that is left among those that hold it), so larger pieces choose first. What is left of the gap returns to the sweep at its new size.
  In the first range a piece without a gap has none anywhere, and opens a sequence;
- what is left of every range, pieces and gaps, is matched across ranges by rank: the i-th piece of a range takes the i-th place
  left above it. The ranges' counts give these runs of ranks; a join carries them out;
- gaps shrink by what they took, and the next round begins.

Where there are several ranges, sequences open before a round for those pieces of the longest's class that its sweeps will leave without a gap: classes
are those of which the same number fits a sequence and, for short pieces, powers of two. The driver sees the number of pieces and gaps of
each size and of what each range leaves, never rows. Each round ends in a checkpoint.

Defined results: a null text counts as empty, an empty text is its end token alone; very long texts are encoded whole and cut;
repeated rows are packed each; ties (pieces of one length) go by the pieces' running number; an empty table gives an empty result;
extra input columns of documents, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.runtime import columns, cut
from tideway.llm.token_ids import BYTE_BPE, END_OF_DOCUMENT, document_ids

SEQUENCE = 1024
ROWS_PER_TASK = 50_000  # of pieces and gaps in a round
MOST_RANGES = 20_000  # beyond, tasks get more rows
HARMONIC = 8  # pieces longer than a sequence's eighth are classed by how many fit


def piece_spans(length: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``most`` tokens, but the first may be shorter."""
    first = length % most or most
    return [(0, first)] + [(at, most) for at in range(first, length, most)] if length else []


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SEQUENCE, vocabulary: str = BYTE_BPE, end: int = END_OF_DOCUMENT
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for every piece of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    tail = np.array([end], dtype="<u4")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch, "text")
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for row, value in enumerate(texts):
                ids = np.concatenate((document_ids(value or "", vocabulary), tail))
                for piece, (start, length) in enumerate(piece_spans(len(ids), most)):
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if out:
                piece, start, length, crc = zip(*out, strict=True)
                arrays = [batch.column("doc_id").take(pa.array(rows)), pa.array(piece, pa.int32())]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _sweep(most: int, longest: int):
    """Sweeps of ranges (part, size, key, waiting), sorted by range and then from the largest size down.

    Gives pieces with ``seq``, the sequence that each takes, or ``place``, its rank among those left, longest first; and gaps with their new
    size, the ``slots`` that they still offer to lower ranges, and the place of the first of these, smallest gap first.
    """

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the range that may go on
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
            for start, end in zip(edges, edges[1:]):
                if held and held[0].column("part")[0].as_py() != part[start]:
                    yield sweep(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield sweep(pa.Table.from_batches(held))

    def sweep(table: pa.Table) -> pa.RecordBatch:
        part, size, key, waiting = (table.column(n).to_pylist() for n in ("part", "size", "key", "waiting"))
        first, lowest = part[0] == 0, size[-1]
        names, room = [], []  # of gaps
        stack: list[int] = []  # gaps of at least the sweep's size, the smallest on top
        later: list[tuple[int, int]] = []  # gaps that the sweep has yet to come down to
        pieces: list[tuple[int, int, int | None, int]] = []
        alone = 0
        for now, name, waits in zip(size, key, waiting, strict=True):
            while later and -later[0][0] >= now:
                stack.append(heapq.heappop(later)[1])
            if not waits:
                names.append(name)
                room.append(now)
                stack.append(len(room) - 1)
                continue
            if stack:
                at = stack.pop()
            elif first:
                at = len(room)
                names.append(name)
                room.append(most)
            else:
                pieces.append((now, name, None, alone))
                alone += 1
                continue
            pieces.append((now, name, names[at], 0))
            room[at] -= now
            if room[at] >= now:
                stack.append(at)
            elif room[at]:
                heapq.heappush(later, (-room[at], at))
        while later and -later[0][0] >= lowest:
            stack.append(heapq.heappop(later)[1])
        places, total = {}, 0
        for at in reversed(stack):
            places[at] = total
            total += max(1, room[at] // longest)
        rows = [(now, name, True, 0, seq, place) for now, name, seq, place in pieces]
        rows += [(left, name, False, max(1, left // longest) if at in places else 0, None, places.get(at, 0)) for at, (left, name) in enumerate(zip(room, names, strict=True)) if left]
        arrays = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(_SWEPT)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part[0]] * len(rows), pa.int32()), *arrays], schema=_SWEPT)

    return sweeps


_SWEPT = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("key", pa.int64()), ("waiting", pa.bool_()), ("slots", pa.int64()), ("seq", pa.int64()), ("place", pa.int64())])


def _runs(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range of pieces, first place, range of gaps, first slot, number) from (pieces left, slots left) of each range."""
    stack: list[list[int]] = []  # (range, first slot, slots)
    runs = []
    for part in sorted(counts):
        pieces, slots = counts[part]
        done = 0
        while done < pieces and stack:
            top = stack[-1]
            n = min(pieces - done, top[2])
            runs.append((part, done, top[0], top[1], n))
            done, top[1], top[2] = done + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if slots:
            stack.append([part, 0, slots])
    return runs


def _across(swept: DataFrame, runs: list[tuple[int, int, int, int, int]], tasks: int) -> DataFrame:
    """``(key, size, seq)``: pieces left by the sweeps with the gap of the same rank."""
    rows = [(run, *r) for run, r in enumerate(runs)]  # at most twice the number of ranges
    table = F.broadcast(swept.sparkSession.createDataFrame(rows, "run int, d_part int, d_from long, g_part int, g_from long, n long"))
    pieces = swept.where("waiting and seq is null").join(table, F.expr("part = d_part and place >= d_from and place < d_from + n"))
    pieces = pieces.select("run", (F.col("place") - F.col("d_from")).alias("i"), "key", "size")
    gaps = swept.where("not waiting and slots > 0").join(table, F.expr("part = g_part and place < g_from + n and place + slots > g_from"))
    last = F.least(F.col("place") + F.col("slots"), F.col("g_from") + F.col("n")) - 1
    slots = gaps.select("run", F.col("key").alias("seq"), "g_from", F.explode(F.sequence(F.greatest("place", "g_from"), last)).alias("slot"))
    slots = slots.select("run", (F.col("slot") - F.col("g_from")).alias("i"), "seq").repartition(tasks, "run", "i")
    return pieces.repartition(tasks, "run", "i").join(slots, ["run", "i"]).select("key", "size", "seq").coalesce(tasks)


def _to_open(lengths: dict[int, int], room: dict[int, int], most: int) -> int:
    """How many sequences open before a round: for the pieces of the longest's class that its sweeps will leave, by the numbers of each size."""
    longest = max(lengths)
    fits = most // longest
    least = most // (fits + 1) if fits < HARMONIC else longest // 2
    slots = left = tokens = 0  # tokens: of the class's pieces beyond what the gaps have room for
    for size in sorted({*lengths, *room}, reverse=True):
        if size <= least:
            break
        gaps, pieces = room.get(size, 0), lengths.get(size, 0)
        slots += gaps * max(1, size // longest)
        taken = min(slots, pieces)
        slots, left, tokens = slots - taken, left + pieces - taken, tokens + size * (pieces - gaps)
    if fits < HARMONIC:
        return -(-left // fits)
    return max(tokens // most, 0 if longest <= max(room, default=0) else 1)


def _ranges(counts: dict[tuple[bool, int], int], rows_per_task: int) -> list[tuple[bool, int, int, int]]:
    """(waiting, size, first range, ranges) in the order of a sweep: ranges of about ``rows_per_task`` rows, from the largest size down."""
    found, at, filled = [], 0, 0
    for waiting, size in sorted(counts, key=lambda c: (-c[1], c[0])):
        n = counts[waiting, size]
        if filled and filled + n > rows_per_task:
            at, filled = at + 1, 0
        number = max(1, -(-n // rows_per_task))
        found.append((waiting, size, at, number))
        at, filled = at + number - 1, n if number == 1 and not filled else filled + n
    return found


def place_pieces(items: DataFrame, most: int = SEQUENCE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(item, seq)`` for every row ``(item, length)``; items are distinct numbers from 0, and ``seq`` tells sequences apart.

    A sequence is named by the item that opened it or, if it was opened before a round, by a number below 0. A round's tables are dealt
    to as many tasks as it has ranges, whatever the session's number of shuffle partitions, for late rounds are small.
    """
    spark = items.sparkSession
    alone = F.col("length") > most // 2
    placed = [items.where(alone).select("item", F.col("item").alias("seq"))]
    pieces = items.where(~alone).select(F.col("item").alias("key"), F.col("length").cast("int").alias("size"))
    gaps = items.where(alone & (F.col("length") < most)).select(F.col("item").alias("key"), (most - F.col("length")).cast("int").alias("size"))
    opened = 0
    while True:
        sizes = pieces.select("size", F.lit(True).alias("waiting")).union(gaps.select("size", F.lit(False)))
        counted = {(r["waiting"], r["size"]): r["n"] for r in sizes.groupBy("waiting", "size").agg(F.count("*").alias("n")).collect()}  # 2 * most rows at most
        lengths = {size: n for (waiting, size), n in counted.items() if waiting}
        if not lengths:
            break
        longest, shortest = max(lengths), min(lengths)
        room = {size: n for (waiting, size), n in counted.items() if not waiting and size >= shortest}
        total = sum(lengths.values()) + sum(room.values())
        if total > rows_per_task and (number := _to_open(lengths, room, most)):
            new = spark.range(number).select((-F.col("id") - 1 - opened).alias("key"), F.lit(most).alias("size"))
            gaps, opened, room[most] = gaps.union(new), opened + number, room.get(most, 0) + number
        dealt = {(True, size): n for size, n in lengths.items()} | {(False, size): n for size, n in room.items()}
        dealt = _ranges(dealt, max(rows_per_task, total // MOST_RANGES))
        ranges = dealt[-1][2] + dealt[-1][3]
        table = F.broadcast(spark.createDataFrame(dealt, "waiting boolean, size int, first int, ranges int"))  # 2 * most rows at most
        both = pieces.select("size", "key", F.lit(True).alias("waiting")).union(gaps.select("size", "key", F.lit(False)))
        part = (F.col("first") + F.pmod(F.xxhash64("key"), "ranges")).cast("int")
        both = both.join(table, ["waiting", "size"]).select(part.alias("part"), "size", "key", "waiting")
        ordered = both.repartition(ranges, "part").coalesce(ranges).sortWithinPartitions("part", F.desc("size"), "waiting", "key")
        swept = cut(ordered.mapInArrow(_sweep(most, longest), "part int, size int, key long, waiting boolean, slots long, seq long, place long"))

        left = swept.where("seq is null").groupBy("part").agg(F.count_if("waiting").alias("pieces"), F.sum("slots").alias("slots"))
        runs = _runs({r["part"]: (r["pieces"], r["slots"]) for r in left.collect()})  # a row per range
        placed.append(swept.where("seq is not null").select(F.col("key").alias("item"), "seq"))
        pieces = swept.where("waiting and seq is null").select("key", "size")
        gaps = swept.where("not waiting").select("key", "size")
        if runs:
            across = cut(_across(swept, runs, ranges))
            placed.append(across.select(F.col("key").alias("item"), "seq"))
            pieces = pieces.repartition(ranges, "key").join(across.select("key").repartition(ranges, "key"), "key", "left_anti").coalesce(ranges)
            changes = gaps.union(across.select(F.col("seq").alias("key"), -F.col("size")))
            gaps = changes.repartition(ranges, "key").groupBy("key").agg(F.sum("size").cast("int").alias("size")).coalesce(ranges)
    found = placed[0]
    for more in placed[1:]:
        found = found.union(more)
    return found


def pack_pieces(pieces: DataFrame, most: int = SEQUENCE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``length`` (1 to ``most``). Within a sequence longer pieces come first."""
    kept = cut(pieces.select(F.struct("*").alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("item")))
    places = place_pieces(kept.select("item", "length"), most, rows_per_task)
    before = Window.partitionBy("seq").orderBy(F.desc("length"), "item").rowsBetween(Window.unboundedPreceding, -1)  # at most `most` rows
    found = kept.join(places, "item").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return found.select("row.*", F.col("seq").alias("sequence_id"), "offset")


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SEQUENCE, vocabulary: str = BYTE_BPE
) -> DataFrame:
    """Every piece of every row: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack_pieces(token_pieces(docs, doc_id, text, most, vocabulary), most)
