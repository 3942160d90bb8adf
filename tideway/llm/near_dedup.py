"""SimHash near-duplicates: an inverted index over byte positions, count filtering, then verification.

A fingerprint has eight bytes. Two fingerprints at four or fewer differing bits differ in at most four bytes, so they share
at least four positional bytes: that is the guaranteed minimum. The index has one posting list for each choice of four
positions and their bytes, since whoever reaches the minimum meets in such a list; lists of single bytes would hold one 256th of the corpus
each. Where two fingerprints meet, the positional bytes that they share are tallied, pairs that reach the minimum are retained,
and those are verified on all 64 bits.

Lists hold distinct fingerprints. Within a list only the links that connect are kept (at most one fewer than
its members), found by a search that leaves out whoever is already connected, so a large group of near copies
costs about one comparison a member. A list of more than ``list_limit`` fingerprints is never held: its rows pass on as they
come and are dealt anew by four of the eight half-bytes not yet fixed, after which a list has at most 65,536 possible members.

Defined results: a null text or one without words has fingerprint zero, and zero links like any other; a text of
one to three words is one shingle; very long texts are hashed whole, in stretches; a bit that half the shingles set (a tie) is 0;
repeated rows share a fingerprint and a component; rows whose id is null get the component of their fingerprint; an empty
table gives an empty result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.components import components
from tideway.llm.runtime import columns, cut, utf8

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
LEAST_SHARED = 8 - MAX_BITS  # positional bytes
LIST_LIMIT = 16_384
_STRETCH = 100_000  # shingles hashed at a time

POSITIONS = list(itertools.combinations(range(8), 4))


def _mask(places: tuple[int, ...], width: int = 8) -> int:
    return sum(((1 << width) - 1) << (width * p) for p in places)


MASKS = np.array([_mask(p) for p in POSITIONS], dtype=np.uint64)


def _gaps(places: tuple[int, ...]) -> list[np.uint64]:
    return [np.uint64(_mask((p,))) for p in range(places[-1]) if p not in places]


#: Bytes that come before a choice's last position without being in it. A pair belongs to the first choice it meets in,
#: which is the one where all these bytes differ.
GAPS = [_gaps(p) for p in POSITIONS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(data: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text: a bit is set if it is set in over half the shingles' hashes."""
    found = data.lower().split() if data else []  # of bytes: only A-Z change, and only 09-0D and 20 divide
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(n - words + 1, 1)]
    ends = ends[words - 1 :] if n >= words else ends[-1:]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _STRETCH):
        spans = zip(starts[at : at + _STRETCH].tolist(), ends[at : at + _STRETCH].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, version, fp)`` for every row; ``version`` is a hash of the text, ``fp`` holds the fingerprint's bits as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (texts,) = columns(batch, "text")
            prints = np.array([simhash(data) for data in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(prints)], ["doc_id", "version", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), utf8(text).alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {kind}, version long, fp long")


def _search(members: np.ndarray, linked) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth-first search; yields (place, places newly reached from it), the start of each part with an empty array."""
    waiting = np.arange(len(members))
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        yield int(queue[0]), waiting[:0]
        while queue and len(waiting):
            at = queue.pop()
            near = linked(members[at], members[waiting])
            if near.any():
                reached = waiting[near]
                queue.extend(reached.tolist())
                waiting = waiting[~near]
                yield int(at), reached


def _tally(differing: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs share, from their exclusive-or."""
    return (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _linked(differing: np.ndarray, bits: int) -> np.ndarray:
    """Pairs retained by their tally, then verified on all bits."""
    found = _tally(differing) >= LEAST_SHARED
    found[found] = np.bitwise_count(differing[found]) <= bits
    return found


def connect(members: np.ndarray, choice: int | None = None, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that, with those of earlier choices, connect all members within ``bits`` of one another.

    ``members`` are distinct fingerprints of one list. With ``choice``, pairs that meet in an earlier choice of positions
    are taken as connected, for they are connected there.
    """
    if not _linked(members[:1] ^ members[1:], bits).any() and len(members) == 2:
        return []

    def near(one, others):
        return _linked(one ^ others, bits)

    gaps = [] if choice is None else GAPS[choice]
    part = np.arange(len(members))
    if gaps:

        def elsewhere(one, others):
            differing = one ^ others
            shared = np.zeros(len(others), dtype=bool)
            for gap in gaps:
                shared |= (differing & gap) == 0
            shared[shared] = _linked(differing[shared], bits)
            return shared

        start = 0
        for at, reached in _search(members, elsewhere):
            if len(reached):
                part[reached] = start
            else:
                start = at
                part[at] = at
    parts = np.unique(part)
    if len(parts) == 1:
        return []
    links, joined = [], {}

    def root(x: int) -> int:
        while joined.setdefault(x, x) != x:
            joined[x] = x = joined[joined[x]]
        return x

    for at, reached in _search(members, near):
        for to in reached.tolist():
            a, b = root(int(part[at])), root(int(part[to]))
            if a != b:
                joined[a] = b
                links.append((int(members[at]), int(members[to])))
    return links


def _runs(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[np.ndarray, bool]]:
    """(rows of whole lists, False) or (rows of one list over the limit, True), from rows sorted by list.

    At most ``limit`` rows of a list, and a batch, are held.
    """
    kept, passing = np.zeros((3, 0), dtype=np.int64), None
    for batch in batches:
        now = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("k", "c", "fp")])
        if passing is not None and now.shape[1]:
            others = np.flatnonzero((now[0] != passing[0]) | (now[1] != passing[1]))
            until = int(others[0]) if len(others) else now.shape[1]
            if until:
                yield now[:, :until], True
            passing, now = (None if len(others) else passing), now[:, until:]
        if not now.shape[1]:
            continue
        rows = np.concatenate((kept, now), axis=1)
        changes = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
        start = int(changes[-1]) + 1 if len(changes) else 0  # of the last list, which may go on
        if start:
            yield rows[:, :start], False
        kept = rows[:, start:]
        if limit is not None and kept.shape[1] > limit:
            passing = (kept[0, 0], kept[1, 0])
            yield kept, True
            kept = kept[:, :0]
    if kept.shape[1]:
        yield kept, False


def _batch(a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], ["a", "b", "c"])


def _links_of_lists(limit: int | None, use_choice: bool):
    """Links (a, b, -1) within lists; fingerprints of lists over the limit as (fp, fp, choice)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, over in _runs(batches, limit):
            if over:
                yield _batch(rows[2], rows[2], rows[1])
                continue
            out: list[tuple[int, int, int]] = []
            if rows.shape[1] > 1:
                k, c, fp = rows[0], rows[1], rows[2].view(np.uint64)
                edges = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1
                starts = np.concatenate(([0], edges))
                ends = np.concatenate((edges, [len(k)]))
                for s in np.flatnonzero(ends - starts > 1).tolist():
                    a, b = int(starts[s]), int(ends[s])
                    members, choice = fp[a:b], int(c[a])
                    if limit is not None and b - a > limit:
                        out += [(_signed(int(x)), _signed(int(x)), choice) for x in members]
                    else:
                        out += [(_signed(x), _signed(y), -1) for x, y in connect(members, choice if use_choice else None)]
            if out:
                yield _batch(*zip(*out, strict=True))

    return linked


def _listed(rows: DataFrame) -> DataFrame:
    """Rows (k, c, fp) dealt by their list and sorted, so that a list is one run."""
    return rows.repartition("k").sortWithinPartitions("k", "c", "fp")


def link_fingerprints(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all those at four or fewer differing bits."""
    masks = F.array(*[F.lit(_signed(int(m))) for m in MASKS])
    rows = prints.select("fp", F.posexplode(masks).alias("c", "mask"))
    rows = rows.select(F.xxhash64("c", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "c", "fp")
    first = cut(_listed(rows).mapInArrow(_links_of_lists(list_limit, True), "a long, b long, c long"))

    # Long lists, dealt anew: the four free bytes are eight half-bytes, of which at least four are shared as well.
    again = []
    for places in POSITIONS:
        free = [h for p in range(8) if p not in places for h in (2 * p, 2 * p + 1)]
        again.append([_signed(int(_mask(places)) | _mask(tuple(free[i] for i in four), 4)) for four in POSITIONS])
    table = F.array(*[F.array(*[F.lit(m) for m in choice]) for choice in again])
    long_lists = first.where("c >= 0").select(F.col("a").alias("fp"), F.col("c").cast("int").alias("c"))
    dealt = long_lists.select("fp", "c", F.explode(F.element_at(table, F.col("c") + 1)).alias("mask"))
    dealt = dealt.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), F.lit(0).alias("c"), "fp")
    second = _listed(dealt.distinct()).mapInArrow(_links_of_lists(None, False), "a long, b long, c long")
    return first.where("c < 0").select("a", "b").union(second.select("a", "b"))


def _grouped(docs: DataFrame, doc_id: str, text: str, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Every row: ``doc_id, version, fp``, its component's smallest fingerprint ``group`` and smallest id ``component_id``.

    Components are those of fingerprints, so rows without an id link others too.
    """
    prints = cut(fingerprints(docs, doc_id, text))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    reached = components(link_fingerprints(nodes.select("fp"), list_limit)).withColumnRenamed("node", "fp")
    groups = nodes.join(reached, "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("group"))
    # Dealt once more, so that a group with a third of all fingerprints can be split where it meets its one row.
    least = groups.groupBy("group").agg(F.min("node").alias("component_id")).repartition(F.xxhash64("group"))
    labels = groups.join(least, "group").select("fp", "group", "component_id")
    return prints.join(labels, "fp").select("doc_id", "version", "fp", "group", "component_id")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", list_limit: int = LIST_LIMIT
) -> DataFrame:
    """``(doc_id, version, fp, component_id)`` for every row: the smallest id that links lead to, the row's own included.

    It is null where no row that links lead to has an id.
    """
    return _grouped(docs, doc_id, text, list_limit).select("doc_id", "version", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of a group's rows with that id the text with the smallest hash stays; rows that share id and text are one document, and stay together. Rows without an id come
    last, so where all ids of a group are null one of its texts stays.
    """
    found = _grouped(docs, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("first")
    kept = found.groupBy("group").agg(first).select("first.doc_id", "first.version")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"))
    same = F.col("id").eqNullSafe(kept["doc_id"]) & (rows["version"] == kept["version"])
    return rows.join(kept, same, "left_semi").select("row.*")
