"""Exact duplicates: rows are dealt by length and content hash to owners that hold their texts in Patricia tries.

A text is compared after lower-casing A-Z only, as UTF-8 bytes. The trie's key is the text's length and content hash followed by
its full bytes, so equal means equal in every byte and each (length, hash) is a subtree of its own. A terminal node holds the
owner: the row that stays, how many rows ended there, and whether ids tie.

Two passes. Each input partition first folds its own rows, so a text that fills a third of the corpus leaves
a partition once. The owners then receive rows sorted by length and hash: a subtree is complete as soon as the next begins,
and complete subtrees leave memory whenever the trie holds more than ``budget`` bytes.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays (a null id only if
all are null), of equal ids one row; very long texts are held and compared whole; repeated rows are rows each, of which
one stays; an empty table gives an empty result; extra columns, whatever their names, are not compared.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideway.llm.runtime import columns, cut, pieces, utf8

TRIE_BUDGET = 16 << 20
REPEATS = 100_000
_ROWS = 1_000


class Node:
    """An edge's bytes (a slice of a key) and what hangs below; ``value`` is set where a key ends."""

    __slots__ = ("key", "start", "end", "children", "value")

    def __init__(self, key: bytes, start: int, end: int, value=None):
        self.key, self.start, self.end, self.value = key, start, end, value
        self.children: dict[int, Node] | None = None


class PatriciaTrie:
    """A compressed radix trie over byte strings. Edges point into the keys, which are held once."""

    def __init__(self):
        self.root = Node(b"", 0, 0)
        self.held = 0

    def insert(self, key: bytes, value, merge) -> None:
        """Set the key's value, or ``merge(old, value)`` if the key is there."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value if node.value is None else merge(node.value, value)
                return
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key, at, len(key), value)
                self.held += len(key)
                return
            size = child.end - child.start
            if key.startswith(child.key[child.start : child.end], at):
                node, at = child, at + size
                continue
            low, high = 1, size  # the first byte is shared
            while low < high - 1:  # the longest shared part of the edge, by halves
                middle = (low + high) // 2
                if key.startswith(child.key[child.start : child.start + middle], at):
                    low = middle
                else:
                    high = middle
            upper = Node(child.key, child.start, child.start + low)
            child.start += low
            upper.children = {child.key[child.start]: child}
            node.children[key[at]] = upper
            node, at = upper, at + low

    def items(self, node: Node | None = None) -> Iterator[tuple[bytes, object]]:
        """Keys and values below a node, without recursion."""
        waiting = [node or self.root]
        while waiting:
            now = waiting.pop()
            if now.value is not None:
                yield now.key[: now.end], now.value
            waiting.extend((now.children or {}).values())


def normalised(data: bytes | None) -> bytes:
    return (data or b"").lower()


def prefixed(text: bytes) -> bytes:
    """The text under its length and content hash."""
    return struct.pack(">QQ", len(text), xxhash.xxh3_64_intdigest(text)) + text


def _better(a: tuple, b: tuple) -> tuple:
    """Of two owners (id, rows, ties, row) the one with the larger id, with the rows of both and the ties of equal ids."""
    if a[0] == b[0]:
        return (a[0], a[1] + b[1], a[2] + b[2], a[3])
    keep = a if b[0] is None or (a[0] is not None and a[0] > b[0]) else b
    return (keep[0], a[1] + b[1], keep[2], keep[3])


MADE = {
    "length": lambda key, owner: len(key) - 16,
    "hash": lambda key, owner: struct.unpack(">q", key[8:16])[0],
    "data": lambda key, owner: key[16:],
    "id": lambda key, owner: owner[0],
    "n": lambda key, owner: owner[1],
    "ties": lambda key, owner: owner[2],
    "sha256": lambda key, owner: hashlib.sha256(memoryview(key)[16:]).hexdigest(),
}


def _fold(schema: pa.Schema, final: bool, budget: int, rows: int = _ROWS):
    """Fold rows into a trie and emit ``schema``: columns of ``MADE`` and, if it is there, the struct ``row`` of the owner.

    Input: ``id``, ``data`` (the text's bytes) and ``row`` if it is asked for; in the final pass ``n``, ``ties`` and sorted rows too.
    """
    kind = schema.field("row").type if "row" in schema.names else None

    def column(field: pa.Field, entries: list[tuple[bytes, tuple]]) -> pa.Array:
        if field.name != "row":
            return pa.array([MADE[field.name](k, v) for k, v in entries], field.type)
        parts = [pa.array([v[3][i] for _, v in entries], f.type) for i, f in enumerate(kind)]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    def out(entries: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(field, entries) for field in schema], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(), b""

        def leave(keep: bytes | None) -> Iterator[pa.RecordBatch]:
            """Emit all but the subtree that ``keep`` begins, and free it."""
            nonlocal trie
            rest, waiting, size = PatriciaTrie(), [], 0
            for key, value in trie.items():
                if keep is not None and key.startswith(keep):
                    rest.insert(key, value, _better)
                    continue
                waiting.append((key, value))
                size += len(key)
                if len(waiting) >= rows or size > budget // 4:
                    yield out(waiting)
                    waiting, size = [], 0
            if waiting:
                yield out(waiting)
            trie = rest

        for batch in pieces(batches, rows):
            row = [part.to_pylist() for part in batch.column("row").flatten()] if kind else []
            data, ids = columns(batch, "data", "id")
            counts, ties = columns(batch, "n", "ties") if final else ([1] * len(ids), [1] * len(ids))
            for i, text in enumerate(data):
                key = prefixed(normalised(text))
                trie.insert(key, (ids[i], counts[i], ties[i], [part[i] for part in row]), _better)
                if trie.held > budget and key[:16] != last[:16]:
                    yield from leave(key[:16] if final else None)
                last = key
        yield from leave(None)

    return fold


def owners(docs: DataFrame, doc_id: str, text: str, whole: bool, budget: int = TRIE_BUDGET) -> DataFrame:
    """One row per distinct text: ``id`` of the row that stays, ``n`` (rows), ``ties`` (rows of that id) and ``sha256``.

    With ``whole`` also ``row``, the row that stays as a struct; then original texts travel, else their normalised bytes.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), utf8(text).alias("data"))
    rows = rows if whole else rows.drop("row")
    row = [T.StructField("row", rows.schema["row"].dataType)] if whole else []
    owner = [T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("ties", T.LongType())]
    place = [T.StructField("length", T.LongType()), T.StructField("hash", T.LongType())]
    carried = [] if whole else [T.StructField("data", T.BinaryType())]
    first = T.StructType([*row, *owner, *place, *carried])
    last = T.StructType([*row, *owner, T.StructField("sha256", T.StringType())])

    dealt = (
        rows.mapInArrow(_fold(to_arrow_schema(first), False, budget), first)
        .repartition("length", "hash")
        .sortWithinPartitions("length", "hash")
        .withColumn("data", F.col("row")[text].cast("binary") if whole else F.col("data"))
        .drop("length", "hash")
    )
    return dealt.mapInArrow(_fold(to_arrow_schema(last), True, budget), last)


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts travel once."""
    return owners(docs, doc_id, text, True).select("row.*")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (texts,) = columns(batch, "data")
        digests = pa.array([hashlib.sha256(normalised(x)).hexdigest() for x in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), digests], ["doc_id", "text_sha256"])


def _numbered(tied: DataFrame) -> DataFrame:
    """``turn`` 1 to ``ties`` for every row, dealt in blocks so that no task makes more than ``REPEATS`` of them."""
    blocks = tied.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("ties") - 1) / REPEATS)))).repartition("text_sha256", "block")
    upto = F.least("ties", (F.col("block") + 1) * REPEATS)
    return blocks.withColumn("turn", F.explode(F.sequence(F.col("block") * REPEATS + 1, upto)))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts go to their owners without the rows; rows then meet their owner by the text's digest, which is one to one with
    texts. That join is the last step of its branch and its right side has one small row a text, so a text that fills a third of all rows is
    split over tasks by adaptive execution. Rows that share the owner's text and id differ in ``kept`` alone: they are made from
    the owner's number of them.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = cut(
        owners(docs, doc_id, text, False).select(F.col("sha256").alias("text_sha256"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "ties")
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("data")).mapInArrow(_digests, f"doc_id {kind}, text_sha256 string")
    is_owner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    met = rows.join(texts, "text_sha256").where((F.col("ties") == 1) | ~is_owner)
    same = _numbered(texts.where("ties > 1"))
    return met.select("doc_id", "keep_id", "group_size", is_owner.alias("kept"), "text_sha256").union(
        same.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.col("turn") == 1, "text_sha256")
    )
