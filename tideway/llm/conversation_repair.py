"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate, by depth-first branch and bound.

A conversation's roles are good if their initials are ``(s?(ua)+)?``. Each row is kept (cost 0), given the role user or assistant (2) or deleted (3); rows
of user or assistant without text are inserted anywhere (2). Blank and duplicate rows have to be deleted; a truncated row that is not deleted adds 1. Of the cheapest
repairs the one whose audit (the edits' initials in order: K, R, D, I) comes first in ASCII order is chosen.

The search runs over stretches of a conversation. A node is a number of rows edited and the role that came last; an explicit stack holds the prefixes to be
extended. Lower bounds on what the rest of a stretch costs, suffix by suffix, cut every prefix that cannot be cheapest; the incumbent (cost, audit) of each role that a
stretch may end with cuts those whose audit comes later; a table holds the best prefix of each node and cuts the others that reach it. A stretch is done when the stack is
empty, so what is left is proved to be cheapest. As the bounds are exact in cost and prefixes are extended in ASCII order, a node is extended once for each incumbent of the
stretch before, and the time grows with the rows. The next stretch starts from the incumbents; what their audits have in common is settled.

Rows arrive sorted, so a task holds a stretch, a conversation's audit (a letter an edit) and a batch, never its texts. Texts meet the audit in a
second sorted pass, which writes the repaired rows. Whether a row repeats an earlier one is an aggregation over conversation, role and text.

Defined results: a null role or text is one space; a null conversation id names a conversation of its own; rows without a turn come first; rows of one turn go by
role, then by the SHA-256 of the text; repeated rows are duplicates of the first of them; a role without a first character cannot be kept; a conversation whose rows are
all deleted has no repaired rows; very long texts are hashed whole; an empty table gives an empty result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.runtime import columns, cut

RECAST, DROP, ADD, CLIPPED = 2, 3, 2, 1  # costs of a new role, a deletion, an insertion, a truncated row that stays
STRETCH = 64  # rows that are searched at a time
BLANKS = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # what came last
INITIALS, NAMES = ("", "s", "u", "a"), ("", "system", "user", "assistant")
ENDS = (NOTHING, ASSISTANT)

#: What a completion may cost more if it starts after the first role instead of the second. ``None``: it cannot be had.
_INSTEAD = {
    NOTHING: {SYSTEM: None, USER: ADD, ASSISTANT: 0},
    SYSTEM: {NOTHING: None, USER: ADD, ASSISTANT: None},
    USER: {NOTHING: None, SYSTEM: ADD, ASSISTANT: ADD},
    ASSISTANT: {NOTHING: DROP, SYSTEM: 0, USER: ADD},
}
_BETTERED_BY = {q: [(p, more[q]) for p, more in _INSTEAD.items() if p != q and more[q] is not None] for q in range(4)}
NEVER = 1 << 60

Row = tuple[str, bool, bool]  # the role's initial; whether it has to go; whether it is truncated


def following(last: int) -> int:
    """The role that an inserted or renamed row must have."""
    return ASSISTANT if last == USER else USER


def kept_as(initial: str, last: int) -> int | None:
    """What comes last once a row is kept as it is, or None if it cannot be."""
    if initial == "s" and last == NOTHING:
        return SYSTEM
    role = following(last)
    return role if initial == INITIALS[role] else None


def lower_bounds(rows: list[Row], last: bool) -> list[list[list[int]]]:
    """What the rest costs at least, by the rows already edited, the role that came last and the role to end with.

    Suffix by suffix, from the end. The bounds look at costs alone; which of the cheapest repairs has the first audit is left to the search.
    """
    bounds: list[list[list[int]]] = []
    for at in range(len(rows), -1, -1):
        if at == len(rows):
            rest = [[0 if role == goal else NEVER for goal in range(4)] for role in range(4)]
        else:
            initial, must_go, truncated = rows[at]
            clipped, after, rest = CLIPPED * truncated, bounds[-1], []
            for role in range(4):
                ways = [(DROP, after[role])]
                if not must_go:
                    ways.append((RECAST + clipped, after[following(role)]))
                    if (kept := kept_as(initial, role)) is not None:
                        ways.append((clipped, after[kept]))
                rest.append([min(price + to[goal] for price, to in ways) for goal in range(4)])
        if at < len(rows) or last:  # up to two insertions first; three would be one and a whole turn
            for _ in range(2):
                rest = [[min(rest[role][goal], ADD + rest[following(role)][goal]) for goal in range(4)] for role in range(4)]
        bounds.append(rest)
    return bounds[::-1]


def search(rows: list[Row], entries: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) for each role that may come last after ``rows``, from those before them.

    Where the stretch is the ``last``, rows may be inserted at its end, and the roles have to be good.
    """
    bounds, n = lower_bounds(rows, last), len(rows)
    goals = [goal for goal in (ENDS if last else range(4)) if min(cost + bounds[0][role][goal] for role, (cost, _) in entries.items()) < NEVER]
    least = {goal: min(cost + bounds[0][role][goal] for role, (cost, _) in entries.items()) for goal in goals}
    incumbents: dict[int, tuple[int, str]] = {}
    best: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]

    def hopeful(at: int, role: int, cost: int, audit: str, goal: int) -> bool:
        """Whether a prefix may still become the incumbent of a goal."""
        if cost + bounds[at][role][goal] > least[goal]:
            return False
        return goal not in incumbents or audit <= incumbents[goal][1][: len(audit)]

    stack = [(0, role, cost, audit) for role, (cost, audit) in sorted(entries.items(), key=lambda e: e[1][1], reverse=True)]
    while stack:
        at, role, cost, audit = stack.pop()
        table = best[at]
        if role in table and table[role] <= (cost, audit):
            continue
        if not any(hopeful(at, role, cost, audit, goal) for goal in goals):
            continue
        table[role] = (cost, audit)
        if at == n and role in goals and (role not in incumbents or (cost, audit) < incumbents[role]):
            incumbents[role] = (cost, audit)
        # Pushed last to first in ASCII order (D, I, K, R), so that what comes first is extended first.
        to = following(role)
        if at < n:
            initial, must_go, truncated = rows[at]
            if not must_go:
                stack.append((at + 1, to, cost + RECAST + CLIPPED * truncated, audit + "R"))
                if (kept := kept_as(initial, role)) is not None:
                    stack.append((at + 1, kept, cost + CLIPPED * truncated, audit + "K"))
        if at < n or last:
            stack.append((at, to, cost + ADD, audit + "I"))
        if at < n:
            stack.append((at + 1, role, cost + DROP, audit + "D"))
    return incumbents


class Repair:
    """The search over a conversation's rows as they come."""

    def __init__(self, stretch: int = STRETCH):
        self.stretch, self.waiting, self.settled = stretch, [], []
        self.open: dict[int, tuple[int, str]] = {NOTHING: (0, "")}

    def add(self, row: Row) -> None:
        self.waiting.append(row)
        if len(self.waiting) == self.stretch:
            self.open = search(self.waiting, self.open, False)
            self.waiting = []
            # An incumbent that another one betters by more than it could save is no longer needed.
            self.open = {q: x for q, x in self.open.items() if not any(p in self.open and self.open[p][0] + more < x[0] for p, more in _BETTERED_BY[q])}
            audits = [audit for _, audit in self.open.values()]
            first, final = min(audits), max(audits)
            same = next((i for i, (a, b) in enumerate(zip(first, final, strict=False)) if a != b), min(len(first), len(final)))
            self.settled.append(first[:same])
            self.open = {role: (cost, audit[same:]) for role, (cost, audit) in self.open.items()}

    def done(self) -> tuple[int, str]:
        """The cost and the audit."""
        cost, audit = min(search(self.waiting, self.open, True).values())
        return cost, "".join([*self.settled, audit])


def repaired_role(letter: str, role: str, last: int) -> tuple[str, int]:
    """The role of a row after its edit, and what comes last."""
    if letter == "K":
        return role, kept_as(role[:1], last)
    return NAMES[following(last)], following(last)


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Dealt by conversation and sorted as its rows follow one another."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "key")


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_FOUND = [*(f.split()[0] for f in _COUNTS.split(", ")), "audit"]


class _Conversation:
    """Counts and search of one conversation, from its rows in order."""

    def __init__(self):
        self.turns, self.first, self.last, self.seen = 0, None, None, None
        self.counts, self.illegal, self.initial, self.repair = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, Repair()

    def add(self, turn: int | None, role: str, key: str, blank: bool, repeated: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        fault = "blank" if blank else "duplicate" if repeated or (turn, role, key) == self.seen else "truncated" if truncated else None
        self.seen = (turn, role, key)
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.repair.add((initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts.values(), self.illegal, *self.repair.done())


def _gone(lost: str | None) -> Column:
    return F.coalesce(F.col(lost).cast("boolean"), F.lit(False)) if lost else F.lit(False)


def repairs(turns: DataFrame, lost: str | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` for each conversation of ``(conv_id, turn, role, text)``.

    Rows where the column named by ``lost`` is true count as absent; their conversations have a row all the same.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    text, turn = _spaced("text"), F.col("turn").cast("long")
    order = F.struct(turn.isNotNull().alias("some"), turn.alias("turn")).alias("place")
    final = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    faults = [(final == "").alias("blank"), (~final.isin(".", "!", "?")).alias("truncated")]
    rows = turns.select("conv_id", order, turn.alias("turn"), _spaced("role").alias("role"), F.sha2(text, 256).alias("key"), *faults, _gone(lost).alias("lost"))
    said = rows.where("not lost").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min("place").alias("earliest"))
    # Dealt once more, so that a text that is repeated all over can be split where it meets its one row.
    said = said.repartition(F.xxhash64("c", "r", "k"))
    same = rows["conv_id"].eqNullSafe(said["c"]) & (rows["role"] == said["r"]) & (rows["key"] == said["k"])
    rows = rows.join(said, same, "left").withColumn("repeated", F.coalesce(F.col("place") > F.col("earliest"), F.lit(False)))
    names = ["conv_id", "turn", "role", "key", "blank", "repeated", "truncated", "lost"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["conv_id", *_FOUND])

        for batch in batches:
            done = []
            for key, *row, gone in zip(*columns(batch, *names), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append((conv, *state.row()))
                    conv, state = key, _Conversation()
                if not gone:
                    state.add(*row)
            if done:
                yield out(done)
        if state is not None:
            yield out([(conv, *state.row())])

    return _ordered(rows.select(*names)).mapInArrow(found, f"conv_id {kind}, {_COUNTS}, audit string")


def repaired_turns(turns: DataFrame, found: DataFrame, lost: str | None = None) -> DataFrame:
    """``(conv_id, place, edit, turn, role, text)``: the rows of each conversation after the edits of ``found``.

    Deleted rows are left out, inserted ones have no turn. A conversation's rows are in one partition, one after the other.
    """
    turns = turns.where(~_gone(lost))
    kind = turns.schema["conv_id"].dataType.simpleString()
    text = _spaced("text")
    rows = turns.select("conv_id", F.lit(1).alias("is_row"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), F.sha2(text, 256).alias("key"), text.alias("text"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("key", "string"))]
    both = rows.unionByName(found.select("conv_id", F.lit(0).alias("is_row"), *nothing, F.col("audit").alias("text")))

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last, place = None, "", 0, NOTHING, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, last, place
            while at < len(audit) and audit[at] == "I":
                role, last = repaired_role("I", "", last)
                yield conv, place, "I", None, role, ""
                at, place = at + 1, place + 1

        def out(done: list[tuple]) -> pa.RecordBatch:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "place", "edit", "turn", "role", "text"])

        for batch in batches:
            done = []
            for key, is_row, turn, role, words in zip(*columns(batch, "conv_id", "is_row", "turn", "role", "text"), strict=True):
                if not is_row:
                    done += inserted()  # the end of the conversation before
                    conv, audit, at, last, place = key, words, 0, NOTHING, 0
                    continue
                done += inserted()
                letter, at = audit[at], at + 1
                if letter != "D":
                    role, last = repaired_role(letter, role, last)
                    done.append((conv, place, letter, turn, role, words))
                    place += 1
            if done:
                yield out(done)
        if done := list(inserted()):
            yield out(done)

    schema = f"conv_id {kind}, place long, edit string, turn long, role string, text string"
    return _ordered(both, "is_row").select("conv_id", "is_row", "turn", "role", "text").mapInArrow(edited, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the ``role:text`` of repaired rows, joined by line feeds, from rows in the order of :func:`repaired_turns`."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            ids, found = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            done = []
            for key, place, role, text in zip(*columns(batch, "conv_id", "place", "role", "text"), strict=True):
                if place == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if done:
                yield out(done)
        if digest is not None:
            yield out([(conv, digest.hexdigest())])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(digested, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(turns: DataFrame, lost: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What was found in each conversation, and the repaired rows."""
    found = cut(repairs(turns, lost))
    return found, repaired_turns(turns, found, lost)
