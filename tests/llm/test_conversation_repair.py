"""Conversation repair against all edits of short conversations, a plain table of states for long ones, and odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideway.llm import conversation_repair as cr
from tideway.llm import queries

GOOD = re.compile(r"(s?(ua)+)?")
ROWS = st.lists(st.tuples(st.sampled_from("suaxU") | st.just(""), st.booleans(), st.booleans()), max_size=3)


def every_repair(rows):
    """All repairs with at most two insertions at a place: (cost, audit, initials)."""
    inserted = ["", "u", "a", "ua"]
    for edits in itertools.product("KDua", repeat=len(rows)):
        if any(must_go and e != "D" for e, (_, must_go, _) in zip(edits, rows, strict=True)):
            continue
        if any(e == "K" and not r for e, (r, _, _) in zip(edits, rows, strict=True)):
            continue
        for places in itertools.product(inserted, repeat=len(rows) + 1):
            cost, audit, initials = 2 * sum(map(len, places)), "I" * len(places[0]), places[0]
            for e, (r, _, clipped), after in zip(edits, rows, places[1:], strict=True):
                cost += {"K": 0, "D": 3}.get(e, 2) + (clipped and e != "D")
                audit += {"K": "K", "D": "D"}.get(e, "R") + "I" * len(after)
                initials += {"K": r, "D": ""}.get(e, e) + after
            if GOOD.fullmatch(initials):
                yield cost, audit


def by_states(rows):
    """(cost, audit) from the best prefix of every state, row by row."""

    def with_inserts(best):
        for _ in range(2):
            for role, (cost, audit) in list(best.items()):
                to = cr.following(role)
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = {cr.NOTHING: (0, "")}
    for initial, must_go, clipped in rows:
        now = {}
        for role, (cost, audit) in with_inserts(best).items():
            moves = [(role, cost + 3, "D")]
            if not must_go:
                moves.append((cr.following(role), cost + 2 + clipped, "R"))
                if cr.kept_as(initial, role) is not None:
                    moves.append((cr.kept_as(initial, role), cost + clipped, "K"))
            for to, price, letter in moves:
                now[to] = min(now.get(to, (10**9, "")), (price, audit + letter))
        best = now
    return min(x for role, x in with_inserts(best).items() if role in cr.ENDS)


def repaired(rows, stretch=cr.STRETCH):
    repair = cr.Repair(stretch)
    for row in rows:
        repair.add(row)
    return repair.done()


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_search_finds_the_cheapest_of_all_repairs(rows):
    want = min(every_repair(rows))
    assert repaired(rows) == want and by_states(rows) == want
    assert repaired(rows, 1) == want and repaired(rows, 2) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=80), st.integers(1, 70))
def test_long_conversations_in_stretches(rows, stretch):
    assert repaired(rows, stretch) == by_states(rows)


@pytest.mark.parametrize("roles", ["u", "a", "s", "x", "uuaa", "usa", "sss"])
def test_hard_long_conversations(roles):
    rows = [(r, False, i % 3 == 0) for i, r in enumerate(roles * (3000 // len(roles)))]
    assert repaired(rows) == by_states(rows)


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_bounds_never_exceed_the_rest(rows):
    bounds = cr.lower_bounds(rows, True)
    for at in range(len(rows) + 1):
        found = cr.search(rows[at:], {cr.NOTHING: (0, "")}, True)
        least = min(every_repair(rows[at:]))[0]
        assert min(cost for cost, _ in found.values()) == least == min(bounds[at][cr.NOTHING][goal] for goal in cr.ENDS)


def plain(rows):
    """The contract over (conv_id, turn, role, text), before damage."""
    import zlib

    conversations = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        own = conversations.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, counts, marks = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault or "none"] = counts.get(fault or "none", 0) + 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = by_states(marks)
        said, last, rest = [], cr.NOTHING, iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rest)[1:]
            if letter != "D":
                role, last = cr.repaired_role(letter, role, last)
                said.append(f"{role}:{text}")
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def written(spark, tmp_path, rows):
    table = spark.createDataFrame([(*r, "x", 1, True, "y") for r in rows], "conv_id long, turn long, role string, text string, lost string, place int, repeated boolean, audit string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    return queries.op13_conversation_repair(spark, str(tmp_path)).collect()


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \t\n", "Why?", "é!", "é", None, "ok. \x0b\x0c\r", "ok ", "." * 5]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ärzte"]
    rows = [(c, t, rng.choice(roles[: 3 if c % 2 else 8]), rng.choice(texts)) for c in range(60) for t in rng.sample(range(12), rng.randrange(1, 9))]
    rows += [(100, None, "user", "Hello there."), (100, None, None, None), (100, None, "user", "Hello there."), (None, 1, "user", "x."), (None, None, "assistant", "y.")]
    rows += [(101, 3, "assistant", "same turn."), (101, 3, "user", "same turn."), (101, 3, "user", "same turn."), (102, -7, "user", "far."), (102, 2**40, "assistant", "apart.")]
    rows += [(103, t, ("user", "assistant")[t % 2], "x" * 300_000 + ".") for t in range(4)] + [(104, t, "user", "again.") for t in range(3000)]
    rows += [(105, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(2000)]
    found = {r["conv_id"]: tuple(r)[1:] for r in written(spark, tmp_path, rows)}
    want = plain(rows)
    assert found.keys() == want.keys()
    for conv, row in want.items():
        assert found[conv] == row, conv


def test_conversations_that_lose_all_rows_and_no_conversations(spark, tmp_path):
    import zlib

    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = written(spark, tmp_path / "one", [(lost, 0, "user", "Gone.")])
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert written(spark, tmp_path / "none", []) == []


def test_repaired_rows_are_real_rows(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Why?"), (1, 5, "bot", "So.")], "conv_id long, turn int, role string, text string")
    found, rows = cr.repair_conversations(turns)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 0, 1, 0, 2, 7, "IKDKR")]
    got = [(r["edit"], r["turn"], r["role"], r["text"]) for r in rows.orderBy("place").collect()]
    assert got == [("I", None, "user", ""), ("K", 0, "assistant", "Hi."), ("K", 2, "user", "Why?"), ("R", 5, "assistant", "So.")]
