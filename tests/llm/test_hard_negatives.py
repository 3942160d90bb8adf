"""Hard-negative mining against plain integer arithmetic, with nulls, ties, repeats, odd lengths and huge values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideway.llm import hard_negatives as hn

ROWS = "vec_id long, label int, embedding array<double>, row long, owner string, scores string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table(spark, rows):
    return spark.createDataFrame([(*r, -1, "x", "y") for r in rows], ROWS)


def plain(rows, every, positives=5, negatives=3):
    """The contract by loops over Python's integers."""
    whole = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * 256) for x in v):
            continue
        whole.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (anchor, label, v) in enumerate(whole):
        if anchor % every:
            continue
        met = [(sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for b, (i, other, w) in enumerate(whole) if a != b]
        met = sorted(((s, i, same) for s, i, same in met if abs(s) < 2**63), key=lambda m: (-m[0], m[1]))
        for p, i, _ in [m for m in met if m[2]][:positives]:
            near = [m for m in met if not m[2] and 50 * p <= 100 * m[0] <= 95 * p][:negatives]
            out += [(anchor, i, rank, n, p, s) for rank, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(1, 20), st.booleans(), st.integers(0, 2**32))
def test_strassen_equals_the_plain_product(m, k, n, leaf, huge, seed):
    rng = np.random.default_rng(seed)
    most = 2**62 if huge else 1000
    a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (n, k))
    if huge:
        a, b = a.astype(object), b.astype(object)
    got = hn.strassen(a, b, leaf)
    assert got.shape == (m, n)
    assert all(int(got[i, j]) == sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True)) for i in range(m) for j in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 30)), max_size=60), st.integers(1, 6), st.integers(1, 9))
def test_heaps_merge_in_any_parts(entries, most, parts):
    whole = sorted(entries, key=lambda e: (-e[0], e[1]))[:most]
    merged = hn.Heap(most)
    for part in range(parts):
        own = entries[part::parts]
        heap = hn.Heap(most)
        heap.offer(np.array([e[0] for e in own], np.int64), np.array([e[1] for e in own], np.int64))
        merged.offer(heap.scores, heap.ids)
    assert list(zip(merged.scores.tolist(), merged.ids.tolist(), strict=True)) == whole


def test_negatives_equal_plain_loops(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), [rng.choice((-0.5, 0.25, 0.3, 0.7, 1.0)) for _ in range(9)]) for i in range(300)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(40)] + [(2000 + i, 2, rows[7][2]) for i in range(40)]  # copies: many equal scores
    want = plain(rows, 10)
    assert want and len({r[2] for r in want}) == 3
    assert found(hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == want
    for name, size in (("TILE_ANCHORS", 3), ("TILE_CANDIDATES", 7), ("BLOCK", 11), ("STRIP", 9)):
        monkeypatch.setattr(hn, name, size)
    assert found(hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [2.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.5]), (2, 2, [1.0, 0.5]), (3, 2, [1.0]), (4, 1, []),
        (5, 2, []), (6, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (7, 1, None), (8, 1, [None, 1.0]), (9, 2, [nan, 1.0]), (10, 2, [inf, 1.0]), (11, 2, [1e306, 1.0]),
        (12, 2, [0.9, 0.7, 0.0]), (20, 3, [-1.0, -1.0]), (30, 9, [1.0, 1.0]),
    ]
    want = plain(rows, 10)
    assert {r[0] for r in want} == {0}
    assert found(hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == want
    huge = [(10 * i, i % 2, [x * 1e9, 3e8, -1e7 * i]) for i, x in enumerate((1.0, 0.9, 0.8, 0.7, 0.6, 1.1, 1e3))]
    assert found(hn.hard_negatives(table(spark, huge), F.col("vec_id") % 10 == 0)) == plain(huge, 10)


@pytest.mark.parametrize("rows", [[], [(50, 1, [1.0])], [(50, None, None)]])
def test_too_few_vectors(spark, rows):
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == COLUMNS and got.count() == 0


def test_one_hot_label(spark):
    """A label with nine tenths of the rows is dealt over strips like any other rows."""
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 10 == 0), rng.normal(0.3, 1, 16).tolist()) for i in range(1200)]
    assert found(hn.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0)) == plain(rows, 50)
