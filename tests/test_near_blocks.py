"""Neighbours with skipped blocks against all pairs: the same rows, and how much is skipped."""

import numpy as np
import pytest

from tideway.operators import embeddings, near_blocks

ROWS = "id long, label long, z array<double>"


def table(spark, x, labels=None, first=0):
    return spark.createDataFrame([(first + i, int(i % 3 if labels is None else labels[i]), None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], ROWS).repartition(4)


def brute(train, test, k):
    """Ranks by similarity, ties to the smaller id; products of exact small numbers or rounded, so that equal ones stay equal."""
    def length(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)

    sims = length(test) @ length(train).T
    return {(i, r + 1): j for i, row in enumerate(sims) for r, j in enumerate(np.lexsort((np.arange(len(row)), -np.round(row, 12)))[:k].tolist())}


def found(rows):
    return {(r["test_id"], r["rank"]): r["train_id"] for r in rows.collect()}


def test_clustered_vectors_skip_most_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    train, test = (np.repeat(centres, n, axis=0) + 0.05 * rng.normal(size=(40 * n, 24)) for n in (60, 5))
    rows, skipped = near_blocks.knn_pruned(table(spark, train), table(spark, test), 5, pivots=40, block_train=25, block_test=7)
    assert found(rows) == brute(train, test, 5) and skipped > 0.85
    few = embeddings.knn(table(spark, train), table(spark, test), 5).select("test_id", "train_id", "label", "rank")
    assert sorted(few.collect()) == sorted(rows.select("test_id", "train_id", "label", "rank").collect())


@pytest.mark.parametrize(("pivots", "block"), [(1, 10_000), (7, 30), (64, 9)])
def test_vectors_without_structure(spark, pivots, block):
    rng = np.random.default_rng(2)
    train, test = rng.normal(size=(400, 12)), rng.normal(size=(60, 12))
    rows, skipped = near_blocks.knn_pruned(table(spark, train), table(spark, test), 4, pivots, block, block)
    assert found(rows) == brute(train, test, 4) and 0.0 <= skipped < 1.0


def test_copies_ties_and_zero_vectors(spark):
    """A third of all rows is one vector, dealt into many blocks; others tie, are opposite, or are zero."""
    train = np.array([[1.0, 0, 0]] * 100 + [[0, 1.0, 0], [0, 2.0, 0], [0, 0, 3.0], [-1.0, 0, 0], [0, 0, 0]] * 40)
    test = np.array([[2.0, 0, 0], [0, 5.0, 0], [0, 0, 0], [-1.0, 0, 0], [0, 0, -1.0]])
    rows, _ = near_blocks.knn_pruned(table(spark, train), table(spark, test), 6, pivots=8, block_train=10, block_test=2)
    assert found(rows) == brute(train, test, 6)


def test_fewer_rows_than_asked_and_missing_vectors(spark):
    train, test = [[1.0, 0.0], None, [0.0, 1.0], [-1.0, 0.0]], [[1.0, 0.1], None]
    rows, skipped = near_blocks.knn_pruned(table(spark, train), table(spark, test), 5)
    assert found(rows) == {(0, 1): 0, (0, 2): 2, (0, 3): 3} and skipped == 0.0
    assert near_blocks.knn_pruned(table(spark, train).limit(0), table(spark, test))[0].count() == 0
    assert near_blocks.knn_pruned(table(spark, train), table(spark, test).limit(0))[0].count() == 0
