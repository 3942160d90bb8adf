"""Prototype updates from a bounded tail: the bound itself, against updates of all rows, and how a class with most of the rows is dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.operators import memory


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def folded(proto, rows, momentum):
    for z in rows:
        proto = unit(momentum * proto + (1 - momentum) * z)
    return proto


def in_cone(rng, axis, trust, n, edge):
    """Directions at a similarity of at least ``trust`` to the axis, or just at it; opposite ones on the edge are the hardest."""
    away = rng.normal(size=(n, len(axis)))
    away = unit(away - np.outer(away @ axis, axis))
    sim = np.full(n, trust) if edge else rng.uniform(trust, 1, n)
    return sim[:, None] * axis + np.sqrt(1 - sim**2)[:, None] * away


@pytest.mark.parametrize(("trust", "momentum"), [(0.75, 0.95), (0.3, 0.95), (0.05, 0.9), (0.9, 0.5), (1.0, 0.95)])
def test_bound_holds_for_any_two_starts(trust, momentum):
    rng = np.random.default_rng(1)
    n = memory.rows_that_count(trust, momentum)
    for size in (2, 3, 64):
        axis = unit(rng.normal(size=size))
        for edge in (True, False):
            a, b = in_cone(rng, axis, trust, 2, True)
            rows = in_cone(rng, axis, trust, n, edge)
            assert np.abs(folded(a, rows, momentum) - folded(b, rows, momentum)).max() < 1e-14
            # Shorter tails keep what the bound says at looser tolerances.
            few = memory.rows_that_count(trust, momentum, 1e-3)
            assert few <= n and np.abs(folded(a, rows[:few], momentum) - folded(b, rows[:few], momentum)).max() <= 1e-3


def test_rows_that_count():
    assert memory.rows_that_count(0.75, 0.95) == 966
    assert memory.rows_that_count(0.0, 0.95) is None and memory.rows_that_count(-0.5, 0.95) is None and memory.rows_that_count(0.5, 1.0) is None
    assert memory.rows_that_count(0.5, 0.0) == 1


@pytest.fixture(scope="module")
def batch(spark):
    """Class 1 has most of the rows, class 2 a few, class 3 none yet, class 4 no rows at all; two rows share a place."""
    rng = np.random.default_rng(3)
    axes = np.eye(6)[:4]
    rows = [(1, i, z.tolist()) for i, z in enumerate(in_cone(rng, axes[0], 0.7, 6000, False))]
    rows += [(2, 7000 + i, z.tolist()) for i, z in enumerate(in_cone(rng, axes[1], 0.7, 50, False))]
    rows += [(3, 9000 - i, (2.0 * z).tolist()) for i, z in enumerate(in_cone(rng, axes[2], 0.7, 9, False))]
    rows += [(2, 7049, rows[6001][2])]
    protos = [(1, axes[0].tolist(), 10), (2, axes[1].tolist(), 5), (3, None, 0), (4, axes[3].tolist(), 2)]
    return spark.createDataFrame(rows, "label long, seq long, z array<double>").repartition(24), spark.createDataFrame(protos, "label long, proto array<double>, n long")


def test_tail_gives_what_all_rows_give(batch):
    rows, protos = batch
    found = {r["label"]: r for r in memory.update_trusted(rows, protos).collect()}
    every = {r["label"]: r for r in memory.update_trusted(rows, protos, tail=10**9).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1]["updates"] > 4 * memory.rows_that_count() and found[2]["updates"] > 20
    for label, row in found.items():
        assert (row["n"], row["updates"]) == (every[label]["n"], every[label]["updates"])
        assert np.allclose(row["proto"], every[label]["proto"], rtol=0, atol=1e-14)
    assert (found[3]["n"], found[3]["updates"], found[4]["n"], found[4]["updates"]) == (1, 1, 2, 0)
    assert np.allclose(found[3]["proto"], unit(np.array(next(r["z"] for r in rows.where("seq = 8992").collect()))))


def test_class_with_most_rows_is_many_tasks(spark, batch):
    rows, _ = batch
    assert memory._newest(rows, 10).groupBy("label").count().where("label = 1").first()["count"] == 10
    plan = memory._newest(rows, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "pmod" in plan
    seqs = {r["seq"] for r in memory._newest(rows, 10).where("label = 1").collect()}
    assert seqs == set(range(5990, 6000))


def test_empty_tables(batch):
    rows, protos = batch
    still = {r["label"]: r for r in memory.update_trusted(rows.limit(0), protos).collect()}
    assert len(still) == 4 and still[1]["n"] == 10 and still[3]["proto"] is None and all(r["updates"] == 0 for r in still.values())
    assert memory.update_trusted(rows, protos.where(F.lit(False))).count() == 0
