"""The linear machine against its optimality conditions and a plain solver, and what it does with odd rows."""

import numpy as np
import pytest

from tideway.operators import linear_machine as lm

ROWS = "id long, label long, z array<double>"


def table(spark, labels, x, parts=3):
    return spark.createDataFrame([(i, None if y is None else int(y), None if v is None else [float(a) for a in v]) for i, (y, v) in enumerate(zip(labels, x, strict=True))], ROWS).repartition(parts)


def gradient(x, own, w, c):
    """Of one class, from the definition."""
    one = np.hstack((x, np.ones((len(x), 1))))
    y = np.where(own, 1.0, -1.0)
    return w - 2 * c * (y * np.maximum(0, 1 - y * (one @ w))) @ one


def descended(x, own, c, rounds=60_000):
    """The minimum by plain gradient steps."""
    w, length = np.zeros(x.shape[1] + 1), 1 + 2 * c * ((x * x).sum() + len(x))
    for _ in range(rounds):
        w = w - gradient(x, own, w, c) / length
    return w


@pytest.mark.parametrize("c", [1.0, 0.05])
def test_weights_are_the_minimum(spark, c):
    rng = np.random.default_rng(1)
    labels = rng.choice([-3, 0, 7], 240, p=[0.1, 0.3, 0.6])
    x = rng.normal(size=(240, 4)) + np.where(labels[:, None] == 7, 0.8, np.where(labels[:, None] == 0, [[0, -1.0, 0, 1]], 0))
    machine = lm.fit_linear_machine(table(spark, labels, x), c)
    assert machine.labels.tolist() == [-3, 0, 7] and machine.gradient <= 1e-8
    for label, w in zip(machine.labels, machine.weights, strict=True):
        assert np.linalg.norm(gradient(x, labels == label, w, c)) <= 2e-8
        assert w == pytest.approx(descended(x, labels == label, c), abs=1e-6)
    found = {r["id"]: r for r in lm.classify(table(spark, labels, x), machine, ["id", "label"]).collect()}
    score = np.hstack((x, np.ones((240, 1)))) @ machine.weights.T
    assert [found[i]["pred"] for i in range(240)] == machine.labels[score.argmax(axis=1)].tolist()
    assert [found[i]["decision"] for i in range(240)] == pytest.approx(score.max(axis=1).tolist())


def test_separable_and_hard_rows(spark):
    """Classes far apart, rows repeated many times, and one row against many: steps still end at the minimum."""
    x = np.array([[30.0, 1], [-30, 1], [0.01, 0]] + [[0.02, 0.0]] * 500)
    labels = [1, 2, 1] + [2] * 500
    machine = lm.fit_linear_machine(table(spark, labels, x))
    assert machine.gradient <= 1e-8 and machine.steps < 60
    assert np.linalg.norm(gradient(x, np.array(labels) == 1, machine.weights[0], 1.0)) <= 2e-8


def test_odd_rows(spark):
    assert lm.fit_linear_machine(table(spark, [], [])) is None
    one = lm.fit_linear_machine(table(spark, [4, None, 4], [[1, 2], [5, 5], None]))
    assert one.labels.tolist() == [4]
    found = lm.classify(table(spark, [1, 1], [[1, 2], None]), one, ["id"]).orderBy("id").collect()
    assert [r["pred"] for r in found] == [4, None]
    with pytest.raises(ValueError, match="labels"):
        lm.fit_linear_machine(table(spark, [1, 2, 3], [[1], [2], [3]]), most_labels=2)
    # Equal decisions go to the smaller label.
    twins = lm.fit_linear_machine(table(spark, [1, 2, 1, 2], [[1, 0], [1, 0], [0, 1], [0, 1]]))
    assert [r["pred"] for r in lm.classify(table(spark, [1], [[1, 0]]), twins, ["id"]).collect()] == [1]
