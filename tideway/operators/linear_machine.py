"""Linear machines, one class against the rest: squared hinge loss, solved by Newton steps from sums that tasks send.

For each class the weights minimise ``|w|^2 / 2 + C * sum(max(0, 1 - y * (w . x))^2)`` with y = 1 for its rows and -1 for others, and a last component of x that is 1,
so the intercept is held down like any weight. The function is strictly convex and piecewise quadratic: the minimum is unique, and Newton's method ends at it
after finitely many steps. A step is one pass over the rows; a task sends, for each class, the loss, the gradient and the matrix of second derivatives of its rows. The driver holds one such matrix a
class and solves for the step; where a step does not lower the function enough it is halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.storage import kept

C, MAX_STEPS, TOLERANCE = 1.0, 5000, 1e-8
MOST_LABELS = 4_096  # each has a matrix of second derivatives
_ROWS = 2048  # multiplied at a time
_SUMS = "class int, i int, s array<double>"


@dataclass
class LinearMachine:
    """Weights ``(label, component)``, the intercept last; ``gradient`` is the largest norm of a class's gradient where the solver stopped."""

    labels: np.ndarray
    weights: np.ndarray
    gradient: float
    steps: int


def with_one(z: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as a matrix, with a last column of ones."""
    x = np.ones((len(z), width + 1))
    x[:, :-1] = z.flatten().to_numpy().reshape(len(z), width)
    return x


def loss_sums(x: np.ndarray, own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``(class, d + 2, d)`` of rows ``x`` of classes ``own``: second derivatives, the gradient, and the loss in the first cell of the last row (all without C)."""
    classes, d = weights.shape
    sums = np.zeros((classes, d + 2, d))
    score = x @ weights.T
    for k in range(classes):
        y = np.where(own == k, 1.0, -1.0)
        short = 1 - y * score[:, k]
        active = short > 0
        xs = x[active]
        sums[k, :d] = 2 * xs.T @ xs
        sums[k, d] = -2 * (y[active] * short[active]) @ xs
        sums[k, d + 1, 0] = short[active] @ short[active]
    return sums


def _pass(rows: DataFrame, weights: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function's values, gradients and second derivatives by class at the weights."""
    classes, d = weights.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, d + 2, d))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                total += loss_sums(with_one(part.column("z"), d - 1), part.column("class").to_numpy(), weights)
        place = np.indices((classes, d + 2)).reshape(2, -1).astype(np.int32)
        offsets = pa.array(np.arange(0, total.size + 1, d, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(place[0]), pa.array(place[1]), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["class", "i", "s"])

    parts = rows.mapInArrow(summed, _SUMS)
    cells = parts.select("class", "i", F.posexplode("s").alias("j", "x")).groupBy("class", "i", "j").agg(F.sum("x").alias("x"))
    table = cells.toArrow()  # classes * (d + 2) * d numbers
    sums = np.zeros((classes, d + 2, d))
    sums[tuple(table.column(n).to_numpy() for n in ("class", "i", "j"))] = table.column("x").to_numpy()
    value = (weights * weights).sum(axis=1) / 2 + c * sums[:, d + 1, 0]
    return value, weights + c * sums[:, d], np.eye(d) + c * sums[:, :d]


def fit_linear_machine(rows: DataFrame, c: float = C, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE, most_labels: int = MOST_LABELS) -> LinearMachine | None:
    """The machine of rows ``(label, z)``, or None without rows. Null labels and vectors are left out; vectors must have one length.

    Stops where the gradient's norm is at most ``tolerance`` in every class, or at what rounding leaves of it.
    """
    usable = rows.where("label is not null and z is not null").select(F.col("label").cast("long").alias("label"), F.col("z").cast("array<double>").alias("z"))
    found = usable.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").limit(most_labels + 1).collect()
    if not found:
        return None
    if len(found) > most_labels:
        raise ValueError(f"more than {most_labels} labels: raise most_labels, or train on fewer")
    width = usable.agg(F.max(F.size("z"))).first()[0]
    labels = np.array([r["label"] for r in found])
    if len(labels) == 1:  # nothing to tell apart
        return LinearMachine(labels, np.zeros((1, width + 1)), 0.0, 0)
    places = rows.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(labels)], "label long, class int")
    classed = kept(usable.join(F.broadcast(places), "label").select("class", "z"))  # at most most_labels places

    floor = 4 * np.finfo(float).eps * c * 2 * sum(r["n"] for r in found)  # of a sum of so many terms
    weights = np.zeros((len(labels), width + 1))
    value, gradient, curve = _pass(classed, weights, c)
    steps = 0
    while steps < max_steps:
        norms = np.linalg.norm(gradient, axis=1)
        going = norms > max(tolerance, floor)
        if not going.any():
            break
        move = np.where(going[:, None], -np.linalg.solve(curve, gradient[..., None])[..., 0], 0.0)
        slope = (move * gradient).sum(axis=1)
        share = np.ones(len(labels))
        while True:
            steps += 1
            new = weights + share[:, None] * move
            now = _pass(classed, new, c)
            high = going & (now[0] > value + 1e-4 * share * slope + floor * np.maximum(1, np.abs(value)))
            if not high.any() or share.min() < 1e-10:
                break
            share = np.where(high, share / 2, share)
        weights, (value, gradient, curve) = new, now
    return LinearMachine(labels, weights, float(np.linalg.norm(gradient, axis=1).max()), steps)


def classify(rows: DataFrame, machine: LinearMachine, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of rows, ``pred``, the label of the largest decision value (ties to the smallest label), and ``decision``, that value.

    Rows without a vector have neither.
    """
    width = machine.weights.shape[1] - 1
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z")
            some = z.is_valid().to_numpy(zero_copy_only=False)
            score = with_one(z.drop_null(), width) @ machine.weights.T
            best = score.argmax(axis=1) if len(score) else np.zeros(0, dtype=int)
            pred, decision = np.zeros(len(z), np.int64), np.zeros(len(z))
            pred[some], decision[some] = machine.labels[best], score[np.arange(len(score)), best]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(pred, mask=~some), pa.array(decision, mask=~some)], [*keep, "pred", "decision"])

    return rows.select(*keep, F.col("z").cast("array<double>").alias("z")).mapInArrow(scored, f"{fields}, pred long, decision double")
