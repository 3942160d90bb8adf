"""Bounded memories of embeddings per class, and prototypes that follow trusted rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators.embeddings import nearest_prototype, prototypes
from tideway.operators.features import unit

NEWEST, SAMPLE = 512, 2048
TRUST, MOMENTUM = 0.75, 0.95


def newest_per_class(rows: DataFrame, n: int = NEWEST, order: str = "seq") -> DataFrame:
    """The newest n rows of each label, vectors at unit length; partitions keep their own n before the shuffle."""
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(order)))
    return rows.withColumn("__turn", turn).where(F.col("__turn") <= n).drop("__turn").withColumn("z", unit(F.col("z")))


def sample_memory(memory: DataFrame, first_seen: DataFrame, most: int = SAMPLE, order: str = "seq") -> DataFrame:
    """Rows by class in the order the classes were first seen ``(label, first)``, oldest first, up to ``most``."""
    return memory.join(first_seen, "label").orderBy("first", order).limit(most).drop("first")


def bootstrap(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, proto, n)`` for every label of the table ``labels``; absent classes have n 0 and no vector."""
    return labels.join(prototypes(rows), "label", "left").select("label", "proto", F.coalesce("n", F.lit(0)).alias("n"))


def nearest(rows: DataFrame, protos: DataFrame) -> DataFrame:
    """Adds ``pred`` and ``sim`` among classes with rows; with none, class 0 and similarity 0."""
    found = nearest_prototype(rows, protos.where("n > 0"))
    return found.withColumns({"pred": F.coalesce("pred", F.lit(0)), "sim": F.coalesce("sim", F.lit(0.0))})


_PARTS = 16  # tasks that look for the newest rows of one class
_MOVED = pa.schema([("label", pa.int64()), ("moved", pa.list_(pa.float64()))])


def rows_that_count(trust: float = TRUST, momentum: float = MOMENTUM, tolerance: float = 2.0**-53) -> int | None:
    """How many of a class's newest trusted rows fix its prototype to ``tolerance``; None where no number of rows can be proved enough.

    An update takes p to v / |v| with v = m p + (1 - m) z, where z and p have length one. Let q be the prototype before the batch. All rows have z q >= t, the trust,
    and so have all prototypes on the way, as v q >= t (m + 1 - m) and |v| <= 1. Two prototypes that take the same update come closer, along their arc, by at least
    m / |v|. Write a for p q before and a' after the update: |v| = (m a + (1 - m) z q) / a', so over n updates the factors have the product
    (last a / first a) times the product of m a / (m a + (1 - m) z q) <= (1 / t) (m / (m + (1 - m) t))^n. Starts in the cone are 2 arccos(t) apart at most.
    Rounding errors shrink in the same way. Without trust (t <= 0) the factors have no bound below one.
    """
    if trust <= 0.0 or momentum >= 1.0:
        return None
    if momentum <= 0.0:
        return 1
    apart = 2.0 * math.acos(min(1.0, trust)) / trust
    shrink = momentum / (momentum + (1.0 - momentum) * trust)
    return max(1, math.ceil(math.log(max(apart, tolerance) / tolerance) / -math.log(shrink)))


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """The n newest rows of each label, first within parts of it, so that a class with most of the rows is many tasks."""
    for keys in (["label", F.pmod(F.xxhash64("seq"), F.lit(_PARTS))], ["label"]):
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("z")))
        rows = rows.withColumn("__turn", turn).where(F.col("__turn") <= n).drop("__turn")
    return rows


def _fold(momentum: float):
    def moved(proto: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The prototype after all rows, in order. Each step scales to length one, so steps do not commute."""
        for z in rows:
            proto = momentum * proto + (1 - momentum) * z
            proto /= max(np.sqrt(proto @ proto), 1e-12)
        return proto

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by label and order; holds one class's prototype and a batch at a time."""
        label, proto = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([label], pa.int64()), pa.array([proto.tolist()], pa.list_(pa.float64()))], schema=_MOVED)

        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").to_numpy()
            z = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
            starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
            for start, end in zip(starts, [*starts[1:], len(labels)], strict=True):
                rows = z[start:end]
                if labels[start] != label:
                    if label is not None:
                        yield row()
                    label, known = int(labels[start]), batch.column("proto")[int(start)].as_py()
                    proto = np.array(known) if known else None
                if proto is None:
                    proto, rows = rows[0] / max(np.linalg.norm(rows[0]), 1e-12), rows[1:]
                proto = moved(proto, rows)
        if label is not None:
            yield row()

    return fold


def update_trusted(rows: DataFrame, protos: DataFrame, trust: float = TRUST, momentum: float = MOMENTUM, order: str = "seq", tail: int | None = None) -> DataFrame:
    """``(label, proto, n, updates)`` after a batch of rows ``(label, seq, z)``; prototypes have length one, as those of :func:`bootstrap`.

    Nearest prototypes are those before the batch. A row moves its class's prototype if they agree at a similarity of ``trust``;
    the first row of an empty class becomes its prototype, and the class's other rows wait for the next batch. A class's updates
    follow one another, each from the last, but only the newest can show in the result (:func:`rows_that_count`, or ``tail`` where given): these are
    found in many tasks and folded in one, all others are counted. Rows of one ``order`` follow one another by their vectors.
    """
    protos = protos.select(F.col("label").cast("long").alias("label"), "proto", F.col("n").cast("long").alias("n"))
    scored = nearest(rows.select(F.col("label").cast("long").alias("label"), F.col(order).alias("seq"), unit(F.col("z")).alias("z")), protos)
    joined = scored.join(protos.select("label", "n"), "label")
    trusted = joined.where((F.col("n") > 0) & (F.col("pred") == F.col("label")) & (F.col("sim") >= trust)).select("label", "seq", "z")
    turn = F.row_number().over(Window.partitionBy("label").orderBy("seq", "z"))
    seeds = joined.where("n = 0").withColumn("__turn", turn).where("__turn = 1").select("label", "seq", "z")
    counts = trusted.groupBy("label").agg(F.count("*").alias("updates")).unionByName(seeds.select("label", F.lit(1).cast("long").alias("updates")))
    most = rows_that_count(trust, momentum) if tail is None else tail
    moves = (trusted if most is None else _newest(trusted, most)).unionByName(seeds).join(protos.select("label", "proto"), "label")
    moved = moves.repartition("label").sortWithinPartitions("label", "seq", "z").mapInArrow(_fold(momentum), "label long, moved array<double>")
    updates = F.coalesce("updates", F.lit(0).cast("long"))
    found = protos.join(moved, "label", "left").join(counts, "label", "left")
    return found.select("label", F.coalesce("moved", "proto").alias("proto"), (F.col("n") + updates).alias("n"), updates.alias("updates"))
