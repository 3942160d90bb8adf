"""Exact nearest neighbours that skip what a bound excludes.

Training rows are dealt to the nearest of a few hundred pivots. A pivot's rows lie within the angle r of it, so a test row at the angle d from the pivot has no similarity above
cos(d - r) there. Each test row is first compared with the rows of its own pivot; the k-th best of these then excludes every pivot that cannot reach it. Copies or a dense region
may make one pivot's rows most of the table: these are dealt into as many blocks as they fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators.embeddings import BLOCK_TEST, BLOCK_TRAIN, _top, matrix
from tideway.operators.features import unit
from tideway.storage import kept

PIVOTS, SAMPLE_PER_PIVOT, ROUNDS = 256, 16, 5  # the driver holds a sample of PIVOTS * SAMPLE_PER_PIVOT vectors
SLACK = 1e-7  # above the error of angles in double precision


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def chosen_pivots(train: DataFrame, pivots: int) -> np.ndarray:
    """At most ``pivots`` directions: means of a sample's nearest rows, from the rows with the smallest hashes. Any directions give right neighbours; these skip more."""
    sample = train.select("z").orderBy(F.xxhash64("id"), "id").limit(pivots * SAMPLE_PER_PIVOT).toArrow()
    rows = np.unique(matrix(sample.column("z")), axis=0)
    centres = rows[np.linspace(0, len(rows) - 1, min(pivots, len(rows))).astype(int)] if len(rows) else rows
    for _ in range(ROUNDS if len(centres) else 0):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        found = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(found[:, None], sums, centres)
        centres = centres / _lengths(centres)
    return centres


def _placed(rows: DataFrame, centres: np.ndarray, columns: str) -> DataFrame:
    """``rows`` with ``home``, the most similar pivot, and the ``angle`` to it."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = matrix(pa.chunked_array([batch.column("z")])) @ centres.T
                home = sims.argmax(axis=1)
                angle = np.arccos(np.clip(sims[np.arange(len(home)), home], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(angle)], [*batch.schema.names, "home", "angle"])

    return rows.mapInArrow(placed, f"{columns}, home int, angle double")


def _reachable(rows: DataFrame, centres: np.ndarray, radius: np.ndarray) -> DataFrame:
    """``(test_id, z, homes)``: the pivots other than its own that may hold rows as similar as the row's k-th best, ``least``."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = np.arccos(np.clip(matrix(pa.chunked_array([batch.column("z")])) @ centres.T, -1.0, 1.0))
                most = np.cos(np.maximum(0.0, angle - radius)) + SLACK
                near = most >= batch.column("least").to_numpy()[:, None]
                near[np.arange(len(near)), batch.column("home").to_numpy()] = False
                homes = pa.ListArray.from_arrays(pa.array(np.r_[0, near.sum(axis=1).cumsum()], pa.int32()), pa.array(np.nonzero(near)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("test_id"), batch.column("z"), homes], ["test_id", "z", "homes"])

    return rows.mapInArrow(reached, "test_id long, z array<double>, homes array<int>")


def _compared(train: DataFrame, blocks: dict[int, int], tests: DataFrame, counts: dict[int, int], k: int, block_test: int) -> DataFrame:
    """The k most similar training rows of each block for the test rows ``(test_id, z, home)`` sent to it; ``blocks`` and ``counts`` by home, at most one entry a pivot."""
    sizes = [(home, n, -(-counts[home] // block_test)) for home, n in blocks.items() if counts.get(home)]

    def dealt(rows: DataFrame, row_id: str, own: str, n_own: str, other: str, n_other: str):
        by_home = F.broadcast(train.sparkSession.createDataFrame(sizes, "home int, __blocks int, __groups int"))
        every = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        return rows.join(by_home, "home").withColumns({own: F.pmod(F.xxhash64(row_id), F.col(n_own)).cast("int"), other: every}).groupBy("home", "__block", "__group")

    left = dealt(train, "id", "__block", "__blocks", "__group", "__groups")
    right = dealt(tests, "test_id", "__group", "__groups", "__block", "__blocks")
    return left.cogroup(right).applyInArrow(_top(k), "test_id long, train_id long, label long, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("test_id").orderBy(F.desc("sim"), "train_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_pruned(train: DataFrame, test: DataFrame, k: int = 5, pivots: int = PIVOTS, block_train: int = BLOCK_TRAIN, block_test: int = BLOCK_TEST) -> tuple[DataFrame, float]:
    """The rows of :func:`tideway.operators.embeddings.knn`, and the share of (test row, training row) pairs that were not compared.

    Rows without a vector take no part; zero vectors have similarity 0 to all. The driver reads the sample and a row per pivot.
    """
    spark = train.sparkSession
    a = train.where("z is not null").select(F.col("id").cast("long"), F.col("label").cast("long"), unit(F.col("z")).alias("z"))
    b = test.where("z is not null").select(F.col("id").cast("long").alias("test_id"), unit(F.col("z")).alias("z"))
    centres = chosen_pivots(a, pivots)
    if not len(centres):
        return spark.createDataFrame([], "test_id long, train_id long, label long, sim double, rank int"), 0.0
    a = kept(_placed(a, centres, "id long, label long, z array<double>"))
    homes = a.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("home").collect()  # at most one row a pivot
    used = np.array([r["home"] for r in homes])
    centres, radius = centres[used], np.array([r["radius"] for r in homes])
    a = a.join(F.broadcast(spark.createDataFrame(list(enumerate(used.tolist())), "place int, home int")), "home").select("id", "label", "z", F.col("place").alias("home"))
    rows = {place: r["n"] for place, r in enumerate(homes)}
    blocks = {place: -(-n // block_train) for place, n in rows.items()}

    def counted(tests: DataFrame) -> dict[int, int]:
        return {r["home"]: r["n"] for r in tests.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most one row a pivot

    b = kept(_placed(b, centres, "test_id long, z array<double>"))
    own = counted(b)
    first = kept(_ranked(_compared(a, blocks, b.select("test_id", "z", "home"), own, k, block_test), k))
    least = first.groupBy("test_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
    bounded = b.join(least, "test_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    others = kept(_reachable(bounded.select("test_id", "z", "home", "least"), centres, radius).where(F.size("homes") > 0))
    asked = others.select("test_id", "z", F.explode("homes").alias("home"))
    more = counted(others.select(F.explode("homes").alias("home")))
    found = _ranked(first.drop("rank").unionByName(_compared(a, blocks, asked, more, k, block_test)), k)
    compared = sum(rows[home] * (own.get(home, 0) + more.get(home, 0)) for home in rows)
    every = sum(rows.values()) * sum(own.values())
    return found, 1.0 - compared / every if every else 0.0
