"""Approximate nearest neighbours by inner product: probed lists and an adaptive dimension scan.

Largest inner product is made nearest distance by one more dimension, ``sqrt(M^2 - |x|^2)`` with M the largest norm. Centroids
come from a bounded sample; every vector goes to the list of its nearest centroid, and a query probes the nearest lists, as many as
it takes to reach ``TARGET`` of the true neighbours of some hundred queries, which are compared with all vectors for it. The k-th best of those sample vectors that lie in the lists
probed bounds what any list need return. Within a list, vectors are rotated at random, so that any block of columns is an unbiased sample of a distance: after
each block of columns a hypothesis test drops the candidates whose scaled partial distance says, at the given strength, that
they are farther than the k-th found so far. Survivors are scored exactly, in double precision on the original
vectors.

A query for which fewer than k come back (the test dropped too many, or repeated ids took the places) is searched once more, in all lists,
without bound and test.

Lists are dealt as blocks of at most ``block`` candidates by ``query_block`` queries, so a list with a third of all vectors is
many tasks; each block returns k rows a query, and the k best are kept.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
a repeated id is found once, with its best score, and no row is a candidate for a query of its id; of several vectors under
one query's id the smallest is asked for (component by component); ties go to the smaller id; with k or
fewer candidates all are found; an empty table gives an empty result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.runtime import cut

SAMPLE, SAMPLE_SHARE = 20_000, 8  # vectors at most, and at most one in so many (but 256)
MAX_LISTS = 1024
LEAST_LISTS = 16
TARGET = 0.97  # of the true neighbours of the trial queries, for the number of lists probed
TRIALS = 256  # queries that the number is found on
COLUMNS = 16
STRENGTH = 1.5  # of the test, in standard deviations of a partial distance
BLOCK, QUERY_BLOCK = 8192, 1024
SEED = 11


def _usable(rows: DataFrame) -> DataFrame:
    """Rows ``(vec_id, v)`` with vectors in double precision that can take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _norm2() -> Column:
    return F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lift(x: np.ndarray, most2: float) -> np.ndarray:
    """Vectors with the dimension that makes inner products distances."""
    return np.hstack((x, np.sqrt(np.maximum(most2 - (x * x).sum(axis=1, keepdims=True), 0))))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = min(lists, len(x))
    centroids = x[np.sort(rng.choice(len(x), lists, replace=False))]
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=lists)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def adaptive_scan(q: np.ndarray, blocks: list[np.ndarray], k: int, far: float = np.inf, strength: float = STRENGTH) -> np.ndarray:
    """Places of the candidates that are left after all column blocks: within ``far``, and about the k nearest."""
    n, size = len(blocks[0]), sum(b.shape[1] for b in blocks)
    head = min(n, 4 * k)
    if head >= k:
        at, known = 0, np.zeros(head)
        for b in blocks:
            part = b[:head] - q[at : at + b.shape[1]]
            known += np.einsum("ij,ij->i", part, part)
            at += b.shape[1]
        far = min(far, np.partition(known, k - 1)[k - 1])
    alive, partial, at = np.arange(n), np.zeros(n), 0
    for b in blocks:
        part = (b if len(alive) == n else b[alive]) - q[at : at + b.shape[1]]
        partial = partial + np.einsum("ij,ij->i", part, part)
        at += b.shape[1]
        allowed = far * (1 + 1e-9) if at == size else far * (at / size) * (1 + strength / np.sqrt(at)) ** 2
        keep = partial <= allowed + 1e-9
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    if len(alive) > k:
        alive = alive[partial <= np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + 1e-9]
    return alive


def probes_needed(trials: np.ndarray, centroids: np.ndarray, asked: np.ndarray, lists: np.ndarray, target: float = TARGET) -> int:
    """Lists to probe so that ``target`` of the trials' true neighbours lie in them: neighbours are pairs of a trial's place and a list."""
    if not len(asked):
        return len(centroids)
    order = _distances(np.hstack((trials, np.zeros((len(trials), 1)))), centroids).argsort(axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None], axis=1)
    needed = np.sort(place[asked, lists])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def true_neighbours(members: DataFrame, ids: np.ndarray, trials: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of all ``members`` for each trial, as the trial's place and the neighbour's list. A task returns k rows a trial."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, list_ = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int32)
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                now = trials @ _matrix(part.column("v")).T
                now[ids[:, None] == part.column("vec_id").to_numpy()[None]] = -np.inf
                both = np.hstack((score, now))
                held = np.hstack((list_, np.broadcast_to(part.column("list").to_numpy(), now.shape)))
                near = np.argpartition(-both, k - 1, axis=1)[:, :k]
                score, list_ = np.take_along_axis(both, near, axis=1), np.take_along_axis(held, near, axis=1)
        place, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(list_[place, at]), pa.array(score[place, at])], ["trial", "list", "score"])

    rows = members.mapInArrow(best, "trial long, list int, score double")
    turn = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score")))
    table = rows.withColumn("turn", turn).where(F.col("turn") <= k).select("trial", "list").toArrow()  # TRIALS * k rows
    return table.column("trial").to_numpy(), table.column("list").to_numpy()


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and exact scores of the k best of some candidates, best first, ties to the smaller id, without the query's own."""
    other = ids != own
    ids, score = ids[other], (x[other] * q).sum(axis=1)
    order = np.lexsort((ids, -score))
    first = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
    return ids[first], score[first]


def _searched(k: int, most2: float, turn: np.ndarray, columns: int, strength: float | None):
    """Search of a block of candidates for a block of queries; without ``strength`` every candidate is scored."""

    def searched(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if candidates.num_rows and queries.num_rows:
            ids = candidates.column("vec_id").to_numpy()
            x = _matrix(candidates.column("v").combine_chunks())
            qs, qx = queries.column("query_id").to_numpy(), _matrix(queries.column("v").combine_chunks())
            bounds = queries.column("bound").to_numpy()
            lifted = lift(x, most2) @ turn
            blocks = [np.ascontiguousarray(lifted[:, a : a + columns]) for a in range(0, lifted.shape[1], columns)]
            turned = np.hstack((qx, np.zeros((len(qx), 1)))) @ turn
            far = (qx * qx).sum(axis=1) + most2 - 2 * bounds
            for i, query in enumerate(qs):
                if strength is None:
                    left = np.arange(len(ids))
                else:
                    left = adaptive_scan(turned[i], blocks, k + 1, far[i], strength)  # one more: the query's own row
                if len(left):
                    v, score = _best(qx[i], x[left], ids[left], k, query)
                    out.append((np.full(len(v), query), v, score))
        q, v, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], schema=_FOUND)

    return searched


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    target: float = TARGET,
    strength: float = STRENGTH,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row where ``is_query`` (over ``vec_id``) holds."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = _usable(rows.where("vec_id is not null"))
    width = rows.agg(F.mode(F.size("v"), True)).first()[0]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width is None:
        return empty
    rows = rows.where(F.size("v") == width)
    n, most2 = rows.agg(F.count("*"), F.max(_norm2())).first()
    lists = max(LEAST_LISTS, min(MAX_LISTS, round(n**0.5 / 4)))
    table = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, max(256, n // SAMPLE_SHARE))).select("vec_id", "v").toArrow()
    sample_ids, sample = table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks())
    centroids = kmeans(lift(sample, most2), lists)
    home = _distances(lift(sample, most2), centroids).argmin(axis=1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _distances(lift(_matrix(batch.column("v")), most2), centroids).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32())], ["vec_id", "v", "list"])

    members = cut(rows.mapInArrow(assigned, "vec_id long, v array<double>, list int"))
    sizes = np.zeros(len(centroids), dtype=np.int64)
    for r in members.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    some = queries.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(TRIALS).toArrow()
    trials = _matrix(some.column("v").combine_chunks())
    probes = probes_needed(trials, centroids, *true_neighbours(members, some.column("vec_id").to_numpy(), trials, k), target)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists to probe, with a score that the query's k-th best in them reaches at least."""
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                x, own = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
                order = _distances(np.hstack((x, np.zeros((len(x), 1)))), centroids).argsort(axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]  # vectors in nearer lists; too few: probe on
                taken = ((np.arange(len(centroids)) < probes) | (before <= 4 * k)) & (sizes[order] > 0)
                row, at = np.nonzero(taken)
                by_list = np.zeros_like(taken)
                by_list[row, order[row, at]] = True
                score = x @ sample.T
                score[(sample_ids[None] == own[:, None]) | ~by_list[:, home]] = -np.inf
                bound = np.partition(score, -k, axis=1)[:, -k] - 1e-9 if len(sample) >= k else np.full(len(x), -np.inf)
                arrays = [pa.array(own[row]), pa.array(order[row, at], pa.int32()), pa.array(bound[row])]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "list", "bound"])

    probing = cut(queries.mapInArrow(probed, "query_id long, list int, bound double"))
    own = queries.withColumnRenamed("vec_id", "query_id")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    def searched(probing: DataFrame, asked: dict[int, int], strength: float | None) -> DataFrame:
        """The k best of every query of ``probing`` (query_id, list, bound) in its lists."""
        parts = [(i, int(-(-sizes[i] // block)) or 1, -(-asked.get(i, 0) // query_block) or 1) for i in range(len(centroids))]
        cuts = F.broadcast(vectors.sparkSession.createDataFrame(parts, "list int, c_parts int, q_parts int"))  # at most MAX_LISTS rows
        c_part, q_part = F.pmod(F.xxhash64("vec_id"), "c_parts").cast("int"), F.pmod(F.xxhash64("query_id"), "q_parts").cast("int")
        left = members.join(cuts, "list").select("vec_id", "v", "list", c_part.alias("c"), every("q_parts").alias("q"))
        dealt = probing.join(cuts, "list").select("query_id", "list", "bound", q_part.alias("q"), every("c_parts").alias("c"))
        right = dealt.dropDuplicates(["query_id", "list", "q", "c"]).join(own, "query_id").select("query_id", "v", "bound", "list", "c", "q")
        key = ["list", "c", "q"]
        found = (
            left.groupBy(*key)
            .cogroup(right.groupBy(*key))
            .applyInArrow(_searched(k, most2, rotation(width + 1), COLUMNS, strength), "query_id long, vec_id long, score double")
        )
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    found = cut(searched(probing, asked, strength))
    full = found.where(F.col("rank") == k).select("query_id")
    short = cut(own.select("query_id").join(full, "query_id", "left_anti"))
    n_short = short.count()
    if not n_short:
        return found
    filled = [int(i) for i in np.flatnonzero(sizes)]
    everywhere = short.select("query_id", F.explode(F.array(*[F.lit(i) for i in filled])).alias("list"), F.lit(float("-inf")).alias("bound"))
    again = searched(everywhere, dict.fromkeys(filled, n_short), None)
    return found.join(short, "query_id", "left_anti").unionByName(again)
