"""Hard-negative mining: Strassen products of integer tiles, and heaps that merge.

Vectors are made integers, ``floor(scale * x)``, so that every score is an exact inner product. Anchors meet candidates in tiles. A tile's scores
are one matrix product by Strassen's recursion: an odd side gets a row or column of zeros, a product of halves takes seven products
instead of eight, and all additions are of 64-bit integers. A pass over tiles of equal label fills a heap of the best positives of each anchor; they fix
the window of scores that each positive's negatives may have, and a second pass over all tiles fills a heap for each of these windows.

Candidates are dealt into strips. A task takes a block of anchors through a strip, tile by tile, and returns one heap of bounded size an
anchor (or window); heaps of the same owner are merged as they come, sorted by owner, so that neither a hot label nor the number of strips makes a
task hold more than one heap and a batch.

Defined results: rows whose id, label or vector is null, or whose vector has a null or non-finite component (before or after scaling), take no part; vectors that are shorter
than others count as if they ended in zeros; every row with a repeated id is an anchor and a candidate of its own, and is another row to its
twins; equal scores go to the smaller id; an anchor without a positive has no result, a positive without a negative in its window neither; pairs
whose score does not fit 64 bits are left out (where values are so large that this can happen, Python's integers take the
place of 64-bit ones); an empty table gives an empty result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.runtime import cut

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # hundredths of the positive's score between which a negative's lies
SCALE = 256
LEAF = 16  # a side of at most so many rows or columns is multiplied directly
TILE_ANCHORS, TILE_CANDIDATES = 256, 2048
BLOCK, STRIP = 32_768, 32_768  # anchors of a block, candidates of a strip: what a task holds of either side
_LONGEST = (1 << 63) - 1


def _filled(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The matrix with rows and columns of zeros at its ends."""
    out = np.zeros((rows, columns), dtype=x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of two integer matrices with rows of equal length."""
    m, k, n = *a.shape, len(b)
    if not m * k * n:
        return np.zeros((m, n), dtype=a.dtype)
    if min(m, k, n) <= leaf:
        return a @ b.T
    if m % 2 or k % 2 or n % 2:
        return strassen(_filled(a, m + m % 2, k + k % 2), _filled(b, n + n % 2, k + k % 2), leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]  # of b.T
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), dtype=p1.dtype)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers as an integer matrix, short rows filled with zeros; Python's integers where 64 bits might not do."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out.astype(np.int64) if np.abs(flat).max(initial=0.0) < 2.0**62 else np.array([[int(x) for x in row] for row in out], dtype=object)


def tile_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices, exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (_filled(x, len(x), width) for x in (a, b))
    if a.dtype != object and b.dtype != object and width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) <= _LONGEST:
        return strassen(a, b)
    return strassen(a.astype(object), b.astype(object))


class Heap:
    """The best ``most`` of the scores offered, higher first, equal ones by the smaller id."""

    __slots__ = ("most", "scores", "ids")

    def __init__(self, most: int, scores: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.most = most
        self.scores = np.zeros(0, np.int64) if scores is None else scores
        self.ids = np.zeros(0, np.int64) if ids is None else ids

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Also merges: the entries of another heap are offered like any others."""
        if len(self.scores) == self.most:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        if not len(scores):
            return
        if len(scores) > self.most:
            near = scores >= np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def _tiles(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]


def _fitting(scores: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as 64-bit integers, and which of the pairs asked for have one that fits."""
    if scores.dtype != object:
        return scores, other
    fits = np.array([[-_LONGEST <= x <= _LONGEST for x in row] for row in scores], dtype=bool).reshape(scores.shape)
    return np.where(fits, scores, 0).astype(np.int64), other & fits


class _Side:
    """One side of a group: rows' numbers, ids and labels, and the integer matrix."""

    def __init__(self, table: pa.Table):
        self.row, self.vec_id, self.label = (table.column(n).to_numpy() for n in ("row", "vec_id", "label"))
        self.x = _integers(table.column("v").combine_chunks())


_HEAPS = "owner long, place int, anchor_id long, positive_id long, positive_score long, scores array<long>, ids array<long>"
_NAMES = [field.split()[0] for field in _HEAPS.split(", ")]
_LISTS = pa.list_(pa.int64())
_SCHEMA = pa.schema([*((n, pa.int32() if n == "place" else pa.int64()) for n in _NAMES[:5]), ("scores", _LISTS), ("ids", _LISTS)])


def _heap_table(rows: list[tuple]) -> pa.Table:
    """Heaps that hold something, as rows (owner, place, anchor_id, positive_id, positive_score, heap)."""
    held = [(*r[:5], r[5].scores, r[5].ids) for r in rows if len(r[5].scores)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True) if held else [[]] * 7, _SCHEMA, strict=True)], schema=_SCHEMA)


def _positives(most: int):
    """The best rows of an anchor's label in a strip, one heap an anchor."""

    def found(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        a, c = _Side(anchors), _Side(candidates)
        heaps = [Heap(most) for _ in a.row]
        for label in np.intersect1d(a.label, c.label):
            own, others = np.flatnonzero(a.label == label), np.flatnonzero(c.label == label)
            for rows in _tiles(own, TILE_ANCHORS):
                for columns in _tiles(others, TILE_CANDIDATES):
                    other = a.row[rows][:, None] != c.row[columns][None]
                    scores, other = _fitting(tile_scores(a.x[rows], c.x[columns]), other)
                    for i, row in enumerate(rows):
                        heaps[row].offer(scores[i, other[i]], c.vec_id[columns][other[i]])
        return _heap_table([(int(r), 0, int(v), None, None, h) for r, v, h in zip(a.row, a.vec_id, heaps, strict=True)])

    return found


def _window(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores between ``least`` and ``most`` hundredths of a score; none where the first is above the second."""
    return -(-least * score // 100), most * score // 100


def _negatives(most: int, least_share: int, most_share: int):
    """The best rows of other labels in a strip within each positive's window, one heap a positive."""

    def found(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        a, c = _Side(anchors), _Side(candidates)
        positives = list(zip(anchors.column("scores").to_pylist(), anchors.column("ids").to_pylist(), strict=True))
        windows = [[_window(s, least_share, most_share) for s in scores] for scores, _ in positives]
        heaps = [[Heap(most) for _ in scores] for scores, _ in positives]
        for rows in _tiles(np.arange(len(a.row)), TILE_ANCHORS):
            for columns in _tiles(np.arange(len(c.row)), TILE_CANDIDATES):
                scores, other = _fitting(tile_scores(a.x[rows], c.x[columns]), a.label[rows][:, None] != c.label[columns][None])
                for i, row in enumerate(rows):
                    widest = (scores[i] >= min(w[0] for w in windows[row])) & (scores[i] <= max(w[1] for w in windows[row])) & other[i]
                    near, ids = scores[i, widest], c.vec_id[columns][widest]
                    for heap, (low, high) in zip(heaps[row], windows[row], strict=True):
                        inside = (near >= low) & (near <= high)
                        heap.offer(near[inside], ids[inside])
        rows = [(int(a.row[i]), j, int(a.vec_id[i]), ids[j], scores[j], heaps[i][j]) for i, (scores, ids) in enumerate(positives) for j in range(len(ids))]
        return _heap_table(rows)

    return found


def _merged(heaps: DataFrame, most: int) -> DataFrame:
    """One heap an owner and place: rows are sorted by them, and each task holds the heap it is merging and a batch."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, None
        for batch in batches:
            done, columns = [], [batch.column(n).to_pylist() for n in _NAMES[:5]]
            lists = []
            for name in ("scores", "ids"):
                column = batch.column(name)
                flat, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
                lists.append(np.split(flat, ends[:-1]))
            for key, scores, ids in zip(zip(*columns, strict=True), *lists, strict=True):
                if now is None or key[:2] != now[:2]:
                    if now is not None:
                        done.append((*now, heap))
                    now, heap = key, Heap(most)
                heap.offer(scores, ids)
            if done:
                yield from _heap_table(done).to_batches()
        if now is not None:
            yield from _heap_table([(*now, heap)]).to_batches()

    return heaps.repartition("owner").sortWithinPartitions("owner", "place").mapInArrow(merged, _HEAPS)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(row, vec_id, label, v)`` of the rows that take part: a number of their own, and components ``floor(scale * x)`` as whole doubles."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes, flat = pc.list_value_length(column).to_numpy(), column.flatten()
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # a null component is nan
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~np.isfinite(x), len(sizes)) > 0
            x = x[np.repeat(~bad, sizes)]
            offsets = np.concatenate(([0], np.cumsum(sizes[~bad]))).astype(np.int32)
            keep = pa.array(~bad)
            arrays = [batch.column("vec_id").filter(keep), batch.column("label").filter(keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "v"])

    named = [F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v")]
    rows = vectors.select(*named).where("vec_id is not null and label is not null and v is not null")
    rows = rows.mapInArrow(whole, "vec_id long, label long, v array<double>")
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows where ``is_anchor`` (over ``vec_id``) holds. For each of an anchor's ``positives`` best other rows of its label: the
    ``negatives`` best rows of other labels whose score is between ``least`` and ``most`` hundredths of the positive's.
    """
    rows = integer_vectors(vectors, vec_id, label, embedding, scale)
    anchors, spark = rows.where(is_anchor), vectors.sparkSession
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    # Each side's rows are dealt to all parts of the other. Strips are at least so many that all cores have some.
    strips, blocks = max(-(-n // STRIP), 4 * spark.sparkContext.defaultParallelism), max(1, -(-n_anchors // BLOCK))

    def dealt(side: DataFrame, own: str, n_own: int, other: str, n_other: int):
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return side.withColumns({own: F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int"), other: every}).groupBy("block", "strip")

    candidates = dealt(rows, "strip", strips, "block", blocks)
    met = dealt(anchors, "block", blocks, "strip", strips).cogroup(candidates)
    best = _merged(met.applyInArrow(_positives(positives), _HEAPS), positives)
    served = cut(anchors.join(best.select(F.col("owner").alias("row"), "scores", "ids"), "row"))
    met = dealt(served, "block", blocks, "strip", strips).cogroup(candidates)
    found = _merged(met.applyInArrow(_negatives(negatives, least, most), _HEAPS), negatives)
    each = found.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.arrays_zip("scores", "ids")).alias("at", "x"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("negative_id"), "positive_score", F.col("x.scores").alias("negative_score"))
