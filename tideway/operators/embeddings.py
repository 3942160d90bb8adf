"""Evaluation of embeddings over tables ``(id, z, label, ...)``: similarity, neighbours, prototypes, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.labels import let
from tideway.operators.features import unit
from tideway.storage import kept

MOST_BROADCAST = 64  # prototypes that a row is compared with one by one; more are met in block products
BLOCK_TRAIN, BLOCK_TEST = 16_384, 2_048
MOST_CELLS = 1 << 21  # similarities of a block of neighbours that are held at a time, 16 MB

# The temperature of both softmax scores, and the margin score's target for equal pairs and bound for different ones.
TEMPERATURE, PAIR_TARGET, PAIR_MARGIN = 0.07, 0.75, 0.20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def embed(rows: DataFrame, encoder: Callable[[pa.RecordBatch], np.ndarray], keep: list[str]) -> DataFrame:
    """Batched scoring: ``keep`` columns and ``z``, the encoder's row for each input row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = pa.array(list(np.asarray(encoder(batch), dtype=np.float64)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], z], [*keep, "z"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(scored, f"{fields}, z array<double>")


def component_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, pos, s, n)``: sums of unit vectors by component; partial sums are made before the shuffle."""
    parts = rows.select(*keys, F.posexplode(unit(F.col("z"))).alias("pos", "x"))
    return parts.groupBy(*keys, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))


def pair_similarity(rows: DataFrame) -> DataFrame:
    """Mean cosine over pairs of equal label and of different label: ``(intra, inter)``, 0 where there is no pair.

    From sums alone: the vectors of a label have pair sum ``|S|^2 - sum |x|^2``.
    """
    by_label = component_sums(rows, ["label"])
    own = by_label.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("n"))
    lengths = rows.select("label", dot(unit(F.col("z")), unit(F.col("z"))).alias("q")).groupBy("label").agg(F.sum("q").alias("q"))
    own = own.join(lengths, "label").agg(
        F.sum(F.col("s2") - F.col("q")).alias("same"), F.sum("s2").alias("s2"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2")
    )
    whole = by_label.groupBy("pos").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all2"))
    joined = own.join(F.broadcast(whole), F.lit(True))  # one row each
    return joined.select(
        F.coalesce(F.try_divide("same", F.col("n2") - F.col("n")), F.lit(0.0)).alias("intra"),
        F.coalesce(F.try_divide(F.col("all2") - F.col("s2"), F.col("n") * F.col("n") - F.col("n2")), F.lit(0.0)).alias("inter"),
    )


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _grid(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_block: int, right_block: int):
    """Both sides dealt by a hash of their ids into blocks of about the given numbers of rows, cogrouped for every pair of blocks."""
    n_left, n_right = max(1, -(-left.count() // left_block)), max(1, -(-right.count() // right_block))

    def dealt(rows: DataFrame, row_id: str, own: str, n: int, other: str, n_other: int):
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return rows.withColumns({own: F.pmod(F.xxhash64(row_id), F.lit(n)).cast("int"), other: every}).groupBy("__left", "__right")

    return dealt(left, left_id, "__left", n_left, "__right", n_right).cogroup(dealt(right, right_id, "__right", n_right, "__left", n_left))


def _top(k: int, most_cells: int = MOST_CELLS):
    """The k most similar training rows of a block for each of its test rows; at most about ``most_cells`` similarities are held at a time."""

    def top(key: tuple, train: pa.Table, test: pa.Table) -> pa.Table:
        parts = []
        if train.num_rows and test.num_rows:
            ids, labels, tests = (t.column(n).to_numpy() for t, n in ((train, "id"), (train, "label"), (test, "test_id")))
            order = np.argsort(ids, kind="stable")  # so that the first of equal ones has the smaller id
            ids, labels = ids[order], labels[order]
            x, y = matrix(test.column("z")), matrix(train.column("z"))[order].T
            rows = max(1, most_cells // len(ids))
            for at in range(0, len(tests), rows):
                sims = x[at : at + rows] @ y
                last = np.partition(sims, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(sims), -np.inf)
                for i, test_id in enumerate(tests[at : at + rows]):
                    near = np.flatnonzero(sims[i] >= last[i])
                    near = near[np.argsort(-sims[i, near], kind="stable")[:k]]
                    parts.append((np.full(len(near), test_id), ids[near], labels[near], sims[i, near]))
        columns = map(np.concatenate, zip(*parts, strict=True)) if parts else ([], [], [], [])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("test_id", "train_id", "label", "sim"), columns, types, strict=True)})

    return top


def knn(train: DataFrame, test: DataFrame, k: int = 5, block_train: int = BLOCK_TRAIN, block_test: int = BLOCK_TEST) -> DataFrame:
    """``(test_id, train_id, label, sim, rank)``: the k most similar training rows, ties to the smaller id.

    Both sides are dealt into blocks; each pair of blocks is one matrix product that returns k rows a test row.
    """
    a = kept(train.select(F.col("id").cast("long"), F.col("label").cast("long"), unit(F.col("z")).alias("z")))
    b = kept(test.select(F.col("id").cast("long").alias("test_id"), unit(F.col("z")).alias("z")))
    found = _grid(a, b, "id", "test_id", block_train, block_test).applyInArrow(_top(k), "test_id long, train_id long, label long, sim double")
    rank = F.row_number().over(Window.partitionBy("test_id").orderBy(F.desc("sim"), "train_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """``(test_id, pred)``: the most common label among the neighbours, ties to the smallest."""
    counts = neighbours.groupBy("test_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("test_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))


def prototypes(rows: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """``(keys, proto, n)``: the mean of a class's unit vectors, at unit length."""
    sums = component_sums(rows, list(keys))
    found = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("x")))).alias("a"), F.max("n").alias("n"))
    return found.select(*keys, unit(F.transform("a", lambda p: p["x"])).alias("proto"), "n")


def _one_row(protos: DataFrame, most: int) -> DataFrame | None:
    """All prototypes in one row, to be broadcast; None if there are more than ``most``."""
    few = protos.limit(most + 1).count() <= most
    return F.broadcast(protos.agg(F.collect_list(F.struct("label", "proto")).alias("protos"))) if few else None


def nearest_prototype(rows: DataFrame, protos: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Adds ``pred`` and ``sim``: the most similar prototype (one row per class), ties to the smallest label.

    Up to ``most`` classes are broadcast; more are met in blocks, as matrix products.
    """
    protos = kept(protos.select(F.col("label").cast("long").alias("label"), "proto"))
    table = _one_row(protos, most)
    if table is not None:
        scored = rows.join(table, F.lit(True)).withColumn("__best", _best())
        return scored.withColumns({"pred": -F.col("__best")["minus"], "sim": F.col("__best")["sim"]}).drop("protos", "__best")
    numbered = kept(rows.withColumn("__row", F.monotonically_increasing_id()))
    near = knn(protos.select(F.col("label").alias("id"), "label", F.col("proto").alias("z")), numbered.select(F.col("__row").alias("id"), "z"), 1)
    near = near.select(F.col("test_id").alias("__row"), F.col("label").alias("pred"), "sim")
    return numbered.join(near, "__row", "left").drop("__row")


def _best() -> Column:
    """The most similar of ``protos`` and, negated, its label; the smallest label wins ties."""

    def among(z: Column) -> Column:
        return F.array_max(F.transform("protos", lambda p: F.struct(dot(z, p["proto"]).alias("sim"), (-p["label"]).alias("minus"))))

    return let(unit(F.col("z")), among)


def _untouched(key: tuple, rows: pa.Table, classes: pa.Table) -> pa.Table:
    """Each row's most similar class of a block among those that its group has no rows of; the smallest label wins ties."""
    names, types = ["row", "label", "sim"], [pa.int64(), pa.int64(), pa.float64()]
    if not rows.num_rows or not classes.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    order = np.argsort(classes.column("label").to_numpy(), kind="stable")
    labels = classes.column("label").to_numpy()[order]
    sims = matrix(rows.column("z")) @ matrix(classes.column("z"))[order].T
    own = rows.column("own").combine_chunks()
    owner, held = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy()), own.flatten().to_numpy()
    place = np.minimum(np.searchsorted(labels, held), len(labels) - 1)
    here = labels[place] == held
    sims[owner[here], place[here]] = -np.inf
    best = sims.argmax(axis=1)
    top = sims[np.arange(len(sims)), best]
    some = top > -np.inf
    return pa.table([rows.column("row").to_numpy()[some], labels[best[some]], top[some]], names=names)


def leave_one_group_out(rows: DataFrame, group: str = "app", block: int = BLOCK_TEST) -> DataFrame:
    """``(id, label, group, pred)``: each row's nearest prototype of all other groups' rows, ties to the smallest label.

    Leaving a group out changes the prototypes of its own labels alone. So there is one prototype a class, met in blocks as matrix products, where a row passes over
    the labels of its group; and one corrected prototype for each group and label that occur together, which the group's rows meet in a join. The better of
    the two wins. Rows that no prototype serves are left out.
    """
    inside = kept(component_sums(rows, [group, "label"]))

    def arrays(sums: DataFrame, *keys: str) -> DataFrame:
        whole = F.array_sort(F.collect_list(F.struct("pos", "s")))
        return sums.groupBy(*keys).agg(F.transform(whole, lambda p: p["s"]).alias("s"), F.max("n").alias("n"))

    def mean(s: Column, n: Column) -> Column:
        return unit(F.transform(s, lambda x: x / n))

    total = inside.groupBy("label", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    totals = kept(arrays(total, "label").select(F.col("label").cast("long").alias("label"), "s", "n"))
    own = arrays(inside, group, "label").select(group, F.col("label").cast("long").alias("label"), F.col("s").alias("own_s"), F.col("n").alias("own_n"))
    # What many rows meet one of is dealt by another key first, so that the join has exchanges of its own and a hot key can be split.
    met = own.join(totals.repartition(F.xxhash64("label")), "label").where("n > own_n")
    left = F.zip_with("s", "own_s", lambda x, y: x - y)
    corrected = met.select(group, "label", mean(left, F.col("n") - F.col("own_n")).alias("proto")).repartition(F.xxhash64(group))
    labels = own.groupBy(group).agg(F.sort_array(F.collect_list("label")).alias("own")).repartition(F.xxhash64(group))
    numbered = rows.select("id", "label", group, unit(F.col("z")).alias("z"), F.monotonically_increasing_id().alias("row"))
    numbered = kept(numbered.join(labels, group))

    classes = totals.select("label", mean(F.col("s"), F.col("n")).alias("z"))
    elsewhere = _grid(numbered.select("row", "z", "own"), classes, "row", "label", block, block).applyInArrow(_untouched, "row long, label long, sim double")
    at_home = numbered.select("row", "z", group).join(corrected, group).select("row", "label", dot(F.col("z"), F.col("proto")).alias("sim"))
    best = elsewhere.union(at_home).groupBy("row").agg(F.max(F.struct("sim", (-F.col("label")).alias("minus"))).alias("best"))
    return numbered.select("row", "id", "label", group).join(best, "row").select("id", "label", group, (-F.col("best.minus")).alias("pred"))


def invariance(base: DataFrame, twin: DataFrame) -> DataFrame:
    """Mean inner product of a flow's embedding with its augmented twin's: ``(score)``."""
    joined = base.select("id", F.col("z").alias("a")).join(twin.select("id", F.col("z").alias("b")), "id")
    return joined.agg(F.coalesce(F.avg(dot(F.col("a"), F.col("b"))), F.lit(0.0)).alias("score"))


def cross_covariance_score(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Mean square of the cross-covariances of two embeddings (divisor n - 1): ``(score)``.

    Each partition sends one sum per pair of components.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(c).to_pylist(), dtype=np.float64) for c in ("a", "b"))
                x1, y1 = (np.hstack((m, np.ones((len(m), 1)))) for m in (x, y))
                total, n = x1.T @ y1 if total is None else total + x1.T @ y1, n + len(x)
        if total is not None:
            i, j = np.indices(total.shape)
            last_i, last_j = total.shape[0] - 1, total.shape[1] - 1
            i, j = np.where(i == last_i, -1, i), np.where(j == last_j, -1, j)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    table = rows.select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b")).mapInArrow(sums, "i int, j int, s double")
    table = table.groupBy("i", "j").agg(F.sum("s").alias("s"))
    xy = table.where("i >= 0 and j >= 0").withColumnRenamed("s", "xy")
    x = table.where("i >= 0 and j = -1").select("i", F.col("s").alias("x"))
    y = table.where("i = -1 and j >= 0").select("j", F.col("s").alias("y"))
    n = table.where("i = -1 and j = -1").select(F.col("s").alias("n"))
    covariance = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1.0))
    return xy.join(x, "i").join(y, "j").join(F.broadcast(n), F.lit(True)).agg(F.avg(covariance * covariance).alias("score"))  # n is one row


def _in_blocks(rows: DataFrame, function: Callable, schema: str, most: int) -> DataFrame:
    """``function(key, left, right)`` for every pair of parts of at most about ``most`` rows of every block of ``rows``."""
    z = kept(rows.select(F.col("block").cast("long").alias("block"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), unit(F.col("z")).alias("z")))
    sizes = z.groupBy("block").agg(F.ceil(F.count("*") / most).alias("parts")).repartition(F.xxhash64("block"))
    dealt = z.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))

    def side(own: str, other: str):
        renewed = [F.col(c).alias(c) for c in ("block", "id", "label", "z")]  # both sides come from one table
        return dealt.select(*renewed, F.col("own").alias(own), every.alias(other)).groupBy("block", "l", "r")

    left, right = side("l", "r"), side("r", "l")
    return left.cogroup(right).applyInArrow(function, schema)


def _product(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosines of all pairs, whether their labels agree, and whether they are different rows."""
    x, y = (matrix(side.column("z")) for side in (left, right))

    def compared(name: str) -> np.ndarray:
        return left.column(name).to_numpy()[:, None] == right.column(name).to_numpy()[None]

    return x @ y.T, compared("label"), ~compared("id")


def margin_score(rows: DataFrame, target: float = PAIR_TARGET, margin: float = PAIR_MARGIN, most: int = BLOCK_TEST) -> DataFrame:
    """Mean squared shortfall of equal pairs plus mean squared excess of different pairs, within blocks: ``(score)``."""

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["short", "n_short", "over", "n_over"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.float64())] * 4, names=names)
        sim, equal, other = _product(left, right)
        short, over = np.maximum(0.0, target - sim[equal & other]), np.maximum(0.0, sim[~equal & other] - margin)
        found = ((short * short).sum(), len(short), (over * over).sum(), len(over))
        return pa.table([pa.array([float(x)]) for x in found], names=names)

    parts = _in_blocks(rows, sums, "short double, n_short double, over double, n_over double", most)

    def mean(total: str, n: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(total), F.sum(n)), F.lit(0.0))

    return parts.agg((mean("short", "n_short") + mean("over", "n_over")).alias("score"))


def prototype_entropy(rows: DataFrame, protos: DataFrame, temperature: float = TEMPERATURE, most: int = MOST_BROADCAST, block: int = BLOCK_TEST) -> DataFrame:
    """Mean cross-entropy of the softmax over cosines with the prototypes: ``(score)``.

    Up to ``most`` prototypes are broadcast; more are met in blocks, as matrix products.
    """
    protos = kept(protos.select(F.col("label").cast("long").alias("label"), "proto"))
    table = _one_row(protos, most)
    if table is None:
        anchors = kept(rows.select(F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("label").cast("long").alias("label"), unit(F.col("z")).alias("z")))
        classes = protos.select(F.col("label").alias("memory_id"), "label", F.col("proto").alias("z"))
        terms = _merged(_grid(anchors, classes, "id", "memory_id", block, block).applyInArrow(_memory_terms(temperature), _TERM_FIELDS))
        return terms.agg(F.avg(F.log("e") + F.col("top") - F.when(F.col("n") > 0, F.col("own"))).alias("score"))
    scored = rows.join(table, F.lit(True))

    def logits(z: Column) -> Column:
        return F.transform("protos", lambda p: F.struct(p["label"].alias("label"), (dot(z, p["proto"]) / temperature).alias("v")))

    def entropy(values: Column) -> Column:
        own = F.get(F.filter(values, lambda x: x["label"] == F.col("label")), F.lit(0))["v"]
        top = F.array_max(F.transform(values, lambda x: x["v"]))
        return let(top, lambda t: F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x["v"] - t))) + t - own)

    return scored.agg(F.avg(let(let(unit(F.col("z")), logits), entropy)).alias("score"))


_TERMS = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("top", pa.float64()), ("own", pa.float64()), ("n", pa.int64()), ("e", pa.float64())])
_TERM_FIELDS = "block long, id long, top double, own double, n long, e double"


def _terms(anchors: pa.Table, v: np.ndarray, equal: np.ndarray, other: np.ndarray) -> pa.Table:
    """For each anchor with contrasts: the largest logit, the sum and number of those of its label, and the sum of exponentials below the largest."""
    v = np.where(other, v, -np.inf)
    some = other.any(axis=1)
    v, equal = v[some], (equal & other)[some]
    top = v.max(axis=1, initial=-np.inf)
    made = (top, np.where(equal, v, 0).sum(axis=1), equal.sum(axis=1), np.exp(v - top[:, None]).sum(axis=1))
    mask = pa.array(some)
    return pa.table([anchors.column("block").filter(mask), anchors.column("id").filter(mask), *map(pa.array, made)], schema=_TERMS)


def _memory_terms(temperature: float):
    def terms(key: tuple, anchors: pa.Table, memory: pa.Table) -> pa.Table:
        if not anchors.num_rows or not memory.num_rows:
            return _TERMS.empty_table()
        x, m = (matrix(side.column("z")) for side in (anchors, memory))
        equal = anchors.column("label").to_numpy()[:, None] == memory.column("label").to_numpy()[None]
        return _terms(anchors, x @ m.T / temperature, equal, np.ones_like(equal))

    return terms


def _merged(parts: DataFrame) -> DataFrame:
    """One row an anchor from its terms of all blocks."""
    highest = F.array_max(F.transform("parts", lambda p: p["top"]))
    summed = let(highest, lambda top: F.struct(top.alias("top"), F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["e"] * F.exp(p["top"] - top)).alias("e")))
    terms = parts.groupBy("block", "id").agg(F.collect_list(F.struct("top", "e")).alias("parts"), F.sum("own").alias("own"), F.sum("n").alias("n"))
    return terms.select("own", "n", summed.alias("all")).select("own", "n", "all.*")


def contrastive_score(
    rows: DataFrame, temperature: float = TEMPERATURE, memory: DataFrame | None = None, memory_id: str = "id", block: int = BLOCK_TEST
) -> DataFrame:
    """Supervised contrastive score within blocks: mean over anchors with a positive of -mean log-softmax over them: ``(score)``.

    Rows of ``memory`` ``(memory_id, label, z)`` are further contrasts of every anchor, and positives where labels agree. Anchors meet
    all contrasts in blocks, as matrix products that return one row an anchor. Without a positive for any anchor the score is 0.
    """

    def within(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _TERMS.empty_table()
        sim, equal, other = _product(left, right)
        return _terms(left, sim / temperature, equal, other)

    parts = _in_blocks(rows, within, _TERM_FIELDS, block)
    if memory is not None:
        own = kept(rows.select(F.col("block").cast("long"), F.col("id").cast("long"), F.col("label").cast("long"), unit(F.col("z")).alias("z")))
        held = kept(memory.select(F.col(memory_id).alias("memory_id"), F.col("label").cast("long"), unit(F.col("z")).alias("z")))
        parts = parts.unionByName(_grid(own, held, "id", "memory_id", block, block).applyInArrow(_memory_terms(temperature), _TERM_FIELDS))
    terms = _merged(parts)
    return terms.where("n > 0").agg(F.coalesce(F.avg(F.log("e") + F.col("top") - F.col("own") / F.col("n")), F.lit(0.0)).alias("score"))
