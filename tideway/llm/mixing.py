"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source queues its documents in a hashed order, pass after pass. A document's virtual finish time is its source's cumulative
words divided by the source's target, so at time one every source has delivered its target. The merged queue is
range-sorted by finish time and cut at the total budget.

The sort is two-level: finish times fall into fixed ranges whose sums give each range's start, and only the range
in which the budget runs out is sorted in itself. Cumulative words are two-level too: a source's hashed order has
1,024 stretches, so a source with a third of all rows is spread over as many groups.

Targets: sources by code point (null last) weigh ``weights`` in turn and share the budget, the total of all sizes; a target
stops at ``max_epochs`` times its source's size, and the excess is shared anew by weight. That is the level at which the sum of
``least(max_epochs * size, weight * level)`` equals the budget.

Defined results: a null text has size 0; a null source is a source; rows without an id queue by their text, null as empty; rows with the
same id and source, or without an id and with the same text, are taken together; very long texts are counted by one expression and stay where they are; equal finish times go by
source, hash and id; an empty table gives an empty result; extra input columns, whatever their names, are not read, and the stage hands them
on. The queue is cut at the last row that still fits the budget whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.runtime import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
STRETCH_BITS = 50  # of 60: 1,024 stretches
RANGES = 4096  # of finish time, for each unit
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A 60-bit key in which the documents of a source queue: by id, or by text where there is no id."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _source_key(source: str) -> Column:
    """A key without nulls that sorts like the source, null last."""
    return F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("2"))


def _source(key: str = "key") -> Column:
    return F.when(F.col(key) != "2", F.substring(F.col(key), 2, 1 << 30))


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows dealt by ranges of ``order``, numbered by ``part``; cut, so that whoever reads them sees the same ranges."""
    return cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def _sums_before(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``before_x``, the sum of x over all rows before in ``order``, and ``all_x``. Two-level: within ranges, and over the ranges' sums."""
    parts = rows.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns])  # a row per range
    earlier, everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"start_{c}") for c in columns]
    parts = parts.select("part", *starts, *[F.sum(c).over(everything).alias(f"all_{c}") for c in columns])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(parts, "part")
    return found.withColumns({f"before_{c}": F.col(f"start_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns})


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(key, source_size, target)`` from rows ``(key, size)``; one row per source. Sources may be many: they are dealt by ranges."""
    by_source = rows.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    placed = _sums_before(_ranges(by_source, "key"), ["key"], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("before_one"), F.lit(len(weights))) + 1).cast("int"))
    shares = placed.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("most"))
    shares = _ranges(shares.withColumn("ratio", F.col("most") / F.col("weight")), "ratio", "key")
    filling = _sums_before(shares, ["ratio", "key"], ["most", "weight", "source_size"])
    level = (F.col("all_source_size") - F.col("before_most")) / (F.col("all_weight") - F.col("before_weight"))
    # The first source, by the level at which it is full, that the rest of the budget does not fill sets the level.
    unfilled = filling.withColumn("level", level).where(F.col("level") <= F.col("ratio"))
    reached = unfilled.agg(F.min(F.struct("ratio", "key", "level"))["level"].alias("level"))
    target = F.least("most", F.coalesce(F.col("weight") * F.col("level"), "most"))
    return shares.join(F.broadcast(reached), F.lit(True)).select("key", "source_size", target.alias("target"))  # one row


def queue(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows ``(key, doc_id, size, r)`` with ``source_size``, ``target`` and ``queued``, their source's words up to them."""
    rows = rows.withColumn("stretch", F.shiftright("r", STRETCH_BITS))
    sums = rows.groupBy("key", "stretch").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "stretch", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")).join(targets, "key")
    within = Window.partitionBy("key", "stretch").orderBy("r", "doc_id")
    queued = F.col("start") + F.sum("size").over(within)
    return rows.join(starts, ["key", "stretch"]).withColumn("queued", queued).drop("start", "stretch")


def last_taken(queued: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source that delivers: the last row taken, ``(key, epoch, last_r, last_id)``, of the queue cut at the budget."""
    items = (
        queued.where("target > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(1, max_epochs + 1)])))
        .withColumn("finish", (F.col("queued") + (F.col("epoch") - 1) * F.col("source_size")) / F.col("target"))
        .withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)))
        .select("key", "doc_id", "r", "size", "epoch", "finish", "range")
    )
    budget = queued.agg(F.sum("size")).first()[0] or 0
    upto = Window.orderBy("range")  # at most 2 * RANGES + 1 rows
    sums = items.groupBy("range").agg(F.sum("size").alias("words")).withColumn("total", F.sum("words").over(upto))
    over = sums.where(F.col("total") > budget).agg(F.min(F.struct("range", (F.col("total") - F.col("words")).alias("before")))).first()[0]
    taken = items.drop("finish", "range")
    if over is not None:  # the budget runs out within this range
        running = F.sum("size").over(Window.partitionBy("range").orderBy("finish", "key", "r", "doc_id"))
        inside = items.where(F.col("range") == over["range"]).withColumn("running", running)
        inside = inside.where(F.col("running") + over["before"] <= budget).drop("running")
        taken = items.where(F.col("range") < over["range"]).unionByName(inside)
    last = F.max(F.struct("epoch", F.col("r").alias("last_r"), F.col("doc_id").alias("last_id"))).alias("last")
    return taken.groupBy("key").agg(last).select("key", "last.*")


def copies() -> Column:
    """How often the mix takes a row ``(r, doc_id)`` of a source whose last row taken is ``(epoch, last_r, last_id)``."""
    reached = F.struct(F.col("r"), F.col("doc_id")) <= F.struct(F.col("last_r").alias("r"), F.col("last_id").alias("doc_id"))
    return F.coalesce(F.col("epoch") - 1 + F.when(reached, 1).otherwise(0), F.lit(0))


def _rows(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    ids = (_source_key(source).alias("key"), F.col(doc_id).alias("doc_id"), shuffle_key(doc_id, text, seed).alias("r"))
    return docs.select(*ids, word_count(text).alias("size"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Every row of ``docs``: ``doc_id, source, size, source_size, target, taken``."""
    rows = cut(_rows(docs, doc_id, text, source, seed))
    queued = cut(queue(rows, source_targets(rows, weights, max_epochs)))
    taken = (F.col("size") * copies()).cast("long").alias("taken")
    found = queued.join(_checked(last_taken(queued, max_epochs)), "key", "left")
    return found.select("doc_id", _source().alias("source"), "size", "source_size", "target", taken)


def _checked(last: DataFrame) -> DataFrame:
    """Broadcast the table of one row per source where it is small; else it is joined like any other."""
    last = cut(last)
    return F.broadcast(last) if last.count() <= BROADCAST_SOURCES else last


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all their columns.

    Texts are not shuffled: they meet one row per source, the last one taken. Rows without words follow their source.
    """
    rows = cut(_rows(docs, doc_id, text, source, seed))
    queued = cut(queue(rows, source_targets(rows, weights, max_epochs)))
    ids = (_source_key(source).alias("key"), F.col(doc_id).alias("doc_id"), shuffle_key(doc_id, text, seed).alias("r"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *ids)
    found = keyed.join(_checked(last_taken(queued, max_epochs)), "key")
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")
