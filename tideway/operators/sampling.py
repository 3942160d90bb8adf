"""Reproducible sampling and splitting: every choice follows a hash of the row's id, never a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.labels import stable_hash
from tideway.storage import kept

_STRETCHES = 12  # bits: the hash order of a group is dealt to this many tasks, as a power of two


def ranked(rows: DataFrame, groups: list[str], key: Column, ids: list[str]) -> DataFrame:
    """Adds ``rank`` (from 1, by the 52-bit ``key``, then ids) and ``group_n`` within each group.

    In two levels: a group's order is cut into stretches of the key, so no task ever holds a whole group.
    """
    rows = rows.withColumn("__key", key).withColumn("__stretch", F.shiftright("__key", 52 - _STRETCHES))
    groups_on = [f"__g{i}" for i in range(len(groups))]
    rows = rows.withColumns({g: F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for g, c in zip(groups_on, groups, strict=True)})
    counts = rows.groupBy(*groups_on, "__stretch").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*groups_on)
    earlier = whole.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups_on, "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("group_n")
    )
    turn = F.row_number().over(Window.partitionBy(*groups_on, "__stretch").orderBy("__key", *ids))
    return (
        rows.join(starts, [*groups_on, "__stretch"])
        .withColumn("rank", F.col("__start") + turn)
        .drop(*groups_on, "__stretch", "__start", "__key")
    )


def balanced_sample(rows: DataFrame, group: str, k: int, ids: list[str], seed: int = 42, unknown: str | None = "unknown") -> DataFrame:
    """The k rows of each group with the smallest keys. Each partition keeps its own k before anything is shuffled."""
    known = rows if unknown is None else rows.where(F.col(group).cast("string") != unknown)
    w = Window.partitionBy(group).orderBy(stable_hash(F.lit(seed), *map(F.col, ids)), *ids)
    return known.withColumn("__turn", F.row_number().over(w)).where(F.col("__turn") <= k).drop("__turn")


def uniform_sample(rows: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """The n rows with the smallest keys: a heap in each partition, then a merge."""
    return rows.orderBy(stable_hash(F.lit(seed), *map(F.col, ids)), *ids).limit(n)


def stratified_split(rows: DataFrame, label: str, fraction: float, ids: list[str], seed: int = 42) -> DataFrame:
    """Adds ``split``: per label ``max(1, round-half-even(n * fraction))`` rows are ``test``, none of a single row."""
    found = ranked(rows, [label], stable_hash(F.lit(seed), *map(F.col, ids)), ids)
    n_test = F.when(F.col("group_n") > 1, F.greatest(F.lit(1), F.bround(F.col("group_n") * F.lit(float(fraction))))).otherwise(0)
    return found.withColumn("split", F.when(F.col("rank") <= n_test, "test").otherwise("train")).drop("rank", "group_n")


def hash_split(rows: DataFrame, fraction: float, ids: list[str], seed: int = 42) -> DataFrame:
    """Adds ``split`` by the key alone: no shuffle, shares hold on average."""
    test = stable_hash(F.lit(seed), *map(F.col, ids)) < F.lit(int(fraction * (1 << 52)))
    return rows.withColumn("split", F.when(test, "test").otherwise("train"))


def stratified_cap(rows: DataFrame, label: str, limit: int, ids: list[str], seed: int = 42) -> DataFrame:
    """At most ``limit`` rows: an equal number per label, topped up at random from the rest, cut in label order."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    total, labels = sizes.agg(F.sum("n"), F.count("*")).first()
    if not total or total <= limit:
        return rows
    by_label = kept(ranked(rows, [label], stable_hash(F.lit(seed), *map(F.col, ids)), ids))  # read twice
    each = max(1, limit // labels)
    first = by_label.where(F.col("rank") <= each)
    missing = limit - (sizes.agg(F.sum(F.least("n", F.lit(each)))).first()[0] or 0)
    if missing <= 0:
        return first.orderBy(label, "rank").limit(limit).drop("rank", "group_n")
    rest = by_label.where(F.col("rank") > each).orderBy(stable_hash(F.lit(seed), *map(F.col, ids)), *ids).limit(missing)
    return first.unionByName(rest).drop("rank", "group_n")


def assert_min_rows(rows: DataFrame, least: int = 20) -> DataFrame:
    found = rows.limit(least).count()
    if found < least:
        raise ValueError(f"{found} rows; at least {least} are needed")
    return rows


def shuffled_batches(rows: DataFrame, size: int, ids: list[str], epoch: int = 0) -> DataFrame:
    """Adds ``batch``: rows in hashed order, ``size`` at a time; another epoch has another order."""
    found = ranked(rows, [], stable_hash(F.lit(f"epoch{epoch}"), *map(F.col, ids)), ids)
    return found.withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank", "group_n")
