"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.runtime import cut


def _met(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link with ``m`` of its node ``a``. A star's centre may be in a third of all links.

    ``least`` is dealt by a hash of its node first: the join then has an exchange of its own on either side, and adaptive execution
    can split a hot centre's links over tasks.
    """
    return links.join(least.repartition(F.xxhash64("a")), "a")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and all its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _met(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _met(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with a link; a component is named by its smallest node.

    ``links`` has two long columns ``a`` and ``b``; direction, repeats and self-links do not matter. Each round is
    two joins on the node and ends in a checkpoint, so neither the plan nor the driver grows with the links; the
    number of rounds grows with the logarithm of the longest chain.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
