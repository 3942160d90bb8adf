"""Counts, quantiles and frequent values by sketches that are stored by day (or any key) and merged over days: bounded state where exact answers hold all distinct values.

The exact operators (``label_map``, ``summary_percentiles``, run summaries) stay; these serve tables that are too large to be read again for every
span of days. Sketches are binary columns of an ordinary table; merging two days gives what one pass over both would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DISTINCT_LOG2, QUANTILE_K, FREQUENT_DEPTH, FREQUENT_WIDTH = 12, 800, 5, 2048

#: Bounds that nearly all estimates keep: three standard errors of a count of distinct values, relative; and the rank of a quantile, of all rows.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_LOG2 / 2)
QUANTILE_ERROR = 3 * 2.3 / QUANTILE_K**0.9


def sketched(rows: DataFrame, keys: list[str], distinct: list[str] = [], quantiles: list[str] = []) -> DataFrame:  # noqa: B006
    """One row a key: ``rows_n`` and sketches ``d_<column>`` and ``q_<column>``. Null values are not counted; a key without values has an empty sketch or null."""
    of = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(DISTINCT_LOG2)).alias(f"d_{c}") for c in distinct]
    of += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_K)).alias(f"q_{c}") for c in quantiles]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows_n"), *of)


def merged(sketches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The sketches of all rows of a key together; without keys, of the whole table."""
    of = [F.hll_union_agg(c, F.lit(False)).alias(c) for c in sketches.columns if c.startswith("d_")]
    of += [F.kll_merge_agg_double(c, F.lit(QUANTILE_K)).alias(c) for c in sketches.columns if c.startswith("q_")]
    return sketches.groupBy(*keys).agg(F.sum("rows_n").alias("rows_n"), *of)


def estimates(sketches: DataFrame, keys: list[str] = [], ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:  # noqa: B006
    """``keys``, ``rows_n``, ``n_<column>`` (distinct values) and ``p_<column>`` (values at the ranks)."""
    of = [F.hll_sketch_estimate(c).alias(f"n_{c[2:]}") for c in sketches.columns if c.startswith("d_")]
    of += [F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(r) for r in ranks])).alias(f"p_{c[2:]}") for c in sketches.columns if c.startswith("q_")]
    return sketches.select(*keys, "rows_n", *of)


def frequency_sketch(rows: DataFrame, keys: list[str], column: str, depth: int = FREQUENT_DEPTH, width: int = FREQUENT_WIDTH) -> DataFrame:
    """``(keys, line, cell, n)``: how many rows' values hash to each cell of each line. Adding cells of equal place merges sketches."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("line"), F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(width)).cast("int").alias("cell")) for i in range(depth)]))
    placed = rows.where(F.col(column).isNotNull()).select(*keys, cells.alias("x")).select(*keys, "x.*")
    return placed.groupBy(*keys, "line", "cell").agg(F.count("*").alias("n"))


def frequencies(sketch: DataFrame, values: DataFrame, column: str, depth: int = FREQUENT_DEPTH, width: int = FREQUENT_WIDTH) -> DataFrame:
    """``(column, most)`` for each of the ``values``: its number of rows, never too small, and rarely more than ``2 * rows / width`` too large.

    The merged sketch has at most ``depth * width`` rows.
    """
    whole = sketch.groupBy("line", "cell").agg(F.sum("n").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("line"), F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(width)).cast("int").alias("cell")) for i in range(depth)]))
    asked = values.select(column).distinct().select(column, cells.alias("x")).select(column, "x.*")
    found = asked.join(F.broadcast(whole), ["line", "cell"], "left")  # depth * width rows
    return found.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("most"))
