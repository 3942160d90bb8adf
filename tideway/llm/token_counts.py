"""Token counts: an exact histogram of document lengths, and suffix sums that answer every context limit.

Documents are encoded where they lie and leave a partition as one count per length. The histogram has a row for each length that
occurs; running and suffix sums over it, in two levels so that no single task holds it, then answer for each limit
how many documents fit, how many tokens are kept if longer ones are cut there, and at which quantile it lies.

Defined results: a null text counts as empty; a document's length includes its end token; very long texts are encoded whole;
documents of one length share a row, so there are no ties; repeated rows count each; an empty table gives an empty
result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.runtime import columns, cut
from tideway.llm.token_ids import BYTE_BPE, document_ids

BLOCK = 256


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """``(length, n_docs)`` for every length that occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            (texts,) = columns(batch, "text")
            counts.update(len(document_ids(x or "", vocabulary)) + 1 for x in texts)
        lengths = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lengths, pa.int64()), pa.array([counts[x] for x in lengths], pa.int64())], ["length", "n_docs"]
        )

    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted, "length long, n_docs long")
    return rows.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length as a context limit: documents and tokens up to it, beyond it, and kept when cut there."""
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    rows = rows.withColumn("block", F.floor(F.col("length") / block))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(f"block_{x}").over(earlier), F.lit(0)).alias(f"before_{x}") for x in ("docs", "tokens")],
        *[F.sum(f"block_{x}").over(everything).alias(f"all_{x}") for x in ("docs", "tokens")],
    )
    upto = Window.partitionBy("block").orderBy("length")
    rows = rows.join(blocks, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        "all_docs",
        "all_tokens",
        (F.col("before_docs") + F.sum("n_docs").over(upto)).alias("docs_upto"),
        (F.col("before_tokens") + F.sum("n_tokens").over(upto)).alias("tokens_upto"),
    )
    longer = F.col("all_docs") - F.col("docs_upto")
    return rows.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_upto",
        "tokens_upto",
        longer.alias("docs_longer"),
        (F.col("all_tokens") - F.col("tokens_upto")).alias("tokens_longer"),
        (F.col("tokens_upto") + F.col("length") * longer).alias("truncated_tokens"),
        (F.col("docs_upto") / F.col("all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """:func:`context_limits` of the documents; the histogram is kept, for it is read twice and texts are encoded once."""
    return context_limits(cut(length_histogram(docs, text, vocabulary)))


def quantile_length(limits: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed: one row ``(length)``."""
    return limits.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens kept when every document is cut at ``limit``: one row ``(tokens)``, for any limit, seen or not."""
    return histogram.agg(F.sum(F.col("n_docs") * F.least(F.col("length"), F.lit(limit))).alias("tokens"))
