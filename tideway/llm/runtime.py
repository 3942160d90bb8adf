"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.storage import kept


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, in the folder the cluster shares for checkpoints.

    What is cut survives a lost executor. See ``tideway.storage`` for the folder.
    """
    return kept(df)


def utf8(text: str = "text") -> Column:
    """The column's UTF-8 bytes, so that Python workers get them without decoding."""
    return F.col(text).cast("binary")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(name).to_pylist() for name in names]


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut batches to at most ``rows`` rows, to bound what a worker holds at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
