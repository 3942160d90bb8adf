"""Tables clustered by key: rows of one key lie in one bucket, so that windows, grouping and joins on the key read them without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = ("file", "window_id")


def write_clustered(rows: DataFrame, name: str, keys: tuple[str, ...] = WINDOW, buckets: int = 256, order: tuple[str, ...] = (), partition: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the catalog's table ``name`` and gives it as read back; a table of that name is replaced.

    Rows are dealt once, by the hash that places buckets, so a bucket is one task and one file (of each ``partition``), sorted by keys and ``order``. Tables that are to be
    joined take the same keys and number of buckets: a bucket of 100 to 500 MB suits scans, and all rows of one key are in one. Null keys are a key like any other.
    """
    writer = rows.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer = writer.partitionBy(partition) if partition else writer
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def write_labelled_set(flows: DataFrame, name: str, keys: tuple[str, ...] = WINDOW, buckets: int = 256, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical rows with a known service, and the background, from one table written in one pass: the background lies in a partition of its own.

    A null service counts as unknown.
    """
    unknown = F.coalesce(F.col("service") == "unknown", F.lit(True))
    written = write_clustered(flows.withColumn("background", unknown), name, keys, buckets, partition="background", path=path)
    return written.where("not background").drop("background"), written.where("background").drop("background")
