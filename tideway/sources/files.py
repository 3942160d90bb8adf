"""Files in and out: packet tables, flow exports, canonical flows and metrics."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.functions.labels import app_from_path, direction, protocol_number
from tideway.functions.values import epoch_seconds
from tideway.operators.windows import CANONICAL, csv_rows, numeric_time_files
from tideway.sources.record_files import file_system

PACKET_COLUMNS = ("Time", "Source", "Destination", "Protocol", "Length")
EXPORT_COLUMNS = ("APP", "CATEGORY", "DURATION", "BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV", "PROTOCOL", "PPI")


def _file() -> Column:
    """The path of the row's file, as it was written."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")


HEAD = 64 << 10  # bytes of a file that are read to find its header


def first_line(path: str) -> str:
    """The first line of a file that is not blank, of its first ``HEAD`` bytes."""
    system, name = file_system(path)
    with system.open_input_file(name) as stream:
        text = stream.read(HEAD).decode("utf-8", "replace")
    return next((line for line in text.splitlines() if line.strip("\ufeff \t")), "")


def headers_of_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> dict[str, str | None]:
    """Paths under ``root``, sorted, with the first line if it names all packet columns, or None.

    Spark lists the files; tasks read the first bytes of each. The driver gets a path and a line a file, which it has to hand to the reader.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(_file())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([first_line(p) for p in batch.column("file").to_pylist()], pa.string())], ["file", "line"])

    lines = listed.mapInArrow(read, "file string, line string")
    cells = F.split(F.regexp_replace(F.lower("line"), '[\ufeff" ]', ""), ",")
    names = F.array(*[F.lit(n.lower()) for n in PACKET_COLUMNS])
    header = F.when(F.size(F.array_except(names, cells)) == 0, F.col("line"))
    return dict(sorted((r["file"], r["header"]) for r in lines.select("file", header.alias("header")).collect()))


def _header_columns(header: str) -> list[str]:
    """Column names of a header line, lower case; a name that is empty or was there before is named by its place."""
    names: list[str] = []
    for place, name in enumerate(next(csv.reader([header.lstrip("\ufeff")]))):
        name = name.strip(' "').lower()
        names.append(name if name and name not in names else f"_{place}")
    return names


def read_packets(spark: SparkSession, root: str, limit_files: int | None = None) -> DataFrame:
    """``(file, time, source, destination, protocol, length)`` as text, from headered CSV and headerless TSV files under ``root``.

    Files with the same header are read together.
    """
    found = headers_of_files(spark, root)
    by_header: dict[str | None, list[str]] = {}
    for path in list(found)[: limit_files or None]:
        by_header.setdefault(found[path], []).append(path)
    bare = by_header.pop(None, [])
    tables = []
    for header, paths in by_header.items():
        text = T.StructType([T.StructField(n, T.StringType()) for n in _header_columns(header)])
        table = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(text).csv(paths)
        tables.append(table.select(_file(), *[n.lower() for n in PACKET_COLUMNS]))
    if bare:
        table = spark.read.option("sep", "\t").schema("time string, source string, destination string, length string").csv(bare)
        tables.append(table.select(_file(), "time", "source", "destination", F.lit(None).cast("string").alias("protocol"), "length"))
    if not tables:
        return spark.createDataFrame([], "file string, time string, source string, destination string, protocol string, length string")
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def typed_packets(rows: DataFrame, root: str = "") -> DataFrame:
    """``(file, app, ts, length, direction, protocol)``; a file's times are numbers if at least half of them parse."""
    rows = rows.join(numeric_time_files(rows), "file")
    return rows.select(
        "file",
        app_from_path(F.replace(F.col("file"), F.lit(root), F.lit(""))).alias("app"),
        epoch_seconds(F.col("time"), F.col("numeric_file")).alias("ts"),
        F.col("length").try_cast("double").alias("length"),
        direction("source", "destination").alias("direction"),
        F.when(F.col("protocol").isNull(), 0).otherwise(protocol_number("protocol")).alias("protocol"),
    )


def read_exports(spark: SparkSession, root: str, pattern: str = "flows-*.csv.gz") -> DataFrame:
    """The nine columns used, as text. Compressed files do not split: one task per file, dealt anew after reading."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("header", True).option("escape", '"').csv(root)
    return raw.select(*EXPORT_COLUMNS).repartition(spark.sparkContext.defaultParallelism)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """A flow table from CSV or Parquet; ``source`` is the file's stem."""
    table = spark.read.parquet(path) if ".parquet" in path else spark.read.option("header", True).csv(path)
    return table.withColumn("source", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))


def write_flows(flows: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet with native arrays, or CSV with spaced names and series as text."""
    if csv:
        csv_rows(flows).write.mode("overwrite").option("header", True).csv(path)
    else:
        flows.select(*[c for c in CANONICAL if c in flows.columns]).write.mode("overwrite").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON metrics as ``(name, value)`` by dotted path; what is not a number is left out."""
    table = spark.read.option("multiLine", True).json(path)
    found = []

    def walk(schema, prefix: str) -> None:
        for field in schema.fields:
            name = f"{prefix}.{field.name}" if prefix else field.name
            if field.dataType.typeName() == "struct":
                walk(field.dataType, name)
            elif field.dataType.typeName() in ("double", "long", "integer", "float"):
                quoted = ".".join(f"`{p}`" for p in name.split("."))
                found.append(F.struct(F.lit(name).alias("name"), F.col(quoted).cast("double").alias("value")))

    walk(table.schema, "")
    return table.select(F.explode(F.array(*found)).alias("x")).select("x.*").where("value is not null")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
