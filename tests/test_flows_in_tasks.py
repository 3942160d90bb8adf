"""Flows of larger tables are more tasks, not larger ones, whatever the number of traces."""

from pyspark.sql import functions as F

from tideway.operators import windows
from tideway.plans.adapters import order_exports


def _packets(spark, n: int = 4000):
    """Two traces, whose first record is not their earliest."""
    end = lambda k: F.struct((F.col("id") % k).alias("ip"), F.lit(0).alias("port"))
    return spark.range(n).select(
        (F.col("id") % 2).cast("string").alias("trace"), F.struct((F.col("id") / 4).cast("long").alias("a"), (-F.col("id")).alias("b")).alias("record_no"), (1e4 - F.col("id") % 97).alias("ts"),
        F.when(F.col("id") % 3 == 0, 6).otherwise(17).alias("proto"), end(7).alias("src"), end(11).alias("dst"), F.lit(100.0).alias("length"), (F.col("id") % 5 != 0).alias("accepted"),
    )


def test_few_traces_are_many_tasks(spark, monkeypatch):
    packets = _packets(spark)
    whole = {(r["trace"], r["window_id"], r["proto"], r["ep_a"], r["ep_b"]): r for r in windows.flows_by_endpoints(packets, 10.0).collect()}
    monkeypatch.setattr(windows, "ROWS_A_TASK", 200, raising=False)
    found = windows.flows_by_endpoints(packets, 10.0)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert {(r["trace"], r["window_id"], r["proto"], r["ep_a"], r["ep_b"]): r for r in found.collect()} == whole


def test_first_origin_by_a_struct(spark, monkeypatch):
    packets = _packets(spark)
    none = F.lit(None).cast("struct<a:bigint,b:bigint>")
    packets = packets.withColumn("record_no", F.when(F.col("ts") == 9999.0, F.struct(F.lit(None).cast("long").alias("a"), F.col("record_no.b").alias("b"))).when(F.col("ts") > 9990.0, none).otherwise(F.col("record_no")))
    for trace in ("0", "1"):
        rows = packets.where(F.col("trace") == trace)
        plain = rows.agg(F.min_by("ts", "record_no")).first()[0]
        assert {r["origin"] for r in windows.with_first_origin(rows, "trace", "record_no").collect()} == {plain}
    few = {(r["trace"], r["origin"]) for r in windows.with_first_origin(packets, "trace", "record_no").collect()}
    monkeypatch.setattr(windows, "FEW_SOURCES", 1)
    assert {(r["trace"], r["origin"]) for r in windows.with_first_origin(packets, "trace", "record_no").collect()} == few


def _tasks(rows) -> int:
    """Tasks that make the whole rows; a plan for their number alone may leave joins out."""
    return len({r["p"] for r in rows.withColumn("p", F.spark_partition_id()).collect()})


def test_a_long_file_is_many_tasks(spark, monkeypatch):
    packets = spark.range(3000).select(F.when(F.col("id") >= 0, "a").alias("file"), F.col("id").alias("seq"), (1.0 + F.col("id") / 10).alias("ts"), F.lit(9.0).alias("length"), F.lit(1).alias("direction"), (F.col("id") % 2).alias("protocol"))
    whole = sorted(map(str, windows.flows_by_file(packets, 1.0).collect()))
    monkeypatch.setattr(windows, "ROWS_A_TASK", 100, raising=False)
    found = windows.flows_by_file(packets, 1.0)
    assert _tasks(found) > 8
    assert sorted(map(str, found.collect())) == whole


def test_exports_of_more_lines_are_more_tasks(spark, sf, monkeypatch):
    whole = sorted(map(str, order_exports(spark, sf).collect()))
    monkeypatch.setattr(windows, "ROWS_A_TASK", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for larger tables
    try:
        found = order_exports(spark, sf)
        assert _tasks(found) > 8
        assert sorted(map(str, found.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
