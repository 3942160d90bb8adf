"""A trace in several files: no task sorts all of it, and its records are numbered through."""

from pyspark.sql import functions as F

from tideway.plans.registry import QUERIES
from tideway.sources import capture


def test_records_are_numbered_through_files(spark, tmp_path):
    spark.dataSource.register(capture.CaptureSource)
    root = str(tmp_path / "c")
    frames = spark.range(500).select(F.lit("t").alias("trace"), F.col("id").alias("record_no"), F.col("id").cast("double").alias("ts"), F.lit(60).alias("incl_len"), F.lit(60).alias("orig_len"), F.unhex(F.lit("00" * 60)).alias("data"))
    frames.repartitionByRange(12, "ts").sortWithinPartitions("ts").write.format("capture").mode("append").save(root)
    assert len(list((tmp_path / "c").glob("*.pcap"))) == 12
    ranges = capture.numbered_through(capture.capture_ranges(spark, root, 1000))
    found = capture.read_captures(spark, root, ranges=ranges)
    assert sorted((r["record_no"], r["ts"]) for r in found.collect()) == [(i, float(i)) for i in range(500)]
    assert sorted(r["record_no"] for r in capture.read_captures(spark, root, first=70, ranges=ranges).collect()) == list(range(70))


def test_a_trace_is_sorted_by_many_tasks(spark, sf):
    QUERIES["s5_s6_capture_files"][0](spark, sf)
    newest = max(capture.files_under(f"{spark.conf.get('spark.checkpoint.dir')}", (".pcap",)), key=lambda f: f[0].count("captures-"))
    folder = newest[0].rsplit("/", 1)[0]
    assert len(capture.files_under(folder, (".pcap",))) > 3
