"""Files made here, read back; and streams against batch runs of the same rows."""

import gzip
import json
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideway import storage
from tideway.operators import memory, sampling, windows
from tideway.operators.flows import exported_flows
from tideway.plans.adapters import event_packets, labelled_vectors
from tideway.sources import capture, clustered, files
from tideway.streaming import flows as stream_flows
from tideway.streaming.flows import FollowedTable, MergedTable, balanced_step, bounded_windowed_flows, newest_step, prototype_step, windowed_flows


def test_packet_files(spark, tmp_path):
    (tmp_path / "Zoom").mkdir()
    (tmp_path / "Zoom" / "a.csv").write_text("﻿No,Time,Source,Destination,Protocol,Length\n1,5.0,10.0.0.1,1.1.1.1,QUIC,100\n2,5.5,1.1.1.1,10.0.0.1,TLSv1,70000\n3,0.0,1.1.1.1,2.2.2.2,DNS,9\n4,x\n", encoding="utf-8")
    (tmp_path / "My App").mkdir()
    (tmp_path / "My App" / "b.csv").write_text("2024-01-01 00:00:10\t8.8.8.8\t192.168.1.1\t60\n2024-01-01 00:00:11é\t192.168.1.1\t8.8.8.8\t61\n", encoding="utf-8")
    rows = files.read_packets(spark, str(tmp_path))
    assert rows.count() == 6
    typed = files.typed_packets(rows, str(tmp_path))
    good = {(r["app"], r["ts"], r["length"], r["direction"], r["protocol"]) for r in windows.valid_packets(typed).collect()}
    assert {x for x in good if x[0] == "zoom"} == {("zoom", 5.0, 100.0, 1, 17), ("zoom", 5.5, 65535.0, -1, 6)}
    assert {x[1:] for x in good if x[0] != "zoom"} == {(1704067210.0, 60.0, -1, 0), (1704067211.0, 61.0, 1, 0)}
    assert files.read_packets(spark, str(tmp_path), limit_files=1).select("file").distinct().count() == 1


def test_packet_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Length,"Time",Protocol,,Destination,Source,Time\n9,1.0,tcp,x,d,s,2.0\n')
    (tmp_path / "b.csv").write_text("time,source,destination,protocol,length\n3.0,s,d,udp,7\n")
    found = files.read_packets(spark, str(tmp_path)).orderBy("time").drop("file").collect()
    assert [tuple(r) for r in found] == [("1.0", "s", "d", "tcp", "9"), ("3.0", "s", "d", "udp", "7")]


def test_export_files(spark, tmp_path):
    with gzip.open(tmp_path / "flows-1.csv.gz", "wt") as out:
        out.write("X,APP,CATEGORY,DURATION,BYTES,BYTES_REV,PACKETS,PACKETS_REV,PROTOCOL,PPI\n")
        out.write('q,yt,Streaming Media,0.5,10,20,1,1,,"[[0,10],[1,-1],[100,200]]"\nq,z,,1,1,1,1,1,17,oops\n')
    found = exported_flows(files.read_exports(spark, str(tmp_path))).collect()
    assert [(r["app"], r["service"], r["flow_duration"], r["packet_lengths"], r["protocol"]) for r in found] == [("youtube", "streaming", 500.0, [100.0, 200.0], 17)]


def test_canonical_files_round_trip(spark, sf, tmp_path):
    flows = windows.flows_by_file(event_packets(spark, sf), 1.0, 5).withColumns({"app": F.lit("a"), "service": F.lit("s")})
    files.write_flows(flows, str(tmp_path / "x.parquet"))
    files.write_flows(flows, str(tmp_path / "x"), csv=True)
    back = files.read_flows(spark, str(tmp_path / "x"))
    assert back.count() == flows.count() == files.read_flows(spark, str(tmp_path / "x.parquet")).count()
    assert "flow bytes/s" in back.columns and back.first()["source"].startswith("part-")


def test_metrics_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": {"b": 1.5, "c": {"d": 2}}, "s": "x"}))
    assert {(r["name"], r["value"]) for r in files.read_metrics(spark, str(tmp_path / "m.json")).collect()} == {("a.b", 1.5), ("a.c.d", 2.0)}


def ethernet(kind: int, body: bytes, tags=()) -> bytes:
    return bytes(12) + b"".join(struct.pack(">HH", t, 1) for t in tags) + struct.pack(">H", kind) + body


def ipv4(protocol, src, dst, ports=(1000, 443)):
    return bytes([0x45]) + bytes(8) + bytes([protocol]) + bytes(2) + bytes(src) + bytes(dst) + struct.pack(">HH", *ports)


def ipv6(first, rest=b""):
    return bytes(6) + bytes([first]) + bytes(1) + bytes(15) + b"\1" + bytes(15) + b"\2" + rest


A, B = (10, 0, 0, 1), (10, 0, 0, 2)
FRAMES = [
    (ethernet(0x0800, ipv4(6, A, B)), 6), (ethernet(0x0800, ipv4(17, B, A, (443, 1000)), (0x8100,)), 17), (ethernet(0x0800, ipv4(17, A, B), (0x88A8, 0x8100)), 17),
    (ethernet(0x86DD, ipv6(0, bytes([17, 0]) + bytes(6) + struct.pack(">HH", 5, 6))), 17), (ethernet(0x86DD, ipv6(44, bytes(12))), None), (ethernet(0x0806, bytes(28)), None),
    (ethernet(0x0800, ipv4(1, A, B)), None), (ethernet(0x0800, ipv4(6, A, B))[:30], None), (b"x", None), (ethernet(0x0800, ipv4(6, B, A, (443, 1000))), 6),
]


@pytest.mark.parametrize("order, scale", [("<", 10**6), (">", 10**9)])
def test_captures(spark, tmp_path, order, scale):
    magic = next(m for m, v in capture.MAGIC.items() if v == (order, float(scale)))
    body = b"".join(struct.pack(order + "IIII", 100 + i, scale // 2, len(f), len(f) + 7) + f for i, (f, _) in enumerate(FRAMES))
    (tmp_path / "t.pcap").write_bytes(magic + bytes(20) + body + b"cut")
    spark.dataSource.register(capture.CaptureSource)
    frames = spark.read.format("capture").load(str(tmp_path))
    assert frames.count() == len(FRAMES) and frames.agg(F.min("ts")).first()[0] == 100.5
    packets = capture.decode_frames(frames)
    found = packets.orderBy("record_no").collect()
    assert [r["proto"] for r in found] == [p for _, p in FRAMES]
    assert capture.scan_counters(packets).first()["accepted"] == 5 and capture.first_records(frames, 3).count() == 3
    flows = windows.flows_by_endpoints(packets, 60.0)
    both = flows.where("proto = 6").first()
    assert both["total_packets"] == 2 and both["directions"] == [1, -1] and bytes(both["ep_a"]["ip"]) == bytes(A)


def _record(order, seconds, fraction, data, whole=None):
    return struct.pack(order + "IIII", seconds, fraction, len(data), len(data) if whole is None else whole) + data


@pytest.mark.parametrize("order, scale", [("<", 10**6), (">", 10**9)])
def test_traces_in_ranges_equal_whole_traces(spark, tmp_path, order, scale):
    """Payloads that are captures themselves, records longer than a range, one cut off at the end, an empty trace; ranges from a few bytes to the whole."""
    rng = random.Random(2)
    magic = next(m for m, v in capture.MAGIC.items() if v == (order, float(scale))) + bytes(20)
    fake = b"".join(_record(order, 1000 + i, i, bytes([i]) * 20) for i in range(30))
    records = [_record(order, 1000 + i, i, rng.randbytes(rng.randrange(1, 90)) if i % 5 else fake[: rng.randrange(1, len(fake))], 7) for i in range(60)]
    records += [_record(order, 1200, 0, b""), _record(order, 1201, 0, rng.randbytes(5000)), _record(order, 10**9, 1, b"late")]
    for name, body in (("a", b"".join(records)), ("b", b"".join(records[::-1]) + fake[:-5]), ("none", b""), ("cut", records[0][:-1])):
        (tmp_path / f"{name}.pcap").write_bytes(magic + body)
    spark.dataSource.register(capture.CaptureSource)
    whole = sorted(map(tuple, spark.read.format("capture").load(str(tmp_path)).collect()))
    assert len(whole) == 2 * len(records) + 29
    for split in (700, 1 << 20):
        assert sorted(map(tuple, capture.read_captures(spark, str(tmp_path), split).collect())) == whole, split
    frames = capture.read_captures(spark, str(tmp_path), 2000)
    assert frames.rdd.getNumPartitions() >= 8  # a task a range
    first = capture.read_captures(spark, f"file:{tmp_path}", 2000, first=10)
    assert sorted(map(tuple, first.collect())) == [r for r in whole if r[1] < 10] and first.rdd.getNumPartitions() <= 4


def _traces(folder, sizes):
    for name, n in sizes.items():
        records = (_record("<", 1000 + i, i, bytes(12) + b"\x08\x00" + bytes(9) + (b"\x06" if i % 2 else b"\x01") + bytes(20)) for i in range(n))
        (folder / f"{name}.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(records))


def test_first_records_of_each_trace(spark, tmp_path):
    _traces(tmp_path, {"a": 50, "b": 7, "c": 9000})
    for most, want in ((8, [8, 7, 8]), (0, [0, 0, 0]), (None, [50, 7, 9000]), (5000, [50, 7, 5000])):
        reader = capture.CaptureReader(str(tmp_path), most)
        assert [sum(batch.num_rows for batch in reader.read(p)) for p in reader.partitions()] == want  # no more is decoded
    spark.dataSource.register(capture.CaptureSource)
    whole = spark.read.format("capture").load(str(tmp_path))
    few = spark.read.format("capture").option("records", 8).load(str(tmp_path))
    for frames in (few, capture.first_records(whole, 8)):
        assert {r["trace"]: r["count"] for r in frames.groupBy("trace").count().collect()} == {"a.pcap": 8, "b.pcap": 7, "c.pcap": 8}
    assert whole.where("record_no < 3 or trace = 'b.pcap'").count() == 13 and whole.unionByName(few).count() == 9057 + 23


def test_counters_come_with_the_pass(spark, tmp_path):
    _traces(tmp_path, {"a": 5, "b": 7})
    spark.dataSource.register(capture.CaptureSource)
    packets, seen = capture.counted(capture.decode_frames(spark.read.format("capture").load(str(tmp_path))))
    packets.where("record_no > 100").write.parquet(str(tmp_path / "out"))
    assert seen.get == {"scanned": 12, "accepted": 5}


def test_clustered_tables_are_read_without_an_exchange(spark, sf, tmp_path):
    packets = windows.with_origin(windows.valid_packets(event_packets(spark, sf)), "file").withColumn("window_id", windows.window_id(F.col("ts"), F.col("origin"), 1.0))
    flat = windows.flows_by_file(event_packets(spark, sf), 1.0)
    labelled = flat.withColumn("service", F.when(F.col("file").cast("int") % 3 == 0, "unknown").when(F.col("file").cast("int") % 3 == 1, "voip"))
    stored = clustered.write_clustered(packets, "clustered_packets", buckets=8, order=("ts", "seq"), path=str(tmp_path / "packets"))
    known, rest = clustered.write_labelled_set(labelled.withColumn("app", F.lit("a")), "clustered_flows", buckets=8, path=str(tmp_path / "flows"))
    keys = list(clustered.WINDOW)
    again = windows.canonical_flows(windows.flow_statistics(windows.with_gaps(stored, keys, ["ts", "seq"]), keys), keys)
    both = known.hint("merge").join(again.select(*keys, F.col("total_packets").alias("counted")), keys)
    for found in (again, both):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert ordered(again) == ordered(flat)
    voip = labelled.where("service = 'voip'")
    assert both.where("counted = total_packets").count() == both.count() == voip.count() > 0
    assert ordered(known.select(*keys, "total_packets")) == ordered(voip.select(*keys, "total_packets")) and known.count() + rest.count() == flat.count()
    assert "PartitionFilters: [isnotnull(background" in known._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "packets").glob("part-*"))) <= 8 and len(list((tmp_path / "flows").glob("*/part-*"))) <= 16  # a file a bucket
    for name in ("clustered_packets", "clustered_flows"):
        spark.sql(f"DROP TABLE {name}")


def test_headers_are_found_in_the_first_bytes(spark, tmp_path, monkeypatch):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a+b%20.csv").write_text("\n\nTime,Source,Destination,Protocol,Length\n" + "1,a,b,tcp,5\n" * 50_000)
    (tmp_path / "bare.csv").write_text("1\ta\tb\t5\n" * 50_000 + "Time,Source,Destination,Protocol,Length\n")
    (tmp_path / "empty.csv").write_text("")
    found = files.headers_of_files(spark, str(tmp_path))
    assert {k.rsplit("/", 1)[-1]: v for k, v in found.items()} == {"a+b%20.csv": "Time,Source,Destination,Protocol,Length", "bare.csv": None}
    assert files.HEAD == 65_536 and files.read_packets(spark, str(tmp_path)).groupBy("protocol").count().where("protocol = 'tcp'").first()["count"] == 50_000


def ordered(df):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect()])


def test_stream_equals_batch(spark, sf, tmp_path):
    packets = event_packets(spark, sf).where("ts > 0").cache()
    origin = 1.0
    for part in range(3):
        packets.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("end", 0, 1e6, 1.0, 1, 6)], "file string, seq long, ts double, length double, direction int, protocol int")
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # closes all windows but its own
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows = windowed_flows(stream, 1.0, origin, late_windows=100)
    flows.writeStream.format("memory").queryName("flows_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    closed = spark.table("flows_out")
    batch = windowed_flows(packets, 1.0, origin)
    assert ordered(closed) == ordered(batch) and closed.count() > 10
    clipped = windows.valid_packets(packets).withColumn("origin", F.lit(origin)).withColumn("window_id", windows.window_id(F.col("ts"), F.col("origin"), 1.0))
    keys = ["file", "window_id"]
    plain = windows.canonical_flows(windows.flow_statistics(windows.with_gaps(clipped, keys, ["ts", "seq"]), keys), keys)
    columns = ["file", "window_id", "condition", "total_packets", "packet_length_mean", "protocol", "flow_bytes_s"]
    assert ordered(batch.select(*columns)) == ordered(plain.select(*columns))


def test_bounded_state_and_late_packets(spark, tmp_path):
    """Windows of one second, two of them kept open: (batch, file, seq, ts); a packet of the first window comes in the fourth batch."""
    arrivals = [(0, "f", 1, 1.1), (0, "f", 2, 1.4), (1, "f", 3, 1.9), (1, "f", 4, 2.5), (1, "g", 5, 1.2), (2, "f", 6, 7.0), (3, "f", 7, 1.5), (3, "f", 8, 6.9), (3, "f", 9, 7.5), (4, "f", 10, 99.0)]
    schema, dropped = "file string, seq long, ts double, length double, direction int, protocol int", 0
    for batch in range(5):
        rows = [(f, s, t, 10.0 * s, 1 if s % 2 else -1, 6 if s < 3 else 17) for b, f, s, t in arrivals if b == batch]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        flows = bounded_windowed_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1.0, 1.0, 2, max_packets=2)
        out = flows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        run = out.outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        dropped += sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)
    found = {(r["file"], r["window_id"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(found) == {("f", 0), ("f", 1), ("g", 0), ("f", 5), ("f", 6)} and dropped == 1
    first = found["f", 0]
    assert (first["total_packets"], first["total_fwd_packets"], first["protocol"]) == (3, 2, 6) and first["packet_lengths"] == [10.0, 20.0]
    assert first["iat_values"] == pytest.approx([0.0, 300.0]) and first["flow_iat_mean"] == pytest.approx(800 / 3) and first["flow_duration"] == pytest.approx(800.0)
    assert first["packet_length_std"] == pytest.approx((200 / 3) ** 0.5) and found["f", 6]["total_packets"] == 2


def test_late_packets_are_rows_of_their_own(spark, tmp_path):
    """Two windows kept open, fragments taken for twenty seconds more: (batch, file, seq, ts)."""
    arrivals = [(0, "f", 1, 1.1), (0, "f", 2, 2.4), (1, "f", 3, 9.0), (2, "f", 4, 1.5), (2, "f", 5, 1.2), (2, "g", 6, 2.0), (2, "f", 7, 9.5), (3, "f", 8, 1.7), (4, "f", 9, 50.0), (5, "f", 10, 1.3), (5, "f", 11, 40.0)]
    schema, dropped = "file string, seq long, ts double, length double, direction int, protocol int", 0
    for batch in range(6):
        spark.createDataFrame([(f, n, t, 10.0 * n, 1, 6) for b, f, n, t in arrivals if b == batch], schema).write.mode("append").parquet(str(tmp_path / "in"))
        found = bounded_windowed_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1.0, 1.0, 2, fragments_for=20.0)
        out = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        run = out.outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        dropped += sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)
        held = [o.numRowsTotal for p in run.recentProgress for o in p.stateOperators][-1]
    rows = [(r["file"], r["window_id"], r["fragment"], r["packet_lengths"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [
        ("f", 0, False, [10.0]), ("f", 0, True, [50.0, 40.0]), ("f", 0, True, [80.0]), ("f", 1, False, [20.0]), ("f", 8, False, [30.0, 70.0]), ("f", 39, True, [110.0]), ("g", 1, True, [60.0])
    ]
    assert dropped == 1 and held == 1  # the last window is open; closed ones and fragments hold nothing


def test_bounded_state_in_any_order_equals_all_packets():
    """The state after batches in any order, against one pass over sorted packets; with few packets held, where the rest comes in order."""
    rng = np.random.default_rng(7)
    for n, held, shuffled in ((1, 4, True), (90, 128, True), (128, 128, True), (300, 40, False), (5, 1, False)):
        ts = np.round(1 + np.sort(rng.random(n)), 3)
        rows = pd.DataFrame({"ts": ts, "seq": np.arange(n), "length": rng.integers(40, 1500, n).astype(float), "direction": rng.choice([-1, 1], n), "protocol": rng.choice([6, 17, 1], n)})
        order = rng.permutation(n) if shuffled else np.arange(n)
        state = None
        for part in np.array_split(order, min(n, 4)):
            state = stream_flows._with_packets(state, rows.iloc[part], held)
            assert len(state[11]) <= held
        found = stream_flows._flow_row("f", 3, state).iloc[0]
        gaps = 1000 * np.diff(ts, prepend=ts[0])
        assert found["total_packets"] == n and found["total_fwd_packets"] == (rows["direction"] > 0).sum()
        assert found["flow_duration"] == pytest.approx(1000 * (ts[-1] - ts[0])) and found["flow_iat_mean"] == pytest.approx(gaps.mean())
        assert found["flow_iat_std"] == pytest.approx(gaps.std(), abs=1e-6) and found["packet_length_std"] == pytest.approx(rows["length"].std(ddof=0), abs=1e-6)
        assert found["lens"] == rows["length"][:held].tolist() and found["gaps"] == pytest.approx(gaps[:held].tolist()) and found["ways"] == rows["direction"][:held].tolist()
        counts = rows["protocol"].value_counts()
        assert found["protocol"] == min(counts.index[counts == counts.max()])


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(Session)
    Session.sparkContext.master = "local[2]"
    assert storage.shared_root(Session)


def test_captures_written_and_read_back(spark, tmp_path):
    rows = [(f"t{i % 2}", i, 5.25 + i, len(f), len(f) + 3, bytearray(f)) for i, (f, _) in enumerate(FRAMES)]
    spark.dataSource.register(capture.CaptureSource)
    frames = spark.createDataFrame(rows, capture.FRAMES).repartition("trace").sortWithinPartitions("record_no")
    frames.write.format("capture").mode("append").save(f"file:{tmp_path}/new")
    back = sorted(map(tuple, spark.read.format("capture").load(str(tmp_path / "new")).collect()))
    assert [(t[:2], n, ts, a, b, bytes(d)) for t, n, ts, a, b, d in back] == sorted((t, i // 2, ts, a, b, bytes(d)) for t, i, ts, a, b, d in rows)


def follow(spark, tmp_path, rows, start, step):
    source, folder = str(tmp_path / "in"), str(tmp_path / "table")
    for part in range(3):
        rows.where(f"id % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = FollowedTable(spark, folder, start)
    assert table.latest() is start
    table.follow(stream, step, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    # A table made anew over the same folder finds what an earlier run wrote.
    assert ordered(FollowedTable(spark, folder, start).latest()) == ordered(table.version(2))
    return table.latest()


def test_followed_samples(spark, sf, tmp_path):
    rows = labelled_vectors(spark, sf).select("id", "z", "label", "seq")
    found = follow(spark, tmp_path / "a", rows, rows.limit(0), balanced_step("label", 4, ["id"]))
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in sampling.balanced_sample(rows, "label", 4, ["id"]).collect())
    rows = rows.withColumn("z", F.col("z").cast("array<double>"))
    newest = follow(spark, tmp_path / "b", rows, rows.limit(0), newest_step(5))
    assert sorted(r["id"] for r in newest.collect()) == sorted(r["id"] for r in memory.newest_per_class(rows, 5).collect())


def test_merged_table_writes_what_a_batch_brings(spark, tmp_path):
    """Eleven batches of a table that grows to 300 rows: all versions are right, also when a batch runs again, and most batches write few rows."""
    rows = spark.range(330).select((F.col("id") % 3).alias("label"), F.col("id").alias("seq"), F.array(F.lit(3.0), F.lit(4.0)).alias("z"))
    table = MergedTable(spark, str(tmp_path / "t"), rows.limit(0), newest_step(100))
    assert table.latest().count() == 0
    written = []
    for number in range(11):
        for _ in range(1 + (number in (3, 4))):
            table.write(rows.where(f"seq div 30 = {number}"), number)
        written.append(spark.read.parquet(table.piece(number)).count())
        want = {r["seq"] for r in rows.where(f"seq < {30 * (number + 1)} and seq >= {30 * (number + 1) - 300}").collect()}
        found = table.version(number).collect()
        assert {r["seq"] for r in found} == want and len(found) == len(want) and found[0]["z"] == pytest.approx([0.6, 0.8])
    assert written == [30, 60, 30, 120, 30, 60, 30, 240, 30, 60, 30]
    assert {r["seq"] for r in MergedTable(spark, str(tmp_path / "t"), rows.limit(0), newest_step(100)).latest().collect()} == set(range(30, 330))


def test_followed_prototypes(spark, sf, tmp_path):
    rows = labelled_vectors(spark, sf).select("id", "z", "label", "seq")
    start = memory.bootstrap(rows.where("id % 10 = 0"), spark.range(10).select(F.col("id").alias("label")))
    found = follow(spark, tmp_path, rows, start, prototype_step(trust=0.3))
    assert found.count() == 10 and found.agg(F.sum("n")).first()[0] > start.agg(F.sum("n")).first()[0]
