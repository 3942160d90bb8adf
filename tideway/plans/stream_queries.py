"""Registered queries on files and streams: the given tables written by Spark in the shared folder, then read or followed from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tideway.operators import embeddings, features, flows, memory, windows
from tideway.plans.adapters import event_packets, labelled_vectors, order_exports, table
from tideway.plans.embedding_queries import VECTORS, _protos, sql_update
from tideway.plans.flow_queries import _EVENT_KEY, _GROUP_SQL, EVENT_PACKETS, EXPORTS_SQL, FLOWS_SQL, _shown, sql_condition
from tideway.sources import capture, clustered, files
from tideway.storage import shared_folder
from tideway.streaming.flows import FollowedTable, MergedTable, balanced_step, bounded_windowed_flows, newest_step, prototype_step, windowed_flows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


# --- files ----------------------------------------------------------------------------------------------------

_FOLDERS = ("zoom", "My Games", "netflix-tv")


@query("""WITH rows AS (SELECT user_id % 3 AS place, event_type, event_id, least(value * 10.0::DOUBLE, 65535.0::DOUBLE) AS length FROM events WHERE isfinite(value) AND event_id > 0)
SELECT CASE place WHEN 0 THEN 'zoom' WHEN 1 THEN 'my_games' ELSE 'netflix' END AS app, CASE WHEN event_type = 'view' THEN -1 ELSE 1 END AS direction,
  CASE WHEN place = 2 THEN 0 WHEN event_type = 'click' THEN 17 ELSE 6 END AS protocol, count(*) AS n, sum(event_id)::BIGINT AS total_ts, round(sum(greatest(length, 0.0::DOUBLE)), 2) AS bytes FROM rows GROUP BY ALL""")  # fmt: skip
def s1_s2_s3_packet_files(spark, sf_dir):
    """Headered CSV in two folders and headerless TSV in a third, listed and read back as typed packets."""
    root = shared_folder(spark, "packet-files")
    is_view = F.col("event_type") == "view"
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("place"),
        F.col("event_id").cast("string").alias("Time"),
        F.when(is_view, "8.8.8.8").otherwise("10.0.0.1").alias("Source"),
        F.when(is_view, "192.168.1.1").otherwise("8.8.4.4").alias("Destination"),
        F.when(F.col("event_type") == "click", " QUIC").otherwise("TLSv1.3").alias("Protocol"),
        (F.col("value") * 10.0).cast("string").alias("Length"),
    )
    for place, folder in enumerate(_FOLDERS):
        part = rows.where(F.col("place") == place).drop("place")
        if place < 2:
            part.write.option("header", True).csv(f"{root}/{folder}")
        else:
            part.drop("Protocol").write.option("sep", "\t").csv(f"{root}/{folder}")
    typed = windows.valid_packets(files.typed_packets(files.read_packets(spark, root), root))
    sums = (F.count("*").alias("n"), F.sum("ts").cast("long").alias("total_ts"), F.round(F.sum("length"), 2).alias("bytes"))
    return typed.groupBy("app", "direction", "protocol").agg(*sums)


@query(EXPORTS_SQL + f"SELECT app, service, {sql_condition('iat_mean', 'iat_std', '0.0')} AS condition, count(*) AS n, sum(m)::BIGINT AS packets FROM rows GROUP BY ALL")
def s4_export_files(spark, sf_dir):
    """Exported flows in compressed CSV, read back and brought to canonical rows."""
    root = shared_folder(spark, "exports")
    order_exports(spark, sf_dir).drop("o_orderkey").write.option("header", True).option("escape", '"').option("compression", "gzip").csv(root)
    found = flows.exported_flows(files.read_exports(spark, root, "part-*.csv.gz"))
    return found.groupBy("app", "service", "condition").agg(F.count("*").alias("n"), F.sum(F.size("packet_lengths")).alias("packets"))


@query(f"SELECT condition, count(*) AS n, sum(total_packets)::BIGINT AS packets, sum(least(total_packets, 128))::BIGINT AS series FROM ({FLOWS_SQL}) GROUP BY condition")
def s7_s8_canonical_files(spark, sf_dir):
    """Canonical rows in CSV with series as text, read back by their column names."""
    root = shared_folder(spark, "canonical")
    found = windows.flows_by_file(event_packets(spark, sf_dir), 1.0).withColumns({"app": F.lit("zoom"), "service": F.lit("conferencing")})
    files.write_flows(found, root, csv=True)
    back = flows.resolve_labels(files.read_flows(spark, root))
    sizes = F.size(F.split("packet_lengths", ";"))
    return back.groupBy("condition").agg(F.count("*").alias("n"), F.sum(F.col("total packets").cast("long")).alias("packets"), F.sum(sizes).alias("series"))


@query(f"""WITH {VECTORS}, pairs AS (SELECT a.label = b.label AS same, list_inner_product(a.z, b.z) AS sim FROM vectors a JOIN vectors b ON a.id < b.id)
SELECT 'similarity.intra' AS name, round(coalesce(avg(sim) FILTER (same), 0), 6) AS value FROM pairs UNION ALL SELECT 'similarity.inter', round(coalesce(avg(sim) FILTER (NOT same), 0), 6) FROM pairs""")
def s10_metrics_files(spark, sf_dir):
    """Nested metrics in JSON, read back by dotted path."""
    root = shared_folder(spark, "metrics")
    files.write_metrics(embeddings.pair_similarity(labelled_vectors(spark, sf_dir)).select(F.struct("intra", "inter").alias("similarity")), root)
    return files.read_metrics(spark, root).select("name", F.round("value", 6).alias("value"))


@query(f"""SELECT condition, count(*) AS n, sum(total_packets)::BIGINT AS packets, sum(total_packets)::BIGINT AS counted, sum(fwd)::BIGINT AS fwd FROM ({FLOWS_SQL}) WHERE file::BIGINT % 3 <> 0 GROUP BY condition""")
def s8_s9_clustered_flows(spark, sf_dir):
    """Packets and labelled flows in tables clustered by window; windows and the join with the known flows need no exchange, and the background is not read."""
    keys, folder = list(clustered.WINDOW), shared_folder(spark, "clustered")
    name = folder.rsplit("-", 1)[-1]
    packets = windows.with_origin(windows.valid_packets(event_packets(spark, sf_dir)), "file")
    packets = packets.withColumn("window_id", windows.window_id(F.col("ts"), F.col("origin"), 1.0)).drop("origin")
    found = windows.flows_by_file(event_packets(spark, sf_dir), 1.0)
    labelled = found.withColumn("service", F.when(F.col("file").cast("long") % 3 == 0, "unknown").otherwise("conferencing"))
    stored = clustered.write_clustered(packets, f"packets_{name}", buckets=8, order=("ts", "seq"), path=f"{folder}/packets")
    known, _ = clustered.write_labelled_set(labelled, f"flows_{name}", buckets=8, path=f"{folder}/flows")
    counts = stored.groupBy(*keys).agg(F.count("*").alias("counted"), F.count_if(F.col("direction") > 0).alias("fwd"))
    both = known.select(*keys, "condition", "total_packets").join(counts, keys)
    return both.groupBy("condition").agg(F.count("*").alias("n"), F.sum("total_packets").alias("packets"), F.sum("counted").alias("counted"), F.sum("fwd").alias("fwd"))


# --- frames ---------------------------------------------------------------------------------------------------


def _bytes(value, width: int) -> Column:
    """A number as ``width`` big-endian bytes in hexadecimal."""
    return F.lpad(F.hex(value), 2 * width, "0")


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as Ethernet frames ``(trace, record_no, ts, incl_len, orig_len, data)``, a trace per return flag.

    By line number: plain, with one tag, with two tags, IPv6 with an extension header, an IPv6 fragment, another EtherType, cut short.
    """
    kind = F.col("l_linenumber")
    protocol = F.when(F.col("l_linestatus") == "O", 17).when(F.col("l_suppkey") % 3 == 0, 1).otherwise(6)
    ports = F.concat(_bytes(F.col("l_partkey") % 65536, 2), _bytes(F.lit(443), 2))
    ipv4 = F.concat(F.lit("45" + "00" * 8), _bytes(protocol, 1), F.lit("0000"), F.lit("0A00"), _bytes(F.col("l_suppkey") % 65536, 2), F.lit("08080808"), ports)
    ends = F.concat(F.lit("FD" + "00" * 13), _bytes(F.col("l_suppkey") % 65536, 2), F.lit("20" + "00" * 14 + "01"))
    ipv6 = F.concat(F.lit("00" * 6 + "0000"), ends, _bytes(protocol, 1), F.lit("00" * 7), ports)
    fragment = F.concat(F.lit("00" * 6 + "2C00"), ends, F.lit("00" * 12))
    body = (
        F.when(kind == 1, F.concat(F.lit("0800"), ipv4))
        .when(kind == 2, F.concat(F.lit("810000010800"), ipv4))
        .when(kind == 3, F.concat(F.lit("88A80001810000020800"), ipv4))
        .when(kind == 4, F.concat(F.lit("86DD"), ipv6))
        .when(kind == 5, F.concat(F.lit("86DD"), fragment))
        .when(kind == 6, F.concat(F.lit("0806"), ipv4))
        .otherwise(F.concat(F.lit("0800"), F.substring(ipv4, 1, 44)))
    )
    data = F.unhex(F.concat(F.lit("00" * 12), body))
    number = F.col("l_orderkey") * 8 + kind
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("trace"), number.cast("long").alias("record_no"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("ts"), data.alias("data")
    )
    return rows.select("trace", "record_no", "ts", F.octet_length("data").alias("incl_len"), F.octet_length("data").alias("orig_len"), "data")


@query("""WITH rows AS (SELECT l_returnflag AS trace, l_linenumber AS kind, CASE WHEN l_linestatus = 'O' THEN 17 WHEN l_suppkey % 3 = 0 THEN 1 ELSE 6 END AS proto, l_suppkey % 65536 AS host, l_partkey % 65536 AS port FROM lineitem)
SELECT trace, CASE WHEN good THEN proto END AS proto, CASE WHEN NOT good THEN NULL WHEN kind = 4 THEN 'FD' || repeat('00', 13) || printf('%04X', host) ELSE '0A00' || printf('%04X', host) END AS source, good AS accepted, count(*) AS n, sum(CASE WHEN good THEN port END)::BIGINT AS ports
 FROM (SELECT *, kind <= 4 AND proto <> 1 AS good FROM rows) GROUP BY ALL""")  # fmt: skip
def p30_p31_p32_p33_frames(spark, sf_dir):
    found = capture.decode_frames(line_frames(spark, sf_dir))
    rows = found.select("trace", "proto", F.hex("src.ip").alias("source"), "accepted", F.col("src.port").cast("long").alias("port"))
    return rows.groupBy("trace", "proto", "source", "accepted").agg(F.count("*").alias("n"), F.sum("port").alias("ports"))


_CAPTURE_SPLIT = 1 << 20
_CAPTURE_ROWS = 500_000  # that a task sorts and writes


@query("""WITH rows AS (SELECT l_returnflag AS trace, l_linenumber AS kind, CASE WHEN l_linestatus = 'O' THEN 17 WHEN l_suppkey % 3 = 0 THEN 1 ELSE 6 END AS proto, l_suppkey % 65536 AS host, l_partkey % 65536 AS port, epoch(l_shipdate)::BIGINT AS ts,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey * 8 + l_linenumber) - 1 AS place FROM lineitem), decoded AS (SELECT *, kind <= 4 AND proto <> 1 AS good FROM rows)
SELECT trace, good AS accepted, count(*) AS n, sum(ts)::BIGINT AS times, sum(CASE WHEN good THEN port END)::BIGINT AS ports, max(place)::BIGINT AS last_record,
 min(ts) FILTER (place >= 100)::BIGINT AS after_first, count(*) FILTER (place < 100) AS n_first FROM decoded GROUP BY ALL""")  # fmt: skip
def s5_s6_capture_files(spark, sf_dir):
    """Frames written as capture files, several to a trace, each a range of its time, so that no task sorts a trace; read back in ranges and numbered through a trace's files.

    The first hundred records of each trace are read by themselves, and no others for them.
    """
    spark.dataSource.register(capture.CaptureSource)
    root = shared_folder(spark, "captures")
    frames, order = line_frames(spark, sf_dir), ("trace", "ts", "record_no")
    tasks = max(4, -(-table(spark, sf_dir, "lineitem").count() // _CAPTURE_ROWS))
    frames.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.format("capture").mode("append").save(root)

    def named(frames: DataFrame) -> DataFrame:
        return frames.withColumn("trace", F.regexp_extract("trace", capture.TRACE_FILE, 1))

    ranges = capture.numbered_through(capture.capture_ranges(spark, root, _CAPTURE_SPLIT))
    decoded = capture.decode_frames(named(capture.read_captures(spark, root, ranges=ranges)))
    found = decoded.groupBy("trace", "accepted").agg(
        F.count("*").alias("n"), F.sum(F.col("ts").cast("long")).alias("times"), F.sum("src.port").cast("long").alias("ports"), F.max("record_no").alias("last_record"),
        F.min(F.when(F.col("record_no") >= 100, F.col("ts").cast("long"))).alias("after_first"),
    )
    first = capture.decode_frames(named(capture.read_captures(spark, root, first=100, ranges=ranges))).groupBy("trace", "accepted").agg(F.count("*").alias("n_first"))
    return found.join(first, ["trace", "accepted"], "left").withColumn("n_first", F.coalesce("n_first", F.lit(0)))


# --- streams --------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, folder: str, order: str, files_at_once: int = 1) -> DataFrame:
    """``rows`` in files by ranges of ``order``, as a stream of a few batches."""
    rows.repartitionByRange(3, order).write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{folder}/in")


_STREAM_SQL = f"WITH packets AS ({EVENT_PACKETS})," + _GROUP_SQL.format(
    placed="SELECT *, floor(ts - 1.0::DOUBLE)::BIGINT AS window_id FROM packets", keys="file, window_id", order="ts, seq", duration="greatest(0.0, max(ts) - min(ts)) * 1000.0::DOUBLE",
    shown="file, window_id, round(len_sum, 2) AS bytes", condition=sql_condition("iat_mean", "iat_std", "0.0")
)


@query(f"SELECT file, window_id, condition, total_packets, fwd, bwd, bytes, iat_mean, protocol FROM ({_STREAM_SQL})")
def t1_t2_t3_streamed_flows(spark, sf_dir):
    """Windows of a stream of files. A last packet, far in the future, moves the watermark past all windows; its own stays open."""
    folder = shared_folder(spark, "streamed-flows")
    packets = event_packets(spark, sf_dir)
    stream = _stream(spark, packets, folder, "ts")
    last = packets.orderBy(F.desc("ts")).limit(1)
    last.select(F.lit("end").alias("file"), "seq", (F.col("ts") + 1e6).alias("ts"), "length", "direction", "protocol").write.mode("append").parquet(f"{folder}/in")
    # Files of one table arrive in any order, so packets may be as late as the table is long.
    span = packets.agg(F.ceil(F.max("ts") - F.min("ts"))).first()[0] or 0
    found = windowed_flows(windows.valid_packets(stream), 1.0, 1.0, int(span) + 2)
    written = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    written.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    shown = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return shown.select(
        "file", "window_id", "condition", "total_packets", F.col("total_fwd_packets").alias("fwd"), F.col("total_bwd_packets").alias("bwd"),
        F.round(F.col("packet_length_mean") * F.col("total_packets"), 2).alias("bytes"), F.round("flow_iat_mean", 3).alias("iat_mean"), "protocol",
    )


def _drained(writer: DataStreamWriter) -> int:
    """Run a stream to the end of what is there; gives the number of rows that came too late."""
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in running.recentProgress for o in p.stateOperators)


_LATE = "floor((ts - 1.0::DOUBLE) / (span / 3))"
_ARRIVALS = f"""packets AS ({EVENT_PACKETS}), extent AS (SELECT max(ts) - 1.0::DOUBLE + 1e-6::DOUBLE AS span FROM packets), arriving AS (SELECT packets.*, {_LATE} = 0 AND seq % 50 = 7 AND ts < span / 3 - 3 AS late FROM packets, extent)"""
_IN_ORDER_SQL = f"WITH {_ARRIVALS}," + _GROUP_SQL.format(
    placed="SELECT *, floor(ts - 1.0::DOUBLE)::BIGINT AS window_id FROM arriving WHERE NOT late", keys="file, window_id", order="ts, seq", duration="greatest(0.0, max(ts) - min(ts)) * 1000.0::DOUBLE",
    shown="file, window_id, round(len_sum, 2) AS bytes", condition=sql_condition("iat_mean", "iat_std", "0.0")
)


@query(f"SELECT file, window_id, condition, total_packets, fwd, bwd, bytes, length_std, iat_mean, iat_std, duration, protocol, lengths, ways, (SELECT count(*) FROM (WITH {_ARRIVALS} SELECT * FROM arriving) WHERE late) AS dropped FROM ({_IN_ORDER_SQL})")
def t2_t3_w9_late_packets(spark, sf_dir):
    """Packets arrive by thirds of the time that they span; one in fifty of the first third comes with the last, long after its window closed.

    Windows stay open for two more windows and hold sums and bounded series. ``dropped`` is the number of packets that came too late.
    """
    shown, dropped = _arrived(spark, sf_dir, "late-packets", None)
    return shown.withColumn("dropped", F.lit(dropped).cast("long"))


_FRAGMENTS_SQL = f"WITH {_ARRIVALS}," + _GROUP_SQL.format(
    placed="SELECT *, floor(ts - 1.0::DOUBLE)::BIGINT AS window_id FROM arriving", keys="file, window_id, late", order="ts, seq", duration="greatest(0.0, max(ts) - min(ts)) * 1000.0::DOUBLE",
    shown="file, window_id, late AS fragment, round(len_sum, 2) AS bytes", condition=sql_condition("iat_mean", "iat_std", "0.0")
)


@query(f"SELECT file, window_id, fragment, condition, total_packets, fwd, bwd, bytes, length_std, iat_mean, iat_std, duration, protocol, lengths, ways, 0::BIGINT AS dropped FROM ({_FRAGMENTS_SQL})")
def t2_w9_late_fragments(spark, sf_dir):
    """The same arrivals; packets that come after their window was closed are rows of their own, and none is dropped."""
    shown, dropped = _arrived(spark, sf_dir, "late-fragments", 1e6)
    return shown.withColumn("dropped", F.lit(dropped).cast("long"))


def _arrived(spark: SparkSession, sf_dir: str, name: str, fragments_for: float | None) -> tuple[DataFrame, int]:
    """Flow rows of the late arrivals, and how many packets were dropped."""
    folder = shared_folder(spark, name)
    packets = windows.valid_packets(event_packets(spark, sf_dir))
    span = packets.agg(F.max("ts") - 1.0 + 1e-6).first()[0]
    third = F.floor((F.col("ts") - 1.0) / (span / 3))
    late = (third == 0) & (F.col("seq") % 50 == 7) & (F.col("ts") < span / 3 - 3)
    arriving = packets.withColumn("batch", F.when(late, 2).otherwise(F.least(third, F.lit(2))))
    end = spark.range(1).select(F.lit("end").alias("file"), F.lit(0).cast("long").alias("seq"), F.lit(1e6).alias("ts"), F.lit(1.0).alias("length"), F.lit(1).alias("direction"), F.lit(6).alias("protocol"), F.lit(3).alias("batch"))
    dropped = 0
    for batch in range(4):
        rows = arriving.where(F.col("batch") == batch) if batch < 3 else end.select(*arriving.columns)
        rows.drop("batch").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(packets.schema).parquet(f"{folder}/in")
        found = bounded_windowed_flows(stream, 1.0, 1.0, fragments_for=fragments_for)
        dropped += _drained(found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append"))
    keys = ["file", "window_id"] if fragments_for is None else ["file", "window_id", "fragment"]
    shown = _shown(spark.read.schema(found.schema).parquet(f"{folder}/out"), [*keys, F.round(F.col("packet_length_mean") * F.col("total_packets"), 2).alias("bytes")])
    return shown.drop("length_mean", "bytes_s", "packets_s"), dropped


def _followed(spark: SparkSession, rows: DataFrame, name: str, order: str, start: DataFrame, step) -> DataFrame:
    folder = shared_folder(spark, name)
    kept = FollowedTable(spark, f"{folder}/table", start)
    kept.follow(_stream(spark, rows, folder, order), step, f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.latest()


@query(f"WITH {VECTORS} SELECT label, id, round(z[1], 6) AS first FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS turn FROM vectors) WHERE turn <= 20")
def t4_m6_streamed_memory(spark, sf_dir):
    """The newest vectors of each class, kept in pieces while a stream of vectors runs: a batch writes what it brings, not the table."""
    rows = labelled_vectors(spark, sf_dir).select("id", "label", "seq", features.unit(F.col("z")).alias("z"))
    folder = shared_folder(spark, "memory")
    kept = MergedTable(spark, f"{folder}/table", rows.limit(0), newest_step(20))
    kept.follow(_stream(spark, rows, folder, "seq"), f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.latest().select("label", "id", F.round(F.col("z")[0], 6).alias("first"))


_BATCHES = ", ".join(f"{sql_update(f'moved{b}', f'(SELECT label, seq, z FROM vectors WHERE id % 10 <> 0 AND id % 3 = {b})', 'start' if b == 0 else f'moved{b - 1}', 0.3)}" for b in range(3))


@query(f"""WITH RECURSIVE {VECTORS}, known AS {_protos("(SELECT * FROM vectors WHERE id % 10 = 0)")}, start AS (SELECT r.label, k.proto, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT label FROM vectors) r LEFT JOIN known k USING (label)), {_BATCHES}
 SELECT label, n, round(list_sum(proto), 6) AS total, round(proto[1], 6) AS first FROM moved2""")
def t5_m6_streamed_prototypes(spark, sf_dir):
    """Prototypes that follow the trusted rows of a stream of three batches, each run of the stream taking what has come since the last."""
    rows = labelled_vectors(spark, sf_dir).select("id", "z", "label", "seq")
    start = memory.bootstrap(rows.where("id % 10 = 0"), rows.select("label").distinct())
    folder = shared_folder(spark, "prototypes")
    kept = FollowedTable(spark, f"{folder}/table", start)
    for batch in range(3):
        rows.where((F.col("id") % 10 != 0) & (F.col("id") % 3 == batch)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        _drained(kept.follow(stream, prototype_step(trust=0.3), f"{folder}/state"))
    found = kept.latest()
    total = F.when(F.col("proto").isNotNull(), F.aggregate("proto", F.lit(0.0), lambda s, x: s + x))
    return found.select("label", "n", F.round(total, 6).alias("total"), F.round(F.get("proto", F.lit(0)), 6).alias("first"))


@query(f"SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_EVENT_KEY}, event_id) AS turn FROM events) WHERE turn <= 100")
def t6_streamed_sample(spark, sf_dir):
    """A balanced sample kept while a stream of events runs; the smallest keys compose over batches."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return _followed(spark, rows, "sample", "event_id", rows.limit(0), balanced_step("event_type", 100, ["event_id"]))
