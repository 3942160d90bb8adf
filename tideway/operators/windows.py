"""Packets to canonical flow rows: tumbling windows, inter-arrival times, statistics and bounded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideway.functions.labels import infer_condition
from tideway.functions.values import finite, series_text
from tideway.storage import kept

MAX_PACKETS = 128
WINDOW_SECONDS = 10.0
LEAST_WINDOW = 0.1
MOST_LENGTH = 65535.0
ROWS_A_TASK = 250_000  # that a task sorts, about
FEW_SOURCES = 10_000  # whose origins are sent to every task

#: The canonical flow row: internal name to the name at the CSV edge.
CANONICAL = {
    "app": "app", "service": "service", "condition": "condition", "packet_lengths": "packet_lengths", "iat_values": "iat_values",
    "directions": "directions", "rtt_ms": "rtt_ms", "jitter_ms": "jitter_ms", "loss_rate": "loss_rate", "total_packets": "total packets",
    "total_fwd_packets": "total fwd packets", "total_bwd_packets": "total backward packets", "packet_length_mean": "packet length mean",
    "packet_length_std": "packet length std", "flow_iat_mean": "flow iat mean", "flow_iat_std": "flow iat std", "flow_duration": "flow duration",
    "flow_bytes_s": "flow bytes/s", "flow_packets_s": "flow packets/s", "protocol": "protocol",
}


def valid_packets(packets: DataFrame) -> DataFrame:
    """Packets with a finite time above 0 and a finite length, which is clipped to 0..65535."""
    good = packets.withColumn("ts", finite(F.col("ts"))).withColumn("length", finite(F.col("length")))
    good = good.where("ts > 0 and length is not null")
    return good.withColumn("length", F.least(F.greatest("length", F.lit(0.0)), F.lit(MOST_LENGTH)))


def numeric_time_files(packets: DataFrame, file: str = "file", time: str = "time") -> DataFrame:
    """Whether a file's times are numbers: at least half of them parse. One row per file."""
    parsed = F.count_if(F.col(time).try_cast("double").isNotNull())
    return packets.groupBy(file).agg((parsed >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("numeric_file"))


def with_origin(packets: DataFrame, source: str, order: str | None = None) -> DataFrame:
    """``origin`` per source: the smallest time, or with ``order`` the time of the first record. Only the origins are held for the join; packets are not sorted for it."""
    first = F.min("ts") if order is None else F.min_by("ts", order)
    return packets.join(packets.groupBy(source).agg(first.alias("origin")).hint("shuffle_hash"), source)


def with_first_origin(packets: DataFrame, source: str, order: str) -> DataFrame:
    """``origin`` per source: the time of its first record. The origins of few sources are sent to all tasks, so that packets are not dealt out by source.

    Where ``order`` is a struct, the least of its first field is found first, by hash; only the records that have it (or null) are compared, and sorted, whole.
    """
    kind, rows = packets.schema[order].dataType, packets
    if isinstance(kind, StructType):
        lead = F.col(order)[kind.names[0]]
        leads = kept(packets.groupBy(source).agg(F.min(lead).alias("__lead")))
        if leads.count() > FEW_SOURCES:
            return with_origin(packets, source, order)
        rows = packets.join(F.broadcast(leads), source).where((lead == F.col("__lead")) | lead.isNull())
    origins = kept(rows.groupBy(source).agg(F.min_by("ts", order).alias("origin")))
    return packets.join(F.broadcast(origins) if origins.count() <= FEW_SOURCES else origins, source)


def dealt(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` of a table of ``total`` rows by ``keys``: more tasks, not larger ones, where the table is larger.

    Spark has a fixed number of partitions and joins small ones, up to a size on the wire that sorts and lists in memory exceed many times. Tables that
    give no core more than a task's rows are left to it.
    """
    tasks = -(-total // ROWS_A_TASK)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def window_id(ts: Column, origin: Column, seconds: float) -> Column:
    """Tumbling window number; exact at boundaries, negative before the origin."""
    width = F.lit(max(float(seconds), LEAST_WINDOW))
    since = ts - origin
    return F.round((since - F.pmod(since, width)) / width).cast("long")


def canonical_key(source: Column, target: Column) -> tuple[Column, Column, Column]:
    """Lower endpoint, upper endpoint, and +1 if the packet goes from lower to upper (or they are equal), else -1."""
    return F.least(source, target), F.greatest(source, target), F.when(source <= target, 1).otherwise(-1)


def with_gaps(packets: DataFrame, keys: list[str], order: list[str], max_packets: int = MAX_PACKETS) -> DataFrame:
    """``iat`` in ms (0 for a window's first packet, never negative) and the running number ``rn``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.greatest(F.lit(0.0), (F.col("ts") - F.lag("ts").over(w)) * 1000.0)
    return packets.withColumn("iat", F.coalesce(gap, F.lit(0.0))).withColumn("rn", F.row_number().over(w))


def _spread(x: str) -> Column:
    mean = F.sum(x) / F.count("*")
    return F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(x) * F.col(x)) / F.count("*") - mean * mean))


def flow_statistics(packets: DataFrame, keys: list[str], max_packets: int = MAX_PACKETS, ordered_duration: list[str] | None = None) -> DataFrame:
    """One row per window: counts, sums, means, population deviations, the most common protocol and the first packets.

    The lag's window and this aggregation share one exchange. Series hold at most ``max_packets`` packets; the
    rest of a window only enters sums. Duration runs from the first to the last packet, by time or by the given order.
    """
    first, last = (F.min("ts"), F.max("ts")) if ordered_duration is None else (F.min_by("ts", F.struct(*ordered_duration)), F.max_by("ts", F.struct(*ordered_duration)))
    kept = F.when(F.col("rn") <= max_packets, F.struct("rn", "length", "iat", "direction"))
    series = F.array_sort(F.collect_list(kept))
    return packets.groupBy(*keys).agg(
        F.count("*").alias("total_packets"),
        F.count_if(F.col("direction") > 0).alias("total_fwd_packets"),
        F.count_if(F.col("direction") <= 0).alias("total_bwd_packets"),
        F.sum("length").alias("length_sum"),
        (F.sum("length") / F.count("*")).alias("packet_length_mean"),
        _spread("length").alias("packet_length_std"),
        (F.sum("iat") / F.count("*")).alias("flow_iat_mean"),
        _spread("iat").alias("flow_iat_std"),
        (F.greatest(F.lit(0.0), last - first) * 1000.0).alias("flow_duration"),
        F.mode("protocol", True).alias("protocol"),
        series.alias("series"),
    )


def canonical_flows(stats: DataFrame, extra: list[str]) -> DataFrame:
    """Canonical columns from window statistics, without labels; ``extra`` columns stay in front."""
    seconds = F.greatest(F.col("flow_duration") / 1000.0, F.lit(0.001))
    return stats.select(
        *extra,
        infer_condition(F.col("flow_iat_mean"), F.col("flow_iat_std"), F.lit(0.0)).alias("condition"),
        F.transform("series", lambda x: x["length"]).alias("packet_lengths"),
        F.transform("series", lambda x: x["iat"]).alias("iat_values"),
        F.transform("series", lambda x: x["direction"]).alias("directions"),
        F.col("flow_iat_mean").alias("rtt_ms"),
        F.col("flow_iat_std").alias("jitter_ms"),
        F.lit(0.0).alias("loss_rate"),
        "total_packets",
        "total_fwd_packets",
        "total_bwd_packets",
        "packet_length_mean",
        "packet_length_std",
        "flow_iat_mean",
        "flow_iat_std",
        "flow_duration",
        (F.col("length_sum") / seconds).alias("flow_bytes_s"),
        (F.col("total_packets") / seconds).alias("flow_packets_s"),
        "protocol",
    )


def flows_by_file(packets: DataFrame, seconds: float = WINDOW_SECONDS, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Flow rows of packets ``(file, seq, ts, length, direction, protocol)``: one per file and window. Packets are dealt out by window: a long file is many tasks."""
    placed = with_origin(valid_packets(packets), "file").withColumn("window_id", window_id(F.col("ts"), F.col("origin"), seconds))
    keys = ["file", "window_id"]
    placed = dealt(placed, keys, packets.count())
    return canonical_flows(flow_statistics(with_gaps(placed, keys, ["ts", "seq"]), keys, max_packets), keys)


def flows_by_endpoints(packets: DataFrame, seconds: float = WINDOW_SECONDS, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Bidirectional flow rows of packets ``(trace, record_no, ts, proto, src, dst, length, accepted)``.

    A trace's origin is its first record, accepted or not; only accepted packets make flows. Packets are dealt out by flow: a few traces are many tasks.
    """
    low, high, way = canonical_key(F.col("src"), F.col("dst"))
    placed = with_first_origin(packets, "trace", "record_no").withColumn("window_id", window_id(F.col("ts"), F.col("origin"), seconds))
    placed = placed.where("accepted").withColumns({"ep_a": low, "ep_b": high, "direction": way, "protocol": F.col("proto")})
    placed = placed.withColumn("length", F.least(F.greatest(F.col("length").cast("double"), F.lit(0.0)), F.lit(MOST_LENGTH)))
    keys = ["trace", "window_id", "proto", "ep_a", "ep_b"]
    placed = dealt(placed, keys, packets.count())
    stats = flow_statistics(with_gaps(placed, keys, ["record_no"]), keys, max_packets, ["record_no"])
    return canonical_flows(stats, keys)


def csv_rows(flows: DataFrame) -> DataFrame:
    """Canonical rows as they are written to CSV: spaced names, series as text."""
    text = flows.withColumns(
        {
            "packet_lengths": F.when(F.size("packet_lengths") > 0, series_text(F.col("packet_lengths"), 2)).otherwise("0.0"),
            "iat_values": F.when(F.size("iat_values") > 0, series_text(F.col("iat_values"), 4)).otherwise("0.0"),
            "directions": F.when(F.size("directions") > 0, series_text(F.col("directions"), 0)).otherwise("1"),
        }
    )
    return text.select(*[F.col(own).alias(edge) for own, edge in CANONICAL.items() if own in flows.columns])
