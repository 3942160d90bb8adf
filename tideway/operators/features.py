"""Feature sequences of flows: a row per packet, a series of network conditions, and their augmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions.labels import condition_index, infer_condition, let, protocol_flags, stable_key
from tideway.functions.values import named, number_of, parse_series, text_of

MAX_PACKETS, PACKET_WIDTH, STEPS, NETWORK_WIDTH = 128, 16, 24, 8

# The names under which foreign tables hold a quantity, in order, and its default.
LENGTHS = ["packet_lengths", "pkt_lengths", "lengths", "packet_size_series", "pkt_size_series"]
IATS = ["iat_values", "iats", "inter_arrival_times", "inter_packet_times", "time_delta_series"]
DIRECTIONS = ["directions", "direction_series", "dir_series"]
NAMES = {
    "fwd": (["total fwd packets", "tot fwd pkts", "fwd packets", "fwd_pkt_count", "total_fwd_packets"], 32.0),
    "bwd": (["total backward packets", "total bwd packets", "bwd packets", "bwd_pkt_count", "total_bwd_packets"], 16.0),
    "length_mean": (["packet length mean", "pkt len mean", "average packet size", "avg pkt size", "packet_length_mean"], 600.0),
    "length_std": (["packet length std", "pkt len std", "packet length variance", "packet_length_std"], 180.0),
    "iat_mean": (["flow iat mean", "iat mean", "flow_iat_mean"], 20.0),
    "protocol": (["protocol", "proto"], 6.0),
    "syn": (["syn flag count", "syn"], 0.0),
    "ack": (["ack flag count", "ack"], 0.0),
    "rst": (["rst flag count", "rst"], 0.0),
    "rtt": (["rtt_ms", "rtt", "mean_rtt", "flow iat mean"], 35.0),
    "jitter": (["jitter_ms", "jitter", "flow iat std"], 5.0),
    "loss": (["loss_rate", "packet_loss", "loss"], 0.0),
    "retrans": (["retransmissions", "retrans", "retransmit_count"], 0.0),
    "throughput": (["throughput_mbps", "throughput", "flow bytes/s", "flow_bytes_s"], 5.0),
    "uplink": (["uplink_ratio", "down/up ratio", "down_up_ratio"], 0.5),
}
COUNTS = ["packet count", "tot pkts", "total packets", "total_packets"]
IAT_STDS = ["flow iat std", "iat std", "flow_iat_std"]
DURATIONS = ["flow duration", "duration", "flow_duration"]
BYTES_S = ["flow bytes/s", "flow bytes per s", "bytes_per_second", "flow_bytes_s"]
PACKETS_S = ["flow packets/s", "flow packets per s", "packets_per_second", "flow_packets_s"]
_DEALT = 4  # tasks a core, where rows are dealt out
QUEUES = ["queue_delay_ms", "queue_delay", "buffer_delay"]
RTT_SCALES, JITTER_ADDS, LOSS_ADDS = (0.7, 1.0, 1.8, 3.2), (0.0, 0.1, 0.25, 0.55), (0.0, 0.005, 0.02, 0.06)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _column_sum(rows: Column, j: int) -> Column:
    """The sum of one column of an array of rows."""
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + r[j])


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def gaussian(*parts: Column) -> Column:
    """A standard normal number that depends on the parts alone (Box-Muller on two keys)."""
    return _normal(*[stable_key(F.lit(x), *parts) for x in "uv"])


def _normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2.0 * F.log(F.lit(1.0) - u)) * F.cos(2.0 * math.pi * v)


def _begun(names: str | list[str], *parts: Column) -> Column:
    """What the texts of many keys of a row begin with, a field for each name; see :func:`_key_after`."""
    return F.struct(*[F.concat_ws("|", F.lit(name), *parts, F.lit("")).alias(name) for name in names])


def _key_after(start: Column, end: Column) -> Column:
    """:func:`stable_key` of the parts of both texts, where the first was joined once for the row."""
    return stable_key(F.concat(start, end))


def spread_out(rows: DataFrame, row_id: str) -> DataFrame:
    """Rows dealt over all cores by their id, for tables whose series are to be drawn.

    That takes about a millisecond a row, so a few megabytes are work for every core, though Spark reads them in one task.
    """
    return rows.repartition(_DEALT * rows.sparkSession.sparkContext.defaultParallelism, row_id)


def _series(rows: DataFrame, names: list[str], whole: bool = False) -> Column:
    """The first of the named series: arrays as they are, text parsed."""
    kinds = dict(rows.dtypes)
    found = []
    for c, name in zip(named(rows, names), [n for n in names if named(rows, [n])], strict=True):
        real = next(k for k in kinds if k.strip().lower() == name.lower())
        found.append(c.cast("array<double>") if kinds[real].startswith("array") else parse_series(text_of(rows, [name]), whole).cast("array<double>"))
    return F.coalesce(*found, F.lit(None).cast("array<double>"))


def packet_series(rows: DataFrame, row_id: str, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Adds ``lens``, ``gaps`` and ``ways`` of equal length; missing series are drawn from the flow's means (:func:`spread_out` first, if most are)."""
    value = {n: number_of(rows, *NAMES[n]) for n in ("fwd", "bwd", "length_mean", "length_std", "iat_mean")}
    total = number_of(rows, COUNTS, value["fwd"] + value["bwd"])
    count = F.greatest(F.lit(4), F.least(F.lit(max_packets), total)).cast("int")
    length_std = F.when(value["length_std"] > 2000.0, F.sqrt(value["length_std"])).otherwise(value["length_std"])
    iat_std = number_of(rows, IAT_STDS, F.greatest(value["iat_mean"] * 0.2, F.lit(1.0)))
    share = F.coalesce(F.try_divide(value["fwd"], value["fwd"] + value["bwd"]), F.lit(0.5))
    own = F.col(row_id).cast("string")

    def drawn(n: Column, mean: Column, std: Column, tag: str, shown) -> Column:
        def series(flow: Column) -> Column:
            def number(i: Column) -> Column:
                return shown(flow["mean"] + flow["std"] * _normal(*[_key_after(flow["start"][x], i.cast("string")) for x in "uv"]))

            return F.transform(F.sequence(F.lit(1), flow["n"]), number)

        start = _begun("uv", F.lit(tag), own)
        return let(F.struct(n.alias("n"), mean.alias("mean"), F.greatest(std, F.lit(1.0)).alias("std"), start.alias("start")), series)

    lens = drawn(count, value["length_mean"], length_std, "len", lambda x: _clip(x, 40, 1500))
    rows = rows.withColumn("lens", F.coalesce(_series(rows, LENGTHS), lens))
    n = F.greatest(F.size("lens"), F.lit(1))
    gaps = drawn(n, value["iat_mean"], iat_std, "iat", lambda x: F.greatest(x, F.lit(0.0)))
    rows = rows.withColumn("gaps", F.coalesce(_series(rows, IATS), gaps))

    def directions(flow: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), flow["n"]), lambda i: F.when(_key_after(flow["start"]["dir"], i.cast("string")) < flow["share"], 1.0).otherwise(-1.0))

    ways = let(F.struct(n.alias("n"), _clip(share, 0.05, 0.95).alias("share"), _begun(["dir"], own).alias("start")), directions)
    rows = rows.withColumn("ways", F.coalesce(_series(rows, DIRECTIONS, True), ways))
    kept = F.least(F.lit(max_packets), *[F.size(c) for c in ("lens", "gaps", "ways")])
    return rows.withColumn("__kept", kept).withColumns({c: F.slice(c, F.lit(1), F.col("__kept")) for c in ("lens", "gaps", "ways")}).drop("__kept")


def packet_matrix(rows: DataFrame, row_id: str, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Adds ``packet_seq``: sixteen numbers a packet, as many rows as packets; ``padded`` fills it up where it is scored."""
    rows = packet_series(rows, row_id, max_packets)
    n, total_len, total_iat = F.size("lens").cast("double"), _sum(F.col("lens")), _sum(F.col("gaps"))
    rows = rows.withColumn("__duration", number_of(rows, DURATIONS, total_iat))
    floor_duration = F.greatest(F.col("__duration"), F.lit(1.0))
    tcp, udp, quic = protocol_flags(number_of(rows, *NAMES["protocol"]))
    fwd = F.coalesce(F.try_divide(F.size(F.filter("ways", lambda x: x > 0)).cast("double"), n), F.lit(0.0))
    flags = [tcp, udp, quic, *[F.least(number_of(rows, *NAMES[x]), F.lit(m)) / m for x, m in (("syn", 16.0), ("ack", 64.0), ("rst", 16.0))]]
    flow = {
        "pps": F.log1p(F.greatest(number_of(rows, PACKETS_S, n / floor_duration), F.lit(0.0))) / 10.0,
        "bps": F.log1p(F.greatest(number_of(rows, BYTES_S, total_len / floor_duration), F.lit(0.0))) / 20.0,
        "fwd": fwd,
        "long": F.log1p(F.greatest(F.col("__duration"), F.lit(0.0))) / 20.0,
        "total": F.greatest(total_iat, F.lit(1.0)),
        "last": F.greatest(F.size("lens") - 1, F.lit(1)).cast("double"),
        **{f"flag{i}": flag for i, flag in enumerate(flags)},
    }
    items = F.arrays_zip("lens", "gaps", "ways", running_sum(F.col("gaps")).alias("cum"))

    def packets(f: Column) -> Column:
        """The matrix, from what is the same for all packets of the flow."""

        def packet(x: Column, i: Column) -> Column:
            burst = _clip(F.floor(x["cum"] / f["total"] * 8.0) / 8.0, 0, 1)
            cells = [x["lens"] / 1500.0, F.log1p(x["gaps"]) / 10.0, x["ways"], f["pps"], f["bps"], f["fwd"], 1.0 - f["fwd"]]
            cells += [f[f"flag{j}"] for j in range(6)] + [f["long"], burst, i / f["last"]]
            return F.array(*[c.cast("float") for c in cells])

        return F.transform(items, packet)

    matrix = let(F.struct(*[c.alias(name) for name, c in flow.items()]), packets)
    return rows.withColumn("packet_seq", matrix).drop("__duration")


def running_sum(x: Column) -> Column:
    """Prefix sums of a short array."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))
    step = F.aggregate(x, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a")))
    return step["a"]


def padded(sequence: Column, length: int = MAX_PACKETS, width: int = PACKET_WIDTH) -> Column:
    zero = F.array(*[F.lit(0.0).cast("float")] * width)
    return F.slice(F.concat(sequence, F.array_repeat(zero, length)), 1, length)


def padding_mask(sequence: Column) -> Column:
    """True for rows whose features sum to nearly zero."""
    return F.transform(sequence, lambda row: F.abs(F.aggregate(row, F.lit(0.0), lambda s, v: s + v)) <= 1e-8)


def network_series(rows: DataFrame, row_id: str, steps: int = STEPS, noise: float = 0.03) -> DataFrame:
    """Adds ``network_seq``: eight scaled conditions at every step, with a drift of noise that grows along the series."""
    value = {n: number_of(rows, *NAMES[n]) for n in ("rtt", "jitter", "loss", "retrans", "throughput", "uplink")}

    def scaled(x: Column, by: float) -> Column:
        return F.log1p(F.greatest(x, F.lit(0.0))) / by

    def conditions(v: Column) -> Column:
        queue = number_of(rows, QUEUES, F.greatest(v["jitter"] * 0.4, F.lit(1.0)))
        hint = condition_index(infer_condition(v["rtt"], v["jitter"], v["loss"]))
        return F.array(
            scaled(v["rtt"], 8.0), scaled(v["jitter"], 6.0), _clip(v["loss"], 0, 1), scaled(v["retrans"], 8.0),
            scaled(v["throughput"], 16.0), _clip(v["uplink"], 0, 1), scaled(queue, 6.0), hint / 3.0,
        )

    base = let(F.struct(*[c.alias(n) for n, c in value.items()]), conditions)
    if not noise:  # all steps are one
        return rows.withColumn("network_seq", let(F.transform(base, lambda x: _clip(x, -5, 5).cast("float")), lambda step: F.array_repeat(step, steps)))

    def series(flow: Column) -> Column:
        def step(t: Column) -> Column:
            def noisy(at: Column) -> Column:
                def cell(x: Column, j: Column) -> Column:
                    drift = noise * _normal(*[_key_after(at[k], j.cast("string")) for k in "uv"]) * at["grown"]
                    return _clip(x + drift, -5, 5).cast("float")

                return F.transform(flow["base"], cell)

            starts = [F.concat(flow["start"][k], t.cast("string"), F.lit("|")).alias(k) for k in "uv"]
            return let(F.struct(*starts, (0.5 + t / max(steps - 1, 1)).alias("grown")), noisy)

        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), step)

    start = _begun("uv", F.lit("net"), F.col(row_id).cast("string"))
    return rows.withColumn("network_seq", let(F.struct(base.alias("base"), start.alias("start")), series))


def augmented(rows: DataFrame, row_id: str, copy: Column | None = None, noise: float = 0.015, itself: Column | None = None) -> DataFrame:
    """Another network condition for the same flow: ``packet_seq``, ``network_seq`` and ``condition`` are replaced, save where ``itself`` holds."""
    copy = F.lit(1) if copy is None else copy
    own = F.col(row_id).cast("string")

    def pick(values: tuple[float, ...], tag: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(stable_key(F.lit(tag), own, copy) * len(values)) + 1).cast("int"))

    chosen = F.struct(pick(RTT_SCALES, "rtt").alias("scale"), pick(JITTER_ADDS, "jit").alias("jitter"), pick(LOSS_ADDS, "loss").alias("loss"))

    def packets(c: Column) -> Column:
        def packet(row: Column, i: Column) -> Column:
            moved = row[1] * c["scale"] + (noise * gaussian(F.lit("aug"), own, copy, i) if noise else 0.0)
            return F.concat(F.slice(row, 1, 1), F.array(_clip(moved, 0, 10).cast("float")), F.slice(row, 3, PACKET_WIDTH))

        return F.transform("packet_seq", packet)

    def networks(c: Column) -> Column:
        def network(row: Column) -> Column:
            first = [_clip(row[0] * c["scale"], 0, 5), _clip(row[1] + c["jitter"], 0, 5), _clip(row[2] + c["loss"], 0, 1)]
            return F.concat(F.array(*[x.cast("float") for x in first]), F.slice(row, 4, NETWORK_WIDTH))

        return F.transform("network_seq", network)

    def changed(name: str, new: Column) -> Column:
        return new if itself is None else F.when(itself, F.col(name)).otherwise(new)

    rows = rows.withColumns({"packet_seq": changed("packet_seq", let(chosen, packets)), "network_seq": changed("network_seq", let(chosen, networks))})
    mean = [_column_sum(F.col("network_seq"), j) / F.size("network_seq") for j in range(3)]
    means = F.struct(F.expm1(mean[0] * 8.0).alias("rtt"), F.expm1(mean[1] * 6.0).alias("jitter"), mean[2].alias("loss"))
    condition = let(means, lambda m: infer_condition(m["rtt"], m["jitter"], m["loss"]))
    return rows.withColumn("condition", changed("condition", condition))


def with_augmented(rows: DataFrame, row_id: str, copies: int, noise: float = 0.015) -> DataFrame:
    """The rows and ``copies`` augmented twins of each, whose ``source`` ends in ``_aug``. The flows are made once for all."""
    itself = F.col("copy") == 0
    all_rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return augmented(all_rows, row_id, F.col("copy"), noise, itself).withColumn("source", F.when(itself, F.col("source")).otherwise(F.concat("source", F.lit("_aug"))))


def flow_records(rows: DataFrame, row_id: str, noise: float = 0.03) -> DataFrame:
    """``(id, packet_seq, network_seq, app, service, condition, source)``."""
    rows = network_series(packet_matrix(rows, row_id), row_id, noise=noise)
    return rows.select(F.col(row_id).alias("id"), "packet_seq", "network_seq", "app", "service", "condition", "source")


def pooled_vector(sequence: Column, series: Column, width: int = PACKET_WIDTH, conditions: int = NETWORK_WIDTH) -> Column:
    """Means and deviations of packet features and means of the network series, at unit length: an encoder without training."""

    def means(rows: Column, count: int) -> Column:
        n = F.greatest(F.size(rows), F.lit(1)).cast("double")
        return F.array(*[_column_sum(rows, j) / n for j in range(count)])

    def moments(rows: Column) -> Column:
        n = F.greatest(F.size(rows), F.lit(1)).cast("double")

        def with_spreads(m: Column) -> Column:
            far = [F.aggregate(rows, F.lit(0.0), lambda s, r: s + (r[j] - m[j]) * (r[j] - m[j])) for j in range(width)]
            return F.concat(m, F.array(*[F.sqrt(x / n) for x in far]))

        return let(means(rows, width), with_spreads)

    return unit(F.concat(let(sequence, moments), let(series, lambda rows: means(rows, conditions))))


def unit(v: Column) -> Column:
    """The vector at length one (its norm is floored at 1e-12)."""

    def scaled(w: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
        return let(norm, lambda n: F.transform(w, lambda x: x / n))

    return let(v.cast("array<double>"), scaled)
