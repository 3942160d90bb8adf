"""The flow jobs on streams: windows under a watermark, and tables that follow a stream batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideway.operators.memory import newest_per_class, update_trusted
from tideway.operators.sampling import balanced_sample
from tideway.operators.windows import MAX_PACKETS, canonical_flows


def _spread(x: Column) -> Column:
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n - mean * mean))


def windowed_flows(packets: DataFrame, seconds: float, origin: float = 0.0, late_windows: int = 2, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Canonical flow rows of a stream ``(file, seq, ts, length, direction, protocol)``; also runs on a batch.

    Windows start at ``origin`` and close ``late_windows`` windows after their end; later packets are dropped (and counted by Spark).
    State holds the packets of open windows; arrival order does not matter. For a stream in order, :func:`bounded_windowed_flows` holds sums.
    """
    width, start = f"{seconds} seconds", f"{origin % seconds} seconds"
    timed = packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    timed = timed.withWatermark("event_time", f"{late_windows * seconds} seconds")
    item = F.struct("ts", "seq", "length", "direction", "protocol")
    grouped = timed.groupBy("file", F.window("event_time", width, width, start).alias("w")).agg(F.collect_list(item).alias("p"), F.mode("protocol", True).alias("protocol"))
    rows = grouped.withColumn("p", F.array_sort("p"))
    gaps = F.transform("p", lambda x, i: F.when(i == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (x["ts"] - F.get("p", i - 1)["ts"]) * 1000.0)))
    rows = rows.withColumns({"gaps": gaps, "lens": F.transform("p", lambda x: x["length"]), "n": F.size("p").cast("long")})
    total = {c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) for c in ("lens", "gaps")}
    forward = F.size(F.filter("p", lambda x: x["direction"] > 0)).cast("long")
    series = F.transform(F.slice("p", 1, max_packets), lambda x, i: F.struct((i + 1).alias("rn"), x["length"].alias("length"), F.get("gaps", i).alias("iat"), x["direction"].alias("direction")))
    stats = rows.select(
        "file",
        F.round((F.unix_micros(F.col("w.start")) / 1e6 - origin) / seconds).cast("long").alias("window_id"),
        F.col("n").alias("total_packets"),
        forward.alias("total_fwd_packets"),
        (F.col("n") - forward).alias("total_bwd_packets"),
        total["lens"].alias("length_sum"),
        (total["lens"] / F.col("n")).alias("packet_length_mean"),
        _spread(F.col("lens")).alias("packet_length_std"),
        (total["gaps"] / F.col("n")).alias("flow_iat_mean"),
        _spread(F.col("gaps")).alias("flow_iat_std"),
        ((F.element_at("p", -1)["ts"] - F.element_at("p", 1)["ts"]) * 1000.0).alias("flow_duration"),
        "protocol",
        series.alias("series"),
    )
    return canonical_flows(stats, ["file", "window_id"])


# What the state of a window holds for a number of files: for each file counts and sums that no order of arrival changes; its protocols with their counts and its first packets
# by time, each with the place of its file; and what came after these packets.
_STATE = (
    "n array<long>, fwd array<long>, length array<double>, length2 array<double>, first array<double>, last array<double>, rest_first array<double>, rest_last array<double>, "
    "rest_gap2 array<double>, protocols array<int>, protocol_counts array<long>, times array<double>, seqs array<long>, lens array<double>, ways array<int>, "
    "files array<string>, protocol_of array<int>, packet_of array<int>"
)
_STATS = (
    "file string, window_id long, total_packets long, total_fwd_packets long, total_bwd_packets long, length_sum double, packet_length_mean double, "
    "packet_length_std double, flow_iat_mean double, flow_iat_std double, flow_duration double, protocol int, lens array<double>, gaps array<double>, ways array<int>, fragment boolean"
)
_TYPES = [{"long": np.int64, "double": np.float64, "int": np.int32, "string": object}[field.split("<")[1].rstrip(">")] for field in _STATE.split(", ")]
BUCKETS = 64


def _arrays(state: tuple | None) -> list[np.ndarray]:
    return [np.asarray(column, t) for column, t in zip(state or [()] * len(_TYPES), _TYPES, strict=True)]


def _with_packets(state: tuple | None, packets: pd.DataFrame, max_packets: int) -> tuple:
    """The state of a window once a batch's packets have come, whatever their order; packets without a column ``file`` are of one file.

    The ``max_packets`` first of a file by time are held. The others leave their number, their span and the squares of the gaps between them, in the order in which they leave.
    """
    *before, protocols, counts, times, seqs, lens, ways, files, protocol_of, packet_of = _arrays(state)
    coming = packets["file"].to_numpy(object) if "file" in packets else np.full(len(packets), "", object)
    codes, names = pd.factorize(np.concatenate((files, coming)), use_na_sentinel=False)  # files that were here keep their places
    own, m = codes[len(files) :], len(names)
    ts, size, direction = packets["ts"].to_numpy(), packets["length"].to_numpy(), packets["direction"].to_numpy()
    starts = (0, 0, 0.0, 0.0, np.inf, -np.inf, np.inf, -np.inf, 0.0)
    n, fwd, length, length2, first, last, rest_first, rest_last, rest_gap2 = (np.concatenate((c, np.full(m - len(files), x, c.dtype))) for c, x in zip(before, starts, strict=True))
    n += np.bincount(own, minlength=m)
    fwd += np.bincount(own[direction > 0], minlength=m)
    length += np.bincount(own, size, m)
    length2 += np.bincount(own, size * size, m)
    np.minimum.at(first, own, ts)
    np.maximum.at(last, own, ts)
    kinds = pd.DataFrame({"of": np.concatenate((protocol_of, own)), "protocol": np.concatenate((protocols, packets["protocol"])), "n": np.concatenate((counts, np.ones(len(own), np.int64)))})
    kinds = kinds.groupby(["of", "protocol"], as_index=False)["n"].sum()

    place, *columns = (np.concatenate(pair) for pair in ((packet_of, own), (times, ts), (seqs, packets["seq"]), (lens, size), (ways, direction)))
    order = np.lexsort((columns[1], columns[0], place))
    place = place[order]
    held = np.arange(len(place)) - np.searchsorted(place, place) < max_packets
    rest, rest_of = columns[0][order[~held]], place[~held]
    if len(rest):
        previous, begins = np.roll(rest, 1), np.diff(rest_of, prepend=-1) != 0
        previous[begins] = rest_last[rest_of[begins]]
        steps = np.where(np.isfinite(previous), np.maximum(rest - previous, 0.0), 0.0)
        rest_gap2 += np.bincount(rest_of, steps * steps, m)
        np.minimum.at(rest_first, rest_of, rest)
        np.maximum.at(rest_last, rest_of, rest)
    sums = (n, fwd, length, length2, first, last, rest_first, rest_last, rest_gap2)
    kept = (kinds["protocol"].astype(int), kinds["n"], *(c[order[held]] for c in columns))
    return (*(c.tolist() for c in sums), *(c.tolist() for c in kept), [x if isinstance(x, str) else None for x in names], kinds["of"].tolist(), place[held].tolist())


def _flow_rows(window: int, state: tuple, fragment: bool = False) -> pd.DataFrame:
    """A closed window, a row for each file. The sum of its gaps is its span; their squares are those between held packets, from these to the rest, and within the rest."""
    n, fwd, length, length2, first, last, rest_first, _, rest_gap2, protocols, counts, times, _, lens, ways, files, protocol_of, packet_of = _arrays(state)
    starts = np.searchsorted(packet_of, np.arange(len(n)))
    ends = np.append(starts[1:], len(times))
    gaps = np.diff(times, prepend=times[0])
    gaps[starts] = 0.0
    rest = np.where(n > ends - starts, rest_first - times[ends - 1], 0.0)
    gap2 = np.add.reduceat(gaps * gaps, starts) + rest_gap2 + rest * rest
    order = np.lexsort((protocols, -counts, protocol_of))
    found = pd.Series(protocols[order], index=protocol_of[order], dtype="Int32")
    protocol = found[~found.index.duplicated()].reindex(range(len(n)))
    means = [length / n, 1000.0 * (last - first) / n]
    spreads = [np.sqrt(np.maximum(0.0, squares / n - mean * mean)) for squares, mean in zip((length2, 1e6 * gap2), means, strict=True)]
    series = [[x.tolist() for x in np.split(c, starts[1:])] for c in (lens, 1000.0 * gaps, ways)]
    columns = (files, window, n, fwd, n - fwd, length, means[0], spreads[0], means[1], spreads[1], 1000.0 * (last - first), protocol.array, *series, fragment)
    return pd.DataFrame(dict(zip([field.split()[0] for field in _STATS.split(", ")], columns, strict=True)))


def _flow_row(file: str, window: int, state: tuple) -> pd.DataFrame:
    """The row of a state of one file."""
    return _flow_rows(window, state).assign(file=file)


def bounded_windowed_flows(
    packets: DataFrame, seconds: float, origin: float = 0.0, late_windows: int = 2, max_packets: int = MAX_PACKETS, fragments_for: float | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """:func:`windowed_flows` with state of bounded size: sums and the first ``max_packets`` packets of a file's window, by time.

    Files are dealt into ``buckets`` by a hash; those of one bucket share a window's state and its call, so that calls grow with windows, not with files. The number must
    stay the same for a stream's checkpoint.

    A window closes when a packet more than ``late_windows`` windows later has come; packets of closed windows are dropped and counted by Spark. Packets may come in any
    order. All columns are exact but one: the deviation of gaps, in windows of more than ``max_packets`` packets, needs those past the first in order of time.

    With ``fragments_for``, packets that come up to so many seconds later than that are kept: those of one window and batch are a row of their own, whose column ``fragment`` is
    true. A closed window leaves nothing behind, as the watermark alone says that it is closed; so the time for which fragments are taken costs no state.
    """
    placed = packets.withColumn("window_id", F.floor((F.col("ts") - origin) / seconds).cast("long"))
    # Event time runs ahead of the window's end by the time for fragments, and the watermark behind event time: it passes ends as it would without, and drops rows so much later.
    kept_for, end = fragments_for or 0.0, origin + (F.col("window_id") + 1) * seconds
    ends = placed.withColumn("dropped_at", F.timestamp_micros(((end + kept_for) * 1e6).cast("long"))).withColumn("closed_at", F.ceil(end * 1000.0).cast("long"))
    ends = ends.withWatermark("dropped_at", f"{late_windows * seconds + kept_for} seconds")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        _, window, closed_at, _ = key
        if state.hasTimedOut:
            yield _flow_rows(window, state.get)
            state.remove()
            return
        coming = pd.concat(list(batches))
        if fragments_for is not None and closed_at <= state.getCurrentWatermarkMs():
            if state.exists:
                yield _flow_rows(window, state.get)
                state.remove()
            yield _flow_rows(window, _with_packets(None, coming, max_packets), fragment=True)
            return
        state.update(_with_packets(state.get if state.exists else None, coming, max_packets))
        state.setTimeoutTimestamp(int(closed_at))

    keys = ("bucket", "window_id", "closed_at", "dropped_at")
    ends = ends.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))
    rows = ends.select(*keys, "file", "seq", "ts", "length", "direction", "protocol").groupBy(*keys)
    stats = rows.applyInPandasWithState(update, _STATS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    item = F.arrays_zip("lens", "gaps", "ways")
    series = F.transform(item, lambda x, i: F.struct((i + 1).alias("rn"), x["lens"].alias("length"), x["gaps"].alias("iat"), x["ways"].alias("direction")))
    shown = ["file", "window_id"] if fragments_for is None else ["file", "window_id", "fragment"]
    return canonical_flows(stats.withColumn("series", series).drop("lens", "gaps", "ways"), shown)


class FollowedTable:
    """A small table that a stream keeps up to date: each batch writes a new version, named by the batch.

    A batch that is run again reads the version before it and writes its own anew, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, start: DataFrame):
        self.spark, self.folder, self.start = spark, folder, start

    def version(self, batch: int) -> DataFrame:
        return self.start if batch < 0 else self.spark.read.parquet(f"{self.folder}/v={batch}")

    def latest(self) -> DataFrame:
        """The newest version written, by this run or an earlier one; the start where there is none."""
        newest = self.newest(r"/v=(\d+)/[^/]*$")
        return self.version(-1 if newest is None else newest)

    def newest(self, form: str) -> int | None:
        """The largest number in the names of finished files; ``form`` finds it."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        try:
            paths = files.load(self.folder).select(F.regexp_extract("path", form, 1).try_cast("int").alias("v"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return paths.agg(F.max("v")).first()[0]

    def follow(self, stream: DataFrame, step, checkpoint: str) -> DataStreamWriter:
        """``step(table, batch)`` gives the next version of the table."""

        def write(batch: DataFrame, number: int) -> None:
            step(self.version(number - 1), batch).write.mode("overwrite").parquet(f"{self.folder}/v={number}")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class MergedTable(FollowedTable):
    """A table followed in pieces, for steps that give the same for all rows at once and for what they kept of parts (the newest rows, bottom-k).

    A piece covers the batches from one number to another; batch b writes one that covers as many as the largest power of two that divides b + 1, merged from the pieces
    there. So a row is written at most once for each power of two, a batch writes what about so many batches bring rather than the table, and a version is read from at
    most as many pieces as b + 1 has bits. Names follow from the batch's number alone, so a batch that runs again writes the same piece.
    """

    def __init__(self, spark: SparkSession, folder: str, start: DataFrame, step):
        super().__init__(spark, folder, start)
        self.step = step

    def piece(self, batch: int) -> str:
        return f"{self.folder}/{batch + 1 - (batch + 1 & -(batch + 1))}-{batch + 1}"

    def _pieces(self, end: int, first: int = 0) -> DataFrame:
        """What the pieces kept of batches ``first`` to ``end``, without ``end``."""
        rows = self.start.limit(0)
        while end > first:
            rows = rows.unionByName(self.spark.read.parquet(self.piece(end - 1)))
            end &= end - 1
        return rows

    def version(self, batch: int) -> DataFrame:
        return self.start if batch < 0 else self.step(self.start, self._pieces(batch + 1))

    def latest(self) -> DataFrame:
        newest = self.newest(r"/\d+-(\d+)/[^/]*$")
        return self.version(-1 if newest is None else newest - 1)

    def write(self, batch: DataFrame, number: int) -> None:
        end = number + 1
        self.step(self._pieces(number, end & number), batch).write.mode("overwrite").parquet(self.piece(number))

    def follow(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)


def newest_step(n: int):
    """Keeps the newest n rows per label: what was kept and the batch, cut again."""
    return lambda table, batch: newest_per_class(table.unionByName(batch.select(*table.columns)), n)


def balanced_step(group: str, k: int, ids: list[str], seed: int = 42):
    """Keeps the k rows of each group with the smallest keys; bottom-k composes over batches."""
    return lambda table, batch: balanced_sample(table.unionByName(batch.select(*table.columns)), group, k, ids, seed)


def prototype_step(**more):
    """Moves prototypes by the batch's trusted rows."""
    return lambda table, batch: update_trusted(batch, table, **more).select("label", "proto", "n")
