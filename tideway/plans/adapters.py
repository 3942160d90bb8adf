"""The given tables seen as packets, exports and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.functions.labels import protocol_number
from tideway.operators.windows import dealt

SQUEEZE = 1e5  # time runs this much faster, so that gaps are those of packets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of one file per user: ``(file, seq, ts, length, direction, protocol)``."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    name = F.when(F.col("event_type") == "click", "QUIC").when(F.col("event_type") == "view", "TLSv1.2").when(F.col("event_type") == "purchase", "tcp")
    name = name.when(F.col("event_type") == "signup", "udp").otherwise("icmp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("file"),
        F.col("event_id").alias("seq"),
        (1.0 + micros / 1e6 / SQUEEZE).alias("ts"),
        (F.col("value") * 10.0).alias("length"),
        F.when(F.col("event_type").isin("view", "click", "signup"), 1).otherwise(-1).alias("direction"),
        protocol_number(name).alias("protocol"),
    )


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as captured packets between forty suppliers and parts; a trace per year of shipping."""
    rows = table(spark, sf_dir, "lineitem")

    def end(key: str):
        return F.struct((F.col(key) % 40).alias("ip"), F.lit(0).alias("port"))

    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.year("l_shipdate").cast("string").alias("trace"),
        order.alias("record_no"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("ts"),
        F.when(F.col("l_linestatus") == "O", 17).otherwise(6).alias("proto"),
        end("l_suppkey").alias("src"),
        end("l_partkey").alias("dst"),
        (F.col("l_quantity") * 30.0).alias("length"),
        (F.col("l_returnflag") != "N").alias("accepted"),
    )


def order_category() -> Column:
    """The category of an order's flow, by its priority."""
    kinds = {"1-URGENT": "Streaming Media", "2-HIGH": "games", "3-MEDIUM": "videoconferencing", "4-NOT SPECIFIED": "file-sharing", "5-LOW": "search"}
    category = F.lit(None).cast("string")
    for priority, name in kinds.items():
        category = F.when(F.col("o_orderpriority") == priority, name).otherwise(category)
    return category


def order_exports(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    """Orders as exported flows, whose series are their lines; orders without lines have an empty one.

    ``chosen`` holds some of the orders, few enough to be broadcast: then only their lines are grouped. Else lines are dealt out in more tasks, not larger ones, where there are more.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.col("l_shipdate").cast("timestamp").alias("day"), "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("way")
        ).alias("line"),
    )
    if chosen is None:
        lines = dealt(lines, ["l_orderkey"], lines.count())
    else:
        lines = lines.join(F.broadcast(chosen.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def days(line):
        return F.unix_micros(line["day"]) / 8.64e10

    gaps = F.transform("lines", lambda x, i: F.when(i == 0, 0.0).otherwise((days(x) - days(F.get("lines", i - 1))) * 20.0))
    ways, sizes = F.transform("lines", lambda x: x["way"]), F.transform("lines", lambda x: x["l_quantity"] * 30.0)

    def joined(x):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: v.cast("string")), ","), F.lit("]"))

    ppi = F.concat(F.lit("["), F.concat_ws(",", joined(gaps), joined(ways), joined(sizes)), F.lit("]"))
    series = grouped.select("l_orderkey", ppi.alias("PPI"))
    orders = table(spark, sf_dir, "orders") if chosen is None else chosen
    orders = orders.join(series, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("APP"),
        order_category().alias("CATEGORY"),
        (F.col("o_totalprice") / 1e5).cast("string").alias("DURATION"),
        F.col("o_custkey").cast("string").alias("BYTES"),
        F.lit("x").alias("BYTES_REV"),
        (F.col("o_custkey") % 5).cast("string").alias("PACKETS"),
        (F.col("o_custkey") % 3).cast("string").alias("PACKETS_REV"),
        F.lit(None).cast("string").alias("PROTOCOL"),
        F.coalesce("PPI", F.lit("[[],[],[]]")).alias("PPI"),
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, z, label, app, seq, block)``: three apps to a label, blocks of 32 ids."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("z"),
        F.col("label").cast("long").alias("label"),
        (F.col("label").cast("long") * 3 + F.col("vec_id") % 3).alias("app"),
        F.col("vec_id").alias("seq"),
        F.floor(F.col("vec_id") / 32).alias("block"),
    )
