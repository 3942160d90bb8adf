"""Drawn series: numbers follow the rows' own keys, and a small table is work for all cores."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tideway.operators import features
from tideway.plans.registry import QUERIES


def key(*parts) -> float:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def normal(*parts) -> float:
    return math.sqrt(-2 * math.log(1 - key("u", *parts))) * math.cos(2 * math.pi * key("v", *parts))


def tasks(rows) -> int:
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_drawn_series_are_spread_over_tasks(spark, sf):
    assert tasks(QUERIES["f1_to_f4_drawn_series"][0](spark, sf)) > 8


def test_drawn_series_follow_their_keys(spark):
    rows = spark.range(200).coalesce(1).select("id", F.lit(6.0).alias("fwd packets"), F.lit(3.0).alias("bwd packets"), F.lit(700.0).alias("packet length mean"), F.lit(90.0).alias("packet length std"))
    drawn = features.packet_series(rows, "id")
    found = {r["id"]: r for r in drawn.where("id in (3, 150)").collect()}
    for i, r in found.items():
        assert r["lens"] == pytest.approx([min(max(700 + 90 * normal("len", i, k), 40), 1500) for k in range(1, 10)])
        assert r["gaps"] == pytest.approx([max(20 + 4 * normal("iat", i, k), 0) for k in range(1, 10)])
        assert r["ways"] == [1.0 if key("dir", i, k) < 6 / 9 else -1.0 for k in range(1, 10)]


def test_drifting_networks_are_spread_over_tasks(spark, sf):
    assert tasks(QUERIES["f11_f12_drifting_network"][0](spark, sf)) > 8
    (row,) = features.network_series(spark.createDataFrame([(7, 50.0)], "id long, rtt double"), "id").collect()
    drift = 0.03 * normal("net", 7, 5, 0) * (0.5 + 5 / 23)
    assert row["network_seq"][5][0] == pytest.approx(math.log1p(50) / 8 + drift, abs=1e-6)
