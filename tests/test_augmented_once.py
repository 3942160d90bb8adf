"""Flows and their augmented twins come from one pass over the packets."""

from pyspark.sql import functions as F

from tideway.operators import features
from tideway.plans.registry import QUERIES


def test_flows_are_made_once_for_all_twins(spark, sf):
    rows = QUERIES["f13_f14_f15_augmented"][0](spark, sf)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [lag") == 1


def test_twins_are_those_of_each_copy(spark):
    flows = spark.range(5).select(F.col("id"), F.array(F.lit(100.0)).alias("lens"), F.lit(30.0).alias("rtt_ms"), F.lit("a").alias("app"), F.lit("s").alias("service"), F.lit("given").alias("condition"), F.lit("x").alias("source"))
    base = features.flow_records(flows, "id")
    found = {(r["id"], r["copy"]): r.asDict() for r in features.with_augmented(base, "id", 2).collect()}
    plain = {(r["id"], 0): r.asDict() | {"copy": 0} for r in base.collect()}
    for copy in (1, 2):
        twins = features.augmented(base, "id", F.lit(copy)).collect()
        plain |= {(r["id"], copy): r.asDict() | {"copy": copy, "source": "x_aug"} for r in twins}
    assert found == plain
    assert found[(0, 0)]["condition"] == "given"
