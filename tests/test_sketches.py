"""Sketches by day, merged, against exact rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.operators import sketches


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 9), f"name {int(x)}", float(v)) for i, (x, v) in enumerate(zip(rng.zipf(1.3, 30_000) % 20_000, rng.lognormal(0, 2, 30_000), strict=True))]
    rows += [(50, None, None), (51, "only", 1.0)]
    return spark.createDataFrame(rows, "day int, name string, value double").repartition(6).cache()


def test_merged_days_are_within_bounds_of_exact_rows(spark, events):
    by_day = sketches.sketched(events, ["day"], ["name"], ["value"])
    whole = sketches.estimates(sketches.merged(by_day)).first()
    names = events.agg(F.count_distinct("name")).first()[0]
    assert whole["rows_n"] == 30_002 and abs(whole["n_name"] - names) <= sketches.DISTINCT_ERROR * names
    values = np.sort([r[0] for r in events.where("value is not null").select("value").collect()])
    for rank, value in zip((0.5, 0.95, 0.99), whole["p_value"], strict=True):
        low, high = np.searchsorted(values, [value, value], "left")[0], np.searchsorted(values, value, "right")
        assert low / len(values) - sketches.QUANTILE_ERROR <= rank <= high / len(values) + sketches.QUANTILE_ERROR
    once = sketches.estimates(sketches.sketched(events, [], ["name"], ["value"])).first()
    assert abs(once["n_name"] - whole["n_name"]) <= 2 * sketches.DISTINCT_ERROR * names
    # Weeks of days, from the stored table alone.
    weeks = sketches.estimates(sketches.merged(by_day.withColumn("week", F.floor(F.col("day") / 7)), ["week"]), ["week"])
    assert {r["week"]: r["rows_n"] for r in weeks.collect()} == {r["week"]: r["n"] for r in events.groupBy(F.floor(F.col("day") / 7).alias("week")).agg(F.count("*").alias("n")).collect()}


def test_frequencies_are_never_too_small(spark, events):
    sketch = sketches.frequency_sketch(events, ["day"], "name")
    exact = {r["name"]: r["n"] for r in events.where("name is not null").groupBy("name").agg(F.count("*").alias("n")).collect()}
    found = {r["name"]: r["most"] for r in sketches.frequencies(sketch, events.where("name is not null"), "name").collect()}
    assert found.keys() == exact.keys() and all(found[k] >= n for k, n in exact.items())
    assert np.mean([found[k] - n <= 2 * 30_000 / sketches.FREQUENT_WIDTH for k, n in exact.items()]) > 0.95
    absent = spark.createDataFrame([("never there",)], "name string")
    assert sketches.frequencies(sketch.limit(0), absent, "name").first()["most"] == 0


def test_empty_and_null_values(spark, events):
    none = sketches.estimates(sketches.merged(sketches.sketched(events.where("day = 50"), ["day"], ["name"], []))).first()
    assert (none["rows_n"], none["n_name"]) == (1, 0)
    assert sketches.sketched(events.limit(0), ["day"], ["name"], ["value"]).count() == 0
