"""A stream's windows of many files: calls grow with windows and buckets, not with files."""

import numpy as np
import pandas as pd

from tideway.streaming import flows


def test_files_of_a_bucket_share_a_state():
    rng = np.random.default_rng(3)
    n = 4000
    rows = pd.DataFrame({
        "file": rng.choice([f"f{i}" for i in range(300)], n), "seq": np.arange(n), "ts": np.round(rng.random(n), 3) + 1, "length": rng.integers(40, 1500, n).astype(float),
        "direction": rng.choice([-1, 1], n), "protocol": rng.choice([6, 17, 1], n),
    })
    rows.loc[rows["file"] == "f7", "file"] = None
    state = None
    for part in np.array_split(np.arange(n), 3):
        state = flows._with_packets(state, rows.iloc[part], 128)
    found = flows._flow_rows(5, state)
    assert len(found) == rows["file"].nunique(dropna=False) and set(found["window_id"]) == {5}
    for _, row in found.iterrows():
        own = rows[rows["file"].isna() if row["file"] is None else rows["file"] == row["file"]]
        (alone,) = flows._flow_row(row["file"], 5, flows._with_packets(None, own.drop(columns="file"), 128)).to_dict("records")
        assert {k: v for k, v in row.items() if not isinstance(v, float)} == {k: v for k, v in alone.items() if not isinstance(v, float)}
        assert np.allclose([v for v in row if isinstance(v, float)], [v for v in alone.values() if isinstance(v, float)])


def test_one_state_for_many_files(spark, tmp_path):
    """A thousand files in four buckets and one window: four states."""
    rows = [(f"f{i % 1000}", i, 1.0 + i / 3000, 10.0, 1, 6) for i in range(2500)]
    schema = "file string, seq long, ts double, length double, direction int, protocol int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    found = flows.bounded_windowed_flows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1.0, 1.0, buckets=4)
    run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [o.numRowsTotal for p in run.recentProgress for o in p.stateOperators][-1] == 4
