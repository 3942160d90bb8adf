"""Golden rows, properties and edge cases of the flow operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.functions import labels, values
from tideway.operators import embeddings, features, flows, memory, metrics, sampling, windows
from tideway.plans.adapters import event_packets, labelled_vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, label, service",
    [
        (None, "unknown", "unknown"), ("", "unknown", "unknown"), ("   ", "", "unknown"), (" YT ", "youtube", "streaming"), ("a____b", "a__b", "unknown"), ("YouTube Live", "youtube_live", "streaming"),
        ("Streaming-Media", "streaming_media", "streaming"), ("lol", "league_of_legends", "gaming"), ("car", "car", "xr_interactive"), ("http download", "file_download", "bulk_transfer"),
        ("valve", "valve", "gaming"), ("\tzoom\n", "zoom", "conferencing"),
    ],
)
def test_labels(spark, raw, label, service):
    c = F.lit(raw).cast("string")
    assert (one(spark, labels.normalize_label(c)), one(spark, labels.infer_service(c))) == (label, service)


@pytest.mark.parametrize("text, number", [("QUIC", 17), ("quicly", 17), (" tls1.3", 6), ("47.9", 47), ("inf", 0), (None, 0), ("nan", 0), ("1e300", 0), ("icmp", 0), ("6", 6)])
def test_protocols(spark, text, number):
    assert one(spark, labels.protocol_number(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize("address, private", [("10.1.1.1", True), ("172.2.0.1", True), ("172.200.0.1", True), ("172.15.0.1", False), ("172.30.9.9", True), ("172.3.1.1", False), ("192.168.0.1", True), (None, False)])
def test_private_addresses(spark, address, private):
    assert one(spark, labels.is_private(F.lit(address).cast("string"))) is private


@pytest.mark.parametrize("rtt, jitter, loss, condition", [(80, 25, 0.01, "good"), (80.1, 25, 0, "moderate"), (181, 25, 0.011, "degraded"), (181, 26, 0.05, "bad"), (181, 26, 0.04, "degraded")])
def test_conditions(spark, rtt, jitter, loss, condition):
    assert one(spark, labels.infer_condition(*[F.lit(float(x)) for x in (rtt, jitter, loss)])) == condition


def test_condition_index(spark):
    assert [one(spark, labels.condition_index(F.lit(c))) for c in ("good", "moderate", "degraded", "bad", "unknown", "x")] == [0, 1, 2, 3, 4, 4]


@pytest.mark.parametrize("text, size", [("[[0,1],[1,-1],[5,6]]", 2), ("[[0,1,2],[1,-1],[5]]", 1), ("[[],[],[]]", None), ("[[1],[1]]", None), ("oops", None), (None, None), ("([0, 1], [1, 1], [5, 6], [9])", 2)])
def test_ppi(spark, text, size):
    found = one(spark, values.parse_ppi(F.lit(text).cast("string")))
    assert (None if found is None else len(found["iats"])) == size


def test_series_text_and_back(spark):
    assert one(spark, values.parse_series(F.lit("1;2|3 4,,5"))) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert one(spark, values.parse_series(F.lit("1;x"))) is None
    assert one(spark, values.series_text(F.array(F.lit(1.0), F.lit(2.25)), 4)) == "1.0000;2.2500"


def test_paths(spark):
    paths = {"a/YouTube_Live/x.csv": "youtube_live", "a/YouTube Live/x.csv": "youtube", "in/my app/f.csv": "my_app"}
    for path, app in paths.items():
        assert one(spark, labels.app_from_path(F.lit(path))) == app


def test_window_counts_add_up(spark, sf):
    packets = event_packets(spark, sf)
    found = windows.flows_by_file(packets, 1.0)
    assert found.agg(F.sum("total_packets")).first()[0] == packets.count()
    assert found.where("total_packets <> total_fwd_packets + total_bwd_packets").count() == 0


def test_mode_tie_takes_the_smallest(spark):
    rows = spark.createDataFrame([("f", i, 1.0 + i / 100, 10.0, 1, p) for i, p in enumerate((17, 6, 17, 6))], "file string, seq long, ts double, length double, direction int, protocol int")
    assert windows.flows_by_file(rows).first()["protocol"] == 6


def test_split_sizes(spark):
    rows = spark.createDataFrame([(i, label) for label, n in (("a", 1), ("b", 2), ("c", 3), ("d", 30)) for i in range(n)], "i long, label string")
    found = sampling.stratified_split(rows.withColumn("id", F.concat("label", "i")), "label", 0.15, ["id"])
    tests = {r["label"]: r["n"] for r in found.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert tests == {"b": 1, "c": 1, "d": 4} and found.count() == rows.count()


def test_sampling_does_not_depend_on_partitions(spark, sf):
    rows = event_packets(spark, sf).select("seq", "file")
    first = sampling.balanced_sample(rows, "file", 3, ["seq"]).collect()
    assert sorted(first) == sorted(sampling.balanced_sample(rows.repartition(7), "file", 3, ["seq"]).collect())


def test_min_rows(spark):
    assert sampling.assert_min_rows(spark.range(20)).count() == 20
    with pytest.raises(ValueError):
        sampling.assert_min_rows(spark.range(19))


def test_label_column():
    assert flows.detect_label_column(["x", "CLASS", "Application"]) == "Application"
    with pytest.raises(ValueError):
        flows.detect_label_column(["x"])


def test_macro_f1_counts_labels_only_predicted(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (0, 0)], "label int, pred int")
    assert abs(metrics.macro_f1(rows).first()[0] - (1 + 2 / 3 + 0) / 3) < 1e-12
    assert metrics.macro_f1(rows.limit(0)).first()[0] == metrics.accuracy(rows.limit(0)).first()[0] == 0


def test_missing_series_are_drawn(spark):
    rows = spark.createDataFrame([(1, "2000", "4000"), (2, None, None)], "id long, `pkt len mean` string, `packet length variance` string")
    found = features.packet_matrix(rows, "id").select("id", "lens", "gaps", "ways", "packet_seq").collect()
    for r in found:
        assert len(r["lens"]) == len(r["gaps"]) == len(r["ways"]) == len(r["packet_seq"]) == 48
        assert all(40 <= x <= 1500 for x in r["lens"]) and min(r["gaps"]) >= 0 and set(r["ways"]) <= {1.0, -1.0}
    assert abs(np.mean(found[1]["lens"]) - 600) < 120


def test_augmentation_changes_what_it_should(spark):
    rows = spark.createDataFrame([(str(i), "a", "gaming", "s") for i in range(30)], "id string, app string, service string, source string").withColumn("condition", F.lit("good"))
    base = features.flow_records(rows, "id", noise=0.0)
    both = base.alias("b").join(features.augmented(base, "id", noise=0.0).alias("t"), "id").select("b.packet_seq", "t.packet_seq", "b.network_seq", "t.network_seq").collect()
    scales = set()
    for before, after, net, net_after in both:
        a, b, n, m = (np.array(x) for x in (before, after, net, net_after))
        moved = a[:, 1] > 1e-3
        scales |= set(np.round(b[moved, 1] / a[moved, 1], 2))
        assert np.allclose(np.delete(a, 1, axis=1), np.delete(b, 1, axis=1)) and np.allclose(n[:, 3:], m[:, 3:])
        assert (m[:, 1] - n[:, 1] > -1e-6).all() and (m[:, 2] - n[:, 2] > -1e-6).all()
    assert scales == {0.7, 1.0, 1.8, 3.2}


def test_pair_similarity_equals_all_pairs(spark, sf):
    rows = labelled_vectors(spark, sf)
    data = rows.select("z", "label").collect()
    z, y = np.array([r["z"] for r in data], dtype=float), np.array([r["label"] for r in data])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    sims, same, off = z @ z.T, y[:, None] == y[None], ~np.eye(len(y), dtype=bool)
    found = embeddings.pair_similarity(rows).first()
    assert abs(found["intra"] - sims[same & off].mean()) < 1e-9 and abs(found["inter"] - sims[~same].mean()) < 1e-9


def test_knn_in_blocks_equals_one_block(spark, sf):
    rows = labelled_vectors(spark, sf)
    train, test = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    small = embeddings.knn(train, test, block_train=50, block_test=20).select("test_id", "train_id", "rank")
    assert sorted(small.collect()) == sorted(embeddings.knn(train, test).select("test_id", "train_id", "rank").collect())


def _contrastive(rows, memory, temperature):
    """The score by a loop over anchors."""
    def unit(z):
        z = np.array(z, dtype=float)
        return z / max(np.linalg.norm(z), 1e-12)

    scores = []
    for r in rows:
        others = [(x["label"], unit(x["z"])) for x in rows if x["block"] == r["block"] and x["id"] != r["id"]]
        others += [(x["label"], unit(x["z"])) for x in memory]
        v = np.array([unit(r["z"]) @ z for _, z in others]) / temperature
        equal = np.array([label == r["label"] for label, _ in others], dtype=bool)
        if equal.any():
            scores.append(np.log(np.exp(v).sum()) - v[equal].mean())
    return float(np.mean(scores)) if scores else 0.0


@pytest.mark.parametrize("remembered, block", [(None, 64), (0, 64), (40, 7), (40, 2048)])
def test_contrastive_score_against_a_loop(spark, sf, remembered, block):
    # Blocks of one row have contrasts in the memory alone.
    rows = labelled_vectors(spark, sf).where("id < 90").withColumn("block", F.when(F.col("id") < 80, F.col("block")).otherwise(F.col("id")))
    kept = None if remembered is None else labelled_vectors(spark, sf).where("id >= 100").orderBy("id").limit(remembered)
    found = embeddings.contrastive_score(rows, 0.07, kept, block=block).first()["score"]
    assert found == pytest.approx(_contrastive(rows.collect(), kept.collect() if kept is not None else [], 0.07))


def test_contrastive_score_without_positives(spark, sf):
    rows = labelled_vectors(spark, sf).where("id < 20").withColumn("label", F.col("id"))
    assert embeddings.contrastive_score(rows).first()["score"] == 0.0


def test_more_prototypes_than_are_broadcast(spark, sf):
    rows = labelled_vectors(spark, sf)
    protos = embeddings.prototypes(rows.where("id % 3 = 0"))
    few, many = (embeddings.nearest_prototype(rows, protos, most=most).select("id", "pred", F.round("sim", 9)).orderBy("id").collect() for most in (100, 2))
    assert few == many and len(few) == rows.count()
    whole, parts = (embeddings.prototype_entropy(rows, protos, most=most, block=block).first()["score"] for most, block in ((100, 2048), (2, 3)))
    assert whole == pytest.approx(parts)


def test_scores_in_parts_of_blocks(spark, sf):
    rows = labelled_vectors(spark, sf)
    assert embeddings.margin_score(rows).first()["score"] == pytest.approx(embeddings.margin_score(rows, most=5).first()["score"])


def test_leave_one_group_out_against_a_loop(spark, sf):
    rows = labelled_vectors(spark, sf).withColumn("app", F.when(F.col("id") < 60, 1).otherwise(F.col("app")))
    data = rows.collect()
    z = {r["id"]: np.array(r["z"], dtype=float) / np.linalg.norm(r["z"]) for r in data}
    found = {r["id"]: r["pred"] for r in embeddings.leave_one_group_out(rows).collect()}
    assert set(found) == {r["id"] for r in data}
    for app in {r["app"] for r in data}:
        protos = {}
        for label in sorted({r["label"] for r in data if r["app"] != app}):
            mean = np.mean([z[r["id"]] for r in data if r["app"] != app and r["label"] == label], axis=0)
            protos[label] = mean / np.linalg.norm(mean)
        for r in data:
            if r["app"] == app:
                assert found[r["id"]] == max(protos, key=lambda k: (protos[k] @ z[r["id"]], -k))


def test_leave_one_group_out_in_small_blocks_with_hot_and_lonely_groups(spark):
    """A group with half of all rows, groups that own a label, a label that only one group has, equal prototypes, and a group of everything."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 7)), int(i % 12) if i % 2 else 50, rng.normal(size=5).tolist()) for i in range(400)]
    rows += [(1000 + i, 90 + i, 60 + i, rng.normal(size=5).tolist()) for i in range(5)] + [(2000, 20, 70, [1.0, 0.0, 0.0, 0.0, 0.0]), (2001, 21, 71, [2.0, 0.0, 0.0, 0.0, 0.0]), (2002, 5, 72, [1.0, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, label int, app long, z array<double>")
    found = embeddings.leave_one_group_out(table, block=3)
    # No table of groups times classes: every pair of sides meets on a key.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    found = {r["id"]: (r["app"], r["pred"]) for r in found.collect()}
    unit = {i: np.array(z) / np.linalg.norm(z) for i, _, _, z in rows}
    for i, _, app, _ in rows:
        protos = {label: np.mean([unit[j] for j, k, other, _ in rows if other != app and k == label], axis=0) for label in {k for _, k, other, _ in rows if other != app}}
        want = max(protos, key=lambda k: (round(float(protos[k] @ unit[i] / np.linalg.norm(protos[k])), 12), -k))
        assert found[i] == (app, want), i
    alone = spark.createDataFrame([(1, 1, 1, [1.0]), (2, 2, 1, [1.0])], "id long, label int, app long, z array<double>")
    assert embeddings.leave_one_group_out(alone).collect() == []


def test_trusted_updates_against_a_loop(spark, sf):
    rows = labelled_vectors(spark, sf)
    start = memory.bootstrap(rows.where("id % 10 = 0 and label <> 3"), spark.range(11).select(F.col("id").alias("label")))
    protos = {r["label"]: (np.array(r["proto"]) if r["proto"] else None, r["n"]) for r in start.collect()}
    frozen, updates = dict(protos), dict.fromkeys(protos, 0)
    for r in rows.where("id % 10 <> 0").orderBy("seq").collect():
        z = np.array(r["z"], dtype=float)
        z /= np.linalg.norm(z)
        sims = {k: float(p @ z) for k, (p, n) in frozen.items() if n}
        best = min(k for k, s in sims.items() if s == max(sims.values()))
        proto, n = protos[r["label"]]
        if frozen[r["label"]][1] == 0 and updates[r["label"]] == 0:
            protos[r["label"]], updates[r["label"]] = (z, 1), 1
        elif frozen[r["label"]][1] and best == r["label"] and sims[best] >= 0.3:
            mixed = 0.95 * proto + 0.05 * z
            protos[r["label"]] = (mixed / np.linalg.norm(mixed), n + 1)
            updates[r["label"]] += 1
    for r in memory.update_trusted(rows.where("id % 10 <> 0"), start, trust=0.3).collect():
        proto, n = protos[r["label"]]
        assert (r["n"], r["updates"]) == (n, updates[r["label"]])
        assert proto is None or np.allclose(r["proto"], proto)


def test_report_marks_missing_metrics(spark):
    found = {r["kpi"]: (r["value"], r["status"]) for r in metrics.report(spark, spark.createDataFrame([("service_similarity.intra", 0.7), ("latency.mean_ms", 100.0)], "name string, value double")).collect()}
    assert found["Embedding intra cosine"] == ("0.7000", "PASS") and found["Mean latency per flow"] == ("100.00 ms", "FAIL")
    assert found["SVM classification accuracy"] == ("missing", "FAIL") and found["Context invariance score"] == ("missing", "INFO")


def test_stable_key_is_uniform(spark):
    mean = spark.range(4000).agg(F.avg(labels.stable_key(F.col("id")))).first()[0]
    assert abs(mean - 0.5) < 0.03 and not math.isnan(mean)
