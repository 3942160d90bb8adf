"""Registered queries on features and embeddings, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.operators import embeddings, features, linear_machine, memory, metrics, near_blocks, sampling, windows
from tideway.plans.adapters import event_packets, labelled_vectors, table
from tideway.plans.flow_queries import FLOWS_SQL, sql_condition, sql_key

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _unit(z: str) -> str:
    return f"list_transform({z}, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform({z}, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12::DOUBLE))"


VECTORS = f"""vectors AS (SELECT vec_id AS id, {_unit('embedding')} AS z, label::BIGINT AS label, label::BIGINT * 3 + vec_id % 3 AS app, vec_id AS seq, vec_id // 32 AS block FROM embeddings)"""
_KEY = sql_key("'42'", "id::VARCHAR")
SPLIT = f"""{VECTORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, id) AS turn, count(*) OVER (PARTITION BY label) AS n FROM vectors),
 sides AS (SELECT *, turn <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.2::DOUBLE, 0)) ELSE 0 END AS is_test FROM ranked), train AS (SELECT * FROM sides WHERE NOT is_test), test AS (SELECT * FROM sides WHERE is_test)"""


def _protos(source: str, keys: str = "label") -> str:
    return f"""(SELECT {keys}, {_unit('mean')} AS proto, n FROM (SELECT {keys}, list(m ORDER BY pos) AS mean, max(n) AS n FROM (
      SELECT {keys}, pos, avg(x) AS m, count(*) AS n FROM (SELECT {keys}, unnest(z) AS x, generate_subscripts(z, 1) AS pos FROM {source}) GROUP BY {keys}, pos) GROUP BY {keys}))"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sampling.stratified_split(labelled_vectors(spark, sf_dir), "label", 0.2, ["id"])
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query(f"WITH {VECTORS} SELECT id, round(list_sum(z), 6) AS total, round(list_inner_product(z, z), 6) AS norm, round(z[1], 6) AS first FROM vectors")
def e2_unit_vectors(spark, sf_dir):
    z = labelled_vectors(spark, sf_dir).select("id", features.unit(F.col("z")).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return z.select("id", F.round(total, 6).alias("total"), F.round(embeddings.dot(F.col("z"), F.col("z")), 6).alias("norm"), F.round(F.col("z")[0], 6).alias("first"))


@query(f"""WITH {VECTORS} SELECT round(coalesce(avg(CASE WHEN a.label = b.label THEN list_inner_product(a.z, b.z) END), 0), 6) AS intra,
 round(coalesce(avg(CASE WHEN a.label <> b.label THEN list_inner_product(a.z, b.z) END), 0), 6) AS inter FROM vectors a JOIN vectors b ON a.id < b.id""")
def e3_j2_pair_similarity(spark, sf_dir):
    found = embeddings.pair_similarity(labelled_vectors(spark, sf_dir))
    return found.select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


_KNN = f"""{SPLIT}, near AS (SELECT test_id, truth, label, sim, turn FROM (SELECT t.id AS test_id, t.label AS truth, r.label, list_inner_product(t.z, r.z) AS sim,
 row_number() OVER (PARTITION BY t.id ORDER BY list_inner_product(t.z, r.z) DESC, r.id) AS turn FROM test t, train r) WHERE turn <= 5),
 votes AS (SELECT test_id, any_value(truth) AS label, label AS vote, count(*) AS n FROM near GROUP BY test_id, label),
 preds AS (SELECT test_id AS id, label, vote AS pred FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY n DESC, vote) AS place FROM votes) WHERE place = 1)"""


def _sql_f1(rows: str) -> str:
    return f"""(SELECT coalesce(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 0) FROM (SELECT tp / greatest(predicted, 1)::DOUBLE AS p, tp / greatest(actual, 1)::DOUBLE AS r FROM (
 SELECT l, (SELECT count(*) FROM {rows} WHERE label = l AND pred = l) AS tp, (SELECT count(*) FROM {rows} WHERE label = l) AS actual, (SELECT count(*) FROM {rows} WHERE pred = l) AS predicted
 FROM (SELECT label AS l FROM {rows} UNION SELECT pred FROM {rows}))))"""


@query(f"WITH {_KNN} SELECT id, label, pred FROM preds")
def e4_knn(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    votes = embeddings.vote(embeddings.knn(train, test))
    return test.join(votes, F.col("id") == F.col("test_id")).select("id", "label", "pred")


@query(f"WITH {_KNN} SELECT test_id, label, round(sim, 6) AS sim, turn AS rank FROM near")
def e4_pruned_neighbours(spark, sf_dir):
    """The neighbours themselves, from blocks around pivots; blocks that a bound excludes are not compared."""
    found, _ = near_blocks.knn_pruned(*sides(spark, sf_dir))
    return found.select("test_id", "label", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KNN} SELECT round((SELECT avg((label = pred)::INT) FROM preds), 6) AS accuracy, round({_sql_f1('preds')}, 6) AS macro_f1")
def e5_a6_a7_classification(spark, sf_dir):
    preds = e4_knn(spark, sf_dir)
    both = metrics.accuracy(preds).join(metrics.macro_f1(preds), F.lit(True))  # one row each
    return both.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_PROTO = f"""{SPLIT}, protos AS {_protos('train')}, scored AS (SELECT t.id, t.label, p.label AS pred, list_inner_product(t.z, p.proto) AS sim FROM test t, protos p),
 best AS (SELECT id, label, pred, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pred) AS turn FROM scored) WHERE turn = 1)"""


@query(f"WITH {_PROTO} SELECT id, label, pred, round(sim, 6) AS sim FROM best")
def e7_m3_m4_prototypes(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    found = embeddings.nearest_prototype(test, embeddings.prototypes(train))
    return found.select("id", "label", "pred", F.round("sim", 6).alias("sim"))


@query(f"""WITH {VECTORS}, others AS (SELECT DISTINCT v.app AS held, w.id AS oid, w.label, w.z FROM vectors v, vectors w WHERE v.app <> w.app),
 protos AS {_protos('others', 'held, label')}, scored AS (SELECT v.id, v.label, v.app, p.label AS pred, row_number() OVER (PARTITION BY v.id ORDER BY list_inner_product(v.z, p.proto) DESC, p.label) AS turn FROM vectors v JOIN protos p ON v.app = p.held)
SELECT id, label, app, pred FROM scored WHERE turn = 1""")
def e8_j3_leave_one_app_out(spark, sf_dir):
    return embeddings.leave_one_group_out(labelled_vectors(spark, sf_dir))


@query("""WITH parts AS (SELECT vec_id, i, j, embedding[i]::DOUBLE AS x, embedding[32 + j]::DOUBLE AS y FROM embeddings, range(1, 33) a(i), range(1, 33) b(j))
SELECT round(avg(c * c) * 1e6, 6) AS score FROM (SELECT i, j, covar_samp(x, y) AS c FROM parts GROUP BY i, j)""")
def e10_cross_covariance(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir).select(F.slice("z", 1, 32).alias("a"), F.slice("z", 33, 32).alias("b"))
    return embeddings.cross_covariance_score(rows).select(F.round(F.col("score") * 1e6, 6).alias("score"))


_PAIRS = f"{VECTORS}, pairs AS (SELECT a.block, a.id, a.label, b.label AS other, list_inner_product(a.z, b.z) AS sim FROM vectors a JOIN vectors b ON a.block = b.block AND a.id <> b.id)"


@query(f"""WITH {_PAIRS} SELECT round(coalesce((SELECT avg(greatest(0, 0.75::DOUBLE - sim) ** 2) FROM pairs WHERE label = other), 0) + coalesce((SELECT avg(greatest(0, sim - 0.2::DOUBLE) ** 2) FROM pairs WHERE label <> other), 0), 6) AS score""")
def e11_margin_score(spark, sf_dir):
    return embeddings.margin_score(labelled_vectors(spark, sf_dir)).select(F.round("score", 6).alias("score"))


@query(f"""WITH {SPLIT}, protos AS {_protos('train')}, logits AS (SELECT t.id, t.label, p.label AS class, list_inner_product(t.z, p.proto) / 0.07::DOUBLE AS v FROM test t, protos p)
SELECT round(avg(s), 6) AS score FROM (SELECT id, ln(sum(exp(v))) - max(CASE WHEN class = label THEN v END) AS s FROM logits GROUP BY id)""")
def e12_prototype_entropy(spark, sf_dir):
    train, test = sides(spark, sf_dir)
    return embeddings.prototype_entropy(test, embeddings.prototypes(train)).select(F.round("score", 6).alias("score"))


@query(f"""WITH {_PAIRS} SELECT round(avg(s), 6) AS score FROM (SELECT block, id, ln(sum(exp(sim / 0.07::DOUBLE))) - avg(CASE WHEN label = other THEN sim / 0.07::DOUBLE END) AS s FROM pairs GROUP BY block, id) WHERE s IS NOT NULL""")
def e13_contrastive_score(spark, sf_dir):
    return embeddings.contrastive_score(labelled_vectors(spark, sf_dir)).select(F.round("score", 6).alias("score"))


_MEMORY = """memory AS (SELECT label, z FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS turn FROM vectors)
 JOIN (SELECT label, min(seq) AS first FROM vectors GROUP BY label) USING (label) WHERE turn <= 20 ORDER BY first, seq LIMIT 90)"""


@query(f"""WITH {_PAIRS}, {_MEMORY}, contrasts AS (SELECT block, id, label, other, sim FROM pairs UNION ALL SELECT v.block, v.id, v.label, m.label, list_inner_product(v.z, m.z) FROM vectors v, memory m)
SELECT round(coalesce(avg(s), 0), 6) AS score FROM (SELECT block, id, ln(sum(exp(sim / 0.07::DOUBLE))) - avg(CASE WHEN label = other THEN sim / 0.07::DOUBLE END) AS s FROM contrasts GROUP BY block, id) WHERE s IS NOT NULL""")
def e13_m2_contrastive_with_memory(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min("seq").alias("first"))
    kept = memory.sample_memory(memory.newest_per_class(rows, 20), first, 90)
    return embeddings.contrastive_score(rows, memory=kept).select(F.round("score", 6).alias("score"))


def _scores(section: str, name: str, preds: DataFrame) -> DataFrame:
    """Accuracy and macro F1 of predictions as long metrics."""
    both = (metrics.accuracy(preds).withColumnRenamed("accuracy", f"{name}_accuracy"), metrics.macro_f1(preds).withColumnRenamed("macro_f1", f"{name}_macro_f1"))
    return metrics.all_metrics(*[metrics.long_metrics(section, row) for row in both])


def _all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = sides(spark, sf_dir)
    rows = labelled_vectors(spark, sf_dir)
    near = embeddings.nearest_prototype(test, embeddings.prototypes(train))
    return metrics.all_metrics(
        metrics.long_metrics("service_similarity", embeddings.pair_similarity(rows)),
        metrics.long_metrics("app_similarity", embeddings.pair_similarity(rows.withColumn("label", F.col("app")))),
        _scores("classification", "knn", e4_knn(spark, sf_dir)),
        _scores("prototype_generalization", "prototype", near),
        _scores("leave_one_app_out", "leave_one_app", embeddings.leave_one_group_out(rows)),
    )


_METRICS = f"""{_KNN}, protos AS {_protos('train')}, hits AS (SELECT t.id, t.label, p.label AS pred, row_number() OVER (PARTITION BY t.id ORDER BY list_inner_product(t.z, p.proto) DESC, p.label) AS turn FROM test t, protos p),
 others AS (SELECT DISTINCT v.app AS held, w.id AS oid, w.label, w.z FROM vectors v, vectors w WHERE v.app <> w.app), held AS {_protos('others', 'held, label')},
 loo AS (SELECT v.id, v.label, h.label AS pred, row_number() OVER (PARTITION BY v.id ORDER BY list_inner_product(v.z, h.proto) DESC, h.label) AS turn FROM vectors v JOIN held h ON v.app = h.held),
 by_proto AS (SELECT * FROM hits WHERE turn = 1), left_out AS (SELECT * FROM loo WHERE turn = 1), sims AS (SELECT a.label = b.label AS same_label, a.app = b.app AS same_app, list_inner_product(a.z, b.z) AS sim FROM vectors a JOIN vectors b ON a.id < b.id),
 metrics AS (SELECT 'service_similarity.intra' AS name, (SELECT coalesce(avg(sim), 0) FROM sims WHERE same_label) AS value UNION ALL SELECT 'service_similarity.inter', (SELECT coalesce(avg(sim), 0) FROM sims WHERE NOT same_label)
  UNION ALL SELECT 'app_similarity.intra', (SELECT coalesce(avg(sim), 0) FROM sims WHERE same_app) UNION ALL SELECT 'app_similarity.inter', (SELECT coalesce(avg(sim), 0) FROM sims WHERE NOT same_app)
  UNION ALL SELECT 'classification.knn_accuracy', (SELECT avg((label = pred)::INT) FROM preds) UNION ALL SELECT 'classification.knn_macro_f1', {_sql_f1('preds')}
  UNION ALL SELECT 'prototype_generalization.prototype_accuracy', (SELECT avg((label = pred)::INT) FROM by_proto) UNION ALL SELECT 'prototype_generalization.prototype_macro_f1', {_sql_f1('by_proto')}
  UNION ALL SELECT 'leave_one_app_out.leave_one_app_accuracy', (SELECT avg((label = pred)::INT) FROM left_out) UNION ALL SELECT 'leave_one_app_out.leave_one_app_macro_f1', {_sql_f1('left_out')})"""


@query(f"WITH {_METRICS} SELECT name, round(value, 6) AS value FROM metrics")
def e15_metrics(spark, sf_dir):
    return _all_metrics(spark, sf_dir).select("name", F.round("value", 6).alias("value"))


@query(f"WITH {_METRICS} SELECT round(sum(value * CASE name WHEN 'service_similarity.intra' THEN 2.0::DOUBLE WHEN 'service_similarity.inter' THEN -1.5::DOUBLE ELSE 0.5::DOUBLE END), 6) AS total FROM metrics WHERE name IN ('service_similarity.intra', 'service_similarity.inter', 'classification.knn_accuracy', 'prototype_generalization.prototype_accuracy')")
def e14_weighted_total(spark, sf_dir):
    weights = [("service_similarity.intra", 2.0), ("service_similarity.inter", -1.5), ("classification.knn_accuracy", 0.5), ("prototype_generalization.prototype_accuracy", 0.5), ("unused", 9.0)]
    found = metrics.weighted_total(_all_metrics(spark, sf_dir), spark.createDataFrame(weights, "name string, weight double"))
    return found.select(F.round("total", 6).alias("total"))


_VALUES = ", ".join(f"({i}, '{k}', '{n}', '{t}', {'NULL' if g is None else g}, '{d}')" for i, (k, n, t, g, d) in enumerate(metrics.KPIS))


@query(f"""WITH {_METRICS}, targets(place, kpi, name, target, goal, direction) AS (VALUES {_VALUES})
SELECT place, kpi, target, CASE WHEN value IS NULL THEN 'missing' WHEN target LIKE '%\\%' ESCAPE '\\' THEN printf('%.2f', value * 100) || '%' WHEN target LIKE '%ms' THEN printf('%.2f', value) || ' ms' ELSE printf('%.4f', value) END AS value,
 CASE WHEN direction = 'info' THEN 'INFO' WHEN value IS NULL THEN 'FAIL' WHEN direction = 'gte' AND value >= goal THEN 'PASS' WHEN direction = 'lt' AND value < goal THEN 'PASS' ELSE 'FAIL' END AS status FROM targets LEFT JOIN metrics USING (name)""")
def r1_r2_r3_report(spark, sf_dir):
    return metrics.report(spark, _all_metrics(spark, sf_dir))


@query(f"WITH {VECTORS} SELECT label, id, round(z[1], 6) AS first FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS turn FROM vectors) WHERE turn <= 20")
def m1_newest_per_class(spark, sf_dir):
    return memory.newest_per_class(labelled_vectors(spark, sf_dir), 20).select("label", "id", F.round(F.col("z")[0], 6).alias("first"))


@query(f"""WITH {VECTORS}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq DESC) AS turn FROM vectors) WHERE turn <= 20)
SELECT id, label FROM kept JOIN (SELECT label, min(seq) AS first FROM vectors GROUP BY label) USING (label) ORDER BY first, seq LIMIT 90""")
def m2_sample_memory(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min("seq").alias("first"))
    return memory.sample_memory(memory.newest_per_class(rows, 20), first, 90).select("id", "label")


def sql_update(name: str, batch: str, protos: str, trust: float) -> str:
    """Tables ``<name>_fold`` (a row per label and update) and ``<name>`` (label, proto, n, updates) after a batch (label, seq, z)."""
    mixed = "list_transform(list_zip(f.proto, m.z), lambda p: 0.95::DOUBLE * p[1] + 0.05::DOUBLE * p[2])"
    return f"""
 {name}_near AS (SELECT b.label, b.seq, b.z, p.label AS pred, list_inner_product(b.z, p.proto) AS sim, row_number() OVER (PARTITION BY b.label, b.seq ORDER BY list_inner_product(b.z, p.proto) DESC, p.label) AS turn
  FROM {batch} b, {protos} p WHERE p.n > 0),
 {name}_moves AS (SELECT b.label, b.seq, b.z, row_number() OVER (PARTITION BY b.label ORDER BY b.seq) AS rn FROM {batch} b JOIN {protos} p USING (label) LEFT JOIN {name}_near s ON s.turn = 1 AND s.label = b.label AND s.seq = b.seq
  WHERE (p.n > 0 AND s.pred = b.label AND s.sim >= {trust}) OR (p.n = 0 AND b.seq = (SELECT min(seq) FROM {batch} x WHERE x.label = b.label))),
 {name}_fold AS (SELECT label, 0::BIGINT AS k, proto, n FROM {protos} UNION ALL SELECT f.label, m.rn, CASE WHEN f.n = 0 THEN m.z ELSE {_unit(mixed)} END, f.n + 1 FROM {name}_fold f JOIN {name}_moves m ON m.label = f.label AND m.rn = f.k + 1),
 {name} AS (SELECT label, arg_max(proto, k) AS proto, max(n)::BIGINT AS n, max(k)::BIGINT AS updates FROM {name}_fold GROUP BY label)"""


_SHOWN = "label, n, updates, round(list_sum(proto), 6) AS total, round(proto[1], 6) AS first"


def _shown_protos(table: DataFrame) -> DataFrame:
    total = F.when(F.col("proto").isNotNull(), F.aggregate("proto", F.lit(0.0), lambda s, x: s + x))
    return table.select("label", "n", "updates", F.round(total, 6).alias("total"), F.round(F.get("proto", F.lit(0)), 6).alias("first"))


@query(f"""WITH RECURSIVE {VECTORS}, known AS {_protos("(SELECT * FROM vectors WHERE id % 10 = 0 AND label <> 3)")}, start AS (SELECT r.label, k.proto, coalesce(k.n, 0) AS n FROM (SELECT unnest(range(12)) AS label) r LEFT JOIN known k USING (label)),
 batch AS (SELECT label, seq, z FROM vectors WHERE id % 10 <> 0), {sql_update('moved', 'batch', 'start', 0.3)} SELECT {_SHOWN} FROM moved""")
def m5_update_trusted(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir)
    names = spark.range(12).select(F.col("id").alias("label"))
    start = memory.bootstrap(rows.where("id % 10 = 0 and label <> 3"), names)
    return _shown_protos(memory.update_trusted(rows.where("id % 10 <> 0"), start, trust=0.3))


_X = [f"x{j}" for j in range(1, 66)]  # 64 components and the constant


def _combined(w: str) -> str:
    return " + ".join(f"{w}{j} * x{j}" for j in range(1, 66))


# Nesterov's method for strongly convex functions: steps of 1 / L, L a bound on second derivatives; other steps than the operator's, to the same minimum.
_SVM = f"""{SPLIT}, rows AS (SELECT label, {', '.join(f'z[{j}] AS x{j}' for j in range(1, 65))}, 1.0::DOUBLE AS x65 FROM train), rate AS (SELECT 1 + 4.0::DOUBLE * count(*) AS l, sqrt(1 + 4.0::DOUBLE * count(*)) AS root FROM train),
 descent AS (SELECT 0 AS step, k, {', '.join(f'0.0::DOUBLE AS w{j}, 0.0::DOUBLE AS v{j}' for j in range(1, 66))} FROM (SELECT DISTINCT label AS k FROM train)
  UNION ALL SELECT any_value(step) + 1, k, {', '.join(f"any_value(v{j}) - (any_value(v{j}) + coalesce(sum(c * x{j}), 0)) / any_value(l), any_value(v{j}) - (any_value(v{j}) + coalesce(sum(c * x{j}), 0)) / any_value(l) + (any_value(root) - 1) / (any_value(root) + 1) * (any_value(v{j}) - (any_value(v{j}) + coalesce(sum(c * x{j}), 0)) / any_value(l) - any_value(w{j}))" for j in range(1, 66))}
  FROM (SELECT d.*, r.*, rate.*, CASE WHEN label = k THEN -2 ELSE 2 END * greatest(0, 1 - CASE WHEN label = k THEN 1 ELSE -1 END * ({_combined('v')})) AS c FROM descent d, rows r, rate WHERE step < 700) GROUP BY k),
 machines AS (SELECT * FROM descent WHERE step = 700)"""


@query(f"""WITH RECURSIVE {_SVM} SELECT id, label, k AS pred FROM (SELECT t.id, t.label, m.k, row_number() OVER (PARTITION BY t.id ORDER BY {' + '.join(f'w{j} * z[{j}]' for j in range(1, 65))} + w65 DESC, k) AS turn FROM test t, machines m) WHERE turn = 1""")
def e6_linear_svm(spark, sf_dir):
    """One-against-rest linear machines with squared hinge loss at C = 1. The SQL twin goes to the same minimum by first derivatives alone."""
    train, test = (d.select("id", "label", features.unit(F.col("z")).alias("z")) for d in sides(spark, sf_dir))
    machine = linear_machine.fit_linear_machine(train)
    return linear_machine.classify(test, machine, ["id", "label"]).select("id", F.col("label").cast("long"), "pred")


def _event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.flows_by_file(event_packets(spark, sf_dir), 1.0)
    return found.select("*", F.concat_ws(":", "file", "window_id").alias("row_id"), F.lit("a").alias("app"), F.lit("gaming").alias("service"), F.lit("events").alias("source"))


_COLUMNS = ", ".join(f"round(sum(f{j}), 3) AS f{j}" for j in range(16))
_FLOW_ARRAYS = FLOWS_SQL.replace("string_agg(CASE WHEN rn <= 128 THEN round(length * 10)::BIGINT::VARCHAR END, ',' ORDER BY rn) AS lengths", "list(length ORDER BY rn) FILTER (rn <= 128) AS lens, list(iat ORDER BY rn) FILTER (rn <= 128) AS iats, list(direction ORDER BY rn) FILTER (rn <= 128) AS dirs").replace(
    "protocol, lengths, ways FROM stats", "protocol, lens, iats, dirs, ways, duration AS raw_duration, stats.iat_mean AS raw_mean, stats.iat_std AS raw_std, len_sum / greatest(duration / 1000.0::DOUBLE, 0.001::DOUBLE) AS bps, n / greatest(duration / 1000.0::DOUBLE, 0.001::DOUBLE) AS pps FROM stats")


_CELLS = (
    "len / 1500", "ln(1 + iat) / 10", "dir", "ln(1 + pps) / 10", "ln(1 + bps) / 20", "len(list_filter(dirs, lambda d: d > 0)) / len(dirs)::DOUBLE",
    "1 - len(list_filter(dirs, lambda d: d > 0)) / len(dirs)::DOUBLE", "(protocol = 6)::INT", "(protocol = 17)::INT", "(protocol = 17)::INT", "0", "0", "0", "ln(1 + raw_duration) / 20",
    "least(floor(list_sum(iats[1:i]) / greatest(list_sum(iats), 1.0::DOUBLE) * 8) / 8, 1)", "(i - 1) / greatest(len(lens) - 1, 1)::DOUBLE",
)
_FEATURES = f"""flows AS ({_FLOW_ARRAYS}), cells AS (SELECT file || ':' || window_id AS row_id, *, generate_subscripts(lens, 1) AS i, unnest(lens) AS len, unnest(iats) AS iat, unnest(dirs) AS dir FROM flows),
 features AS (SELECT row_id, i, {', '.join(f"({c})::FLOAT::DOUBLE AS f{j}" for j, c in enumerate(_CELLS))} FROM cells)"""


@query(f"WITH {_FEATURES} SELECT count(*) AS packets, count(DISTINCT row_id) AS flows, {_COLUMNS} FROM features")
def f1_f9_packet_features(spark, sf_dir):
    rows = features.packet_matrix(_event_flows(spark, sf_dir), "row_id")
    cells = rows.select("row_id", F.explode("packet_seq").alias("p"))
    return cells.agg(F.count("*").alias("packets"), F.count_distinct("row_id").alias("flows"), *[F.round(F.sum(F.col("p")[j].cast("double")), 3).alias(f"f{j}") for j in range(16)])


@query(f"""WITH flows AS ({_FLOW_ARRAYS}), v AS (SELECT bps, iat_mean AS rtt, iat_std AS jitter, condition FROM flows)
SELECT 24 * count(*) AS steps, round(24 * sum(ln(1 + rtt) / 8), 1) AS n0, round(24 * sum(ln(1 + jitter) / 6), 1) AS n1, round(24 * sum(ln(1 + bps) / 16), 1) AS n4, round(24 * sum(0.5::DOUBLE), 1) AS n5, round(24 * sum(ln(1 + greatest(0.4 * jitter, 1)) / 6), 1) AS n6,
 round(24 * sum(CASE condition WHEN 'good' THEN 0 WHEN 'moderate' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END / 3.0::DOUBLE), 1) AS n7 FROM v""")
def f11_network_series(spark, sf_dir):
    rows = features.network_series(_event_flows(spark, sf_dir), "row_id", noise=0.0)
    cells = rows.select(F.explode("network_seq").alias("p"))
    return cells.agg(F.count("*").alias("steps"), *[F.round(F.sum(F.col("p")[j].cast("double")), 1).alias(f"n{j}") for j in (0, 1, 4, 5, 6, 7)])


def _records(spark: SparkSession, sf_dir: str, noise: float = 0.0) -> DataFrame:
    return features.flow_records(_event_flows(spark, sf_dir), "row_id", noise=noise)


def sql_gaussian(*parts: str) -> str:
    u, v = (f"({sql_key(repr(name), *parts)} / 4503599627370496.0::DOUBLE)" for name in "uv")
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u})) * cos(6.283185307179586::DOUBLE * {v}))"


def _sql_pick(tag: str, own: str, copy: str, values: tuple[float, ...]) -> str:
    return f"[{', '.join(f'{v}::DOUBLE' for v in values)}][(floor({sql_key(repr(tag), own, copy)} / 4503599627370496.0::DOUBLE * {len(values)}) + 1)::INT]"


def _sql_twins(noise: float) -> str:
    """``networks`` (row_id, n0..n7), and ``twins`` of flows: a row per flow and copy (0 is the flow itself) with its conditions; ``moved`` has its packets."""
    moved = f"least(greatest(f1 * scale{f' + {noise}::DOUBLE * ' + sql_gaussian(repr('aug'), 'row_id', 'copy::VARCHAR', '(i - 1)::VARCHAR') if noise else ''}, 0), 10)::FLOAT::DOUBLE"
    means = ("exp(n0 * 8) - 1", "exp(n1 * 6) - 1", "n2")
    return f"""networks AS (SELECT file || ':' || window_id AS row_id, condition, (ln(1 + raw_mean) / 8)::FLOAT::DOUBLE AS n0, (ln(1 + raw_std) / 6)::FLOAT::DOUBLE AS n1, 0.0::DOUBLE AS n2, 0.0::DOUBLE AS n3,
  (ln(1 + bps) / 16)::FLOAT::DOUBLE AS n4, 0.5::DOUBLE AS n5, (ln(1 + greatest(0.4 * raw_std, 1)) / 6)::FLOAT::DOUBLE AS n6, (CASE condition WHEN 'good' THEN 0 WHEN 'moderate' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END / 3.0::DOUBLE)::FLOAT::DOUBLE AS n7 FROM flows),
 picks AS (SELECT *, {_sql_pick('rtt', 'row_id', 'copy::VARCHAR', (0.7, 1.0, 1.8, 3.2))} AS scale, {_sql_pick('jit', 'row_id', 'copy::VARCHAR', (0.0, 0.1, 0.25, 0.55))} AS jitter, {_sql_pick('loss', 'row_id', 'copy::VARCHAR', (0.0, 0.005, 0.02, 0.06))} AS loss
  FROM networks CROSS JOIN (SELECT unnest([1, 2]) AS copy)),
 changed AS (SELECT * REPLACE (least(n0 * scale, 5)::FLOAT::DOUBLE AS n0, least(n1 + jitter, 5)::FLOAT::DOUBLE AS n1, least(n2 + loss, 1)::FLOAT::DOUBLE AS n2) FROM picks),
 twins AS (SELECT row_id, 0 AS copy, condition, 1.0::DOUBLE AS scale, n0, n1, n2, n3, n4, n5, n6, n7 FROM networks UNION ALL SELECT row_id, copy, {sql_condition(*means)}, scale, n0, n1, n2, n3, n4, n5, n6, n7 FROM changed),
 moved AS (SELECT features.* REPLACE (CASE WHEN copy = 0 THEN f1 ELSE {moved} END AS f1), copy FROM features JOIN twins USING (row_id))"""


@query(f"""WITH {_FEATURES}, {_sql_twins(0.0)}, packets AS (SELECT row_id, copy, sum(f1) AS f1, sum(f0) AS f0 FROM moved GROUP BY ALL)
SELECT CASE WHEN copy = 0 THEN 'events' ELSE 'events_aug' END AS source, condition, count(*) AS n, round(sum(f0), 3) AS f0, round(sum(f1), 3) AS f1, round(sum(24 * n0), 2) AS n0, round(sum(24 * n1), 2) AS n1, round(sum(24 * n2), 3) AS n2, round(sum(24 * n4), 2) AS n4
 FROM twins JOIN packets USING (row_id, copy) GROUP BY ALL""")
def f13_f14_f15_augmented(spark, sf_dir):
    """Flows and two augmented twins of each: gaps, round trips, jitter, loss and the conditions that follow from them."""
    rows = features.with_augmented(_records(spark, sf_dir), "id", 2, noise=0.0)

    def total(c: str, j: int):
        return F.aggregate(c, F.lit(0.0), lambda s, r: s + r[j])

    rows = rows.select("source", "condition", *[total("packet_seq", j).alias(f"f{j}") for j in (0, 1)], *[total("network_seq", j).alias(f"n{j}") for j in (0, 1, 2, 4)])
    places = {"f0": 3, "f1": 3, "n0": 2, "n1": 2, "n2": 3, "n4": 2}
    return rows.groupBy("source", "condition").agg(F.count("*").alias("n"), *[F.round(F.sum(c), d).alias(c) for c, d in places.items()])


_DRAWN = f"""rows AS (SELECT p_partkey AS id, p_size::DOUBLE AS fwd, CASE WHEN p_size % 4 = 0 THEN 16 ELSE p_size % 7 END::DOUBLE AS bwd, CASE WHEN p_size % 5 = 0 THEN p_size * 20 END AS whole, p_retailprice AS length_mean,
  CASE WHEN p_size % 3 = 0 THEN 50 ELSE p_size * 4 END::DOUBLE AS length_std, (p_size % 30)::DOUBLE AS iat_mean, CASE WHEN p_size % 2 = 0 THEN 3.0::DOUBLE ELSE greatest((p_size % 30)::DOUBLE * 0.2::DOUBLE, 1.0::DOUBLE) END AS iat_std FROM part),
 packets AS (SELECT *, unnest(range(1, greatest(4, least(128, coalesce(whole, fwd + bwd)))::BIGINT + 1)) AS i FROM rows),
 drawn AS (SELECT id, least(greatest(length_mean + greatest(length_std, 1) * {sql_gaussian("'len'", 'id::VARCHAR', 'i::VARCHAR')}, 40), 1500) AS len, greatest(iat_mean + greatest(iat_std, 1) * {sql_gaussian("'iat'", 'id::VARCHAR', 'i::VARCHAR')}, 0) AS gap,
  CASE WHEN {sql_key("'dir'", 'id::VARCHAR', 'i::VARCHAR')} / 4503599627370496.0::DOUBLE < least(greatest(fwd / (fwd + bwd), 0.05::DOUBLE), 0.95::DOUBLE) THEN 1 ELSE -1 END AS way FROM packets)"""


@query(f"WITH {_DRAWN} SELECT id, count(*) AS n, round(sum(len), 3) AS lengths, round(sum(gap), 3) AS gaps, sum(way)::BIGINT AS ways FROM drawn GROUP BY id")
def f1_to_f4_drawn_series(spark, sf_dir):
    """Flows without series get theirs drawn from their means, by hash."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), size.alias("Total Fwd Packets"), F.when(size % 4 != 0, size % 7).alias("bwd_pkt_count"), F.when(size % 5 == 0, size * 20).alias("Total Packets"),
        F.col("p_retailprice").alias("packet length mean"), F.when(size % 3 == 0, 2500.0).otherwise(size * 4.0).alias("Pkt Len Std"), (size % 30).alias("IAT Mean"), F.when(size % 2 == 0, 3.0).alias("iat std"),
    )
    drawn = features.packet_series(features.spread_out(rows, "id"), "id")
    sums = [F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 3).alias(n) for c, n in (("lens", "lengths"), ("gaps", "gaps"))]
    return drawn.select("id", F.size("lens").cast("long").alias("n"), *sums, F.aggregate("ways", F.lit(0.0), lambda s, x: s + x).cast("long").alias("ways"))


_NOISY = f"""base AS (SELECT p_partkey AS id, [ln(1 + p_size * 4.0::DOUBLE) / 8, ln(1 + (p_size % 40)::DOUBLE) / 6, (p_size % 9) / 100.0::DOUBLE, 0.0::DOUBLE, ln(1 + p_retailprice) / 16, 0.5::DOUBLE, ln(1 + greatest((p_size % 40) * 0.4::DOUBLE, 1.0::DOUBLE)) / 6,
  (CASE {sql_condition('p_size * 4.0', '(p_size % 40)', '((p_size % 9) / 100.0::DOUBLE)')} WHEN 'good' THEN 0 WHEN 'moderate' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END) / 3.0::DOUBLE] AS v FROM part),
 cells AS (SELECT id, j, least(greatest(v[j + 1] + 0.03::DOUBLE * {sql_gaussian("'net'", 'id::VARCHAR', 't::VARCHAR', 'j::VARCHAR')} * (0.5::DOUBLE + t / 23.0::DOUBLE), -5), 5)::FLOAT::DOUBLE AS x FROM base, range(24) a(t), range(8) b(j))"""


@query(f"WITH {_NOISY} SELECT id, {', '.join(f'round(sum(x) FILTER (j = {j}), 4) AS n{j}' for j in range(8))} FROM cells GROUP BY id")
def f11_f12_drifting_network(spark, sf_dir):
    """Network series with their drift of noise, by hash."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (size * 4.0).alias("rtt"), (size % 40).alias("jitter"), (size % 9 / 100.0).alias("loss"), F.col("p_retailprice").alias("throughput"))
    drifted = features.network_series(features.spread_out(rows, "id"), "id")
    return drifted.select("id", *[F.round(F.aggregate("network_seq", F.lit(0.0), lambda s, r: s + r[j]), 4).alias(f"n{j}") for j in range(8)])


@query(f"WITH flows AS ({FLOWS_SQL}) SELECT sum(128 - least(total_packets, 128))::BIGINT AS masked, count(*) * 128 AS rows FROM flows")
def f9_f10_padding_mask(spark, sf_dir):
    seq = _records(spark, sf_dir).select(features.padded(F.col("packet_seq")).alias("p"))
    masks = seq.select(F.size("p").alias("n"), F.size(F.filter(features.padding_mask(F.col("p")), lambda x: x)).alias("masked"))
    return masks.agg(F.sum("masked").alias("masked"), F.sum("n").alias("rows"))


def _pooled_sql(noise: float) -> str:
    """``pooled`` (row_id, copy, z): means and deviations of packet features and the network conditions, at unit length."""
    parts = [f"avg(f{j})" for j in range(16)] + [f"stddev_pop(f{j})" for j in range(16)] + [f"any_value(n{j})" for j in range(8)]
    return f"""{_FEATURES}, {_sql_twins(noise)}, raw AS (SELECT row_id, copy, [{', '.join(parts)}] AS v FROM moved JOIN twins USING (row_id, copy) GROUP BY row_id, copy), pooled AS (SELECT row_id, copy, {_unit('v')} AS z FROM raw)"""


def pooled_encoder(batch: pa.RecordBatch) -> np.ndarray:
    """Means and deviations of packet features and means of the network series, at unit length, for a whole batch at once."""

    def cells(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows of all sequences, where each sequence begins, and how long it is."""
        sequences = batch.column(name)
        sizes = pc.list_value_length(sequences).to_numpy()
        flat = sequences.flatten()
        return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1), np.cumsum(sizes) - sizes, sizes[:, None]

    def means(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts, axis=0) / sizes

    packets, starts, sizes = cells("packet_seq")
    mean = means(packets, starts, sizes)
    centred = packets - np.repeat(mean, sizes[:, 0], axis=0)
    v = np.hstack((mean, np.sqrt(means(centred * centred, starts, sizes)), means(*cells("network_seq"))))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@query(f"WITH {_pooled_sql(0.0)} SELECT row_id AS id, 'gaming' AS service, round(list_sum(z), 6) AS total FROM pooled WHERE copy = 0")
def e1_embed(spark, sf_dir):
    """Batches scored by an encoder that is handed in."""
    found = embeddings.embed(_records(spark, sf_dir).where(F.size("packet_seq") > 0), pooled_encoder, ["id", "service"])
    return found.select("id", "service", F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_pooled_sql(0.0)} SELECT row_id AS id, round(list_sum(z), 6) AS total, round(z[1], 6) AS first, round(z[18], 6) AS spread FROM pooled WHERE copy = 0")
def f16_pooled_vectors(spark, sf_dir):
    rows = _records(spark, sf_dir).select("id", features.pooled_vector(F.col("packet_seq"), F.col("network_seq")).alias("z"))
    return rows.select("id", F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("z")[0], 6).alias("first"), F.round(F.col("z")[17], 6).alias("spread"))


@query(f"""WITH {_pooled_sql(0.015)}, chosen AS (SELECT row_id FROM networks ORDER BY {sql_key("'42'", 'row_id')}, row_id LIMIT 256)
SELECT round(avg(list_inner_product(a.z, b.z)), 6) AS score FROM pooled a JOIN pooled b USING (row_id) WHERE a.copy = 0 AND b.copy = 1 AND row_id IN (SELECT row_id FROM chosen)""")
def e9_f13_f16_invariance(spark, sf_dir):
    """Embeddings of flows and of their augmented twins, noise included, by the pooled encoder in native columns."""
    rows = sampling.uniform_sample(_records(spark, sf_dir), 256, ["id"])

    def encoded(d: DataFrame) -> DataFrame:
        return d.select("id", features.pooled_vector(F.col("packet_seq"), F.col("network_seq")).alias("z"))

    return embeddings.invariance(encoded(rows), encoded(features.augmented(rows, "id"))).select(F.round("score", 6).alias("score"))


@query(f"""WITH {VECTORS} SELECT round(avg(list_inner_product(a.z, b.z)), 6) AS score FROM vectors a JOIN (SELECT id, {_unit('list_reverse(z)')} AS z FROM vectors) b USING (id)""")
def j6_alignment(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir)
    base, twin = (rows.select("id", features.unit(z).alias("z")) for z in (F.col("z"), F.reverse("z")))
    return embeddings.invariance(base, twin).select(F.round("score", 6).alias("score"))
