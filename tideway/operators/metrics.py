"""Metrics as long tables ``(name, value)``, label counts, and the report against targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideway.functions.labels import CONDITIONS, SERVICES

# The report's rows (title, metric, target text, target, direction).
KPIS = (
    ("Embedding intra cosine", "service_similarity.intra", "> 0.70", 0.70, "gte"),
    ("Embedding inter cosine", "service_similarity.inter", "< 0.30", 0.30, "lt"),
    ("k-NN classification accuracy", "classification.knn_accuracy", ">= 90%", 0.90, "gte"),
    ("SVM classification accuracy", "classification.svm_accuracy", ">= 90%", 0.90, "gte"),
    ("Prototype generalization", "prototype_generalization.prototype_accuracy", ">= 85%", 0.85, "gte"),
    ("Leave-one-app generalization", "leave_one_app_out.leave_one_app_accuracy", ">= 85%", 0.85, "gte"),
    ("Context invariance score", "cist_score", "higher is better", None, "info"),
    ("Mean latency per flow", "latency.mean_ms", "< 100 ms", 100.0, "lt"),
)


def accuracy(rows: DataFrame, target: str = "label", pred: str = "pred") -> DataFrame:
    """``(accuracy)``; 0 without rows."""
    return rows.agg(F.coalesce(F.avg((F.col(target) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"))


def macro_f1(rows: DataFrame, target: str = "label", pred: str = "pred") -> DataFrame:
    """``(macro_f1)``: the mean over all labels that occur as target or prediction; 0 without rows."""
    cells = rows.groupBy(F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p"))))
    by_label = cells.select("n", hit.alias("hit"), sides.alias("x")).groupBy("x.label").agg(
        F.sum(F.col("hit") * F.col("x.is_t")).alias("tp"), F.sum(F.col("n") * F.col("x.is_t")).alias("actual"), F.sum(F.col("n") * F.col("x.is_p")).alias("predicted")
    )
    precision, recall = (F.col("tp") / F.greatest(F.col(c), F.lit(1)) for c in ("predicted", "actual"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    return by_label.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def summary_percentiles(rows: DataFrame, column: str) -> DataFrame:
    """``(mean, p50, p95, p99)`` by linear interpolation."""
    p = F.percentile(F.col(column), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.agg(F.avg(column).alias("mean"), p.alias("p")).select("mean", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def label_map(rows: DataFrame, kinds: tuple[str, ...] = ("app", "service", "condition")) -> DataFrame:
    """``(kind, name, id)``: ids from 0, the fixed vocabulary first, then other names in order. All kinds in one pass."""
    fixed = {"service": SERVICES, "condition": CONDITIONS}
    names = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds])).alias("x")).select("x.*").distinct()
    known = [(k, n, i) for k in kinds for i, n in enumerate(fixed.get(k, ()))]
    if known:
        table = rows.sparkSession.createDataFrame(known, "kind string, name string, place int")
        names = names.join(F.broadcast(table), ["kind", "name"], "full")
    else:
        names = names.withColumn("place", F.lit(None).cast("int"))
    order = Window.partitionBy("kind").orderBy(F.col("place").asc_nulls_last(), "name")
    return names.where("name is not null").select("kind", "name", (F.row_number().over(order) - 1).alias("id"))


def label_ids(rows: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """Adds ``<kind>_id``; a name that is not in the map has the id of ``unknown``, else 0. The map is a vocabulary."""
    table = labels.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("id").alias(f"{kind}_id"))
    rest = table.agg(F.coalesce(F.max(F.when(F.col(kind) == "unknown", F.col(f"{kind}_id"))), F.lit(0))).first()[0]
    return rows.join(table, kind, "left").withColumn(f"{kind}_id", F.coalesce(f"{kind}_id", F.lit(rest)))


def long_metrics(prefix: str, row: DataFrame) -> DataFrame:
    """A one-row table as ``(name, value)`` rows under a prefix."""
    pairs = F.array(*[F.struct(F.lit(f"{prefix}.{c}" if prefix else c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def all_metrics(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def weighted_total(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """``(total)``: the sum of weight times value over names with a weight."""
    return metrics.join(weights, "name").agg(F.sum(F.col("value") * F.col("weight")).alias("total"))


def history_means(history: DataFrame) -> DataFrame:
    return history.groupBy("epoch", "metric").agg(F.avg("value").alias("value"))


def status(value: Column, target: Column, direction: Column) -> Column:
    good = F.when(direction == "gte", value >= target).otherwise(value < target)
    return F.when(direction == "info", "INFO").when(value.isNull() | ~good, "FAIL").otherwise("PASS")


def report(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """``(kpi, target, value, status)``; a metric that is missing fails."""
    targets = spark.createDataFrame([(i, *k) for i, k in enumerate(KPIS)], "place int, kpi string, name string, target string, goal double, direction string")
    joined = targets.join(metrics, "name", "left")
    text = (
        F.when(F.col("value").isNull(), "missing")
        .when(F.col("target").endswith("%"), F.concat(F.format_string("%.2f", F.col("value") * 100), F.lit("%")))
        .when(F.col("target").endswith("ms"), F.concat(F.format_string("%.2f", F.col("value")), F.lit(" ms")))
        .otherwise(F.format_string("%.4f", F.col("value")))
    )
    return joined.select("place", "kpi", "target", text.alias("value"), status(F.col("value"), F.col("goal"), F.col("direction")).alias("status"))
