"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, iou


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def accuracy(rows: DataFrame, predicted: str, target: str, ignore: int | None = None) -> DataFrame:
    """Share of equal pairs; empty: 0. ignore: a target value that doesn't count."""
    rows = rows if ignore is None else rows.where(F.col(target) != ignore)
    return rows.agg(mean_or_zero((F.col(predicted) == F.col(target)).cast("double")).alias("accuracy"))


def per_label(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """label, precision, recall, f1 for every label on either side, in one aggregation."""
    p, t = F.col(predicted), F.col(target)
    parts = F.when(p == t, F.array(F.struct(t.alias("label"), F.lit(1).alias("tp"), F.lit(1).alias("p"), F.lit(1).alias("t")))).otherwise(
        F.array(F.struct(p.alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("t")), F.struct(t.alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("t"))))
    sums = rows.select(F.explode(parts).alias("x")).groupBy("x.label").agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "p", "t")))
    precision, recall = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro_f1(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    return per_label(rows, predicted, target).agg(mean_or_zero(F.col("f1")).alias("macro_f1"))


def nearest_rank(rows: DataFrame, value: str, keys: list[str], share: float = 0.95) -> DataFrame:
    """keys, mean, p: the value at index min(n-1, half-even round(share*(n-1))) of the sorted values."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.least(n - 1, F.bround((n - 1) * F.lit(share)).cast("long"))
    ranked = rows.withColumn("__k", F.row_number().over(w) - 1).withColumn("__at", at)
    return ranked.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(F.when(F.col("__k") == F.col("__at"), F.col(value))).alias("p"))


def click_success(truth: DataFrame, predictions: DataFrame, image: str, name: str, key: str, threshold: float = 0.5) -> DataFrame:
    """Share of truth boxes that a prediction of the same image and class meets with IoU of `threshold` or more."""
    t, p = truth.alias("t"), predictions.alias("p")
    meets = iou(
        Box(*(F.col(f"t.{c}") for c in ("x1", "y1", "x2", "y2"))), Box(*(F.col(f"p.{c}") for c in ("x1", "y1", "x2", "y2"))),
    ) >= threshold
    hit = t.join(
        p, (F.col(f"t.{image}") == F.col(f"p.{image}")) & (F.col(f"t.{name}") == F.col(f"p.{name}")) & meets, "left_semi",
    ).select(key).withColumn("hit", F.lit(1.0))
    return truth.join(hit, key, "left").agg(mean_or_zero(F.coalesce("hit", F.lit(0.0))).alias("click_success"))


def zipped(predictions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Both sides by row key; an error where either side lacks a row."""
    both = predictions.withColumn("__p", F.lit(True)).join(targets.withColumn("__t", F.lit(True)), key, "full")
    whole = F.col("__p").isNotNull() & F.col("__t").isNotNull()
    return both.where(
        F.when(whole, True).otherwise(F.raise_error(F.lit("predictions and targets differ in length")).cast("boolean"))
    ).drop("__p", "__t")


def latency_penalty(ms: Column, target: float = 30.0) -> Column:
    return F.greatest(F.lit(0.0), (ms - target) / 1000.0)


def detector_score(map50: Column, success: Column, ms: Column) -> Column:
    return 0.6 * F.coalesce(map50, F.lit(0.0)) + 0.4 * success - latency_penalty(ms)


def reported_map50(metrics_json: Column) -> Column:
    """mAP50 of a metrics document under its usual names, 0 where there is none."""
    names = ("map50", "metrics/mAP50(B)", "mAP50")
    parsed = F.from_json(metrics_json, "map<string,string>")
    return F.coalesce(*(F.try_element_at(parsed, F.lit(n)).try_cast("double") for n in names), F.lit(0.0))
