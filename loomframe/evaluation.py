"""Evaluation of a task's predictions against its targets, and the history of experiments.

Predictions and targets are tables: what a model says is an input here. Each task returns one row of the same columns, so
that tasks can be compared and kept in one place: task, primary_metric, metrics, artifacts, checkpoint_path.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, center_distance, denormalize, iou
from loomframe.operators import metrics
from loomframe.sources import commits, packages

#: The metric by which runs of a task are compared, and the class index that does not count (fixed values).
PRIMARY = {"grounding": "mean_iou", "tool_button_detection": "score", "router_classification": "primitive_macro_f1"}
IGNORE = -100


def _result(task: str, found: DataFrame, artifacts: dict[str, str] | None, checkpoint: str | None) -> DataFrame:
    """One row from a row of metrics."""
    values = F.map_from_arrays(F.array(*(F.lit(c) for c in found.columns)), F.array(*(F.col(c).cast("double") for c in found.columns)))
    kept = artifacts or {}
    files = F.map_from_arrays(F.array(*(F.lit(k) for k in kept)), F.array(*(F.lit(v) for v in kept.values()))) if kept else F.create_map()
    return found.select(
        F.lit(task).alias("task"),
        F.lit(PRIMARY[task]).alias("primary_metric"),
        values.alias("metrics"),
        files.cast("map<string,string>").alias("artifacts"),
        F.lit(checkpoint).cast("string").alias("checkpoint_path"),
    )


def grounding(
    predictions: DataFrame,
    targets: DataFrame,
    key: str,
    width: Column,
    height: Column,
    mode: str = "0-1000",
    artifacts: dict[str, str] | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """mean_iou and mean_distance_px of boxes x1, y1, x2, y2 on both sides, brought to pixels by the normalisation mode.

    width and height are columns of the targets. A key on one side alone is an error; no rows give 0.
    """
    box = lambda name: F.struct("x1", "y1", "x2", "y2").alias(name)
    told = predictions.select(key, box("p"))
    known = targets.select(key, box("t"), width.alias("w"), height.alias("h"))
    both = metrics.zipped(told, known, key)
    p, t = (denormalize(Box.of(F.col(c)), mode, F.col("w"), F.col("h")) for c in "pt")
    found = both.agg(
        metrics.mean_or_zero(iou(p, t)).alias("mean_iou"), metrics.mean_or_zero(center_distance(p, t)).alias("mean_distance_px"),
    )
    return _result("grounding", found, artifacts, checkpoint)


def router(
    predictions: DataFrame,
    targets: DataFrame,
    key: str,
    primary: str,
    auxiliary: tuple[str, ...] = (),
    artifacts: dict[str, str] | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """primitive_macro_f1 and primitive_accuracy of the primary classes, and <name>_accuracy of each auxiliary one, where a
    target of IGNORE doesn't count. Classes are integer columns of the same name on both sides."""
    names = [primary, *auxiliary]
    both = metrics.zipped(
        predictions.select(key, *(F.col(n).alias(f"p_{n}") for n in names)), targets.select(key, *(F.col(n).alias(f"t_{n}") for n in names)), key,
    )
    main = metrics.macro_f1(both, f"p_{primary}", f"t_{primary}").withColumnRenamed("macro_f1", "primitive_macro_f1")
    share = lambda n, test: metrics.mean_or_zero(F.when(test, (F.col(f"p_{n}") == F.col(f"t_{n}")).cast("double")))
    rest = [share(primary, F.lit(True)).alias("primitive_accuracy"), *(share(n, F.col(f"t_{n}") != IGNORE).alias(f"{n}_accuracy") for n in auxiliary)]
    return _result("router_classification", main.crossJoin(both.agg(*rest)), artifacts, checkpoint)  # one row each


def detector(
    truth: DataFrame,
    predictions: DataFrame,
    latencies: DataFrame,
    reported_map50: float = 0.0,
    artifacts: dict[str, str] | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """mAP50 (as reported), click_success, latency_ms_mean, latency_ms_p95 and score.

    truth: box_id, image, name, x1, y1, x2, y2; predictions: image, name and the box; latencies: latency_ms.
    """
    hits = metrics.click_success(truth, predictions, "image", "name", "box_id")
    ms = metrics.nearest_rank(latencies.withColumn("__all", F.lit(1)), "latency_ms", ["__all"])
    times = ms.agg(
        F.coalesce(F.max("mean"), F.lit(0.0)).alias("latency_ms_mean"), F.coalesce(F.max("p").cast("double"), F.lit(0.0)).alias("latency_ms_p95"),
    )
    found = hits.crossJoin(times).withColumn("mAP50", F.lit(float(reported_map50)))  # one row each
    found = found.withColumn("score", metrics.detector_score(F.col("mAP50"), F.col("click_success"), F.col("latency_ms_mean")))
    return _result("tool_button_detection", found.select("mAP50", "click_success", "latency_ms_mean", "latency_ms_p95", "score"), artifacts, checkpoint)


TASKS = {"grounding": grounding, "tool_button_detection": detector, "router_classification": router}


def evaluate(task: str, *tables: DataFrame, **options) -> DataFrame:
    """The result of a task by its name."""
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}; known: {', '.join(sorted(TASKS))}")
    return TASKS[task](*tables, **options)


def reported_map50(spark: SparkSession, folder: str) -> float:
    """mAP50 of the packaged model's metrics, else of the first row of the leaderboard; 0 where neither says one."""
    for name, pick in (("best_package/metrics.json", lambda d: d), ("leaderboard.json", lambda d: d[0] if d else {})):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            text = "\n".join(r["value"] for r in spark.read.text(f"{folder}/{name}", wholetext=True).collect())  # one small file
            try:
                return float(pick(json.loads(text)).get("mAP50", 0.0))
            except (TypeError, ValueError, AttributeError):
                return 0.0
    return 0.0


def record_experiment(spark: SparkSession, folder: str, profile: packages.ToolProfile, result: DataFrame, now_ms: float | None = None) -> int:
    """Write the tool's profile anew and append the result as the next run of its history; returns the run's number."""
    packages.write_document(spark, asdict(profile), f"{folder}/tool_profile.json")
    row = result.first().asDict()  # one row
    entry = {"recorded_ms": time.time() * 1000 if now_ms is None else now_ms, "tool_id": profile.tool_id, **row}
    return commits.append(spark, f"{folder}/_runs", entry)


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """run, tool_id, recorded_ms, task, primary_metric, value of a tool's history."""
    rows = [
        (n, e["tool_id"], float(e["recorded_ms"]), e["task"], e["primary_metric"], float(e["metrics"][e["primary_metric"]]))
        for n, e in commits.read(spark, f"{folder}/_runs")
    ]
    return spark.createDataFrame(rows, "run int, tool_id string, recorded_ms double, task string, primary_metric string, value double")
