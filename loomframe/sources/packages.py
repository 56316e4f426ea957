"""Model packages and profiles: small JSON side files, appended history, content hashes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.hashing import content_hash
from loomframe.functions.text import padded


@dataclass(frozen=True)
class ToolProfile:
    tool_id: str
    tool_name: str = ""
    model: dict = field(default_factory=dict)
    dataset_hash: str | None = None


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document as a one-line text folder, in any store Spark writes to."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def write_package(spark: SparkSession, folder: str, profile: ToolProfile, metrics: dict, labels: list[str], files: DataFrame) -> str:
    """Side files profile, metrics, labels and dataset hash; returns the hash. files: name, content."""
    found = content_hash(files).first()["dataset_hash"]
    for name, doc in (
        ("profile", asdict(profile) | {"dataset_hash": found}),
        ("metrics", metrics),
        ("labels", {"labels": labels}),
        ("dataset", {"dataset_hash": found}),
    ):
        write_document(spark, doc, f"{folder}/{name}.json")
    return found


def record_run(spark: SparkSession, folder: str, tool_id: str, run: dict) -> None:
    """Append one training run to a tool's history."""
    spark.createDataFrame(
        [(tool_id, json.dumps(run, sort_keys=True))], "tool_id string, run string",
    ).withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(f"{folder}/training_history")


def save_sample_part(rows: DataFrame, folder: str, part: str) -> None:
    """Append event, label, review or metadata rows (session_id, sample_id, version, ...) to their table."""
    rows.write.mode("append").parquet(f"{folder}/{part}")


def current_part(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """Newest version of each sample's part."""
    rows = spark.read.parquet(f"{folder}/{part}")
    rest = [c for c in rows.columns if c not in ("session_id", "sample_id")]
    return rows.groupBy("session_id", "sample_id").agg(
        F.max_by(F.struct(*rest), "version").alias("r")
    ).select("session_id", "sample_id", "r.*")


def next_sample_ids(samples: DataFrame) -> DataFrame:
    """session_id, next_id: the number of samples and one, as sample_NNNNNN."""
    return samples.groupBy("session_id").agg(F.concat(F.lit("sample_"), padded(F.count("*") + 1)).alias("next_id"))


def apply_weights(settings: dict, best: dict[str, float]) -> dict:
    """Settings with the best fusion weights in place."""
    return settings | {"labeler": (settings.get("labeler") or {}) | {"fusion_weights": dict(best)}}


def detector_weights(spark: SparkSession, folder: str) -> str | None:
    """The packaged model, else the exported one, else the last best.pt of the sorted training runs; null without any."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("best_package/model.pt", "best_export/model.pt"):
        path = jvm.org.apache.hadoop.fs.Path(at, name)
        if files.exists(path):
            return path.toString()
    runs = jvm.org.apache.hadoop.fs.Path(at, "yolo_runs")
    if not files.exists(runs):
        return None
    found, every = [], files.listFiles(runs, True)  # a folder of training runs
    while every.hasNext():
        path = every.next().getPath().toString()
        if path.endswith("/weights/best.pt"):
            found.append(path)
    return max(found, default=None)
