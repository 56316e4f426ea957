"""The improvement commands over a session folder and its store: judge, tune weights, iterate with resume, retrain.

Iterations and retrain decisions are entries of commit logs, numbered without gaps: a run that was stopped goes on after
the last one, and of two writers one gets a number.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import flows
from loomframe.functions.geometry import Box, iou
from loomframe.operators import improve, labels, monitor, search
from loomframe.operators.split import hash_sample
from loomframe.runtime import checkpoint
from loomframe.sources import commits

KEYS = flows.KEYS
#: Size of a screen whose image isn't there.
SCREEN = (1920, 1080)
#: Bounds of the fusion weights before they are brought to a sum of 1.
WEIGHTS = {n: search.Range(0.0, high) for n, high in (("click_proximity", 1.0), ("diff", 1.0), ("vlm", 1.0), ("ocr", 0.5), ("profile_hint", 0.5))}


@dataclass(frozen=True)
class JudgeSettings:
    vlm_weight: float = 0.6
    heuristic_weight: float = 0.4
    min_bbox_area_ratio: float = 0.001
    max_bbox_area_ratio: float = 0.5


@dataclass(frozen=True)
class LoopSettings:
    max_iterations: int = 5
    patience: int = 3
    improvement_threshold: float = 0.01
    tuning_samples: int = 50
    tuning_trials: int = 30
    judge: JudgeSettings = field(default_factory=JudgeSettings)

    @staticmethod
    def from_yaml(text: str) -> LoopSettings:
        """From groups loop, weight_tuner (n_samples, n_trials) and judge; unknown keys are left out, a value out of bounds is
        an error."""
        doc = yaml.safe_load(text) or {}
        group = lambda name, *keys: {k: v for k, v in (doc.get(name) or {}).items() if k in keys}
        loop = group("loop", "max_iterations", "patience", "improvement_threshold")
        tuner = {f"tuning_{k[2:]}": v for k, v in group("weight_tuner", "n_samples", "n_trials").items()}
        judge_ = JudgeSettings(**group("judge", *(f.name for f in fields(JudgeSettings))))
        own = LoopSettings(**loop, **tuner, judge=judge_)
        whole = {"max_iterations": 1, "patience": 1, "tuning_samples": 5, "tuning_trials": 5, "improvement_threshold": 0}
        wrong = [n for n, least in whole.items() if getattr(own, n) < least]
        wrong += [f.name for f in fields(JudgeSettings) if not 0 <= getattr(judge_, f.name) <= 1]
        if wrong:
            raise ValueError(f"out of bounds: {', '.join(wrong)}")
        return own


def prediction_score(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """session_id, sample_id, vision_score, ious: the mean IoU of a sample's label box with a judge's predicted boxes, one
    a prompt; a prompt without a box counts 0, a sample without predictions has none and 0.

    samples: the keys and x1, y1, x2, y2; predictions: the keys, prompt and x1, y1, x2, y2 (null: the prediction failed).
    """
    told = predictions.select(*KEYS, "prompt", F.struct("x1", "y1", "x2", "y2").alias("p"))
    both = samples.join(told, KEYS, "left")
    score = F.when(F.col("p.x1").isNotNull(), iou(Box.of(F.col("p")), Box.cols())).when(F.col("prompt").isNotNull(), F.lit(0.0))
    listed = F.transform(F.array_sort(F.collect_list(F.when(score.isNotNull(), F.struct("prompt", score.alias("iou"))))), lambda x: x["iou"])
    return both.groupBy(*KEYS).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("vision_score"), listed.alias("ious"))  # a judge's few prompts


def judge(
    spark: SparkSession, folder: str, store: str | None = None, predictions: DataFrame | None = None, settings: JudgeSettings | None = None,
) -> DataFrame:
    """A judgment of each labeled sample: ord, sample, vision, rule and ensemble scores, reward, the box's measures.

    predictions: see prediction_score; without them the vision score is 0.
    """
    own = settings or JudgeSettings()
    rows = flows.load(spark, folder, store).where("label IS NOT NULL AND trigger IS NOT NULL")
    flat = labels.flat_fields(F.col("label"))
    box = [F.coalesce(flat[n], F.lit(float(k >= 2))).alias(c) for k, (n, c) in enumerate(zip(labels.BOX, ("x1", "y1", "x2", "y2"), strict=True))]
    size = [F.coalesce(c, F.lit(n)).alias(c) for c, n in zip(("width", "height"), SCREEN, strict=True)]
    rows = rows.select(*KEYS, "ord", *box, "x", "y", F.col("label.confidence").alias("confidence"), *size)
    rule = improve.heuristic(
        Box.cols(), F.col("x"), F.col("y"), F.col("confidence"), F.col("width"), F.col("height"), own.min_bbox_area_ratio, own.max_bbox_area_ratio,
    )
    rows = rows.withColumn("rule", rule)
    if predictions is None:
        rows = rows.withColumn("vision_score", F.lit(0.0)).withColumn("ious", F.array().cast("array<double>"))
    else:
        rows = rows.join(prediction_score(rows.select(*KEYS, "x1", "y1", "x2", "y2"), predictions), KEYS)
    ensemble = improve.ensemble(F.col("vision_score"), F.col("rule.score"), own.vlm_weight, own.heuristic_weight)
    return rows.withColumn("ensemble_score", ensemble).withColumn("reward", improve.clamp(F.col("ensemble_score")))


def mean_rewards(judgments: DataFrame) -> DataFrame:
    """n, mean_reward, mean_iou of judgments; 0 without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return judgments.agg(F.count("*").alias("n"), mean("reward").alias("mean_reward"), mean("vision_score").alias("mean_iou"))


def normalised(params: dict[str, float]) -> dict[str, float]:
    total = sum(params.values())
    return {k: v / total for k, v in params.items()} if total > 0 else dict(params)


def tune_weights(samples: DataFrame, objective: Callable[[dict[str, Column]], Column], key: str, settings: LoopSettings | None = None, seed: int = 0) -> dict:
    """weights, value, trials, samples: the fusion weights of the best mean of the objective over a sample of the rows.

    objective: a column of the samples' from the normalised weights as columns.
    """
    own = settings or LoopSettings()
    total = sum((F.col(f"w.{n}") for n in WEIGHTS), F.lit(0.0))
    parts = {n: F.when(total > 0, F.col(f"w.{n}") / total).otherwise(F.col(f"w.{n}")) for n in WEIGHTS}
    taken = checkpoint(hash_sample(samples, key, own.tuning_samples, seed))
    history = search.search(taken, WEIGHTS, objective(parts), key, own.tuning_trials, seed=seed)
    found = search.best(history)
    return {"weights": normalised(found.params), "value": found.value, "trials": len(history), "samples": taken.count()}


def run_loop(spark: SparkSession, log: str, iterate: Callable[[int], dict], settings: LoopSettings | None = None) -> list[dict]:
    """Iterations from the last one of the log and one, at most max_iterations, until improvement has stalled.

    iterate(number) returns the iteration's numbers, mean_ensemble_score among them; its entry is the commit of that
    number, so an iteration that fails leaves none and is run again, and one that another writer has meanwhile is an error.
    """
    own = settings or LoopSettings()
    done = [e | {"iteration": n} for n, e in commits.read(spark, log)]
    out = []
    start = done[-1]["iteration"] + 1 if done else 1
    for number in range(start, start + own.max_iterations):
        before = [e["mean_ensemble_score"] for e in done]
        entry = dict(iterate(number))
        entry["improved"] = not before or entry["mean_ensemble_score"] > max(before)
        commits.append(spark, log, entry, number=number)
        done.append(entry | {"iteration": number})
        out.append(done[-1])
        history = spark.createDataFrame([(e["iteration"], float(e["mean_ensemble_score"])) for e in done], "iteration int, score double")
        if improve.stalled(history, "score", "iteration", own.patience, own.improvement_threshold).first()["stalled"]:
            break
    return out


def iteration(
    spark: SparkSession,
    folder: str,
    store: str | None = None,
    predictions: DataFrame | None = None,
    objective: Callable[[dict[str, Column]], Column] | None = None,
    settings: LoopSettings | None = None,
) -> Callable[[int], dict]:
    """An iterate of run_loop: judge the labeled samples, count preference pairs, tune the weights if there is an objective
    (over columns of judge()) and five samples at least."""
    own = settings or LoopSettings()

    def run(number: int) -> dict:
        judged = checkpoint(judge(spark, folder, store, predictions, own.judge))
        means = mean_rewards(judged).first()
        entry = {"mean_ensemble_score": means["mean_reward"], "mean_iou": means["mean_iou"], "n_samples": means["n"], "n_preference_pairs": 0}
        if means["n"]:
            entry["n_preference_pairs"] = improve.ranked_pairs(judged, "ord", "ensemble_score", "ord").count()
        if objective is not None and means["n"] >= 5:
            entry["weight_snapshot"] = tune_weights(judged, objective, "ord", own, seed=number)
        return entry

    return run


def history(spark: SparkSession, log: str) -> DataFrame:
    """iteration, score, improved of a loop's log."""
    rows = [(n, float(e["mean_ensemble_score"]), bool(e["improved"])) for n, e in commits.read(spark, log)]
    return spark.createDataFrame(rows, "iteration int, score double, improved boolean")


def decide_retrain(spark: SparkSession, log: str, counts: DataFrame, now_ms: float | None = None, **limits) -> dict:
    """The retrain decision for one row of counts (failures, corrections, drifted), with the time since the last one of the
    log. A decision to retrain becomes the log's next entry; of two that see the same last one, one is an error."""
    past = commits.read(spark, log)
    now = time.time() * 1000 if now_ms is None else now_ms
    hours = (now - past[-1][1]["at_ms"]) / 3_600_000 if past else None
    row = counts.withColumn("hours_since", F.lit(hours).cast("double"))
    found = monitor.retrain_decision(row, "failures", "corrections", "drifted", "hours_since", **limits).first().asDict()
    if found["should_retrain"]:
        entry = {"at_ms": now, "reason": found["reason"], "strategy": found["recommended_strategy"]}
        commits.append(spark, log, entry, number=past[-1][0] + 1 if past else 1)
    return found
