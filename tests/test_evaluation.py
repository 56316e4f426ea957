"""Evaluation by task against plain loops, and the history of experiments."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomframe import evaluation
from loomframe.sources import packages

BOX = "k int, x1 double, y1 double, x2 double, y2 double"


def test_grounding_in_pixels(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 500.0, 500.0), (2, 100.0, 100.0, 200.0, 200.0)], BOX)
    t = spark.createDataFrame([(2, 100.0, 100.0, 200.0, 300.0), (1, 0.0, 0.0, 500.0, 500.0)], BOX)
    r = evaluation.evaluate("grounding", p, t, key="k", width=F.lit(200), height=F.lit(100), artifacts={"eval": "x"}, checkpoint="c").first()
    # the second: 20 by 10 of 20 by 20 pixels, centres 5 apart; the first is equal
    assert r.metrics == pytest.approx({"mean_iou": 0.75, "mean_distance_px": 2.5})
    assert (r.task, r.primary_metric, r.artifacts, r.checkpoint_path) == ("grounding", "mean_iou", {"eval": "x"}, "c")
    with pytest.raises(Exception, match="differ in length"):
        evaluation.grounding(p.limit(1), t, "k", F.lit(200), F.lit(100)).collect()
    none = evaluation.grounding(p.limit(0), t.limit(0), "k", F.lit(1), F.lit(1)).first()
    assert none.metrics == {"mean_iou": 0.0, "mean_distance_px": 0.0} and none.artifacts == {}
    with pytest.raises(ValueError, match="unknown task"):
        evaluation.evaluate("sorting", p)


def test_router_against_loops(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(4), rng.randrange(5), rng.choice([-100, 0, 1]), rng.randrange(2), -100) for k in range(200)]
    p = spark.createDataFrame([(k, a, b, 0) for k, a, _, _, b, _ in rows], "k int, main int, aux int, gone int")
    t = spark.createDataFrame([(k, a, b, c) for k, _, a, b, _, c in rows], "k int, main int, aux int, gone int")
    got = evaluation.router(p, t, "k", "main", ("aux", "gone")).first().metrics
    pairs = [(a, b) for _, a, b, *_ in rows]
    f1 = []
    for c in {x for pair in pairs for x in pair}:
        tp, n, m = sum(a == b == c for a, b in pairs), Counter(a for a, _ in pairs)[c], Counter(b for _, b in pairs)[c]
        precision, recall = tp / n if n else 0.0, tp / m if m else 0.0
        f1.append(2 * precision * recall / (precision + recall) if precision + recall else 0.0)
    aux = [(b, c) for _, _, _, c, b, _ in rows if c != -100]
    want = {
        "primitive_macro_f1": sum(f1) / len(f1),
        "primitive_accuracy": sum(a == b for a, b in pairs) / len(pairs),
        "aux_accuracy": sum(a == b for a, b in aux) / len(aux),
        "gone_accuracy": 0.0,
    }
    assert got == pytest.approx(want)


def test_detector_and_history(spark, tmp_path):
    truth = spark.createDataFrame([(1, "i", "a", 0.0, 0.0, 10.0, 10.0), (2, "i", "b", 0.0, 0.0, 10.0, 10.0)], "box_id int, image string, name string, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([("i", "a", 0.0, 0.0, 10.0, 9.0), ("j", "b", 0.0, 0.0, 10.0, 10.0)], "image string, name string, x1 double, y1 double, x2 double, y2 double")
    times = spark.createDataFrame([(20.0,), (40.0,), (60.0,)], "latency_ms double")
    (tmp_path / "leaderboard.json").write_text(json.dumps([{"mAP50": 0.5}, {"mAP50": 0.9}]))
    map50 = evaluation.reported_map50(spark, str(tmp_path))
    result = evaluation.detector(truth, found, times, map50)
    got = result.first().metrics
    assert got == pytest.approx({"mAP50": 0.5, "click_success": 0.5, "latency_ms_mean": 40.0, "latency_ms_p95": 60.0, "score": 0.3 + 0.2 - 0.01})
    (tmp_path / "best_package").mkdir()
    (tmp_path / "best_package" / "metrics.json").write_text(json.dumps({"mAP50": "bad"}))
    assert evaluation.reported_map50(spark, str(tmp_path)) == 0.0 and evaluation.reported_map50(spark, str(tmp_path / "no")) == 0.0
    empty = evaluation.detector(truth.limit(0), found, times.limit(0)).first().metrics
    assert empty["score"] == 0.0 and empty["latency_ms_p95"] == 0.0
    profile = packages.ToolProfile("router", "v2")
    assert [evaluation.record_experiment(spark, str(tmp_path), profile, result, now_ms=float(k)) for k in range(2)] == [1, 2]
    rows = evaluation.experiments(spark, str(tmp_path)).orderBy("run").collect()
    assert [(r.run, r.recorded_ms, round(r.value, 6)) for r in rows] == [(1, 0.0, 0.49), (2, 1.0, 0.49)]
    assert packages.read_document(spark, str(tmp_path / "tool_profile.json"))["tool_id"] == "router"
