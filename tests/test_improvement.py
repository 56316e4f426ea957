"""Parzen-tree search, pruning, the improvement loop and retrain decisions with resume."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import improvement
from loomframe.operators import search
from loomframe.sources import commits, image_files


def _samples(spark, n=40):
    return spark.range(n).selectExpr("id", "(id % 5) / 5.0 AS v")


def _peak(*w):
    return sum((-((F.col(f"w.{n}") - at) ** 2) for n, at in w), F.lit(0.0)) + F.col("v") * 0.0


SPACE = {"a": search.Range(0.0, 1.0), "b": search.Range(0.0, 1.0)}


def test_search_repeats_and_beats_the_grid(spark):
    samples, goal = _samples(spark), _peak(("a", 0.37), ("b", 0.62))
    one = search.search(samples, SPACE, goal, "id", trials=48, seed=4)
    first = search.search(samples, SPACE, goal, "id", trials=12, seed=4)
    again = search.search(samples, SPACE, goal, "id", trials=36, seed=4, history=first)  # stopped and taken up again
    assert [(t.params, t.value, t.pruned) for t in one] == [(t.params, t.value, t.pruned) for t in again] and len(one) == 48
    grid = max(-((a - 0.37) ** 2) - (b - 0.62) ** 2 for a in (0.0, 0.25, 0.5, 0.75, 1.0) for b in (0.0, 0.25, 0.5, 0.75, 1.0))
    assert search.best(one).value > grid
    late, early = (np.mean([t.value for t in part]) for part in (one[24:], one[:10]))
    assert late > early and any(t.pruned for t in one) and not search.best(one).pruned
    for t in one:
        assert len(t.steps) == (1 if t.pruned else 2)


def test_kinds_of_parameters():
    space = {"lr": search.Range(1e-4, 5e-3, log=True), "n": search.Range(5, 30, whole=True), "size": (416, 512, 640), "how": ("x", "y")}
    rng = np.random.default_rng(0)
    past = []
    for k in range(60):
        p = search.suggest(past, space, rng)
        assert 1e-4 <= p["lr"] <= 5e-3 and 5 <= p["n"] <= 30 and isinstance(p["n"], int) and p["size"] in space["size"] and p["how"] in "xy"
        past.append(search.Trial(k, p, -abs(np.log(p["lr"] / 1e-3)) + (p["size"] == 512) + (p["how"] == "y")))
    late = past[30:]
    assert sum(t.params["size"] == 512 for t in late) > 15 and sum(t.params["how"] == "y" for t in late) > 18
    assert search.best([]) is None and search.suggest([], space, rng).keys() == space.keys()


def test_median_pruning_by_hand():
    done = [search.Trial(k, {}, v, [v]) for k, v in enumerate((0.1, 0.2, 0.3, 0.4))]
    assert not search.prune(search.Trial(9, {}, 0.0, [0.0]), done)  # too few
    done.append(search.Trial(4, {}, 0.5, [0.5, 0.6]))
    assert search.prune(search.Trial(9, {}, 0.2, [0.29]), done) and not search.prune(search.Trial(9, {}, 0.3, [0.3]), done)
    assert not search.prune(search.Trial(9, {}, 0.0, [0.5, 0.0]), done)


def test_weights_are_normalised(spark):
    settings = improvement.LoopSettings(tuning_trials=15, tuning_samples=20)
    out = improvement.tune_weights(_samples(spark), lambda w: w["diff"] - w["ocr"] + F.col("v") * 0.0, "id", settings)
    assert sum(out["weights"].values()) == pytest.approx(1.0) and set(out["weights"]) == set(improvement.WEIGHTS)
    assert (out["trials"], out["samples"]) == (15, 20) and out["value"] == pytest.approx(out["weights"]["diff"] - out["weights"]["ocr"])


def test_loop_goes_on_where_it_stopped(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    scores = [0.4, 0.5, 0.45, 0.9, 0.1, 0.2, 0.3, 0.35]

    def iterate(n):
        seen.append(n)
        if n == 3 and seen.count(3) == 1:
            raise OSError("lost")
        return {"mean_ensemble_score": scores[n - 1]}

    settings = improvement.LoopSettings(max_iterations=3, patience=10)
    with pytest.raises(OSError):
        improvement.run_loop(spark, log, iterate, settings)
    out = improvement.run_loop(spark, log, iterate, settings)
    assert seen == [1, 2, 3, 3, 4, 5] and [e["iteration"] for e in out] == [3, 4, 5]
    assert [r.improved for r in improvement.history(spark, log).orderBy("iteration").collect()] == [True, True, False, True, False]

    def raced(n):
        commits.append(spark, log, {"mean_ensemble_score": 0.0, "improved": False}, number=n)  # another writer was faster
        return {"mean_ensemble_score": 1.0}

    with pytest.raises(FileExistsError):
        improvement.run_loop(spark, log, raced, settings)
    assert len(commits.read(spark, log)) == 6
    stalled = improvement.run_loop(spark, str(tmp_path / "flat"), lambda n: {"mean_ensemble_score": 0.5}, improvement.LoopSettings(max_iterations=9, patience=2))
    assert len(stalled) == 3


def test_retrain_decisions_are_kept(spark, tmp_path):
    log, hour = str(tmp_path / "retrain"), 3_600_000.0
    counts = lambda f, c, d: spark.createDataFrame([(f, c, d)], "failures int, corrections int, drifted boolean")
    assert not improvement.decide_retrain(spark, log, counts(1, 1, False), now_ms=0.0)["should_retrain"]
    first = improvement.decide_retrain(spark, log, counts(60, 1, False), now_ms=10 * hour)
    assert first["should_retrain"] and first["recommended_strategy"] == "incremental"
    wait = improvement.decide_retrain(spark, log, counts(60, 1, True), now_ms=20 * hour)
    assert not wait["should_retrain"] and wait["reason"].startswith("cooldown active (10.0h")
    again = improvement.decide_retrain(spark, log, counts(0, 0, True), now_ms=40 * hour)
    assert again["should_retrain"] and again["recommended_strategy"] == "full"
    assert [e["at_ms"] for _, e in commits.read(spark, log)] == [10 * hour, 40 * hour]


def test_judge_with_a_table_of_predictions(spark, tmp_path):
    boxes = {"sample_000001": [10, 10, 30, 20], "sample_000002": [0, 0, 60, 40], "sample_000003": None}
    for name, box in boxes.items():
        d = tmp_path / "s" / "samples" / name
        d.mkdir(parents=True)
        (d / "event.json").write_text(json.dumps({"timestamp_ms": 1.0, "action": "click", "x": 15.0, "y": 15.0}))
        element = [{"element_id": "e", "bbox_xyxy": box}] if box else []
        (d / "label.json").write_text(json.dumps({"confidence": 0.8, "elements": element}))
        if box:
            (d / "pre.png").write_bytes(image_files.png(np.zeros((40, 60, 3), np.uint8)))
    told = [("s", "sample_000001", "a", 10.0, 10.0, 30.0, 20.0), ("s", "sample_000001", "b", 10.0, 10.0, 20.0, 20.0), ("s", "sample_000002", "a", None, None, None, None)]
    predictions = spark.createDataFrame(told, "session_id string, sample_id string, prompt string, x1 double, y1 double, x2 double, y2 double")
    got = {r.sample_id[-1]: r for r in improvement.judge(spark, str(tmp_path), predictions=predictions).collect()}
    assert got["1"].ious == [1.0, 0.5] and got["1"].vision_score == 0.75 and got["2"].ious == [0.0] and got["3"].ious == []
    assert got["1"].rule.score == 1.0 and got["1"].ensemble_score == pytest.approx(0.6 * 0.75 + 0.4)
    assert got["2"].rule.penalties == ["bbox_too_large"] and got["2"].ensemble_score == pytest.approx(0.4 * 0.7)
    # without an element the box is 0, 0, 1, 1 on a screen of 1920 by 1080, and the click lies outside
    assert got["3"].rule.penalties == ["bbox_too_small", "click_outside_bbox"] and got["3"].reward == pytest.approx(0.4 * 0.4)
    means = improvement.mean_rewards(improvement.judge(spark, str(tmp_path), predictions=predictions)).first()
    assert means.n == 3 and means.mean_reward == pytest.approx((0.85 + 0.28 + 0.16) / 3) and means.mean_iou == pytest.approx(0.25)
    entry = improvement.iteration(spark, str(tmp_path), predictions=predictions)(1)
    assert entry["n_samples"] == 3 and entry["n_preference_pairs"] == 3


def test_settings_of_the_loop():
    text = "loop: {max_iterations: 7, run_dpo: false}\nweight_tuner: {n_samples: 9}\njudge: {vlm_weight: 0.5, vlm_device_map: auto}"
    own = improvement.LoopSettings.from_yaml(text)
    assert (own.max_iterations, own.tuning_samples, own.tuning_trials, own.judge.vlm_weight, own.patience) == (7, 9, 30, 0.5, 3)
    assert improvement.LoopSettings.from_yaml("") == improvement.LoopSettings()
    for bad in ("loop: {patience: 0}", "weight_tuner: {n_trials: 2}", "judge: {vlm_weight: 2}", "loop: {improvement_threshold: -1}"):
        with pytest.raises(ValueError):
            improvement.LoopSettings.from_yaml(bad)
