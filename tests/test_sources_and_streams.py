import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import labels
from loomframe.sources import readers, taxonomy, writers
from loomframe.streaming import recorder


def test_input_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp_ms":100.0,"event_type":"click","x":50,"y":60}\n\n{"timestamp_ms":5,"foo":"bar"}\n')
    a, b = readers.input_log_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("timestamp_ms").collect()
    assert (a.event_type, a.x, a.metadata) == ("click", None, {"foo": "bar"}) and (b.x, b.metadata) == (50.0, None)
    (tmp_path / "b.csv").write_text("t,x,y\n1,,2\n")
    r = readers.input_log_csv(spark, str(tmp_path / "b.csv"), ts_col="t").first()
    assert (r.timestamp_ms, r.event_type, r.x, r.y, r.key) == (1.0, "click", None, 2.0, None)


def _sample(folder, session, number, **files):
    d = folder / session / "samples" / f"sample_{number:06d}"
    d.mkdir(parents=True)
    for name, content in files.items():
        if name == "pre":
            (d / "pre.png").write_bytes(b"x")
        else:
            (d / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))


def test_sessions(spark, tmp_path):
    click = {"timestamp_ms": 1.0, "action": "click", "x": 5.0, "y": None, "key": None}
    edited = {"review_status": "edited", "review_corrections": {"screen_type": "x"}}
    _sample(tmp_path, "s1", 0, event=click)
    _sample(tmp_path, "s1", 1, event=click, label={"confidence": 0.5, "elements": []}, review=edited, metadata={"a": 1}, pre=b"")
    _sample(tmp_path, "s1", 2, event="{broken")
    _sample(tmp_path, "s1", 3, event=click | {"unknown": 1})
    _sample(tmp_path, "s1", 4, event={"action": "click"})
    _sample(tmp_path, "s1", 5, event=click | {"action": "dance"})
    _sample(tmp_path, "s1", 6, event=click, review={"status": "edited"})
    _sample(tmp_path, "s1", 7, event=click, label={"page": {"colour": "red"}})
    _sample(tmp_path, "s1", 8, event=click, label={"elements": [{"bbox_xyxy": [1, 2, 3, 4]}]})
    _sample(tmp_path, "s2", 0, pre=b"")
    _sample(tmp_path, "s2", 1, review={"review_status": "rejected", "review_corrections": None})
    out = {(r.session_id, r.sample_id): r for r in readers.sessions(spark, str(tmp_path)).collect()}
    assert sorted(out) == [("s1", "sample_000000"), ("s1", "sample_000001"), ("s2", "sample_000000"), ("s2", "sample_000001")]
    one = out["s1", "sample_000001"]
    assert one.review_status == "edited" and json.loads(one.corrections) == {"screen_type": "x"} and one.ord == 1
    assert one.label.confidence == 0.5 and json.loads(one.metadata) == {"a": 1} and one.image_path.endswith("/s1/samples/sample_000001/pre.png")
    zero = out["s1", "sample_000000"]
    assert zero.event.x == 5 and zero.label is None and zero.review_status == "pending" and zero.image_path is None
    assert out["s2", "sample_000000"].event is None and out["s2", "sample_000000"].image_path
    assert out["s2", "sample_000001"].review_status == "rejected" and out["s2", "sample_000001"].corrections is None
    after = labels.effective_label(readers.sessions(spark, str(tmp_path))).where(
        "sample_id = 'sample_000001' AND session_id = 's1'"
    ).first()
    assert after.label.page.screen_type == "x"
    assert readers.sessions(spark, str(tmp_path / "none")).count() == 0


def test_flat_labels_come_back_nested(spark, tmp_path):
    flat = {
        "bbox_x_min": 10, "bbox_y_min": 20, "bbox_x_max": 30, "bbox_y_max": 40, "semantic_id": "btn", "semantic_text": "Go", "function_id": "go",
        "hotkeys": ["G"], "available_actions": ["click"], "situation_id": "sit", "screen_type": "map", "confidence": 0.6, "candidates": [], "evidence": {"roi": {"n": 1}},
    }
    listed = {"element_id": "e1", "bbox_xyxy": [1, 2, 3, 4], "function_id": "f1"}
    target = {
        "element_id": "e2",
        "bbox_x_min": 5,
        "bbox_x_max": 7,
        "is_route_target": True,
        "function_id": "f2",
        "confidence": 0.2,
        "metadata": {"k": [1]},
    }
    cases = [
        flat,
        {"function_id": "only", "confidence": 0.1},
        {
            "elements": [listed, target],
            "page": {"screen_type": "p"},
            "route_label": {"roi_name": "r"},
            "confidence": 0.3,
            "function_id": "old",
        },
        {"elements": [listed], "function_id": "own"},
        {"page": None, "route_label": {"primitive_id": "p", "target_element_id": "t"}, "hotkeys": ["X"]},
    ]
    for k, label in enumerate(cases):
        _sample(tmp_path, "s", k, label=label)
    a, b, c, d, e = [r.label for r in readers.sessions(spark, str(tmp_path)).orderBy("ord").collect()]
    assert (a.page.screen_type, a.page.situation_id, a.page.state_flags, a.page.confidence) == ("map", "sit", [], 0.6)
    one = a.elements[0]
    assert len(a.elements) == 1 and (
        one.element_id, one.bbox_x_min, one.bbox_y_max, one.semantic_text, one.hotkeys,
    ) == ("elem_001", 10, 40, "Go", ["G"])
    assert (one.is_route_target, one.confidence, one.enabled_state) == (True, 0.6, "enabled")
    assert (a.route_label.primitive_id, a.route_label.target_element_id, a.route_label.confidence) == ("go", "elem_001", 0.6)
    assert json.loads(a.evidence) == {"roi": {"n": 1}} and a.transition_detected is False
    assert b.elements == [] and b.route_label.primitive_id == "only" and b.route_label.target_element_id is None and b.page.screen_type is None
    assert [x.element_id for x in c.elements] == ["e1", "e2"] and (
        c.elements[0].bbox_x_max, c.elements[1].bbox_y_min, c.elements[1].bbox_y_max,
    ) == (3, 0, 1)
    assert (
        c.route_label.primitive_id, c.route_label.target_element_id, c.route_label.roi_name,
    ) == ("f2", "e2", "r") and json.loads(c.elements[1].metadata) == {"k": [1]}
    assert (d.route_label.primitive_id, d.route_label.target_element_id) == ("own", "e1")
    assert (e.route_label.primitive_id, e.route_label.target_element_id, e.elements[0].hotkeys) == ("p", "t", ["X"])


def test_grounding_reader(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('{"image_path":"a/b.png","prompt":"p","bbox":[1,2,3,4]}\n')
    assert readers.grounding_jsonl(spark, str(p), "/root").first()[:] == ("/root/a/b.png", "p", [1, 2, 3, 4], "b.png")
    p.write_text('{"image_path":"a/b.png","prompt":"p","bbox":[1,2,3]}\n')
    with pytest.raises(Exception, match="bad grounding line"):
        readers.grounding_jsonl(spark, str(p)).collect()


def test_frames_logs_taxonomy(spark, tmp_path):
    for i in (0, 1, 2):
        (tmp_path / f"frame_{i:06d}.png").write_bytes(b"x")
    assert [r.frame_ts_ms for r in readers.frame_files(spark, str(tmp_path), 2.0).orderBy("frame_index").collect()] == [0, 500, 1000]
    assert readers.json_log(spark, str(tmp_path / "none"), "a int").count() == 0
    log = str(tmp_path / "log")
    for k in (1, 2):
        writers.append_log(spark.createDataFrame([(k,)], "a int"), log)
    assert readers.json_log(spark, log, "a int").count() == 2
    y = tmp_path / "t.yaml"
    y.write_text(
        "primitives:\n  A: {router_enabled: false}\n  B:\nsituations:\n  s: {screen_types: [m], allowed_primitives: [B]}\nelements:\n  e: {function_id_or_related_primitive: B, text_aliases: [x], icon_aliases: [y]}\nrois:\n  r: [0, 0, 1, 1]\n  bad: [0, 1]\n"
    )
    dims = taxonomy.load(spark, "yaml", str(y))
    assert [r.primitive_id for r in taxonomy.router_primitives(dims["primitive"]).collect()] == ["B"]
    e = dims["element"].first()
    assert (e.function_id, e.aliases) == ("B", ["x", "y"]) and dims["roi"].count() == 1
    with pytest.raises(ValueError):
        taxonomy.Settings.from_yaml("review: {auto_approve_confidence: 2}")


def test_coco_roundtrip(spark, tmp_path, data):
    from loomframe.plans.export_queries import NAMES, _rows

    rows = _rows(spark, data)
    writers.coco_parts(rows, NAMES, str(tmp_path / "c"))
    parts = [spark.read.json(f"{tmp_path}/c/{n}") for n in ("images", "annotations", "categories")]
    writers.write_text(writers.coco_document(*parts), "value", str(tmp_path / "doc"))
    images, annotations, categories = readers.coco(spark, str(tmp_path / "doc"))
    assert images.count() == parts[0].count() and annotations.count() == parts[1].count() and categories.count() == 3
    writers.write_yolo(rows.limit(20), NAMES, str(tmp_path / "y"))
    split = writers.router_split(rows)
    assert set(split.columns) == {"sample_id", "image_path", "primitive_id", "situation_id", "screen_type", "session_id", "split"}
    assert split.where("split = 'val'").count() > 0
    assert writers.write_router_full(rows, str(tmp_path / "r")).count() == 0  # images that aren't there leave no rows


def test_gesture_stream_equals_steps(spark, tmp_path):
    rng = np.random.default_rng(3)
    raw, t = [], 0.0
    for _ in range(120):
        t += float(rng.integers(20, 500))
        kind = str(rng.choice(["press", "release", "move", "scroll", "key"], p=[0.3, 0.35, 0.2, 0.1, 0.05]))
        raw.append(
            {
                "source": f"s{rng.integers(2)}",
                "ts_ms": t,
                "kind": kind,
                "x": float(rng.integers(0, 15)),
                "y": 0.0,
                "button": str(rng.choice(["left", "right"])),
                "dx": 1.0,
                "dy": -1.0,
                "key": "a",
            }
        )
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, raw)) + "\n")
    q = recorder.record_events(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r.source, r.timestamp_ms, r.action) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want, state = [], {}
    import pandas as pd

    for r in pd.DataFrame(raw).itertuples():
        held, event = recorder.step(state.get(r.source, (None,) * 8), r)
        state[r.source] = held
        if event and event[0] in recorder.RECORDABLE:
            want.append((r.source, r.ts_ms, event[0]))
    assert got == sorted(want) and {a for _, _, a in want} >= {"click", "scroll", "type"}


def test_windows_and_monitor_streams(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = recorder.windowed_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
    frames = stream.select(
        F.col("user_id").cast("string").alias("source"),
        F.col("event_id").alias("frame_no"),
        (F.col("value") / 100).alias("mean_confidence"),
        (F.col("value") > 60).alias("is_drifted"),
    )
    m = recorder.monitor_stream(frames).writeStream.format("memory").queryName("m").outputMode("append").trigger(availableNow=True).start()
    m.awaitTermination(120)
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    want = e.select(
        F.col("event_id").alias("frame_no"), F.max(F.col("value") > 60).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("latched"),
    )
    assert spark.table("m").select("frame_no", "latched").exceptAll(want).count() == 0 and spark.table("m").count() == e.count()


def test_packages(spark, tmp_path):
    from loomframe.sources import packages

    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "name string, content binary")
    h = packages.write_package(spark, str(tmp_path / "p"), packages.ToolProfile("t"), {"map50": 0.5}, ["x"], files)
    assert h == packages.content_hash(files.orderBy("name")).first()[0] and packages.read_document(
        spark, str(tmp_path / "p" / "profile.json"),
    )["dataset_hash"] == h
    for v, status in ((1, "pending"), (2, "edited")):
        packages.save_sample_part(
            spark.createDataFrame([("s", "a", v, status)], "session_id string, sample_id string, version int, status string"),
            str(tmp_path),
            "review",
        )
    assert packages.current_part(spark, str(tmp_path), "review").first().status == "edited"
    assert packages.next_sample_ids(packages.current_part(spark, str(tmp_path), "review")).first().next_id == "sample_000002"


def test_teaching(spark):
    from loomframe.operators import teaching

    def teacher(request):
        if "bad" in request:
            raise RuntimeError
        return {"primitive_id": "p"}

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, r string")
    got = {r.id: r.chosen for r in teaching.teach(df, "id", "r", teacher, retries=1).collect()}
    assert got[1].primitive_id == "p" and got[2] is None
    img = spark.createDataFrame([(1, b"x")], "id int, c binary")
    model = lambda c: [{"label": "a", "bbox": [0, 0, 0.5, 0.5]}, {"label": "a", "bbox": [0, 0, 0.5, 0.49]}, {"label": "b", "bbox": [0.6, 0.6, 0.6, 0.9]}]
    out = teaching.prelabel(img, "id", "c", model, F.lit(100), F.lit(100)).collect()
    assert [(r.label, r.x2) for r in out] == [("a", 50.0)]
    assert teaching.analyze(
        spark.createDataFrame([("Slider", 0.9), ("x", 0.1), ("y", 0.5)], "label string, score double"), {"slider": ("drag",)},
    ).select("affordances", "element_type").collect() == [(["drag"], "drag"), (["click"], "button")]
