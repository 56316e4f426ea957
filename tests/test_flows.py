"""Flows over a session folder with real images, image files, models, the sample stream, settings."""

import json
import struct
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import flows
from loomframe.operators import candidates, models
from loomframe.sources import image_files, packages, taxonomy, writers
from loomframe.sources import store as stores
from loomframe.streaming import recorder

TAXONOMY = """
primitives: {go: {}, stop: {}}
situations: {s1: {screen_types: [map], allowed_primitives: [go], roi_priority: [corner]}}
elements: {btn: {function_id: stop, hotkeys: [B]}}
rois: {corner: [0.0, 0.0, 0.5, 0.5], bottom_right: [0.5, 0.5, 1.0, 1.0]}
"""


def _noise(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (40, 60, 3)).astype(np.uint8)


@pytest.fixture(scope="module")
def session(tmp_path_factory):
    """Six samples: two labeled, a copy of the first screen, one flat gray, one without an image, one rejected."""
    root = tmp_path_factory.mktemp("work")
    label = {"page": {"screen_type": "map", "situation_id": "s1"}, "route_label": {"primitive_id": "go"}, "confidence": 0.5}
    label["elements"] = [{"element_id": "e", "bbox_xyxy": [5, 5, 25, 15], "semantic_id": "btn", "confidence": 0.4}]
    gray = np.full((40, 60, 3), 10, np.uint8)
    cases = [
        (label, _noise(1), None),
        (label, _noise(2), None),
        (label, _noise(1), None),
        (label, gray, None),
        (label, None, None),
        (label, _noise(3), "rejected"),
    ]
    for k, (found, pixels, status) in enumerate(cases):
        d = root / "sess" / "samples" / f"sample_{k:06d}"
        d.mkdir(parents=True)
        (d / "event.json").write_text(json.dumps({"timestamp_ms": float(k), "action": "click", "x": 6.0, "y": 4.0}))
        (d / "label.json").write_text(json.dumps(found))
        if pixels is not None:
            (d / "pre.png").write_bytes(image_files.png(pixels))
            (d / "post.png").write_bytes(image_files.png(255 - pixels))
        if status:
            (d / "review.json").write_text(json.dumps({"review_status": status, "review_corrections": None}))
    return root


@pytest.fixture(scope="module")
def dims(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tax") / "t.yaml"
    path.write_text(TAXONOMY)
    return taxonomy.load(spark, "yaml", str(path))


def _metadata(spark, store, key):
    rows = stores.current(spark, store, "metadata").where(F.col("key") == key).collect()
    return {r.sample_id: json.loads(r.value) for r in rows}


def test_filter_stats_and_queue(spark, session, tmp_path):
    store = str(tmp_path / "store")
    got = {r.drop_stage: r.n for r in flows.filter_samples(spark, str(session), store).collect()}
    assert got == {"kept": 3, "quality": 1, "invalid_action": 1, "dedup": 1}
    told = _metadata(spark, store, "filter")
    clusters = {k: (v["cluster_id"], v["cluster_representative"]) for k, v in told.items()}
    assert clusters == {
        "sample_000000": ("cluster_000001", True),
        "sample_000001": ("cluster_000002", True),
        "sample_000002": ("cluster_000001", False),
        "sample_000003": ("cluster_000003", True),
        "sample_000004": ("missing", True),
        "sample_000005": ("cluster_000004", True),
    }
    assert told["sample_000002"]["flags"] == ["duplicate_non_representative"] and told["sample_000002"]["score"] == 0.8
    assert told["sample_000003"]["flags"] == ["quality_issue"] and told["sample_000000"]["flags"] == []
    assert told["sample_000004"]["flags"] == ["quality_issue", "legacy_invalid_action"]
    counts = flows.stats(spark, str(session), store).first()  # a filter run rejects nothing
    assert (counts.total, counts.labeled, counts.rejected, counts.pending, counts.duplicates) == (6, 6, 1, 5, 1)
    queue = {r.sample_id: r for r in flows.review_queue(spark, str(session), store).collect()}
    assert sorted(queue) == ["sample_000000", "sample_000001", "sample_000003", "sample_000004"]  # not the copy, not the rejected
    assert {r.decision for r in queue.values()} == {"review"} and queue["sample_000000"].priority == pytest.approx(0.4)
    done = flows.reject_filtered(spark, str(session), store).first()
    assert (done.rejected, done.left_alone) == (3, 0)
    held = {r.sample_id: (r.review_status, r.corrections) for r in stores.merged(spark, str(session), store).collect()}
    assert [held[f"sample_00000{k}"][0] for k in range(6)] == ["pending", "pending", "rejected", "rejected", "rejected", "rejected"]
    assert json.loads(held["sample_000002"][1]) == {"auto_filter_rejected": True} and held["sample_000005"][1] is None


def test_flags_of_copies_whose_first_is_dropped(spark, tmp_path):
    """Clusters are over all labeled samples: a kept sample whose leader falls at an earlier stage is a copy all the same."""
    first, second = tmp_path / "s" / "samples" / "sample_000001", tmp_path / "s" / "samples" / "sample_000002"
    for d, post in ((first, _noise(1)), (second, 255 - _noise(1))):
        d.mkdir(parents=True)
        (d / "event.json").write_text(json.dumps({"timestamp_ms": 1.0, "action": "click"}))
        (d / "label.json").write_text(json.dumps({"confidence": 0.5}))
        (d / "pre.png").write_bytes(image_files.png(_noise(1)))
        (d / "post.png").write_bytes(image_files.png(post))  # the first shows no change
    store = str(tmp_path / "store")
    got = {r.drop_stage: r.n for r in flows.filter_samples(spark, str(tmp_path), store).collect()}
    assert got == {"invalid_action": 1, "kept": 1}
    told = _metadata(spark, store, "filter")
    missing = ["missing_primitive_id", "missing_situation_id"]
    assert told["sample_000001"]["flags"] == [*missing, "legacy_invalid_action"]
    assert told["sample_000002"]["flags"] == [*missing, "duplicate_non_representative"]


def test_queue_reads_evidence_and_metadata(spark, tmp_path):
    """Each bonus of the priority from where label-auto and filter leave it; approvals are stored."""
    cases = {
        "a": ({"confidence": 0.45}, {}, 0.45),
        "b": ({"confidence": 0.6}, {"filter": {"flags": ["candidate_conflict"], "cluster_representative": True}}, 0.35),
        "c": (
            {
                "confidence": 0.6,
                "evidence": {"conflict_pair": ["p", "q"], "triggered_hard_negatives": ["x"], "open_screen_detected": True},
                "page": {"screen_type": "popup", "situation_id": "s"},
                "route_label": {"primitive_id": "popup_primitive"},
            },
            {},
            0.15,
        ),
        "d": ({"confidence": 0.9, "evidence": {"route_candidates": [{"confidence": 0.5}, {"confidence": 0.45}, {}]}}, {"screen_novelty": True}, 0.6),
        "e": ({"confidence": 0.95}, None, None),
        "f": ({"confidence": 0.2, "evidence": {"triggered_hard_negatives": list("abcdef"), "conflict_pair": []}}, {"screen_novelty": 0}, 0.0),
    }
    for k, (label, metadata, _) in cases.items():
        d = tmp_path / "s" / "samples" / f"sample_{k}"
        d.mkdir(parents=True)
        (d / "event.json").write_text(json.dumps({"timestamp_ms": 1.0, "action": "click"}))
        (d / "label.json").write_text(json.dumps(label))
        if metadata is not None:
            (d / "metadata.json").write_text(json.dumps(metadata))
    store = str(tmp_path / "store")
    settings = taxonomy.Settings(review=taxonomy.ReviewSettings(enable_auto_approve=True, auto_approve_confidence=0.91))
    queue = flows.review_queue(spark, str(tmp_path), store, settings).collect()
    got = {r.sample_id[-1]: r.priority for r in queue}
    assert {k: v if v is None else round(v, 6) for k, v in got.items()} == {k: want for k, (_, _, want) in cases.items()}
    again = flows.review_queue(spark, str(tmp_path), store, settings).collect()
    assert sorted(r.sample_id[-1] for r in again) == list("abcdf")  # the approved one isn't pending any more
    assert flows.stats(spark, str(tmp_path), store).first().approved == 1


def test_flows_in_a_chain(spark, session, dims, tmp_path):
    """label-auto, filter, review and export, each on what the ones before it left."""
    bare, store = _without_labels(session, tmp_path), str(tmp_path / "store")
    assert flows.label_auto(spark, bare, dims, store, _teacher()).first().labeled == 5
    flows.filter_samples(spark, bare, store)
    queue = flows.review_queue(spark, bare, store).orderBy("priority", "ord").collect()
    # 0.9 of the teacher, who names no situation, less 0.25 and the cluster bonus; 0.75 of the local labeler less that bonus
    assert [(r.sample_id[-1], round(r.priority, 2)) for r in queue] == [("0", 0.55), ("1", 0.65), ("3", 0.65), ("5", 0.65)]
    flows.decide(spark, store, "sess", "sample_000001", "edited", json.dumps({"primitive_id": "stop"}))
    flows.decide(spark, store, "sess", "sample_000003", "rejected")
    with pytest.raises(ValueError, match="not a decision"):
        flows.decide(spark, store, "sess", "sample_000000", "pending")
    counts = flows.stats(spark, bare, store).first()
    assert (counts.labeled, counts.edited, counts.rejected, counts.duplicates) == (5, 1, 1, 1)
    stores.compact(spark, store)
    flows.export(spark, bare, str(tmp_path / "out"), dims, ("router_full",), store=store)
    full = spark.read.csv(str(tmp_path / "out/router_full/labels.csv"), header=True).collect()
    assert {r.sample_id: r.primitive_id for r in full} == {"sample_000000": "stop", "sample_000001": "stop", "sample_000005": "go"}


def test_export_all(spark, session, dims, tmp_path):
    out = str(tmp_path / "out")
    assert len(flows.export(spark, str(session), out, dims, flows.FORMATS)) == 7
    full = spark.read.csv(f"{out}/router_full/labels.csv", header=True).collect()
    assert sorted(r.sample_id for r in full) == [f"sample_00000{k}" for k in range(4)]
    assert (
        tmp_path / "out/router_full/images/sample_000001.png"
    ).read_bytes() == (session / "sess/samples/sample_000001/pre.png").read_bytes()
    crop = spark.read.format("image").load(f"{out}/router_roi/images").where("image.origin LIKE '%sample_000001.png'").first().image
    assert (crop.width, crop.height) == (30, 20)
    assert (np.frombuffer(crop.data, np.uint8).reshape(20, 30, 3)[:, :, ::-1] == _noise(2)[:20, :30]).all()
    parts = [spark.read.csv(f"{out}/router_full/{p}.csv", header=True).count() for p in ("train", "val")]
    assert sum(parts) == 4 and parts[1] == 1
    assert spark.read.json(f"{out}/coco/annotations").count() == 4 and spark.read.json(f"{out}/grounding").count() == 4
    states = spark.read.csv(f"{out}/roi_state/labels.csv", header=True).collect()
    assert {r.turn_state for r in states} == {"s1"} and len(states) == 4
    by_name = {r.sample_id: Path(r.image_path) for r in states}
    corner = image_files.pixels(by_name["sample_000001"].read_bytes())
    assert (corner == _noise(2)[40 - 8 :, 60 - 16 :]).all()
    yolo = tmp_path / "out" / "yolo"
    listed = [x for p in ("train", "val") for f in (yolo / f"{p}.txt").glob("part-*") for x in f.read_text().split()]
    assert sorted(listed) == [f"images/sample_00000{k}.png" for k in range(4)] and all((yolo / x).exists() for x in listed)
    assert (yolo / "labels" / "sample_000001.txt").read_text() == "0 0.250000 0.250000 0.333333 0.250000\n"
    assert {p.suffix for p in (yolo / "labels").iterdir()} <= {".txt"}
    with pytest.raises(ValueError, match="unknown formats"):
        flows.export(spark, str(session), out, dims, ("tfrecord",))


def _teacher():
    def teacher(request):
        asked = json.loads(request)
        if asked["sample_id"]:
            return None
        assert asked["rois"] == ["corner", "bottom_right"] and asked["pre_image_b64"].startswith("iVBOR")
        ranked = [{"rank": 1, "primitive_id": "stop", "confidence": 0.9}]
        box = [0.0, 0.0, 0.5, 0.5]
        return {"primitive_id": "stop", "confidence": 0.9, "roi_name": "corner", "roi_bbox_norm": box, "evidence": {"why": "red"}, "candidates": ranked}

    return teacher


def _without_labels(session, tmp_path):
    bare = tmp_path / "bare"
    for d in sorted((session / "sess" / "samples").iterdir()):
        own = bare / "sess" / "samples" / d.name
        own.mkdir(parents=True)
        for name in ("event.json", "pre.png", "post.png"):
            if (d / name).exists():
                (own / name).write_bytes((d / name).read_bytes())
    return str(bare)


def test_label_auto_and_relabel(spark, session, dims, tmp_path):
    bare, store = _without_labels(session, tmp_path), str(tmp_path / "a")
    got = flows.label_auto(spark, bare, dims, store, _teacher()).first().asDict()
    # the first screen is taught and copied once; the others have local labels, but for the one without an image
    assert got == {"unlabeled": 6, "clusters": 5, "labeled": 5, "teacher_calls": 5, "fallback": 3, "copied": 1, "blocked": 0, "calls_saved": 1}
    named = {r.sample_id: r.label for r in stores.current(spark, store, "label").collect()}
    assert sorted(named) == [f"sample_00000{k}" for k in (0, 1, 2, 3, 5)] and named["sample_000002"] == named["sample_000000"]
    taught, local = named["sample_000000"], named["sample_000001"]
    assert taught.route_label.primitive_id == "stop" and taught.route_label.roi_bbox_norm == [0.0, 0.0, 0.5, 0.5]
    assert (taught.route_label.trigger_modality, taught.route_label.trigger_action_type) == ("mouse", "click")
    assert json.loads(taught.evidence) == {"why": "red", "route_candidates": [{"rank": 1, "primitive_id": "stop", "confidence": 0.9}]}
    assert (local.route_label.primitive_id, local.page.situation_id, local.page.screen_type, local.route_label.roi_name) == ("go", "s1", "map", "corner")
    assert json.loads(local.evidence)["matched_rois"] == ["corner"] and local.confidence == pytest.approx(0.75)
    stamps, filters, auto = (_metadata(spark, store, k) for k in ("label_auto_provider", "filter", "label_auto"))
    copy = stamps["sample_000002"]
    assert (copy["status"], copy["source_sample_id"], copy["source_provider_status"]) == ("copied_from_representative", "sample_000000", "ok")
    assert (stamps["sample_000001"]["provider"], stamps["sample_000001"]["fallback_from"]) == ("local_vlm", "gemini")
    assert stamps["sample_000004"]["status"] == "failed" and "sample_000004" not in auto
    assert filters["sample_000002"] == {"flags": ["duplicate_non_representative"], "cluster_id": "cluster_000001", "cluster_representative": False}
    assert auto["sample_000000"]["route_label"]["roi_name"] == "corner" and auto["sample_000001"]["confidence"] == pytest.approx(0.75)
    # a second run finds the sample that still has no label, and nothing else
    assert flows.label_auto(spark, bare, dims, store, _teacher()).first().unlabeled == 1
    counts = flows.relabel(spark, bare, dims, store, lambda r: {"primitive_id": "go"} if json.loads(r)["sample_id"] == 1 else None).first()
    assert (counts.processed, counts.success, counts.failed) == (5, 1, 4)
    again = {r.sample_id: r.label for r in stores.current(spark, store, "label").collect()}["sample_000001"]
    assert (again.route_label.primitive_id, again.page.situation_id, again.confidence) == ("go", "s1", pytest.approx(0.75))
    assert {k: v["status"] for k, v in _metadata(spark, store, "relabel").items()}["sample_000001"] == "ok"


def test_label_auto_without_fallback(spark, session, dims, tmp_path):
    bare, store = _without_labels(session, tmp_path), str(tmp_path / "a")
    settings = taxonomy.Settings(labeler=taxonomy.LabelerSettings(provider_fallback_to_local=False))
    got = flows.label_auto(spark, bare, dims, store, settings=settings).first()
    assert (got.labeled, got.blocked, got.fallback, got.calls_saved) == (0, 1, 0, 0)
    assert _metadata(spark, store, "label_auto_provider")["sample_000002"]["status"] == "blocked_by_representative_failure"
    local = taxonomy.Settings(labeler=taxonomy.LabelerSettings(provider="local_vlm", provider_fallback_to_local=False))
    got = flows.label_auto(spark, bare, dims, store, settings=local).first()
    assert (got.labeled, got.teacher_calls, got.fallback, got.copied) == (5, 0, 4, 1)


def _filtered_png(pixels, kind):
    """A PNG whose lines are predicted by one filter, by the words of the format."""
    h, w, c = pixels.shape
    flat = np.pad(pixels.astype(int).reshape(h, w * c), ((1, 0), (c, 0)))
    here, left, up, corner = flat[1:, c:], flat[1:, :-c], flat[:-1, c:], flat[:-1, :-c]
    p = left + up - corner
    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    lines = (here - [0, left, up, (left + up) // 2, paeth][kind]) % 256
    body = np.hstack([np.full((h, 1), kind), lines]).astype(np.uint8).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_pixels_of_png(kind):
    for channels in (1, 3, 4):
        own = np.random.default_rng(kind).integers(0, 256, (7, 9, channels)).astype(np.uint8)
        assert (image_files.pixels(_filtered_png(own, kind)) == own).all()
    assert image_files.pixels(b"GIF89a") is None and image_files.pixels(image_files.png(own)[:40]) is None


def test_files_by_their_paths(spark, tmp_path):
    """Only the files asked for are read; missing ones have no row; other kinds of image are cropped by the image source."""
    a, b = _noise(7), _noise(8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(image_files.png(a))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + 60 * 40 * 3, 0, 0, 54, 40, 60, -40, 1, 24, 0, 60 * 40 * 3, 0, 0, 0, 0) + b[:, :, ::-1].tobytes()
    (tmp_path / "in" / "b.bmp").write_bytes(bmp)
    names = ["a.png", "broken.png", "b.bmp", "gone.png"]
    rows = spark.createDataFrame([(f"x{k}", f"{tmp_path}/in/{n}") for k, n in enumerate(names)] + [("none", None)], "name string, image_path string")
    rows = rows.withColumn("image_path", F.when(F.col("name") == "x0", F.concat(F.lit("file:"), "image_path")).otherwise(F.col("image_path")))
    got = {r.name: r.content for r in image_files.fetched(rows, "image_path").collect()}
    assert bytes(got["x0"]) == image_files.png(a) and got["x3"] is None and got["none"] is None and len(got) == 5
    done = image_files.write_copies(rows, str(tmp_path / "copies")).collect()
    assert sorted(r.name for r in done) == ["x0", "x1", "x2"] and (tmp_path / "copies" / "x2").read_bytes() == bmp
    box = F.struct(F.lit(3).alias("x1"), F.lit(2).alias("y1"), F.lit(33).alias("x2"), F.lit(22).alias("y2"))
    cut = image_files.write_crops(rows.withColumn("crop", box), str(tmp_path / "crops")).where("path IS NOT NULL").collect()
    assert sorted(r.name for r in cut) == ["x0", "x2"]
    assert (image_files.pixels((tmp_path / "crops" / "x0").read_bytes()) == a[2:22, 3:33]).all()
    assert (image_files.pixels((tmp_path / "crops" / "x2").read_bytes()) == b[2:22, 3:33]).all()


def test_router_of_no_rows(spark, session, dims, tmp_path):
    rows = flows.load(spark, str(session)).where("sample_id = 'sample_000004'")
    assert writers.write_router_full(rows, str(tmp_path / "f")).count() == 0
    assert writers.write_router_roi(rows, str(tmp_path / "r"), dims["situation"], dims["roi"]).count() == 0


def test_models_and_tensors(spark, tmp_path):
    class Corner(models.FrameModel):
        def load(self):
            self.ready = True

        def predict(self, image):
            return [{"label": "box", "bbox": [0, 0, len(image) % 7, 2]}] if self.ready else []

    pixels = _noise(5)
    (tmp_path / "a.png").write_bytes(image_files.png(pixels))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content").unionByName(
        spark.createDataFrame([("none", None)], "path string, content binary")
    )
    found = models.predict(files, "path", "content", Corner()).collect()
    assert len(found) == 1 and (found[0].label, found[0].score) == ("box", 0.5)
    screens = {r.path[-5:]: r.screen_type for r in models.classify_screens(files, "path", "content", lambda c: "map").collect()}
    assert screens == {"a.png": "map", "none": None}
    assert models.classify_screens(files, "path", "content").where("screen_type IS NOT NULL").count() == 0
    t = models.image_tensors(spark.read.format("image").load(str(tmp_path))).first()
    want = ((pixels / 255.0 - models.MEAN) / models.DEVIATION).transpose(2, 0, 1).ravel()
    assert (t.channels, t.height, t.width) == (3, 40, 60) and np.allclose(t.tensor, want, atol=1e-5)


def test_candidates_by_hand(spark):
    c = spark.createDataFrame(
        [("a", 1, 0.0, 0.0, 10.0, 10.0), ("a", 2, 0.0, 0.0, 10.0, 10.0), ("b", 1, 900.0, 900.0, 910.0, 910.0)],
        "s string, o int, x1 double, y1 double, x2 double, y2 double",
    )
    near = candidates.nearest_to_click(c.withColumn("px", F.lit(5.0)).withColumn("py", F.lit(8.0)), "s", "o", "px", "py").collect()
    assert [(r.s, r.o, r.distance) for r in near] == [("a", 1, 3.0)]
    boxes = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(w).alias("x2"), F.lit(1.0).alias("y2")) for n, w in ((1, 2.0), (2, 5.0), (3, 2.0))))
    assert [b.n for b in spark.range(1).select(candidates.largest_first(boxes).alias("b")).first().b] == [2, 1, 3]


def test_sample_stream(spark, tmp_path):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    frames = [("s", at(k * 100), f"f{k:03d}") for k in range(0, 400)]
    events = [("s", at(1040), "a"), ("s", at(2000), "b"), ("other", at(1500), "c"), ("s", at(39000), "late")]
    for name, rows, kind in (
        ("e", events, "source string, event_ts timestamp, event string"),
        ("f", frames, "source string, frame_ts timestamp, frame_path string"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    out = recorder.sample_stream(read("e"), read("f"))
    q = out.writeStream.format("memory").queryName("samples").option(
        "checkpointLocation", str(tmp_path / "c"),
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event: r for r in spark.table("samples").collect()}
    assert set(got) == {"a", "b"}  # nothing of another source; the last event waits for its watermark
    assert got["a"].pre_frame == "f010" and got["a"].post_frame == "f015"
    assert got["a"].pre_clip == ["f008", "f009", "f010"] and got["a"].post_clip == ["f011", "f012", "f013"]
    assert got["b"].pre_frame == "f020" and got["b"].pre_clip == ["f017", "f018", "f019", "f020"] and got["b"].post_clip == ["f020", "f021", "f022", "f023"]


def test_settings_and_weights(spark, tmp_path):
    s = taxonomy.Settings.from_yaml(
        "recorder: {capture_fps: 5, unknown: 1}\nexport: {normalizing_range: 100}\nrelabel: {max_samples: 3}\ngame_profile: x"
    )
    assert s.recorder.ring_frames == 25 and s.export.normalizing_range == 100 and s.relabel.max_samples == 3 and s.game_profile == "x"
    assert s.labeler.fusion_weights["diff"] == 0.35 and s.filter.dedup_hash_threshold == 8
    for bad in (
        "recorder: {capture_fps: 0}",
        "review: {server_port: 80}",
        "relabel: {max_samples: 0}",
        "labeler: {diff_threshold: 2}",
        "recorder: {ui_scale: 0}",
    ):
        with pytest.raises(ValueError):
            taxonomy.Settings.from_yaml(bad)
    assert packages.detector_weights(spark, str(tmp_path)) is None
    for run in ("a", "b"):
        (tmp_path / "yolo_runs" / run / "weights").mkdir(parents=True)
        (tmp_path / "yolo_runs" / run / "weights" / "best.pt").write_bytes(b"w")
    assert packages.detector_weights(spark, str(tmp_path)).endswith("yolo_runs/b/weights/best.pt")
    (tmp_path / "best_export").mkdir()
    (tmp_path / "best_export" / "model.pt").write_bytes(b"w")
    assert packages.detector_weights(spark, str(tmp_path)).endswith("best_export/model.pt")
    board = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "name string, score double")
    assert [
        r.line.split() for r in writers.leaderboard_table(board, "score", "name").orderBy("place").collect()
    ] == [["1", "b", "0.9000"], ["2", "a", "0.5000"]]
