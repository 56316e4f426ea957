"""Stateful streams with timers, sources with offsets, the sample sink."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe import flows
from loomframe.functions.geometry import contains  # noqa: F401  (the package must be importable by workers)
from loomframe.sources import commits, image_files, streams
from loomframe.streaming import recorder


def _lines(path, rows, mode="w"):
    with open(path, mode) as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def _raw(rng, n, start=0.0, sources=2):
    out, t = [], start
    for _ in range(n):
        t += rng.randrange(20, 500)
        kind = rng.choices(["press", "release", "move", "scroll", "key"], [30, 35, 20, 10, 5])[0]
        out.append({"source": f"s{rng.randrange(sources)}", "ts_ms": t, "kind": kind, "x": float(rng.randrange(15)), "y": 0.0, "button": rng.choice(["left", "right"]), "dx": 1.0, "dy": -1.0, "key": "a"})
    return out


def _steps(raw):
    state, out = {}, []
    for r in pd.DataFrame(raw).itertuples():
        held, event = recorder.step(state.get(r.source, (None,) * 8), r)
        state[r.source] = held
        if event and event[0] in recorder.RECORDABLE:
            out.append((r.source, r.ts_ms, event[0]))
    return sorted(out)


def test_gestures_go_on_after_a_restart(spark, tmp_path):
    """Two runs of the query over a log that grows, the second with a line cut in the middle: events of one long run."""
    rng = random.Random(8)
    raw = _raw(rng, 160)
    log = tmp_path / "in"
    log.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    _lines(log / "a.jsonl", raw[:70])
    with open(log / "a.jsonl", "a") as f:
        f.write(json.dumps(raw[70])[:25])  # still being written
    assert recorder.record_events(spark, str(log), out, cp).awaitTermination(120) is not False
    with open(log / "a.jsonl", "a") as f:
        f.write(json.dumps(raw[70])[25:] + "\nno json\n{}\n")
    _lines(log / "a.jsonl", raw[71:], "a")
    recorder.record_events(spark, str(log), out, cp).awaitTermination(120)
    recorder.record_events(spark, str(log), out, cp).awaitTermination(120)  # nothing new
    got = sorted((r.source, r.timestamp_ms, r.action) for r in spark.read.parquet(out).collect())
    assert got == _steps(raw) and len(got) > 40


def test_limits_of_the_log_reader(tmp_path):
    """Batches by bytes end at line ends, ranges read every line once, and a reader that starts again goes on."""
    rng = random.Random(3)
    rows = _raw(rng, 300)
    for name, part in (("a.jsonl", rows[:180]), ("b.jsonl", rows[180:])):
        _lines(tmp_path / name, part)
    options = {"path": str(tmp_path), "maxBytes": "5000", "progress": str(tmp_path / "p" / "done.json")}
    (tmp_path / "p").mkdir()
    offset, seen, batches = {}, [], 0
    while True:
        reader = streams.InputLogReader(options)  # a new one each time: nothing is kept but the progress
        end = {k: v for k, v in reader.latestOffset().items() if not k.endswith("done.json")}
        if end == offset:
            break
        took = sum(end.values()) - sum(offset.values())
        assert 0 < took <= 5000
        batches += 1
        for p in reader.partitions(offset, end):
            seen += [r[1] for r in reader.read(p)]
        reader.commit(end)
        offset = end
    assert seen == [r["ts_ms"] for r in rows] and batches > 5
    whole = streams.InputLogReader({"path": str(tmp_path / "a.jsonl").rsplit("/", 1)[0]})
    old, streams.SPLIT = streams.SPLIT, 37
    try:
        parts = whole.partitions({}, {str(tmp_path / "a.jsonl"): (tmp_path / "a.jsonl").stat().st_size})
        assert [r[1] for p in parts for r in whole.read(p)] == [r["ts_ms"] for r in rows[:180]] and len(parts) > 100
    finally:
        streams.SPLIT = old


def test_frames_by_offsets(tmp_path):
    for source, numbers in (("s0", range(0, 1200, 100)), ("s1", (50, 7))):
        (tmp_path / source).mkdir()
        for n in numbers:
            (tmp_path / source / f"frame_{n}.png").write_bytes(b"x")
    (tmp_path / "s0" / "notes.txt").write_text("x")
    reader = streams.FrameReader({"path": str(tmp_path), "maxFrames": "5", "progress": str(tmp_path / "done" / "p.json")})
    offset, seen = {}, []
    while (end := reader.latestOffset()) != offset:
        for p in reader.partitions(offset, end):
            seen += [(r[0], r[1]) for r in reader.read(p)]
        reader.commit(end)
        offset = end
    assert seen == [("s0", float(n)) for n in range(0, 1200, 100)] + [("s1", 7.0), ("s1", 50.0)]
    timed = streams.FrameReader({"path": str(tmp_path), "fps": "10", "startMs": "1000"})
    assert [r[1] for r in timed.read(streams.FrameList("s1", ["frame_7.png"]))] == [1700.0]


def test_idle_sources_leave_no_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        raw = spark.readStream.schema(recorder.RAW).json(str(src)).withColumn("ts", F.timestamp_millis(F.col("ts_ms").cast("long")))
        q = recorder.gesture_stream(raw, idle_ms=60_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return q.lastProgress.stateOperators[0].numRowsTotal

    press = {"kind": "press", "x": 1.0, "y": 1.0, "button": "left"}
    _lines(src / "1.json", [{"source": f"s{k}", "ts_ms": 1000.0 * k, **press} for k in range(1, 6)])
    first = run()
    _lines(src / "2.json", [{"source": "late", "ts_ms": 10_000_000.0, **press}])
    run()
    _lines(src / "3.json", [{"source": "late", "ts_ms": 10_000_400.0, "kind": "release", "x": 1.0, "y": 1.0, "button": "left"}])
    left = run()
    assert first >= 5 and left < first and left <= 4  # of one source: its state, its timer and that by time
    assert [(r.source, r.action) for r in spark.read.parquet(out).collect()] == [("late", "hold")]


class Handle:
    """State and timers of one key, as the engine gives them."""

    class Value:
        def __init__(self):
            self.rows = None

        def get(self):
            return self.rows if not isinstance(self.rows, list) else iter(self.rows)

        def exists(self):
            return self.rows is not None

        def update(self, row):
            self.rows = row

        def put(self, rows):
            assert rows
            self.rows = list(rows)

        def clear(self):
            self.rows = None

    class Items(Value):
        def get(self):
            return iter(self.rows or [])

    def __init__(self):
        self.timers, self.made = [], {}

    def getValueState(self, name, schema, ttl=None):
        return self.made.setdefault(name, self.Value())

    def getListState(self, name, schema, ttl=None):
        return self.made.setdefault(name, self.Items())

    def registerTimer(self, at):
        self.timers.append(at)


class Info:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_ring_against_all_frames():
    """Samples of the ring equal those of a look at every frame, and the ring stays as small as it says."""
    rng = random.Random(2)
    h = Handle()
    ring = recorder.Ring(frames=20, delay_ms=500.0, clip_ms=300.0, idle_ms=60_000)
    ring.init(h)
    frames = [float(t) for t in range(0, 60_000, 100) if rng.random() < 0.9]
    events = sorted(float(rng.randrange(500, 55_000)) for _ in range(60))
    got, now = [], 0.0
    while now < 62_000:
        end = now + rng.randrange(100, 3000)
        new = [(t, f"f{int(t)}", None) for t in frames if now <= t < end] + [(t, None, json.dumps({"t": t})) for t in events if now <= t < end]
        rng.shuffle(new)
        if new:
            list(ring.handleInputRows(("s",), [pd.DataFrame(new, columns=["ms", "frame_path", "event"])], None))
        now = end
        for at in sorted(t for t in h.timers if t <= now):
            h.timers.remove(at)
            for f in ring.handleExpiredTimer(("s",), None, Info(at)):
                got += list(f.itertuples(index=False, name=None))
        assert len(list(h.made["ring"].get())) <= 20 + 45 + 40
    want = []
    for t in sorted(set(events)):
        near = [x for x in frames if x <= t][-20:] + [x for x in frames if t < x <= t + 500]
        path = lambda x: f"f{int(x)}"
        pre = min(near, key=lambda x: (abs(x - t), x))
        post = max((x for x in near if x <= t + 500), default=None)
        want.append(("s", t, json.dumps({"t": t}), path(pre), path(post), [path(x) for x in near if t - 300 <= x <= t], [path(x) for x in near if t <= x <= t + 300]))
    assert sorted(got) == want
    for at in [60_000 + 200_000] * 3:
        list(ring.handleExpiredTimer(("s",), None, Info(at)))
    assert all(not s.exists() for s in h.made.values())


def test_recorder_writes_samples_once(spark, tmp_path):
    """Raw log and frames to session folders; replayed batches and restarts change nothing; numbers go on."""
    log, shots, out = tmp_path / "log", tmp_path / "frames", tmp_path / "out"
    (shots / "s0").mkdir(parents=True)
    log.mkdir()
    import numpy as np

    def frames(low, high):
        for t in range(low, high, 100):
            (shots / "s0" / f"{t}.png").write_bytes(image_files.png(np.full((4, 6, 3), t // 100 % 256, np.uint8)))

    def clicks(*times):
        return [{"source": "s0", "ts_ms": t + d, "kind": k, "x": 2.0, "y": 1.0, "button": "left"} for t in times for d, k in ((-50.0, "press"), (0.0, "release"))]

    def run():
        recorder.record_events(spark, str(log), str(tmp_path / "events"), str(tmp_path / "cp1")).awaitTermination(120)
        q = recorder.record(spark, str(tmp_path / "events"), str(shots), str(out), str(tmp_path / "cp2"), late="0 seconds")
        q.awaitTermination(120)
        assert q.exception() is None

    frames(0, 5000)
    _lines(log / "a.jsonl", clicks(1040.0, 2000.0))
    run()
    frames(5000, 9000)
    _lines(log / "a.jsonl", clicks(6020.0), "a")
    run()
    frames(9000, 12000)
    _lines(log / "b.jsonl", clicks(11000.0))
    run()
    found = sorted(p.name for p in (out / "s0" / "samples").iterdir())
    assert found[:3] == ["sample_000001", "sample_000002", "sample_000003"]
    one = out / "s0" / "samples" / "sample_000001"
    pre, post = (image_files.pixels((one / f"{n}.png").read_bytes())[0, 0, 0] for n in ("pre", "post"))
    assert (pre, post) == (10, 15) and sorted(p.name for p in (one / "clip").iterdir()) == [
        "post_000.png", "post_001.png", "post_002.png", "post_stable.png", "pre_000.png", "pre_001.png", "pre_002.png",
    ]
    event = json.loads((one / "event.json").read_text())
    assert (event["action"], event["timestamp_ms"]) == ("click", 1040.0) and flows.load(spark, str(out)).count() == len(found)
    held = {p: p.stat().st_mtime_ns for p in out.rglob("*.png")}
    samples = spark.createDataFrame([("s0", 1040.0, json.dumps(event), str(shots / "s0" / "1000.png"), None, [], [])], recorder.SAMPLES)
    sink = recorder.SampleSink(str(out), str(tmp_path / "cp2"))
    done = [e["batch"] for _, e in commits.read(spark, sink.log)]
    sink(samples, done[0])  # a batch that is played again
    assert {p: p.stat().st_mtime_ns for p in out.rglob("*.png")} == held and len(commits.read(spark, sink.log)) == len(done)
    for again in range(2):  # a batch that fails before its commit gets the same numbers once more
        image_files_before, recorder.commits.append = recorder.commits.append, (lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        try:
            with pytest.raises(OSError):
                recorder.SampleSink(str(out), "other")(samples, 0)
        finally:
            recorder.commits.append = image_files_before
    recorder.SampleSink(str(out), "other")(samples, 0)
    assert sorted(p.name for p in (out / "s0" / "samples").iterdir()) == [*found, f"sample_{len(found) + 1:06d}"]
