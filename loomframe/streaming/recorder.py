"""The recorder as streams over raw input rows and frames.

raw rows: source, ts_ms (double), ts (timestamp), kind (press, release, move, scroll, key), x, y, button, dx, dy, key.
State lives in the stream's checkpoint and goes when its source has been idle, by timers in event time; late rows are
bounded by watermarks. Load shedding of a full queue is left to the sources' limits (maxBytes, maxFrames), so no event is
dropped on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loomframe.functions.text import padded
from loomframe.sources import commits, image_files, streams
from loomframe.sources.taxonomy import RecorderSettings

RAW = "source string, ts_ms double, ts timestamp, kind string, x double, y double, button string, dx double, dy double, key string"
EVENTS = "source string, timestamp_ms double, action string, x double, y double, end_x double, end_y double, button string, duration_ms double, key string, text string"
#: press (x, y, time, button), last click-like event (x, y, time), last hover let through.
STATE = "px double, py double, pt double, pb string, cx double, cy double, ct double, hover double"
RECORDABLE = ("click", "right_click", "double_click", "hold", "press", "drag", "type", "scroll")
DRAG_PX, HOLD_MS, DOUBLE_MS, DOUBLE_PX, HOVER_MS = 10.0, 400.0, 300.0, 12.0, 250.0


def step(state: tuple, row) -> tuple[tuple, tuple | None]:
    """The state machine for one raw row: (state after, event or null). Times are in order within a source."""
    px, py, pt, pb, cx, cy, ct, hover = state
    event = None
    if row.kind == "press":
        px, py, pt, pb = row.x, row.y, row.ts_ms, row.button
    elif row.kind == "release" and pt is not None:
        moved, held = ((row.x - px) ** 2 + (row.y - py) ** 2) ** 0.5, row.ts_ms - pt
        if moved > DRAG_PX:
            event = ("drag", px, py, row.x, row.y, pb, held, None, None)
        elif pb == "right":
            event = ("right_click", row.x, row.y, None, None, pb, held, None, None)
        elif held >= HOLD_MS:
            event = ("hold", row.x, row.y, None, None, pb, held, None, None)
        else:
            double = ct is not None and row.ts_ms - ct <= DOUBLE_MS and ((row.x - cx) ** 2 + (row.y - cy) ** 2) ** 0.5 <= DOUBLE_PX
            event = ("double_click" if double else "click", row.x, row.y, None, None, pb, held, None, None)
            cx, cy, ct = row.x, row.y, row.ts_ms
        px = py = pt = pb = None
    elif row.kind == "move" and (hover is None or row.ts_ms - hover >= HOVER_MS):
        hover = row.ts_ms
        event = ("hover", row.x, row.y, None, None, None, None, None, None)
    elif row.kind == "scroll":
        event = ("scroll", row.x, row.y, None, None, None, None, None, f"dx={row.dx:g},dy={row.dy:g}")
    elif row.kind == "key":
        single = isinstance(row.key, str) and len(row.key) == 1
        event = ("type" if single else "press", None, None, None, None, None, None, row.key, row.key if single else None)
    return (px, py, pt, pb, cx, cy, ct, hover), event


#: Event time without a row after which a source's state goes, and how late rows may be.
IDLE_MS, LATE = 600_000, "10 seconds"
_STORES = "spark.sql.streaming.stateStore.providerClass"


def with_timers(spark: SparkSession) -> None:
    """State with lists and timers needs the state store on RocksDB; set for this session where another one is."""
    if "RocksDB" not in spark.conf.get(_STORES, ""):
        spark.conf.set(_STORES, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Idle(StatefulProcessor):
    """State that goes when no row of its key has come for idle_ms of event time. The time of the last row is state, too;
    a timer that finds a later one waits for that."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms long")
        self.states = self.own(handle)

    def saw(self, ms: float) -> None:
        last = self.seen.get()[0] if self.seen.exists() else None
        if last is None:
            self.handle.registerTimer(int(ms) + self.idle_ms)
        if last is None or ms > last:
            self.seen.update((int(ms),))

    def idle(self, info) -> bool:
        """Whether the state is gone; else the timer is set again."""
        due = (self.seen.get()[0] if self.seen.exists() else 0) + self.idle_ms
        if info.getExpiryTimeInMs() < due:
            self.handle.registerTimer(due)
            return False
        for state in (self.seen, *self.states):
            state.clear()
        return True

    def close(self) -> None:
        pass


class Gestures(_Idle):
    """The state machine of a source; an open press, the last click and the last hover are its state."""

    def own(self, handle):
        self.held = handle.getValueState("held", STATE)
        return (self.held,)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(None if v != v else v for v in self.held.get()) if self.held.exists() else (None,) * 8
        frame = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        frame = frame.astype(object).where(frame.notna(), None)
        out = []
        for row in frame.itertuples():
            held, event = step(held, row)
            if event:
                out.append((key[0], row.ts_ms, *event))
        self.held.update(held)
        self.saw(float(frame["ts_ms"].iloc[-1]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.idle(expiredTimerInfo)
        return iter(())


def gesture_stream(raw: DataFrame, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """Events of a stream of raw rows, keyed by source; state is one small row a source and goes when it is idle.

    ts_ms must be the time of ts; rows that have no source or time go.
    """
    with_timers(raw.sparkSession)
    timed = raw.where("ts IS NOT NULL AND ts_ms IS NOT NULL AND source IS NOT NULL").withWatermark("ts", late)
    return timed.groupBy("source").transformWithStateInPandas(Gestures(idle_ms), EVENTS, "append", "eventTime")


SAMPLES = "source string, event_ms double, event string, pre_frame string, post_frame string, pre_clip array<string>, post_clip array<string>"


class Ring(_Idle):
    """Frames of a source in a ring, and its events that wait for the frames after them.

    An event waits until event time has passed it by the longer of delay and clip; then it becomes a sample of the frames
    that the ring holds. The ring keeps the newest `frames` of them, and those that a waiting event needs.
    """

    def __init__(self, frames: int, delay_ms: float, clip_ms: float, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.frames, self.delay, self.clip = frames, delay_ms, clip_ms

    def own(self, handle):
        self.ring = handle.getListState("ring", "ms double, path string")
        self.waiting = handle.getListState("waiting", "ms double, event string")
        return self.ring, self.waiting

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, events, last = [], [], None
        for f in rows:
            for ms, path, event in zip(f["ms"], f["frame_path"], f["event"], strict=True):
                last = ms if last is None else max(last, ms)
                if event is None or event != event:
                    new.append((float(ms), path))
                else:
                    events.append((float(ms), event))
        waiting = [tuple(w) for w in self.waiting.get()]
        if new:
            ring = sorted({*(tuple(r) for r in self.ring.get()), *new})
            oldest = min((w[0] for w in [*waiting, *events]), default=None)
            cut = max(0, len(ring) - self.frames)
            if oldest is not None:  # the frames before a waiting event that its ring held
                before = sum(r[0] <= oldest for r in ring)
                cut = min(cut, max(0, before - self.frames))
            self.ring.put(ring[cut:])
        for ms, _ in events:
            self.handle.registerTimer(int(ms + max(self.delay, self.clip)) + 1)
        if events:
            self.waiting.put([*waiting, *events])
        self.saw(float(last))
        yield pd.DataFrame([], columns=[c.split()[0] for c in SAMPLES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ring, waiting = [tuple(r) for r in self.ring.get()], [tuple(w) for w in self.waiting.get()]
        due = sorted({w for w in waiting if int(w[0] + max(self.delay, self.clip)) + 1 <= now})
        out = [s for s in (self.sample(ring, *w) for w in due) if s]
        if due:
            rest = [w for w in waiting if w not in due]
            self.waiting.put(rest) if rest else self.waiting.clear()
        elif self.seen.exists() and now >= self.seen.get()[0] + self.idle_ms or not waiting:
            self.idle(expiredTimerInfo)
        yield pd.DataFrame([(key[0], *s) for s in out], columns=[c.split()[0] for c in SAMPLES.split(", ")])

    def sample(self, ring: list, ms: float, event: str) -> tuple | None:
        """The event with its frames; null where the ring holds none up to the end of its wait."""
        known = [r for r in ring if r[0] <= ms + max(self.delay, self.clip)]
        at_event = [r for r in known if r[0] <= ms][-self.frames :] + [r for r in known if r[0] > ms]
        if not at_event:
            return None
        pre = min(at_event, key=lambda r: (abs(r[0] - ms), r[0]))[1]
        post = max((r for r in at_event if r[0] <= ms + self.delay), default=(None, None))[1]
        within = lambda low, high: [p for t, p in at_event if low <= t <= high]
        return ms, event, pre, post, within(ms - self.clip, ms), within(ms, ms + self.clip)


def ring_samples(
    events: DataFrame, frames: DataFrame, ring_frames: int = 50, delay_ms: float = 500.0, clip_ms: float = 300.0, idle_ms: int = IDLE_MS, late: str = LATE,
) -> DataFrame:
    """A sample (SAMPLES) for each event of a stream, from a ring of its source's frames.

    events: source, event_ms, event_ts, event (JSON); frames: source, frame_ms, frame_ts, frame_path. Both lists of state
    are bounded: the ring by its size and by what waits, what waits by the delay.
    """
    with_timers(events.sparkSession)
    one = events.select("source", F.col("event_ts").alias("ts"), F.col("event_ms").alias("ms"), F.lit(None).cast("string").alias("frame_path"), "event")
    two = frames.select("source", F.col("frame_ts").alias("ts"), F.col("frame_ms").alias("ms"), "frame_path", F.lit(None).cast("string").alias("event"))
    both = one.unionByName(two).where("ts IS NOT NULL AND source IS NOT NULL").withWatermark("ts", late)
    return both.groupBy("source").transformWithStateInPandas(Ring(ring_frames, delay_ms, clip_ms, idle_ms), SAMPLES, "append", "eventTime")


class SampleSink:
    """Writes batches of samples as session folders: folder/<source>/samples/sample_NNNNNN with event.json,
    metadata.json, pre.png, post.png and clip.

    Numbers go on from the last of their source. A batch is committed to a log (folder/_recorded) with the numbers it
    reached; one that is played again finds its commit and changes nothing, and one that failed before it gets the same
    numbers, since samples of a batch are numbered in order of time, and replaces its files.
    """

    #: Every so many commits hold the numbers of all sources, so that no more entries than these are read.
    FULL = 50

    def __init__(self, folder: str, query: str) -> None:
        self.folder, self.log, self.query = folder.rstrip("/"), f"{folder.rstrip('/')}/_recorded", query

    def numbers(self, spark: SparkSession, batch: int) -> tuple[dict[str, int], bool, int]:
        """(last number of each source, whether the batch is committed, commits so far)."""
        every = commits.numbers(spark, self.log)
        last: dict[str, int] = {}
        done = False
        for n in reversed(every):
            entry = commits.entry(spark, self.log, n)
            done |= entry["query"] == self.query and entry["batch"] == batch
            last = entry["last"] | last
            if entry["full"]:
                break
        return last, done, len(every)

    def __call__(self, samples: DataFrame, batch: int) -> None:
        spark = samples.sparkSession
        last, done, many = self.numbers(spark, batch)
        if done:
            return
        rows = samples.persist()
        try:
            before = spark.createDataFrame(list(last.items()), "source string, last int")
            place = F.row_number().over(Window.partitionBy("source").orderBy("event_ms", "event"))
            numbered = rows.withColumn("k", place).join(before, "source", "left")
            numbered = numbered.withColumn("n", F.col("k") + F.coalesce("last", F.lit(0)))
            at = F.concat("source", F.lit("/samples/sample_"), padded(F.col("n")))
            named = numbered.select("*", at.alias("at"))
            image_files.write_copies(self.images(named), self.folder).count()
            image_files.write_files(self.documents(named), self.folder).count()
            reached = {r["source"]: r["n"] for r in numbered.groupBy("source").agg(F.max("n").alias("n")).collect()}  # sources of a batch
        finally:
            rows.unpersist()
        full = many % self.FULL == 0
        commits.append(spark, self.log, {"query": self.query, "batch": batch, "full": full, "last": last | reached if full else reached})

    @staticmethod
    def images(named: DataFrame) -> DataFrame:
        """name, image_path of all image files."""
        clip = lambda part: F.transform(f"{part}_clip", lambda p, i: F.struct(F.format_string(f"clip/{part}_%03d.png", i).alias("f"), p.alias("p")))
        stable = F.when(F.size("post_clip") > 0, F.array(F.struct(F.lit("clip/post_stable.png").alias("f"), F.element_at("post_clip", -1).alias("p"))))
        single = [F.struct(F.lit(f"{k}.png").alias("f"), F.col(f"{k}_frame").alias("p")) for k in ("pre", "post")]
        every = F.concat(F.array(*single), clip("pre"), clip("post"), F.coalesce(stable, F.array().cast("array<struct<f:string,p:string>>")))
        rows = named.select("at", F.explode(every).alias("e")).where("e.p IS NOT NULL")
        return rows.select(F.concat_ws("/", "at", "e.f").alias("name"), F.col("e.p").alias("image_path"))

    @staticmethod
    def documents(named: DataFrame) -> DataFrame:
        """name, content of event.json and metadata.json."""
        names = lambda part: F.transform(f"{part}_clip", lambda p, i: F.format_string(f"clip/{part}_%03d.png", i))
        clip = F.struct(
            names("pre").alias("pre_frames"), names("post").alias("post_frames"), F.when(F.size("post_clip") > 0, "clip/post_stable.png").alias("post_stable"),
        )
        frames = F.struct(F.col("pre_frame").alias("pre"), F.col("post_frame").alias("post"))
        metadata = F.to_json(F.struct(clip.alias("clip"), frames.alias("frames")))
        files = F.array(F.struct(F.lit("metadata.json").alias("f"), metadata.alias("c")), F.struct(F.lit("event.json").alias("f"), F.col("event").alias("c")))
        rows = named.select("at", F.explode(files).alias("e"))
        return rows.select(F.concat_ws("/", "at", "e.f").alias("name"), F.col("e.c").cast("binary").alias("content"))


def recordable(events: DataFrame, hover: bool = False) -> DataFrame:
    return events.where(F.col("action").isin(*RECORDABLE, *(["hover"] if hover else [])))


def clip_stream(
    events: DataFrame, frames: DataFrame, before: str = "300 milliseconds", after: str = "300 milliseconds", late: str = "10 seconds",
) -> DataFrame:
    """Frames within the clip of each event of the same source, ends included: a stream-stream interval join.

    events: source, event_ts; frames: source, frame_ts, frame_path.
    """
    e = events.withWatermark("event_ts", late).alias("e")
    f = frames.withWatermark("frame_ts", late).alias("f")
    return e.join(f, F.expr(f"e.source = f.source AND f.frame_ts BETWEEN e.event_ts - INTERVAL {before} AND e.event_ts + INTERVAL {after}")).select(
        "e.*", "f.frame_ts", "f.frame_path", F.when(F.col("f.frame_ts") <= F.col("e.event_ts"), "pre").otherwise("post").alias("clip"),
    )


def sample_stream(
    events: DataFrame,
    frames: DataFrame,
    ring: str = "5 seconds",
    delay: str = "500 milliseconds",
    clip: str = "300 milliseconds",
    late: str = "10 seconds",
) -> DataFrame:
    """A sample for each event of the same source, once the watermark has passed its clips: source, event_ts, event,
    pre_frame (nearest in time, ties to the earlier), post_frame (the latest at event_ts + delay), pre_clip and
    post_clip (frames in order of time), from the ring of frames before and after the event.

    events: source, event_ts, event (JSON); frames: source, frame_ts, frame_path. Events without a frame in the ring
    have no sample. It is a stream-stream interval join and an aggregation, both bounded by watermarks; events of a
    source at the same time with the same content are one.
    """
    e = events.withWatermark("event_ts", late).alias("e")
    f = frames.withWatermark("frame_ts", late).alias("f")
    reach = f"greatest(INTERVAL {delay}, INTERVAL {clip})"
    near = e.join(f, F.expr(f"e.source = f.source AND f.frame_ts BETWEEN e.event_ts - INTERVAL {ring} AND e.event_ts + {reach}"))
    seen = F.timestamp_micros(F.unix_micros("f.frame_ts")).alias("frame_ts")  # plain time: the aggregation goes by event_ts alone
    rows = near.select("e.source", "e.event_ts", "e.event", seen, "f.frame_path")
    at, t, path = F.col("frame_ts"), F.col("event_ts"), F.col("frame_path")
    gap = F.abs(F.unix_micros(at) - F.unix_micros(t))
    frame = F.struct(at.alias("frame_ts"), path.alias("frame_path"))
    paths = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, frame))), lambda x: x["frame_path"])
    return rows.groupBy("source", "event_ts", "event").agg(
        F.min_by("frame_path", F.struct(gap, at)).alias("pre_frame"),
        F.max_by("frame_path", F.when(at <= t + F.expr(f"INTERVAL {delay}"), at)).alias("post_frame"),
        paths((at >= t - F.expr(f"INTERVAL {clip}")) & (at <= t)).alias("pre_clip"),
        paths((at >= t) & (at <= t + F.expr(f"INTERVAL {clip}"))).alias("post_clip"),
    )


def windowed_counts(events: DataFrame, ts: str, key: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: counts in tumbling or sliding windows under a watermark."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window, key).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Extension: counts in sessions of a key."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


MONITOR = "source string, frame_no long, mean_confidence double, is_drifted boolean, latched boolean, window_mean double"


class Monitor(StatefulProcessor):
    """Latch and the last 100 values of a source; both go by themselves when nothing has come for `idle_ms`."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.latched = handle.getValueState("latched", "latched boolean", self.idle_ms)
        self.history = handle.getListState("history", "value double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latched = bool(self.latched.get()[0]) if self.latched.exists() else False
        history = [r[0] for r in self.history.get()]
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_no", kind="stable").itertuples():
            latched = latched or bool(r.is_drifted)
            history = [*history, float(r.mean_confidence)][-100:]
            out.append((key[0], r.frame_no, float(r.mean_confidence), bool(r.is_drifted), latched, sum(history) / len(history)))
        self.latched.update((latched,))
        self.history.put([(v,) for v in history])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MONITOR.split(", ")])

    def close(self) -> None:
        pass


def monitor_stream(frames: DataFrame, idle_ms: int = 24 * 3_600_000) -> DataFrame:
    """Latch and last-100 history of each source over source, frame_no, mean_confidence, is_drifted."""
    with_timers(frames.sparkSession)
    return frames.groupBy("source").transformWithStateInPandas(Monitor(idle_ms), MONITOR, "append", "processingTime")


def record_events(spark: SparkSession, raw_folder: str, out_folder: str, checkpoint: str, hover: bool = False, max_bytes: int = 0):
    """Start a stream of recordable events from raw input logs to Parquet; returns the StreamingQuery."""
    streams.register(spark)
    raw = spark.readStream.format("input_log").option("maxBytes", max_bytes).option("progress", f"{checkpoint}/input_log.json").load(raw_folder)
    out = recordable(gesture_stream(raw), hover)
    return out.writeStream.format("parquet").option("path", out_folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record(
    spark: SparkSession,
    event_folder: str,
    frame_folder: str,
    out_folder: str,
    checkpoint: str,
    settings: RecorderSettings | None = None,
    fps: float | None = None,
    idle_ms: int = IDLE_MS,
    late: str = LATE,
):
    """Start the recorder: events (Parquet of record_events, which may be running) and frames become samples below
    out_folder, as flows read them; returns the StreamingQuery.

    fps: frames are numbered by it from time 0; without, the number in a frame's name is its time in ms.
    """
    limits = settings or RecorderSettings()
    streams.register(spark)
    events = recordable(spark.readStream.schema(EVENTS).parquet(event_folder), limits.enable_hover)
    body = F.to_json(F.struct(*(c.split()[0] for c in EVENTS.split(", ") if not c.startswith("source "))))
    timed = events.select("source", F.col("timestamp_ms").alias("event_ms"), F.timestamp_millis(F.col("timestamp_ms").cast("long")).alias("event_ts"), body.alias("event"))
    frames = spark.readStream.format("frame_folder").option("progress", f"{checkpoint}/frames.json").option("fps", fps or 0).load(frame_folder)
    samples = ring_samples(timed, frames, limits.ring_frames, float(limits.post_action_delay_ms), idle_ms=idle_ms, late=late)
    sink = SampleSink(out_folder, checkpoint)
    return samples.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def select_monitor(monitors: DataFrame, wanted: int) -> DataFrame:
    """The wanted screen, else the first real one (1), else the whole desktop (0). monitors: index, left, top, width, height."""
    rank = F.when(F.col("index") == wanted, 0).when(F.col("index") == 1, 1).when(F.col("index") == 0, 2).otherwise(3)
    return monitors.orderBy(rank, "index").limit(1)
