"""Streaming sources with offsets of their own: raw input logs that still grow, and folders of frames.

register(spark) makes them known to spark.readStream.format(...). Both list their folder on the driver and read it in
partitions on the executors, in any store that Arrow's file systems open. What a batch may take is limited by an option;
the place up to which batches are done is kept beside the query's checkpoint (option progress), so that a query that
starts again goes on with a limited batch, too. Without progress, the first batch of a run takes all there is.
"""

from __future__ import annotations

import io
import json
import re
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LOG = "source string, ts_ms double, ts timestamp, kind string, x double, y double, button string, dx double, dy double, key string"
FRAMES = "source string, frame_ms double, frame_ts timestamp, frame_path string"
IMAGE = re.compile(r"\.(png|jpg|jpeg|webp)$", re.IGNORECASE)
#: Bytes of a log that one partition reads.
SPLIT = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    store, base = _open(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)


def _time(ms: float) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class _Progress:
    """Where a query's batches are done: a small file, replaced as a whole."""

    def __init__(self, path: str | None) -> None:
        self.path = path

    def load(self) -> dict | None:
        if not self.path:
            return None
        store, own = _open(self.path)
        try:
            with store.open_input_stream(own) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def keep(self, offset: dict) -> None:
        if self.path:
            store, own = _open(self.path)
            store.create_dir(own.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{own}.part") as f:
                f.write(json.dumps(offset).encode())
            store.move(f"{own}.part", own)


class _Limited(DataSourceStreamReader):
    """Offsets that go on from the last batch by what the limit allows."""

    def __init__(self, options: dict, limit: str) -> None:
        self.path = options["path"]
        self.limit = int(options.get(limit) or 0)
        self.progress = _Progress(options.get("progress"))
        self.done = self.progress.load()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.done is None and self.progress.path:
            self.done = {}  # the query's first run
        found = self.reach(self.done or {}, self.limit if self.done is not None else 0)
        return found

    def commit(self, end: dict) -> None:
        self.done = end
        self.progress.keep(end)

    def partitions(self, start: dict, end: dict):
        self.done = end
        return self.between(start, end)


class LogRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, whole: int) -> None:
        self.path, self.start, self.end, self.whole = path, start, end, whole


class InputLogReader(_Limited):
    """Offsets: bytes done of each file, always at the end of a line, so a line that is still being written waits."""

    def __init__(self, options: dict) -> None:
        super().__init__(options, "maxBytes")

    def reach(self, done: dict, limit: int) -> dict:
        out, left = dict(done), limit
        store, _ = _open(self.path)
        for f in _files(self.path):
            at = int(done.get(f.path, 0))
            if f.size <= at or (limit and left <= 0):
                continue
            wanted = min(f.size, at + left) if limit else f.size
            end = self._line_end(store, f.path, at, wanted, f.size if left == limit else wanted)
            if end > at:
                out[f.path] = end
                left -= end - at
        return out

    @staticmethod
    def _line_end(store, path: str, start: int, wanted: int, size: int) -> int:
        """The end of the last whole line up to `wanted`, else of the first one up to size; start if there is none."""
        with store.open_input_file(path) as f:
            high = wanted
            while high > start:
                low = max(start, high - (1 << 16))
                f.seek(low)
                found = f.read(high - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                high = low
            at = wanted
            while at < size:
                f.seek(at)
                found = (part := f.read(1 << 16)).find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += len(part)
        return start

    def between(self, start: dict, end: dict):
        out = []
        for path, last in sorted(end.items()):
            first = int(start.get(path, 0))
            out += [LogRange(path, s, min(s + SPLIT, last), first) for s in range(first, last, SPLIT)]
        return out or [LogRange("", 0, 0, 0)]

    def read(self, partition: LogRange):
        if partition.start == partition.end:
            return
        store, _ = _open(self.path)
        with io.BufferedReader(store.open_input_file(partition.path), 1 << 20) as f:
            # a line belongs to the range in which it begins
            at = partition.start
            if at > partition.whole:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                at += len(line)
                row = _raw_row(line)
                if row:
                    yield row


def _raw_row(line: bytes) -> tuple | None:
    """A row of LOG; a line that isn't a JSON object with a time gives none."""
    try:
        row = json.loads(line)
        ms = float(row["ts_ms"])
        number = lambda k: None if row.get(k) is None else float(row[k])
        text = lambda k: None if row.get(k) is None else str(row[k])
        return (text("source"), ms, _time(ms), text("kind"), number("x"), number("y"), text("button"), number("dx"), number("dy"), text("key"))
    except (ValueError, KeyError, TypeError, OverflowError, OSError):
        return None


class InputLog(DataSource):
    """Raw input rows of JSON lines below path, files that grow included. Options: path, maxBytes, progress."""

    @classmethod
    def name(cls) -> str:
        return "input_log"

    def schema(self) -> str:
        return LOG

    def streamReader(self, schema):
        return InputLogReader(self.options)


class FrameList(InputPartition):
    def __init__(self, source: str, names: list[str]) -> None:
        self.source, self.names = source, names


class FrameReader(_Limited):
    """Offsets: the last frame done of each source; frames come in order of the number in their name."""

    def __init__(self, options: dict) -> None:
        super().__init__(options, "maxFrames")
        self.fps, self.start = float(options.get("fps") or 0), float(options.get("startMs") or 0)

    @staticmethod
    def number(name: str) -> int:
        found = re.search(r"\d+", name.rsplit(".", 1)[0])
        return int(found.group()) if found else 0

    def _listed(self) -> dict[str, list[str]]:
        _, base = _open(self.path)
        out: dict[str, list[str]] = {}
        for f in _files(self.path):
            source, _, name = f.path.removeprefix(base).lstrip("/").rpartition("/")
            if IMAGE.search(name):
                out.setdefault(source, []).append(name)
        return {s: sorted(names, key=lambda n: (self.number(n), n)) for s, names in out.items()}

    def _after(self, names: list[str], last: str | None) -> list[str]:
        return names if last is None else [n for n in names if (self.number(n), n) > (self.number(last), last)]

    def reach(self, done: dict, limit: int) -> dict:
        out, left = dict(done), limit
        for source, names in sorted(self._listed().items()):
            rest = self._after(names, done.get(source))
            rest = rest[: max(left, 0)] if limit else rest
            if rest:
                out[source] = rest[-1]
                left -= len(rest)
        return out

    def between(self, start: dict, end: dict):
        listed = self._listed()
        out = []
        for source, last in sorted(end.items()):
            names = [n for n in self._after(listed.get(source, []), start.get(source)) if (self.number(n), n) <= (self.number(last), last)]
            out += [FrameList(source, names[k : k + 5000]) for k in range(0, len(names), 5000)]
        return out or [FrameList("", [])]

    def read(self, partition: FrameList):
        for name in partition.names:
            n = self.number(name)
            ms = self.start + n * 1000 / self.fps if self.fps else float(n)
            yield partition.source, ms, _time(ms), f"{self.path.rstrip('/')}/{partition.source + '/' if partition.source else ''}{name}"


class FrameFolder(DataSource):
    """Frames below path/<source>/, their time in ms by the number in their name: itself, or with fps a count from startMs.
    Options: path, fps, startMs, maxFrames, progress. A frame that arrives after one of a later number is left out."""

    @classmethod
    def name(cls) -> str:
        return "frame_folder"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema):
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    for kind in (InputLog, FrameFolder):
        spark.dataSource.register(kind)
