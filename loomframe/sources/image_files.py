"""Image files of exports: copies and crops, written where the executors reach, one file a row."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomframe.runtime import checkpoint

WRITTEN = "name string, path string, bytes long"


def png(pixels: np.ndarray) -> bytes:
    """A PNG of an array of height, width and 1, 3 or 4 channels (gray, RGB, RGBA)."""
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    lines = np.hstack([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, width * channels)])

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pixels(data: bytes) -> np.ndarray | None:
    """Height, width and 1, 3 or 4 channels of a PNG of 8 bits that isn't interlaced (palettes become RGB), else null."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, parts = 8, {}
    while at + 8 <= len(data):
        size, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        parts[name] = parts.get(name, b"") + data[at + 8 : at + 8 + size]
        at += 12 + size
    try:
        width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
        lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * channels)
    except (KeyError, ValueError, struct.error, zlib.error):
        return None
    if depth != 8 or interlaced:
        return None
    out = _unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, channels))
    if kind == 3:
        colours = np.zeros((256, 3), np.uint8)
        own = np.frombuffer(parts.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        colours[: len(own)] = own
        return colours[out[:, :, 0]]
    return out[:, :, :1] if kind == 4 else out


def _unfiltered(filters: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines of a PNG without the prediction that each says it has."""
    out = np.zeros_like(lines)
    above = np.zeros(lines.shape[1:], np.uint8)
    for k, (kind, line) in enumerate(zip(filters.tolist(), lines, strict=True)):
        if kind == 0:
            above = line
        elif kind == 1:
            above = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            above = line + above
        else:
            above = _looked_back(kind, line.astype(int).tolist(), above.astype(int).tolist())
        out[k] = above
    return out


def _looked_back(kind: int, line: list, above: list) -> np.ndarray:
    """A line whose pixels are predicted from the one before: by its mean with the one above (3), or by the nearest of
    left, above and above left to left + above - above left (4)."""
    channels = len(line[0])
    left, corner, out = [0] * channels, [0] * channels, []
    for own, up in zip(line, above, strict=True):
        if kind == 3:
            left = [(o + ((a + b) >> 1)) & 255 for o, a, b in zip(own, left, up, strict=True)]
        else:
            new = []
            for o, a, b, c in zip(own, left, up, corner, strict=True):
                da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                new.append((o + (a if da <= db and da <= dc else b if db <= dc else c)) & 255)
            left = new
        corner = up
        out.append(left)
    return np.array(out, np.uint8)


def _store(path: str, held: dict) -> tuple[fs.FileSystem, str]:
    """File system and path within it; held keeps the file systems of a task."""
    if "://" not in path:
        return held.setdefault("", fs.LocalFileSystem()), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    scheme, rest = path.split("://", 1)
    if scheme == "file":
        return held.setdefault("", fs.LocalFileSystem()), "/" + rest.lstrip("/")
    base = f"{scheme}://{rest.split('/', 1)[0]}"
    if base not in held:
        held[base] = fs.FileSystem.from_uri(path)[0]
    return held[base], fs.FileSystem.from_uri(path)[1]


def _read(path: str | None, held: dict) -> bytes | None:
    if path is None:
        return None
    store, own = _store(path, held)
    try:
        with store.open_input_stream(own) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _write(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Whole or not at all: under a name of its own first, and then moved."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.part") as f:
        f.write(content)
    store.move(f"{path}.part", path)


def fetched(rows: DataFrame, path_col: str, name: str = "content") -> DataFrame:
    """rows with the bytes of the file that path_col names, null where there is none. Only the files named are read, by
    the tasks that hold their rows, and nothing is shuffled. Stores are those that Arrow's file systems open."""
    schema = StructType([*rows.schema.fields, StructField(name, BinaryType())])

    def run(batches):
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: a batch of images would be large
                one = batch.slice(k, 1)
                data = _read(one.column(path_col)[0].as_py(), held)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary())], names=[*one.schema.names, name])

    return rows.mapInArrow(run, schema)


def write_copies(rows: DataFrame, folder: str) -> DataFrame:
    """Copy the files of rows (name, image_path) to folder/name; returns name, path, bytes of those that are there."""

    def run(batches):
        held: dict = {}
        target, base = _store(folder, held)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = _read(r["image_path"], held)
                if data is not None:
                    _write(target, f"{base}/{r['name']}", data)
                    out.append((r["name"], f"{base}/{r['name']}", len(data)))
            yield _written(out)

    return rows.select("name", "image_path").mapInArrow(run, WRITTEN)


def write_crops(rows: DataFrame, folder: str) -> DataFrame:
    """Write the crop (struct x1, y1, x2, y2 in pixels) of each row's image_path as PNG to folder/name; returns name,
    path, bytes of those whose image is there. A task reads, crops and writes, so no pixels are shuffled.

    Images that aren't plain PNG files are decoded by Spark's image source, which needs a pass over their folders.
    """

    def run(batches):
        held: dict = {}
        target, base = _store(folder, held)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = _read(r["image_path"], held)
                image = None if data is None else pixels(data)
                if image is not None:
                    box = r["crop"]
                    own = png(image[box["y1"] : box["y2"], box["x1"] : box["x2"]])
                    _write(target, f"{base}/{r['name']}", own)
                    out.append((r["name"], f"{base}/{r['name']}", len(own)))
                elif data is not None:
                    out.append((r["name"], None, len(data)))
            yield _written(out)

    done = checkpoint(rows.select("name", "image_path", "crop").mapInArrow(run, WRITTEN))
    other = rows.join(done.where("path IS NULL").select("name"), "name", "left_semi")
    folders = [r[0] for r in other.select(F.regexp_replace("image_path", "/[^/]+$", "").alias("f")).distinct().limit(1001).collect()]
    if not folders:
        return done
    # a decoder for other kinds runs in Spark only: one scan of their folders, or of what they have in common
    root = folders if len(folders) <= 1000 else [_shared(rows)]
    images = rows.sparkSession.read.format("image").options(recursiveFileLookup=True, dropInvalid=True).load(root)
    return done.where("path IS NOT NULL").unionByName(write_files(crops(images, other), folder))


def _shared(rows: DataFrame) -> str:
    """The deepest folder that holds all images, found from the smallest and largest path."""
    low, high = rows.agg(F.min("image_path"), F.max("image_path")).first()
    same = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    return low[: low.rfind("/", 0, max(same, 1)) + 1] or "/"


def _written(out: list[tuple]) -> pa.RecordBatch:
    names, paths, sizes = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["name", "path", "bytes"])


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """name, content (PNG) of the crop of each box. images: image-source rows; boxes: name, image_path, crop (x1, y1,
    x2, y2 in pixels). Boxes of images that aren't there have no row."""

    def run(batches):
        for batch in batches:
            names, data = [], []
            for r in batch.to_pylist():
                own = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                if r["nChannels"] >= 3:
                    own = np.concatenate([own[:, :, 2::-1], own[:, :, 3:]], axis=2)  # the source has blue first
                names.append(r["name"])
                data.append(png(own[r["y1"] : r["y2"], r["x1"] : r["x2"]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["name", "content"])

    found = images.select(
        F.col("image.origin").alias("__path"), *(F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")),
    )
    both = boxes.select(
        "name", _plain(F.col("image_path")).alias("__at"), "crop.*",
    ).join(found.withColumn("__at", _plain(F.col("__path"))), "__at")
    return both.select(
        "name", "x1", "y1", "x2", "y2", "height", "width", "nChannels", "data",
    ).mapInArrow(run, "name string, content binary")


def _plain(path):
    """A path without the spelling of its local scheme."""
    return F.regexp_replace(path, "^file:/*", "/")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write each row's content (binary) to folder/name; returns name, path, bytes of what was written.

    folder is a path or URI that every executor reaches (a local folder only in local mode). A file is written under a
    name of its own first and then moved, so a task that runs again replaces whole files by equal ones.
    """

    def run(batches):
        store, base = _store(folder, {})
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                path = f"{base}/{r['name']}"
                _write(store, path, r["content"])
                out.append((r["name"], path, len(r["content"])))
            yield _written(out)

    return rows.select("name", "content").mapInArrow(run, WRITTEN)
