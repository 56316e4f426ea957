"""Grace hash deduplication of whole texts.

1. Each scan task collapses equal texts in a table of bounded size and writes one row per distinct text with the ids of
   its copies (map-side combine: a text that makes up a third of the corpus leaves a task as few rows).
2. Those rows are dealt out by SHA-256. A task keeps distinct contents in an open-addressing table and compares
   complete contents. Once the table holds its budget, contents that it doesn't have go to spill files chosen by the
   next digits of the digest; each file is then treated the same way. Every level keeps at least one content, so any
   bucket ends, even one where digests agree. Which group a row is in is written out at once, so the table's memory
   doesn't grow with the copies.
3. Groups go back to the rows' ids by joins on the collapsed row, so no task ever gathers the ids of a large group.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, scratch, ship, texts

SPACES = re.compile("[ \t-\r]+")
_ODD = re.compile("[\t-\r]|  ")
LOCAL = pa.schema([("ids", pa.list_(pa.int64())), ("first", pa.int64()), ("n", pa.int64()), ("sha", pa.binary()), ("content", pa.binary())])
#: Members (rid and gid) and groups (gid and the rest) in one table.
GROUPS = pa.schema(
    [("rid", pa.int64()), ("gid", pa.int64()), ("keep_rid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)
#: Bytes of texts that a scan task holds for collapsing, and most ids of one of its rows.
HELD, MOST_IDS = 24 << 20, 10_000


def normalise(text: str) -> str:
    """Each run of ASCII white space becomes one space."""
    return SPACES.sub(" ", text) if _ODD.search(text) else text


def _row(ids: list, text: str) -> tuple:
    ids.sort(key=lambda i: (i is None, i))
    data = text.encode("utf-8", "surrogatepass")
    return ids, ids[0], len(ids), hashlib.sha256(data).digest(), data


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapses texts over the whole partition. Texts beyond the table's budget pass one by one."""
    table: dict[str, list] = {}
    held, out, size = 0, [], 0
    for batch in it:
        for i, text in zip(batch.column(0).to_pylist(), texts(batch, batch.schema.names[1]), strict=True):
            text = normalise(text)
            ids = table.get(text)
            if ids is not None:
                ids.append(i)
                if len(ids) >= MOST_IDS:
                    out.append(_row(table.pop(text), text))
                    held -= len(text) + 200
                    size += len(text)
            elif held + len(text) <= HELD:
                table[text] = [i]
                held += len(text) + 200
            else:
                out.append(_row([i], text))
                size += len(text)
            if size > 4 << 20:
                yield _arrow(out, LOCAL)
                out, size = [], 0
    while table:
        text, ids = table.popitem()
        out.append(_row(ids, text))
        size += len(text)
        if size > 4 << 20:
            yield _arrow(out, LOCAL)
            out, size = [], 0
    if out:
        yield _arrow(out, LOCAL)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete content is equal."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.gids: list[int] = []
        self.best: list[tuple] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry or -1, slot)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, at
            at = (at + 1) & mask
        return -1, at

    def add(self, slot: int, h: int, content: bytes, gid: int) -> int:
        k = len(self.contents)
        self.slots[slot] = k
        self.hashes.append(h)
        self.contents.append(content)
        self.gids.append(gid)
        self.best.append((True, 0, 0))
        self.sizes.append(0)
        self.bytes += len(content) + 200
        if 2 * (k + 1) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for j, v in enumerate(self.hashes):
                at = v & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = j
        return k

    def join(self, k: int, rid: int, first: int | None, n: int) -> None:
        key = (first is None, first or 0, rid)
        self.best[k] = key if self.sizes[k] == 0 else min(self.best[k], key)
        self.sizes[k] += n


def _digit(sha: bytes, depth: int) -> int:
    """Another digit of the digest for each depth; beyond the digest, of a digest of it."""
    while depth >= 2 * len(sha) - 16:
        sha, depth = hashlib.sha256(sha).digest(), depth - (2 * len(sha) - 16)
    byte = sha[8 + depth // 2]
    return byte >> 4 if depth % 2 == 0 else byte & 15


def grace(records: Iterator[tuple], budget: int, folder: str, depth: int = 0) -> Iterator[tuple]:
    """records: (rid, first, n, sha, content). Yields GROUPS rows: each record's group, then the groups, whose gid is
    the rid of a member. Spill files live in folder while they are needed."""
    held, files = ContentTable(), {}
    try:
        for rid, first, n, sha, content in records:
            h = int.from_bytes(sha[:8], "little") >> 1
            k, slot = held.find(h, content)
            if k < 0 and (held.bytes + len(content) <= budget or not held.contents):
                k = held.add(slot, h, content, rid)
            if k >= 0:
                held.join(k, rid, first, n)
                yield rid, held.gids[k], None, None, None
            else:
                d = _digit(sha, depth)
                if d not in files:
                    files[d] = open(os.path.join(folder, f"{depth}-{d}-{len(os.listdir(folder))}"), "w+b")  # noqa: SIM115
                files[d].write(struct.pack("<qqqqq", rid, first or 0, first is None, n, len(content)) + sha + content)
        for gid, (none, first, keep_rid), size in zip(held.gids, held.best, held.sizes, strict=True):
            yield None, gid, keep_rid, None if none else first, size
        del held
        for f in files.values():
            f.flush()
            f.seek(0)
            yield from grace(_reread(f), budget, folder, depth + 1)
            f.close()
            os.unlink(f.name)
    finally:
        for f in files.values():
            f.close()


def _reread(f) -> Iterator[tuple]:
    while head := f.read(40):
        rid, first, none, n, size = struct.unpack("<qqqqq", head)
        sha = f.read(32)
        yield rid, None if none else first, n, sha, f.read(size)


def _grace_task(budget: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in it:
                yield from zip(*(batch.column(k).to_pylist() for k in ("rid", "first", "n", "sha", "content")), strict=True)

        with tempfile.TemporaryDirectory() as folder:
            part: list[tuple] = []
            for row in grace(records(), budget, folder):
                part.append(row)
                if len(part) >= 20_000:
                    yield _arrow(part, GROUPS)
                    part = []
            if part:
                yield _arrow(part, GROUPS)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 96 << 20) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as empty, and empty texts are
    equal to each other. The row with the smallest id stays; a null id comes after all others, and of repeated rows
    with the same id exactly one has kept. table_bytes bounds the contents a task holds; the rest spills and recurses.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    local = rows.mapInArrow(_local, ddl(LOCAL)).withColumn("rid", F.monotonically_increasing_id())
    local = scratch(local, "exact-dedup")
    dealt = local.select("rid", "first", "n", "sha", "content").repartition("sha")
    found = scratch(dealt.mapInArrow(_grace_task(table_bytes), ddl(GROUPS)), "exact-groups")
    groups = found.where("rid IS NULL").select("gid", "keep_rid", "keep_id", "group_size")
    members = found.where("rid IS NOT NULL").select("rid", "gid").join(groups, "gid").drop("gid")
    joined = local.select("rid", "ids", "sha").join(members, "rid")
    every = joined.select("rid", "keep_rid", "keep_id", "group_size", "sha", F.posexplode("ids").alias("at", "id"))
    kept = ((F.col("rid") == F.col("keep_rid")) & (F.col("at") == 0)).alias("kept")
    return every.select(F.col("id").alias(id_col), "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))
