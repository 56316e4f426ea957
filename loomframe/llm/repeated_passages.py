"""Passages that stand elsewhere too: every byte covered by a string of `length` bytes that starts at another place.

Suffixes are compared to a depth of `length`, in blocks, after a difference cover has told which of them can tie.

* Cover sample. COVERS holds sets of residues such that every difference modulo the period is a difference of two of
  them. So for any two places i and j some k below the period makes both i + k and j + k places of the sample. The
  sample's strings of length - period + 1 bytes are hashed and ranked against each other, a bucket at a time; those that
  occur once go. Two equal strings of `length` bytes have equal ranks at i + k and j + k, whatever k is theirs, so a
  place none of whose sample places is left can't tie with any other, and its suffix is never sorted.
* Blocks. The bucket of a remaining suffix is its least window: the 16 bytes of least hash in its first `length`, at their
  first place. Equal strings have the same at the same distance, so they meet in one bucket. Neighbouring suffixes of a
  text mostly share their least window and go there together as one stretch of bytes, a few bytes a suffix.
* One bucket at a time. A task sorts the suffixes of one bucket, or of a few small ones, by a hash of `length` bytes,
  from which equal neighbours are read off, by that and a second hash of 64 bits. What a bucket's stretches are is bounded: a
  bucket of more than HOT bytes goes suffix by suffix to buckets by hash, to which a task brings each string once.

What a task meets twice it knows to be repeated. It sends on one of them only, marked, so that a passage with copies in a
third of all rows reaches no bucket more often than there are chunks of input.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, released, scratch, ship

#: Perfect difference sets by period.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
    273: (0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255),
}
#: Bytes that are laid end to end (a multiple of every period is taken), and bytes of a least window.
LAID, LEAST = 1 << 19, 16
#: Sample places, and bytes of stretches, that a task gathers before it hands them on.
CHUNK, CHUNK_BYTES = 1 << 20, 8 << 20
#: Sample places of a bucket; bytes of stretches beyond which a bucket is hot; bytes that are sorted together.
BUCKET, HOT, TOGETHER = 1 << 20, 8 << 20, 1 << 20
_PLACE = np.uint64(22)
BUCKETED = pa.schema(
    [
        ("bucket", pa.int64()),
        ("h", pa.list_(pa.int64())),
        ("g", pa.list_(pa.int64())),
        ("rid", pa.list_(pa.int64())),
        ("at", pa.list_(pa.int32())),
        ("sure", pa.list_(pa.bool_())),
    ]
)
PLACES = pa.schema([("rid", pa.int64()), ("at", pa.int32())])
STRETCHES = pa.schema(
    [("bucket", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("starts", pa.int64()), ("sure", pa.bool_()), ("data", pa.binary())]
)
RUNS = pa.schema([("rid", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all windows of some width from sums over prefixes, modulo 2^64."""

    def __init__(self, size: int, seed: int) -> None:
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 1
        self.letters = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32 | 1))
        factors = np.array([[base, pow(base, -1, 2**64)]], np.uint64).repeat(size + 1, axis=0)
        factors[0] = 1
        self.powers, self.inverse = np.cumprod(factors, axis=0).T.copy()

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.powers[: len(data)])))

    def at(self, prefixes: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        return mixed((prefixes[places + width] - prefixes[places]) * self.inverse[places])

    def every(self, data: np.ndarray, width: int) -> np.ndarray:
        sums = self.prefixes(data)
        n = len(data) - width + 1
        return mixed((sums[width:] - sums[:n]) * self.inverse[:n])


@lru_cache(maxsize=4)
def rolling(size: int, seed: int) -> Rolling:
    return Rolling(size, seed)


def hashes(data: np.ndarray, seed: int) -> Rolling:
    return rolling(1 << max(20, len(data).bit_length()), seed)


def cover_of(length: int) -> tuple[int, np.ndarray]:
    """Period and residues for strings of that length: the largest period up to seven tenths of it."""
    period = max((p for p in COVERS if 10 * p <= 7 * length), default=0)
    if not period or length < LEAST + 4:
        raise ValueError("strings of 20 bytes at least")
    return period, np.array(COVERS[period])


def _views(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) if len(x.as_buffer()) else np.zeros(0, np.uint8) for x in column]


def _laid(pieces, size: int = LAID):
    """Lists of (rid, place in the text, bytes) of about `size` bytes together."""
    held, total = [], 0
    for piece in pieces:
        held.append(piece)
        total += len(piece[2])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _list_rows(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order] if len(c) else c)) if len(c) else pa.array([None] * len(first), f.type) for c, f in zip(columns, list(BUCKETED)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *lists], schema=BUCKETED)


def _handed(h: np.ndarray, g: np.ndarray, rid: np.ndarray, at: np.ndarray, sure: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows by bucket. Of strings met before in this chunk one goes to the bucket of its hash, the others anywhere."""
    order = np.argsort(h)
    h, rid, at, sure = h[order], rid[order], at[order], sure[order]
    same = h[1:] == h[:-1]
    if len(g):
        g = g[order]
        same &= g[1:] == g[:-1]
    again = np.concatenate(([False], same))
    group = np.cumsum(~again) - 1
    sure = (np.bincount(group, weights=sure + 2.0 * again) > 0)[group]
    aside = mixed((rid.astype(np.uint64) << np.uint64(20)) ^ at.astype(np.uint64))
    bucket = (np.where(again, aside, h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return _list_rows(bucket, [h, g, rid, at, sure])


def _sample(length: int, buckets: int):
    """The cover sample of texts: hashes of its strings, by bucket."""
    period, cover = cover_of(length)
    width = length - period + 1
    step = -(-LAID // period) * period
    places = (np.arange(step // period + 1)[:, None] * period + cover[None, :]).ravel()

    def pieces(it):
        for batch in it:
            for rid, data in zip(batch.column("rid").to_numpy().tolist(), _views(batch.column("text")), strict=True):
                for s in range(0, len(data) - width + 1, step):
                    yield rid, s, data[s : s + step + width - 1]

    def run(it):
        held, total = [], 0

        def flush():
            h, rid, at = (np.concatenate(c) for c in zip(*held, strict=True))
            return _handed(h, np.zeros(0, np.int64), rid, at, np.zeros(len(h), bool), buckets)

        for group in _laid(pieces(it)):
            own = [places[: np.searchsorted(places, len(data) - width + 1)] for _, _, data in group]
            starts = np.cumsum([0, *(len(data) for _, _, data in group)])
            data = np.concatenate([d for _, _, d in group])
            roll = hashes(data, 1)
            index = np.concatenate([p + s for p, s in zip(own, starts, strict=False)])
            counts = [len(p) for p in own]
            held.append(
                (
                    roll.at(roll.prefixes(data), index, width).view(np.int64),
                    np.repeat(np.array([r for r, _, _ in group], np.int64), counts),
                    np.concatenate([p + s for p, (_, s, _) in zip(own, group, strict=True)]).astype(np.int32),
                )
            )
            total += len(index)
            if total >= CHUNK:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    return run


def _repeated(it):
    """The places of strings that occur again, of rows of BUCKETED in order of bucket."""
    held: list[tuple] = []
    bucket = None

    def found():
        h, g, rid, at, sure = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        if len(g):
            same &= g[order][1:] == g[order][:-1]
        sure[order[1:][same]] = sure[order[:-1][same]] = True
        return pa.RecordBatch.from_arrays([pa.array(rid[sure]), pa.array(at[sure])], schema=PLACES)

    for batch in it:
        for k, own in enumerate(batch.column("bucket").to_pylist()):
            if own != bucket and held:
                yield found()
                held = []
            bucket = own
            lists = [batch.column(c)[k].values for c in ("h", "g", "rid", "at", "sure")]
            held.append(tuple(np.zeros(0, np.int64) if x is None else x.to_numpy(zero_copy_only=False) for x in lists))
    if held:
        yield found()


def _candidates(length: int):
    """(rid, place, bytes) of the runs of suffixes that can tie, of rows rid, text, at (sorted sample places)."""
    period, _ = cover_of(length)

    def pieces(it):
        for batch in it:
            for rid, data, at in zip(batch.column("rid").to_numpy().tolist(), _views(batch.column("text")), batch.column("at"), strict=True):
                at = at.values.to_numpy().astype(np.int64)
                low, high = np.maximum(at - period + 1, 0), np.minimum(at, len(data) - length)
                low, high = low[low <= high], high[low <= high]
                if not len(low):
                    continue
                first = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1] + 1)))
                for x, y in zip(low[first].tolist(), high[np.append(first[1:] - 1, len(high) - 1)].tolist(), strict=True):
                    for s in range(x, y + 1, LAID):
                        yield rid, s, data[s : min(y + 1, s + LAID) + length - 1]

    return pieces


def least_windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the least window of each suffix's first `length` bytes, hash of the window at each place)."""
    own = hashes(data, 2).every(data, LEAST)
    dull = np.zeros(len(own), bool)  # windows of a short period never come first while there are others
    for period in (1, 2, 3, 4):
        differ = np.concatenate(([0], np.cumsum(data[period:] != data[:-period])))
        dull |= differ[LEAST - period : len(own) + LEAST - period] == differ[: len(own)]
    key = (dull.astype(np.uint64) << np.uint64(63)) | ((own >> np.uint64(23)) << _PLACE) | np.arange(len(own), dtype=np.uint64)
    wide = length - LEAST + 1
    n = len(own) - wide + 1
    blocks = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])
    return (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64), own


def _starts(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of every suffix of pieces laid end to end."""
    counts = sizes - length + 1
    piece = np.repeat(np.arange(len(sizes)), counts)
    before = np.cumsum(counts) - counts
    return piece, np.arange(len(piece)) - before[piece] + (np.cumsum(sizes) - sizes)[piece]


def _stretches(length: int):
    """Neighbouring suffixes of one least window as one row of their bytes, rows of equal bytes in a chunk once."""

    def run(it):
        rows: list[list] = []
        seen: dict[bytes, int] = {}
        total = 0
        for group in _laid(_candidates(length)(it)):
            data = np.concatenate([d for _, _, d in group])
            sizes = np.array([len(d) for _, _, d in group])
            piece, place = _starts(sizes, length)
            least, own = least_windows(data, length)
            least = least[place]
            cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]))))
            last = place[np.append(cut[1:] - 1, len(place) - 1)]
            offset = np.array([s for _, s, _ in group]) - (np.cumsum(sizes) - sizes)
            values = zip(own[least[cut]].view(np.int64).tolist(), piece[cut].tolist(), place[cut].tolist(), last.tolist(), (place + offset[piece])[cut].tolist(), strict=True)
            whole = data.tobytes()
            for bucket, k, first, end, at in values:
                text = whole[first : end + length]
                twin = seen.setdefault(text, len(rows))
                if twin < len(rows):
                    rows[twin][4] = True
                    rows.append([at * 2654435761 + group[k][0], group[k][0], at, end - first + 1, True, None])
                else:
                    rows.append([bucket, group[k][0], at, end - first + 1, False, text])
                    total += len(text)
            if total >= CHUNK_BYTES:
                yield _row_batch(rows)
                rows, seen, total = [], {}, 0
        if rows:
            yield _row_batch(rows)

    return run


def _row_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STRETCHES, strict=True)], schema=STRETCHES)


def _runs(rid: np.ndarray, first: np.ndarray, hit: np.ndarray, row: np.ndarray, index: np.ndarray) -> pa.RecordBatch:
    """Runs of hits within a row; index: a suffix's number in its row."""
    begin = hit & np.concatenate(([True], ~hit[:-1] | (row[1:] != row[:-1])))
    end = hit & np.concatenate((~hit[1:] | (row[1:] != row[:-1]), [True]))
    rows = row[begin]
    return pa.RecordBatch.from_arrays([pa.array(rid[rows]), pa.array(first[rows] + index[begin]), pa.array(first[rows] + index[end])], schema=RUNS)


def _suffixes(rows: list[tuple], length: int) -> list[np.ndarray]:
    """row, number in the row and both hashes of every suffix of rows of STRETCHES."""
    found = []
    for group in _laid((k, 0, np.frombuffer(r[5], np.uint8)) for k, r in enumerate(rows)):
        data = np.concatenate([d for _, _, d in group])
        sizes = np.array([len(d) for _, _, d in group])
        piece, place = _starts(sizes, length)
        found.append((piece + group[0][0], place - (np.cumsum(sizes) - sizes)[piece], *(hashes(data, seed).every(data, length)[place] for seed in (3, 4))))
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    """bucket, rid, at, sure."""
    return [np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 4)]


def _compare(length: int):
    """Runs of suffixes that occur again, of rows of STRETCHES in order of bucket: whole buckets are sorted together."""

    def found(rows):
        bucket, rid, at, sure = _columns(rows)
        row, index, h, g = _suffixes(rows, length)
        order = np.argsort(h)
        h, g, bucket = h[order], g[order], bucket[row[order]]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (bucket[1:] == bucket[:-1])
        hit = sure[row].astype(bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        return _runs(rid, at, hit, row, index)

    def run(it):
        held, size = [], 0
        for batch in it:
            known = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] is None:
                    known.append((row[1], row[2], row[2] + row[3] - 1))
                    continue
                if size >= TOGETHER and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
            if known:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*known, strict=True)], schema=RUNS)
        if held:
            yield found(held)

    return run


def _single(length: int, buckets: int):
    """The suffixes of hot stretches one by one, by buckets of their hashes."""

    def run(it):
        def flush(rows):
            _, rid, at, sure = _columns(rows)
            row, index, h, g = _suffixes(rows, length)
            return _handed(h.view(np.int64), g.view(np.int64), rid[row], (at[row] + index).astype(np.int32), sure[row].astype(bool), buckets)

        held, size = [], 0
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[5])
                if size >= CHUNK_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _places(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_repeated), ddl(PLACES))


def repeated_runs(texts: DataFrame, length: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rid, first, last: runs of places whose strings of `length` bytes start elsewhere too; rid, text of rows that can have any).

    texts: rid, text (binary), written.
    """
    spark = texts.sparkSession
    least = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    period, cover = cover_of(length)
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(least, size * len(cover) // period // BUCKET)
    sampled = texts.select("rid", "text").mapInArrow(released(_sample(length, buckets)), ddl(BUCKETED))
    places = scratch(_places(sampled), "cover-places", free=True).groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("at"))
    some = scratch(texts.join(places, "rid").select("rid", "text", "at"), "candidate-texts", free=True)
    rows = scratch(some.mapInArrow(released(_stretches(length)), ddl(STRETCHES)), "stretches")
    sizes = rows.groupBy("bucket").agg(F.sum(F.length("data")).alias("size"))
    crowded = scratch(sizes.where(F.col("size") > hot).select("bucket"), "hot-buckets", free=True)  # at most one for each `hot` bytes
    if crowded.limit(1).count():
        single = rows.where("data IS NOT NULL").join(crowded, "bucket").select(*(f.name for f in STRETCHES))
        single = _places(single.mapInArrow(released(_single(length, buckets)), ddl(BUCKETED)))
        single = single.select("rid", F.col("at").cast("bigint").alias("first"), F.col("at").cast("bigint").alias("last"))
        rows = rows.join(crowded, "bucket", "left_anti").select(*(f.name for f in STRETCHES))
    runs = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_compare(length)), ddl(RUNS))
    if crowded.limit(1).count():
        runs = runs.unionByName(single)
    return scratch(runs, "repeated-runs", free=True), some.select("rid", "text")


def _cut(length: int, with_kept: bool):
    schema = _cut_schema(with_kept)

    def run(it):
        for batch in it:
            out = []
            for rid, data, runs in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "runs")), strict=True):
                spans: list[list[int]] = []
                for r in sorted((r["first"], r["last"] + length) for r in runs):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (rid, [s for s, _ in spans], [e for _, e in spans], hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_kept else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _cut_schema(with_kept: bool) -> pa.Schema:
    plain = [("rid", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string())]
    return pa.schema([*plain, ("kept", pa.binary())] if with_kept else plain)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_kept: bool = False, hot: int = HOT,
) -> DataFrame:
    """id_col, n_bytes, starts and ends of the removed runs, kept_sha256 (and kept, the remaining bytes): a row per row.

    Texts are bytes of UTF-8; matches don't cross texts; all strings are judged on the input. Null text counts as empty.
    Ids may be null or repeated, and of repeated rows each is another place. A text of any length is taken a stretch at a
    time, but cut as a whole. Other columns are ignored; an empty table gives no rows. length: 20 at least.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = scratch(own.withColumn("rid", F.monotonically_increasing_id()), "texts")
    runs, some = repeated_runs(texts, length, hot)
    listed = runs.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = some.join(listed, "rid").select("rid", "text", "runs").mapInArrow(released(_cut(length, with_kept)), ddl(_cut_schema(with_kept)))
    whole = texts.select("rid", "doc_id", F.length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"), *(["text"] if with_kept else []))
    out = whole.join(cut, "rid", "left")
    none = F.array().cast("array<bigint>")
    kept = [F.coalesce("kept", "text").alias("kept")] if with_kept else []
    return out.select(
        F.col("doc_id").alias(id_col), "n_bytes", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"), *kept,
    )
