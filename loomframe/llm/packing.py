"""Best-fit packing of tokenised documents, improved by swap-based local search.

Pieces of one length are interchangeable, so packing works on the number of pieces of each length (at most `capacity`
numbers, whatever the corpus size) and on bins kept as patterns with a multiplicity: best-fit decreasing fills them,
then moves, one-for-one and two-for-one exchanges between underfull bins raise the sum of squared fills until no
exchange helps; bins that empty go. The patterns then say which sequence and offset the k-th piece of each length has.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, released, scratch, ship, texts
from loomframe.llm.token_counts import SPACE, byte_letters

#: Letters of the Latin blocks, and ASCII marks without the apostrophe.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = r"!-&(-/:-@\[-`{-~"
_CUT = re.compile(f" (?=[^{SPACE}])")
_NOT_PLAIN = re.compile(f" (?:[{SPACE}]|$)")
#: Words of the vocabulary's pattern in a text that these alone make up: a run of letters, of digits or of marks, each
#: with a space before it or none, and single line ends.
_WORDS = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n(?![{SPACE}])")
#: Characters below this are letters, or not, in every version of Unicode alike.
_LATIN = chr(0x250)
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PIECES_IDS = PIECES.append(pa.field("ids", pa.list_(pa.int64())))
PLACES = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Encoder:
    """Ids of byte-level BPE as little-endian 32-bit bytes, as the tokenizers library gives them.

    A text of Latin letters, digits and ASCII marks falls into runs that the vocabulary's pattern makes words of; words
    are remembered in a bounded memory. In other texts the stretches between spaces before visible characters are
    encoded by themselves, since the pattern always begins a new word there and never looks back.
    """

    def __init__(self, path: str, remember: int = 120_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        letters = byte_letters()
        self.mark = letters[ord(" ")]
        self.letters = {chr(k): "".join(letters[b] for b in chr(k).encode()) for k in range(ord(_LATIN))}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """One word of the vocabulary's pattern, a space before it included: the library's merges apply to it alone."""
        if word.isascii() and word != "\n":  # visible ASCII stands for itself
            spelled = self.mark + word[1:] if word[0] == " " else word
        else:
            spelled = "".join(map(self.letters.__getitem__, word))
        found = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        if len(word) <= 60:
            if len(self.words) >= self.remember:
                self.words.clear()
            self.words[word] = found
        return found

    def _keep(self, part: str, found: bytes) -> None:
        if len(part) <= 60:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[part] = found

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._encode([text])[0]
        words = _WORDS.findall(text)
        if len("".join(words)) != len(text):
            return self._by_parts(text)
        found = list(map(self.words.get, words))
        if None in found:
            get, learn = self.words.get, self._word
            found = [f or get(w) or learn(w) for f, w in zip(found, words, strict=True)]
        return b"".join(found)

    def _by_parts(self, text: str) -> bytes:
        """A text with other characters: the library encodes the stretches between spaces."""
        parts = _CUT.split(text) if _NOT_PLAIN.search(text) else text.split(" ")
        found: list = list(map(self.known.get, parts))
        found[0] = self._encode([parts[0]])[0] if parts[0] else b""
        if None in found:
            missing: dict[str, list[int]] = {}
            for k in [k for k, f in enumerate(found) if f is None]:
                words = _WORDS.findall(part := " " + parts[k])
                if len("".join(words)) == len(part) and part[-1] != "\n":
                    found[k] = b"".join([self.words.get(w) or self._word(w) for w in words])
                    self._keep(parts[k], found[k])
                else:
                    missing.setdefault(parts[k], []).append(k)
            for part, ids in zip(missing, self._encode([" " + p for p in missing]), strict=True):
                self._keep(part, ids)
                for k in missing[part]:
                    found[k] = ids
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else pieces of full capacity after a shorter first one."""
    first = total if total <= capacity else total % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, total, capacity)]


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES_IDS if with_ids else PIECES

    def run(it):
        held = encoder(path or default_vocabulary())
        for batch in it:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                data = memoryview(held.encode(text) + end)
                for k, (s, n) in enumerate(cuts(len(data) // 4, capacity)):
                    own = data[4 * s : 4 * (s + n)]
                    rows.append((i, k, s, n, zlib.crc32(own), *([np.frombuffer(own, "<u4").tolist()] if with_ids else [])))
                if with_ids and len(rows) > 2000:
                    yield _arrow(rows, schema)
                    rows = []
            if rows:
                yield _arrow(rows, schema)

    return run, schema


def _arrow(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Bins:
    """Bins as {pattern: multiplicity}; a pattern is the ascending tuple of its lengths."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins: Counter = Counter()

    def best_fit(self, counts: dict[int, int]) -> None:
        """Longest first, each into the fullest bin that has room; alike bins are filled together."""
        open_: dict[int, Counter] = {self.capacity: Counter()}
        rooms: list[int] = []  # ascending rooms of open_, without empty bins
        for size in sorted(counts, reverse=True):
            left = counts[size]
            while left:
                k = bisect_left(rooms, size)
                room = rooms[k] if k < len(rooms) else self.capacity
                pattern, many = next(iter(open_[room].items())) if k < len(rooms) else ((), left)
                each = min(room // size, left)
                many = min(many, left // each)
                if k < len(rooms):
                    open_[room][pattern] -= many
                    open_[room] += Counter()
                    if not open_[room]:
                        rooms.pop(k)
                rest = room - each * size
                if rest not in open_ or not open_[rest]:
                    open_[rest] = Counter()
                    insort(rooms, rest)
                open_[rest][tuple(sorted([*pattern, *[size] * each]))] += many
                left -= each * many
        for group in open_.values():
            self.bins.update(group)
        self.bins += Counter()

    def improve(self) -> int:
        """Exchanges between an emptier and a fuller underfull bin until none raises the sum of squared fills or the
        room left over is less than one bin, the emptiest bins first. Two patterns that have no exchange never get one,
        so they are looked at once. Returns the number of exchanges."""
        fruitless: set[tuple] = set()
        done = 0
        while True:
            under = sorted((p for p in self.bins if sum(p) < self.capacity), key=lambda p: (sum(p), p))
            if sum(self.bins[p] * (self.capacity - sum(p)) for p in under) < self.capacity:
                return done
            found = next(
                ((low, high, pair) for low in under for high in reversed(under) if (pair := self._look(low, high, fruitless))), None,
            )
            if found is None:
                return done
            low, high, pair = found
            self._replace(low, high, pair, self.bins[low] // 2 if high == low else min(self.bins[low], self.bins[high]))
            done += 1

    def _look(self, low, high, fruitless: set) -> tuple | None:
        if (low, high) in fruitless or (high == low and self.bins[low] < 2):
            return None
        pair = self._exchange(low, high)
        if pair is None:
            fruitless.add((low, high))
        return pair

    def _replace(self, low, high, pair, many) -> None:
        self.bins[low] -= many
        self.bins[high] -= many
        for p in pair:
            if p:
                self.bins[p] += many
        self.bins += Counter()

    def _exchange(self, low: tuple, high: tuple) -> tuple[tuple, tuple] | None:
        """The exchange that fills `high` most: what it gains must fit its room and raise the squares."""
        room, gap = self.capacity - sum(high), sum(high) - sum(low)
        best, gain = None, max(0, -gap)  # squares rise if gain > low - high
        own = sorted(set(low))
        gives = [((x,), x) for x in own if x <= room + max(high)]
        gives += [((x, y), x + y) for k, x in enumerate(own) for y in own[k:] if (x != y or low.count(x) > 1) and x + y <= room + max(high)]
        takes = [((), 0), *(((x,), x) for x in sorted(set(high)))]
        sizes = [t for _, t in takes]
        for give, g in gives:
            k = bisect_left(sizes, g - room)  # the smallest that makes it fit
            if k < len(takes) and gain < g - sizes[k] <= room and not (len(give) == 2 and k == 0 and g == 0):
                best, gain = (give, takes[k][0]), g - sizes[k]
        if best is None:
            return None
        give, take = Counter(best[0]), Counter(best[1])
        return tuple(sorted((Counter(low) - give + take).elements())), tuple(sorted((Counter(high) - take + give).elements()))


def solve(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns and multiplicities for the number of pieces of each length."""
    bins = Bins(capacity)
    bins.best_fit(counts)
    bins.improve()
    return bins.bins


def places(bins: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ascending first ranks of its runs, and each run's first sequence and offset."""
    rows: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, many in sorted(bins.items()):
        at = 0
        for size in reversed(pattern):
            rows.setdefault(size, []).append((used[size], sequence, at))
            used[size] += many
            at += size
        sequence += many
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    path: str | None = None,
    with_ids: bool = False,
    group_rows: int = 1_000,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids if with_ids).

    A document is its ids and end_id; one longer than capacity is cut into pieces of capacity after a shorter first
    one. Null text counts as empty: end_id alone. Ids may be null or repeated, each row is packed. Other columns are
    ignored; an empty table gives no rows. group_rows: about how many pieces of a length are numbered together (the
    square root of their number, where that is more); the groups of a length are then counted up.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    run, schema = _pieces(path, capacity, end_id, with_ids)
    pieces = scratch(rows.mapInArrow(released(run), ddl(schema)).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    shipped = spark.sparkContext.broadcast(places(solve(counts, capacity)))  # bounded by capacity, not by the corpus
    many = [(length, -(-n // max(group_rows, isqrt(n)))) for length, n in counts.items()]
    groups = F.broadcast(spark.createDataFrame(many, "length bigint, groups bigint"))  # at most capacity rows
    # rid differs between repeated rows, so that no group of them lands in one task
    piece = pieces.join(groups, "length").withColumn("group", F.expr("pmod(xxhash64(rid), groups)"))
    sizes = piece.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = sizes.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    ranked = piece.withColumn("k", F.row_number().over(Window.partitionBy("length", "group").orderBy("rid")) - 1)
    ranked = ranked.join(before, ["length", "group"]).withColumn("rank", F.col("before") + F.col("k"))
    own = [f.name for f in schema]
    out = pa.schema([*schema, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(it):
        held = shipped.value
        for batch in it:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows_ in np.split(order, edges) if len(order) else []:
                first, seq, off = held[int(length[rows_[0]])]
                run_ = np.searchsorted(first, rank[rows_], "right") - 1
                sequence[rows_] = seq[run_] + rank[rows_] - first[run_]
                offset[rows_] = off[run_]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(sequence), pa.array(offset)], schema=out)

    return ranked.select(*own, "rank").mapInArrow(place, ddl(out)).withColumnRenamed("doc_id", id_col)
