"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. With at most two differing bits some segment A has
none, and then the segment after it or the one before it has at most one; going round the three segments, one of the
ordered pairs (exact segment, next segment with at most one error) always holds. The next segment is decoded with the
binary Golay code (23, 12): the nearest code word and, where that is three bits away, the five code words four bits
away. Two words one bit apart always share one of these. The exact segment with the code word's index is a key; equal
keys are joined and verified.

Only distinct fingerprints take part, so exact copies never multiply. Fingerprints of a crowded key aren't paired:
they are linked through the words one bit away, of which two fingerprints at most two bits apart share one and which
have at most 65 fingerprints each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, per_document, scratch, ship, unused
from loomframe.llm.components import connected_components

#: Generator polynomial of the Golay code, the segments as (first bit, number of bits), the hash's seed.
GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
KEYS = pa.schema([("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])


def fingerprint(text: str, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; no words: 0. Signed, for Spark's bigint."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by byte; for each remainder six error words of weight up to 4, and how many of them count."""
    parts = np.array([[_remainder(b << shift & 0x7FFFFF) for b in range(256)] for shift in (0, 8, 16)], np.int64)
    errors, number = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    single = [_remainder(1 << k) for k in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            r = 0
            for k in bits:
                r ^= single[k]
            if weight < 4 or bin(int(errors[r, 0])).count("1") == 3:
                errors[r, number[r]] = sum(1 << k for k in bits)
                number[r] += 1
    return parts, errors, number


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the code words near each word of up to 23 bits: the nearest, and those four bits away if that
    is three away."""
    parts, errors, number = _tables()
    r = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    row, _ = valid = np.nonzero(np.arange(6)[None, :] < number[r][:, None])
    return row, ((words[:, None] ^ errors[r]) >> 11)[valid]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints (uint64)."""
    words = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        row, index = golay_indices(words[(k + 1) % 3])
        rows.append(row)
        keys.append((k << 40) | (words[k][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(it):
    for batch in it:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        row, key = golay_keys(fp)
        order = np.argsort(row, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(fp))))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))], schema=KEYS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed bigint) of each row; null text counts as empty and has fingerprint 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: per_document(lambda t: (fingerprint(t),), FINGERPRINTS)(it), ddl(FINGERPRINTS))


def links(distinct: DataFrame, crowd: int = 48) -> DataFrame:
    """fp, other: links that join all distinct fingerprints at most two bits apart, directly or by way of others.

    crowd: number of fingerprints of a key beyond which they are linked through the words one bit away instead.
    """
    keyed = distinct.select("fp").mapInArrow(_keys, ddl(KEYS)).select("fp", F.explode("keys").alias("key"))
    # one exchange by key; a key has at most one row of each distinct fingerprint
    held = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    shared = scratch(held.where("n > 1"), "golay-keys")
    few = shared.where(F.col("n") <= crowd).select("key", "fp")
    pairs = few.alias("a").join(
        few.alias("b"), F.expr("a.key = b.key AND a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= 2"),
    ).select(F.col("a.fp").alias("fp"), F.col("b.fp").alias("other"))
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)) for k in range(64)))
    middle = many.select("fp", F.explode(near).alias("word"))
    least = middle.groupBy("word").agg(F.min("fp").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = middle.join(least, "word").where("fp != other").select("fp", "other")
    return pairs.unionByName(through)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id: the smallest id reachable over links of at most two bits.

    Null text counts as empty; texts without words have fingerprint 0 and are linked like any other. Null ids never
    become a component_id unless a component has no other. Repeated rows each give a row. Other columns are ignored.
    """
    prints = scratch(fingerprints(docs, id_col, text_col), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    parts = connected_components(links(distinct), "fp", "other")
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids of dropped rows up to which they are broadcast: eight bytes each.
BROADCAST_ROWS = 1_000_000


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates,
) -> DataFrame:
    """docs, all columns unchanged, without the rows whose component by groups has a smaller id.

    Of rows that share an id and stay, one stays. A row with a null id can't be named and stays. The ids that go are
    broadcast only below BROADCAST_ROWS of them, else joined.
    """
    (own,) = unused(docs.columns, "__id")
    found = scratch(groups(docs, id_col, text_col).select(F.col(id_col).alias(own), F.col("component_id").alias("root")), "near-duplicates")
    gone = found.where(F.col(own) != F.col("root")).select(own).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(gone, F.col(id_col) == F.col(own), "left_anti")
    if found.where(F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
    return kept
