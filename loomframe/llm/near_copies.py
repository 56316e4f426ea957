"""Near copies by SimHash and Golay keys: candidates from two wide fingerprints, judged by five-word shingles.

Near copies of similarity 0.8 differ in far more than two bits of a fingerprint, so there are two fingerprints of 512
bits. One is a SimHash over a text's distinct words, which scattered edits hardly move. The other has a bit of the least
of a text's shingles under each of 512 hashes: a bit differs between two texts with half of one less their similarity,
whatever was edited, added or cut. Of both, segments of 23 bits are decoded with the Golay code to the indices of the
code words near them (simhash.golay_indices), and an index with the first bits of the segment after it, taken exactly, is
a key. With e errors in s segments, some segment has at most e / s of them (pigeonhole), and at a similarity of 0.8 a
tenth of the second fingerprint's bits differ: two or three a segment, so that several of its 22 segments meet.

Documents that share a key are candidates unless more bits of the second fingerprint differ than chance allows at a
similarity of 0.8: three deviations beyond a tenth, which some pairs in a thousand exceed at the very limit. A candidate
is a link if the Jaccard similarity of the sets of five-word shingles is 0.8 or more, computed on the whole texts.

Only distinct sets take part, so exact copies never multiply. Keys are sorted and each is gone through once; members
without a near member in a key leave there, so accidental keys cost no more than that. Only links that can join two
components are sought, in three steps: each member is compared with the few nearest that it shares a key with; then
members outside a key's largest component with a member of that; then, in the keys that still hold several
components, all members outside the largest with all members of others whose common shingles allow a similarity of 0.8.
The first two steps only leave less to the third, which is exact: pairs within a component can't change the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, released, scratch, ship, texts
from loomframe.llm.components import connected_components
from loomframe.llm.simhash import golay_indices

SEED = 42
#: Bits of a segment, 64-bit words of a fingerprint.
WIDTH, WORDS = 23, 8
#: Segments of the SimHash and of the fingerprint of least shingles, and bits of the next segment in a key of each. One
#: more exact bit for each doubling of the documents beyond 10^8 keeps keys small.
SEGMENTS, EXACT = (8, 22), (15, 12)
#: The similarity that links, and deviations beyond the mean that its differing bits are allowed.
LEAST, DEVIATIONS = 0.8, 3


def _most(bits: int) -> int:
    """Most differing bits of candidates: each differs with half of one less the similarity."""
    share = (1 - LEAST) / 2
    return int(bits * share + DEVIATIONS * (bits * share * (1 - share)) ** 0.5)


#: Of the first two words, and of all of the fingerprint of least shingles.
NEAR, NEAR_ALL = _most(128), _most(64 * WORDS)
#: Partners of a member in the first two steps.
FEW = 4
#: Members of a key that are compared with each other at once.
TOGETHER = 256
#: Words of the fingerprint of least shingles, and of the SimHash.
FP, SIM = [f"w{k}" for k in range(WORDS)], [f"v{k}" for k in range(WORDS)]
PRINTS = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), *((w, pa.int64()) for w in FP + SIM)])
MEMBER = [("node", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64())]
KEYS = pa.schema([*MEMBER, ("keys", pa.list_(pa.int64()))])
SHARED = pa.schema([("key", pa.int64()), *MEMBER, ("others", pa.list_(pa.int64())), ("distances", pa.list_(pa.int32()))])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than width are one shingle."""
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def _lanes(h: np.ndarray) -> np.ndarray:
    """WORDS independent 64-bit hashes of each hash."""
    out = np.empty((len(h), WORDS), np.uint64)
    for k in range(WORDS):
        x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes; none: all 0."""
    h = hashes.view(np.uint64)
    counts = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(_lanes(h[k : k + 8192]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    own = sorted(set(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


#: 512 hashes of 32 bits: an odd factor and a summand each, by the hash of their number.
_FACTORS, _SUMMANDS = (
    np.array([xxhash.xxh64_intdigest(f"{name}{k}", SEED) & 0xFFFFFFFF for k in range(64 * WORDS)], np.uint32) for name in ("factor", "summand")
)
_FACTORS |= np.uint32(1)


def least_bits(hashes: np.ndarray) -> np.ndarray:
    """For each of 512 hashes one bit of the least value among the hashes given (at least one)."""
    h = (hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(64 * WORDS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(h), 64):
        np.minimum(least, (h[k : k + 64, None] * _FACTORS + _SUMMANDS).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.packbits((mixed >> np.uint32(31)).astype(bool), bitorder="little").view(np.int64)


def keys_of(prints: np.ndarray, segments: int, exact: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints, rows of WORDS 64-bit numbers. first: the number of the first segment,
    which is part of a key."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    every = 64 * WORDS // WIDTH
    words = bits[:, : every * WIDTH].reshape(-1, every, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int64))
    rows, keys = [], []
    for k in range(segments):
        row, index = golay_indices(words[:, k])
        rows.append(row)
        low = words[row, (k + 1) % every] & ((1 << exact) - 1)
        keys.append(((first + k) << (12 + exact)) | (low << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _prints(it):
    for batch in it:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            nodes, prints = [], []
            for text in texts(part):
                words = split_words(text)
                own = shingles(words)
                nodes.append(node_of(own))
                prints.append(np.concatenate((least_bits(own), fingerprint(word_hashes(words)))))
            columns = np.array(prints).T
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), *map(pa.array, columns)], schema=PRINTS)


def _keys(exact: tuple[int, int]):
    def run(it):
        for batch in it:
            sim, least = (np.stack([batch.column(w).to_numpy() for w in names], axis=1) for names in (SIM, FP))
            one = keys_of(sim, SEGMENTS[0], exact[0])
            two = keys_of(least, SEGMENTS[1], exact[1], first=SEGMENTS[0] << max(0, exact[0] - exact[1]))
            row, key = (np.concatenate(c) for c in zip(one, two, strict=True))
            order = np.argsort(row, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(least))))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in MEMBER), keys], schema=KEYS)

    return run


def near_members(rows: np.ndarray, run: np.ndarray, every: bool) -> pa.RecordBatch | None:
    """SHARED rows of members with a near member in their key (every: of all members), each with its FEW nearest.

    rows: key, node, w0, w1 by column; run: (keys, members) places in rows, keys of as many members each.
    """
    words = rows[2:, run].view(np.uint64)
    distance = np.bitwise_count(words[:, :, :, None] ^ words[:, :, None, :]).sum(axis=0, dtype=np.int32)
    distance[:, np.arange(run.shape[1]), np.arange(run.shape[1])] = 1000
    few = min(FEW, run.shape[1] - 1)
    nearest = np.argsort(distance, axis=2, kind="stable")[:, :, :few]
    away = np.take_along_axis(distance, nearest, axis=2)
    near = away <= NEAR
    kept = near.any(axis=2) | every
    if not kept.any():
        return None
    at = run[kept]
    others = rows[1][run[np.nonzero(kept)[0][:, None], nearest[kept]]]
    chosen = near[kept]
    offsets = pa.array(np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[chosen])) for x in (others, away[kept].astype(np.int32))]
    return pa.RecordBatch.from_arrays([*(pa.array(rows[c][at]) for c in range(4)), *lists], schema=SHARED)


def _runs(keys: np.ndarray, cut: bool, together: int):
    """(places, every) of the members of each key, keys of one size together. A key of more than `together` members, and
    the first if it was cut before, are gone through in parts whose members are all kept: a near one may be in another
    part."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    sizes = np.diff(np.append(starts, len(keys)))
    whole = sizes <= together
    whole[0] &= not cut
    for k in np.flatnonzero(~whole):
        for a in range(starts[k], starts[k] + sizes[k], together):
            yield np.arange(a, min(a + together, starts[k] + sizes[k]))[None, :], True
    for size in np.unique(sizes[whole & (sizes > 1)]):
        own = starts[whole & (sizes == size)]
        step = max(1, 500_000 // (size * size))
        for a in range(0, len(own), step):
            yield own[a : a + step, None] + np.arange(size)[None, :], False


def _near(together: int):
    """near_members of rows sorted by key; no more than a batch and `together` rows are held."""

    def found(rows: np.ndarray, cut: bool):
        for run, every in _runs(rows[0], cut, together) if rows.shape[1] else ():
            out = near_members(rows, run, every)
            if out is not None:
                yield out

    def run(it):
        held, cut = np.zeros((4, 0), np.int64), False
        for batch in it:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("key", "node", "w0", "w1")])], axis=1)
            others = np.flatnonzero(rows[0] != rows[0][-1])
            last = int(others[-1]) + 1 if len(others) else 0  # where the last key begins, which may go on
            if last:
                yield from found(rows[:, :last], cut)
                cut = False
            held = rows[:, last:]
            if held.shape[1] > together:
                done = held.shape[1] - held.shape[1] % together
                yield from found(held[:, :done], True)
                held, cut = held[:, done:], True
        yield from found(held, cut)

    return run


def _sets(it):
    for batch in it:
        for a in range(0, batch.num_rows, 500):
            sets = [shingles(split_words(t)) for t in texts(batch.slice(a, 500))]
            yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=SETS)


def shingle_sets(members: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, shingles of the nodes in members, once each. Texts are fetched by id; a null or repeated id may fetch
    others too."""
    wanted = scratch(members.select("node").distinct().join(nodes.select("node", "least_id"), "node"), "wanted-nodes")
    named = rows.join(wanted.select(F.col("least_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    fetched = named.unionByName(rows.where("doc_id IS NULL")).select("text").mapInArrow(_sets, ddl(SETS))
    return scratch(fetched.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")


def similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) near in all bits whose whole sets have a similarity of 0.8 or more.

    nodes: node, least_id, fingerprint words. rows: doc_id, text.
    """
    one, two = (nodes.select(F.col("node").alias(k), *(F.col(w).alias(f"{k}{w}") for w in FP)) for k in "ab")
    near = pairs.join(one, "a").join(two, "b").where(f"{_differ('a', 'b', FP)} <= {NEAR_ALL}")
    near = scratch(near.select("a", "b"), "candidates")
    sets = shingle_sets(near.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows)
    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    # sets of similarity 0.8 have four fifths of each other's size
    alike = "5 * least(size(a_set), size(b_set)) >= 4 * greatest(size(a_set), size(b_set))"
    both = near.join(one, "a").join(two, "b").where(alike)
    return both.where("9 * size(array_intersect(a_set, b_set)) >= 4 * (size(a_set) + size(b_set))").select("a", "b")


def common_parts(members: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, size, common (shingles that another of the members has too) of members that can be similar to one.

    Two members have no more shingles in common than the lesser of their common parts, which bounds their similarity.
    """
    sets = shingle_sets(members, nodes, rows)
    every = sets.select("node", F.explode("shingles").alias("shingle"))
    twice = every.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    counted = every.join(twice.select("shingle"), "shingle").groupBy("node").agg(F.count("*").alias("common"))
    return counted.join(sets.select("node", F.size("shingles").alias("size")), "node").where("5 * common >= 4 * size")


def _closest(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each node with the FEW nearest of its others. rows: node, other, distance."""
    place = F.dense_rank().over(Window.partitionBy("node").orderBy("distance", "other"))
    chosen = rows.withColumn("place", place).where(F.col("place") <= FEW)
    return chosen.select(*_pair("node", "other")).distinct()


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _differ(x: str, y: str, words: list[str]) -> str:
    """SQL: number of differing bits of fingerprint words, whose names have x or y before them."""
    return " + ".join(f"bit_count({x}{w} ^ {y}{w})" for w in words)


def _distance(x: str, y: str) -> str:
    return _differ(x, y, FP[:2])


def _mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, w0, w1, component, main (the key's largest component), low and high (two members of that) of the keys
    that hold several components: one pass over the rows of a key, no join."""
    parts = connected_components(found, "a", "b")
    placed = shared.select("key", *(c for c, _ in MEMBER)).join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node"),
    )
    whole, member = Window.partitionBy("key"), F.struct(*(c for c, _ in MEMBER))
    sized = placed.withColumn("n", F.count("*").over(Window.partitionBy("key", "component")))
    several = F.min("component").over(whole) != F.max("component").over(whole)
    mixed = sized.withColumn("several", several).withColumn("main", F.max(F.struct("n", "component")).over(whole)["component"]).where("several")
    of_main = F.when(F.col("component") == F.col("main"), member)
    ends = mixed.withColumn("low", F.min(of_main).over(whole)).withColumn("high", F.max(of_main).over(whole))
    return scratch(ends.drop("n", "several"), "mixed-keys")


def links(nodes: DataFrame, rows: DataFrame, exact: tuple[int, int] = EXACT) -> DataFrame:
    """a, b: similar pairs that join all similar sets that share a key, directly or by way of others.

    nodes: node, least_id, fingerprint words. rows: doc_id, text.
    """
    keyed = nodes.select("node", *FP, *SIM).mapInArrow(_keys(exact), ddl(KEYS)).select(F.explode("keys").alias("key"), *(c for c, _ in MEMBER))
    # one exchange; a key has at most one row of each node, which is one in a hundred of all rows
    shared = scratch(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(released(_near(TOGETHER)), ddl(SHARED)), "golay-keys")
    first = shared.select("node", F.explode(F.arrays_zip("others", "distances")).alias("o")).select(
        "node", F.col("o.others").alias("other"), F.col("o.distances").alias("distance"),
    )
    tested = scratch(_closest(first), "nearest-pairs")
    found = scratch(similar(tested, nodes, rows), "similar-pairs")
    placed = _mixed(shared, found)
    away = lambda e: F.bit_count(F.col("w0").bitwiseXOR(e["w0"])) + F.bit_count(F.col("w1").bitwiseXOR(e["w1"]))
    near_ends = F.transform(F.array("low", "high"), lambda e: F.struct(away(e).alias("distance"), e["node"].alias("node")))
    outside = placed.where("component != main").withColumn("end", F.array_min(near_ends))
    outside = outside.select("node", F.col("end.node").alias("other"), F.col("end.distance").alias("distance")).where(f"distance <= {NEAR}")
    more = scratch(_closest(outside).join(tested, ["a", "b"], "left_anti"), "main-pairs")
    if more.limit(1).count():
        tested = tested.unionByName(more)
        found = found.unionByName(scratch(similar(more, nodes, rows), "similar-pairs"))
        placed = _mixed(shared, found)
    placed = placed.drop("low", "high")
    own = placed.groupBy("node").agg(F.collect_list("key").alias("own"))  # a node has about a hundred keys
    able = common_parts(placed, nodes, rows).join(own, "node").join(nodes.select("node", *FP[2:]), "node")
    placed = scratch(placed.join(able, "node"), "last-keys")
    near = (
        "x.key = y.key AND x.component != y.component AND (y.component = y.main OR x.node < y.node) "
        "AND 9 * least(x.common, y.common) >= 4 * (x.size + y.size) AND "
        f"{_distance('x.', 'y.')} <= {NEAR} AND {_differ('x.', 'y.', FP)} <= {NEAR_ALL} "
        "AND x.key = array_min(array_intersect(x.own, y.own))"  # of the keys that both have, at the first
    )
    rest = placed.where("component != main").alias("x").join(placed.alias("y"), F.expr(near)).select(*_pair("x.node", "y.node")).distinct()
    rest = scratch(rest.join(tested, ["a", "b"], "left_anti"), "other-pairs")
    return found.unionByName(similar(rest, nodes, rows)) if rest.limit(1).count() else found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: tuple[int, int] = EXACT) -> DataFrame:
    """id_col, component_id: the smallest id reachable over links (similarity 0.8 or more), a row per row.

    Null text counts as empty; texts without words are copies of each other, and so are texts of equal shingle sets.
    Null ids never become a component_id unless a component has no other. Repeated rows each give a row. Other columns
    are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = scratch(rows.mapInArrow(released(_prints), ddl(PRINTS)), "wide-prints")
    nodes = scratch(found.groupBy("node").agg(F.min("doc_id").alias("least_id"), *(F.min(w).alias(w) for w in FP + SIM)), "distinct-sets")
    parts = connected_components(links(nodes, rows, exact), "a", "b")
    rooted = nodes.select("node", "least_id").join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = found.select("doc_id", "node").join(rooted.select("node", "root").join(least, "root").select("node", "component_id"), "node")
    return out.select(F.col("doc_id").alias(id_col), "component_id")
