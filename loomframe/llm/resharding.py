"""Minimum-cost-flow resharding.

Shards have row capacities at most one apart; moving a row costs its bytes. The rows of each old shard are counted by
size class (sizes kept to 8 significant bits, so a bounded number of classes whose sizes differ by less than 1 in 128).
A flow network carries every row from its old shard to a new one, either by the free arc that stays or by an arc that
takes its size classes from cheap to dear at their mean bytes a row; successive shortest paths give the transfers that
move the fewest bytes, to within that 1 in 128. Rows of a shard are ranked from small to large, transfers take ranges
of ranks, and shard and slot of every row follow from its rank by arithmetic. rewrite() then writes the shards that get
or lose rows anew, and no others, and commits them together by a manifest.
"""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.llm.common import scratch, scratch_folder, unused
from loomframe.sources import commits


class Network:
    """Successive shortest augmenting paths (queue-based Bellman-Ford) over arcs of rising cost."""

    def __init__(self) -> None:
        self.arcs: dict[object, list[list]] = {}
        self.steps: list[tuple[list, list, list]] = []

    def arc(self, a, b, room: int, cost: float = 0.0) -> list:
        there, back = [b, room, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self.arcs.setdefault(a, []).append(there)
        self.arcs.setdefault(b, []).append(back)
        return there

    def rising(self, a, b, blocks: list[tuple[float, int]]) -> list:
        """One arc whose blocks (cost, room) are used from the first on, costs rising. Only the block in use and the
        one before it can be on a shortest path, so the network stays small whatever their number."""
        arc = self.arc(a, b, 0)
        self.steps.append((arc, [(cost, room) for cost, room in blocks if room], [0, 0]))
        self._step(*self.steps[-1])
        return arc

    @staticmethod
    def _step(arc: list, blocks: list, at: list) -> None:
        """Lays the block in use open. at: its place, and what of it is used."""
        k, used = at
        while k < len(blocks) and used >= blocks[k][1]:
            k, used = k + 1, 0
        at[:] = k, used
        arc[1], arc[2] = (blocks[k][1] - used, blocks[k][0]) if k < len(blocks) else (0, 0.0)
        back = arc[3]
        if used:
            back[1], back[2] = used, -blocks[k][0]
        else:
            back[1], back[2] = (blocks[k - 1][1], -blocks[k - 1][0]) if k else (0, 0.0)

    def push(self, source, sink) -> None:
        """Send as much as there is room for, by cheapest paths."""
        convex = {id(arc): (arc, blocks, at) for arc, blocks, at in self.steps}
        while True:
            cost, by, queue, inside = {source: 0.0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                inside.discard(a)
                for arc in self.arcs.get(a, ()):
                    if arc[1] > 0 and (new := cost[a] + arc[2]) < cost.get(arc[0], float("inf")) - 1e-9:
                        cost[arc[0]], by[arc[0]] = new, arc
                        if arc[0] not in inside:
                            inside.add(arc[0])
                            queue.append(arc[0])
            if sink not in cost:
                return
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = by[at][3][0]
            flow = min(arc[1] for arc in path)
            for arc in path:
                if step := convex.get(id(arc)):
                    step[2][1] += flow
                    self._step(*step)
                elif step := convex.get(id(arc[3])):
                    at = step[2]
                    if not at[1]:
                        at[:] = at[0] - 1, step[1][at[0] - 1][1]
                    at[1] -= flow
                    self._step(*step)
                else:
                    arc[1] -= flow
                    arc[3][1] += flow


@dataclass(frozen=True)
class Plan:
    """moves: rows from old to new shard; stays: rows that stay; sizes: rows of each new shard."""

    moves: dict[tuple[int, int], int]
    stays: dict[int, int]
    sizes: dict[int, int]

    def affected(self) -> list[int]:
        """Shards whose files change: those that get or lose rows."""
        return sorted({j for _, j in self.moves} | {i for i, _ in self.moves})


def plan(blocks: dict[int, list[tuple[float, int]]], shards: int) -> Plan:
    """blocks: for each old shard (bytes a row, rows) of its size classes, costs rising."""
    total = sum(n for own in blocks.values() for _, n in own)
    least, more = divmod(total, shards)
    net, keeps, pairs, ends = Network(), {}, {}, []
    for i, own in sorted(blocks.items()):
        rows = sum(n for _, n in own)
        net.arc("source", ("old", i), rows)
        if i < shards:
            keeps[i] = net.arc(("old", i), ("new", i), rows)
        net.rising(("old", i), ("moving", i), sorted(own))
        for j in range(shards):
            if j != i:
                pairs[i, j] = net.arc(("moving", i), ("new", j), rows)
    for j in range(shards):
        ends.append(net.arc(("new", j), "sink", least))
    net.push("source", "sink")
    for arc in ends:  # every shard keeps its floor; what is left goes one each
        arc[3][1] = 0
    if more:
        for j in range(shards):
            net.arc(("new", j), "last", 1)
        net.arc("last", "sink", more)
        net.push("source", "sink")
    moves = {k: arc[3][1] for k, arc in pairs.items() if arc[3][1]}
    stays = {i: arc[3][1] for i, arc in keeps.items()}
    sizes = {j: stays.get(j, 0) + sum(n for (_, b), n in moves.items() if b == j) for j in range(shards)}
    return Plan(moves, stays, sizes)


def size_class(size: str) -> str:
    """SQL: size with all but its 8 leading bits cleared."""
    return f"shiftleft(shiftright({size}, greatest(0, length(bin({size})) - 8)), greatest(0, length(bin({size})) - 8))"


def _ranges(p: Plan) -> list[tuple]:
    """(old, first rank, end rank, shard, slot of the first rank): moved rows are the lowest ranks."""
    filled = {j: p.stays.get(j, 0) for j in p.sizes}
    out = []
    for i in sorted({i for i, _ in p.moves} | set(p.stays)):
        at = 0
        for (a, j), n in sorted(p.moves.items()):
            if a == i:
                out.append((i, at, at + n, j, filled[j]))
                filled[j] += n
                at += n
        if p.stays.get(i):
            out.append((i, at, at + p.stays[i], i, 0))
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int, size: Column, carry: dict[str, Column], group_rows: int = 1_000) -> DataFrame:
    """The columns in carry, old_shard, size, shard, slot: one row per input row, rows of shards at most one apart.

    old_shard: integer column expression from 0 (null: 0); size: bytes a row (long). carry: name -> column expression
    of what else is returned. Slots of a shard are 0, 1, ... without gaps: first the rows that stay, from small to
    large, then arrivals. Repeated rows are rows like others; an empty table gives no rows. group_rows: about how many
    rows of a size class are ranked together (the square root of their number, where that is more).
    """
    spark = docs.sparkSession
    own = [c.alias(f"__c_{k}") for k, c in carry.items()]
    base = docs.select(F.coalesce(old_shard.cast("int"), F.lit(0)).alias("__old"), size.cast("bigint").alias("__size"), *own)
    base = base.withColumn("__class", F.expr(size_class("__size"))).withColumn("__rid", F.monotonically_increasing_id())
    base = scratch(base, "reshard")
    counted = base.groupBy("__old", "__class").agg(F.count("*").alias("n"), F.avg("__size").alias("mean")).collect()  # size classes are at most 128 for each power of two
    blocks: dict[int, list] = {}
    first, at = [], {}
    for r in sorted(counted, key=lambda r: (r["__old"], r["__class"])):
        old, n = r["__old"], r["n"]
        blocks.setdefault(old, []).append((r["mean"], n))
        first.append((old, r["__class"], at.get(old, 0), -(-n // max(group_rows, isqrt(n)))))
        at[old] = at.get(old, 0) + n
    starts = F.broadcast(spark.createDataFrame(first, "__old int, __class bigint, __first bigint, __groups bigint"))  # a row a size class
    ranges = spark.createDataFrame(_ranges(plan(blocks, shards)), "__old int, __from bigint, __to bigint, shard int, __slot bigint")
    keys = ["__old", "__class", "__group"]
    # __rid differs between repeated rows, so that no group of them lands in one task
    salted = base.join(starts, ["__old", "__class"]).withColumn("__group", F.expr("pmod(xxhash64(__rid), __groups)"))
    sizes = salted.groupBy(*keys).agg(F.count("*").alias("n"))
    before = sizes.select(
        *keys, (F.sum("n").over(Window.partitionBy("__old", "__class").orderBy("__group")) - F.col("n")).alias("__before"),
    )
    ranked = salted.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__size", "__rid")) - 1)
    ranked = ranked.join(before, keys).withColumn("__rank", F.col("__first") + F.col("__before") + F.col("__k"))
    placed = ranked.join(F.broadcast(ranges), "__old").where("__rank >= __from AND __rank < __to")  # at most shards ranges for an old shard
    slot = (F.col("__slot") + F.col("__rank") - F.col("__from")).alias("slot")
    return placed.select(
        *(F.col(f"__c_{k}").alias(k) for k in carry), F.col("__old").alias("old_shard"), F.col("__size").alias("size"), "shard", slot,
    )


def current_shards(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folder of each shard by the table's last manifest; empty for a table that isn't there."""
    log = f"{folder}/_manifests"
    every = commits.numbers(spark, log)
    return {int(k): v for k, v in commits.entry(spark, log, every[-1])["shards"].items()} if every else {}


def read_shards(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table's rows with their shard; null for a table without rows."""
    by_write: dict[str, list[str]] = {}
    for path in current_shards(spark, folder).values():
        by_write.setdefault(path.rsplit("/", 1)[0], []).append(f"{folder}/{path}")
    parts = [spark.read.option("basePath", f"{folder}/{base}").parquet(*paths) for base, paths in sorted(by_write.items())]
    return reduce(DataFrame.unionByName, parts) if parts else None


def write_shards(rows: DataFrame, folder: str, keep: dict[int, str] | None = None, order: str | None = None) -> dict[int, str]:
    """Write rows (with a column shard) to folders of their own, and commit a manifest of them and of the shards in keep.
    order: a column that orders the rows of a file and isn't written.

    Until the manifest is there the table is what it was; of two writers one gets the next manifest, and the other an
    error. Files that no manifest names any more stay for readers of the table before.
    """
    spark = rows.sparkSession
    log, at = f"{folder}/_manifests", f"write-{uuid.uuid4().hex}"
    number = (commits.numbers(spark, log) or [0])[-1] + 1
    rows = rows.sortWithinPartitions("shard", order).drop(order) if order else rows.sortWithinPartitions("shard")
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/{at}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{at}")
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in listed]
    shards = (keep or {}) | {int(n.split("=")[1]): f"{at}/{n}" for n in names if n.startswith("shard=")}
    commits.append(spark, log, {"shards": shards}, number=number)
    return shards


def rewrite(placed: DataFrame, folder: str, rows: DataFrame, key: str = "rid") -> list[int]:
    """Replace the files of the affected shards as reshard() has placed the rows; the others' files stay. Returns the
    shards written.

    folder holds the old table (write_shards), or nothing yet; rows are its rows, and placed has their key (one row a key)
    with shard, old_shard and slot. Shards that got or lost rows are written as wholes to a new place, in order of slots,
    and take the old ones' by one manifest, so every row is in the table once at any time.
    """
    spark = placed.sparkSession
    placed = scratch(placed.select(key, "shard", "old_shard", "slot"), "placed")
    pairs = placed.where("shard != old_shard").select("old_shard", "shard").distinct().collect()  # at most old x new pairs
    held = {r["shard"] for r in placed.select("shard").distinct().collect()}
    changed = {r["shard"] for r in pairs} | {r["old_shard"] for r in pairs}
    before = current_shards(spark, folder)
    shards = sorted(s for s in held if s in changed or s not in before)
    if not shards and not (changed - held) & set(before):
        return []
    own = rows.drop("shard").columns
    slot = unused([*own, "shard"], "__slot")[0]
    new = placed.where(F.col("shard").isin(shards)).select(key, "shard", F.col("slot").alias(slot))
    new = rows.drop("shard").join(new.hint("merge"), key)  # as many rows as the table has: never broadcast
    write_shards(new, folder, {s: p for s, p in before.items() if s in held and s not in shards}, slot)
    return shards


def reshard_documents(
    docs: DataFrame, shards: int = 24, old_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard for documents whose old shards are by source.

    The documents table has no shards of its own; the hash of the source modulo old_shards stands for them. Ids and texts
    are written so, the new shards are planned from the old ones' sizes, the affected files are rewritten, and what is
    returned is read from them. size: UTF-8 bytes of the text (null: none) and 8. The law is rows: shards' counts are at
    most one apart. Null texts and ids stay null; repeated rows are rows like others.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    old = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(source_col), F.lit(old_shards)).cast("int").alias("shard"),
    )
    write_shards(old.withColumn("rid", F.monotonically_increasing_id()), folder)
    table = read_shards(spark, folder)
    if table is None:  # no rows
        table = old.withColumn("rid", F.lit(0).cast("bigint"))
        placed = table.select("rid", F.lit(0).cast("bigint").alias("slot"), F.col("shard").alias("old_shard"))
    else:
        placed = scratch(reshard(table, F.col("shard"), shards, F.octet_length(text) + 8, {"rid": F.col("rid")}), "placement")
        rewrite(placed, folder, table)
        table = read_shards(spark, folder)
    found = table.select(
        "rid", "doc_id", "shard", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    return found.join(placed.select("rid", "slot", "old_shard"), "rid").select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
