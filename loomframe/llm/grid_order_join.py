"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine c or more are at most eps = sqrt(2 - 2c) apart, and so are their projections. Vectors are laid
on a grid of eps along the leading principal dimensions and sorted by cell, dimension by dimension. The sequence is
cut into blocks; two blocks whose cells are more than one apart in any dimension hold no link and never meet. Blocks
that meet are joined recursively: intervals are halved, halves whose boxes are more than eps apart are skipped, and
small intervals are compared by exact cosine in double precision.

Equal vectors (same label) take part once, with their number; a pair of blocks gives back, for each vector, how many
vectors it links to and one link to its local root, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import ddl, scratch, ship
from loomframe.llm.components import connected_components

SUMS = pa.schema([("dim", pa.int32()), ("k", pa.int64()), ("value", pa.float64())])
PLACED = pa.schema(
    [
        ("rid", pa.int64()),
        ("label", pa.int64()),
        ("dim", pa.int32()),
        ("n", pa.int64()),
        ("cells", pa.list_(pa.int64())),
        ("vector", pa.binary()),
    ]
)
BLOCKS = pa.schema(
    [("label", pa.int64()), ("dim", pa.int32()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("data", pa.binary())]
)
FOUND = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
LEAF = 256


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    with np.errstate(over="ignore"):
        norm = np.sqrt((v * v).sum(axis=1))
    odd = ~np.isfinite(norm) | (norm < 1e-150)  # squares beyond what a double holds
    if odd.any():
        v[odd] /= np.abs(v[odd]).max(axis=1)[:, None]
        norm[odd] = np.sqrt((v[odd] * v[odd]).sum(axis=1))
    return v / norm[:, None]


def _by_dim(batch):
    """(dim, row numbers, matrix) for the vectors of a batch."""
    column = batch.column("embedding")
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat[offsets[rows][:, None] + np.arange(dim)[None, :]]


def _sums(it):
    totals: dict[int, np.ndarray] = {}
    for batch in it:
        for dim, _, matrix in _by_dim(batch):
            u = np.hstack([_unit(matrix), np.ones((len(matrix), 1))])
            totals[dim] = totals.get(dim, 0) + u.T @ u
    for dim, m in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m.size, dim, np.int32)), pa.array(np.arange(m.size)), pa.array(m.ravel())], schema=SUMS,
        )


def principal(vectors: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """For each dimensionality the leading directions of the covariance over all vectors (a matrix of dim squared)."""
    rows = vectors.select("embedding").mapInArrow(_sums, ddl(SUMS)).groupBy("dim", "k").agg(F.sum("value").alias("value")).collect()
    out, by_dim = {}, {}
    for r in rows:
        by_dim.setdefault(r["dim"], {})[r["k"]] = r["value"]
    for dim, values in by_dim.items():
        m = np.array([values[k] for k in range((dim + 1) ** 2)]).reshape(dim + 1, dim + 1)
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
        out[dim] = np.ascontiguousarray(axes[:, ::-1][:, :leading])
    return out


def _place(axes, eps, kind):
    def run(it):
        for batch in it:
            n = batch.num_rows
            cells, data, dims = [None] * n, [None] * n, np.zeros(n, np.int32)
            for dim, rows, matrix in _by_dim(batch):
                c = np.floor(_unit(matrix) @ axes.value[dim] / eps).astype(np.int64)
                for i, row in enumerate(rows):
                    cells[row], data[row] = c[i].tolist(), matrix[i].astype(kind).tobytes()
                dims[rows] = dim
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    batch.column("label"),
                    pa.array(dims),
                    batch.column("n"),
                    pa.array(cells, pa.list_(pa.int64())),
                    pa.array(data, pa.binary()),
                ],
                schema=PLACED,
            )

    return run


def _blocks(size):
    """Consecutive rows of a label and dimensionality as one row: ids, numbers and vectors in one array of bytes."""

    def close(key, rows):
        cells = np.array([r[1] for r in rows])
        data = np.array([r[0] for r in rows], "<i8").tobytes() + np.array([r[2] for r in rows], "<i8").tobytes() + b"".join(r[3] for r in rows)
        return (*key, cells.min(axis=0).tolist(), cells.max(axis=0).tolist(), data)

    def run(it):
        key, rows, out = None, [], []
        for batch in it:
            for rid, label, dim, n, cells, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (key != (label, dim) or len(rows) >= size):
                    out.append(close(key, rows))
                    rows = []
                key = (label, dim)
                rows.append((rid, cells, n, vector))
            if out:
                yield _arrow(out, BLOCKS)
                out = []
        if rows:
            yield _arrow([close(key, rows)], BLOCKS)

    return run


def _arrow(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Side:
    """A block: ids, numbers, unit vectors and their projections. kind: of a vector's numbers, <f4 or <f8."""

    def __init__(self, data: bytes, dim: int, axes: np.ndarray, kind: str = "<f4") -> None:
        n = len(data) // (16 + np.dtype(kind).itemsize * dim)
        self.ids = np.frombuffer(data, "<i8", n)
        self.n = np.frombuffer(data, "<i8", n, 8 * n)
        self.unit = _unit(np.frombuffer(data, kind, n * dim, 16 * n).reshape(n, dim))
        self.at = self.unit @ axes
        self.links = np.zeros(n, np.int64)

    def box(self, s: int, e: int):
        part = self.at[s:e]
        return part.min(axis=0), part.max(axis=0)


def join_blocks(a: Side, b: Side, same: bool, least: float, eps: float) -> np.ndarray:
    """Adds to the links of both sides and returns a local root for each row of a, then of b (same: of a alone)."""
    parent = np.arange(len(a.ids) + (0 if same else len(b.ids)))
    shift = 0 if same else len(a.ids)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def leaf(s, e, t, f, own):
        hits = a.unit[s:e] @ b.unit[t:f].T >= least
        if own:
            np.fill_diagonal(hits, False)
        if not hits.any():
            return
        a.links[s:e] += hits @ b.n[t:f]
        if not own:
            b.links[t:f] += a.n[s:e] @ hits
        left, right = np.arange(e - s), np.full(f - t, e - s)
        while True:  # smallest row number that each row and column reaches
            new = np.minimum(right, np.where(hits, left[:, None], e - s).min(axis=0))
            back = np.minimum(left, np.where(hits, new[None, :], e - s).min(axis=1))
            if (new == right).all() and (back == left).all():
                break
            left, right = back, new
        for base, labels in ((s, left), (shift + t, right)):
            for i in np.flatnonzero(labels < e - s):
                x, y = find(base + int(i)), find(s + int(labels[i]))
                if x != y:
                    parent[max(x, y)] = min(x, y)

    def meet(s, e, t, f, own):
        if not own:
            (lo, hi), (lo2, hi2) = a.box(s, e), b.box(t, f)
            gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
            if gap @ gap > eps * eps:
                return
        if e - s <= LEAF and f - t <= LEAF:
            leaf(s, e, t, f, own)
        elif own:
            m = (s + e) // 2
            meet(s, m, s, m, True)
            meet(s, m, m, e, False)
            meet(m, e, m, e, True)
        elif e - s >= f - t:
            m = (s + e) // 2
            meet(s, m, t, f, False)
            meet(m, e, t, f, False)
        else:
            m = (t + f) // 2
            meet(s, e, t, m, False)
            meet(s, e, m, f, False)

    meet(0, len(a.ids), 0, len(b.ids), same)
    return np.array([find(x) for x in range(len(parent))])


def _join(axes, least, eps, kind):
    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                dim, one, two, left, right = (batch.column(c)[k].as_py() for c in ("dim", "one", "two", "left", "right"))
                a = Side(left, dim, axes.value[dim], kind)
                same = one == two
                b = a if same else Side(right, dim, axes.value[dim], kind)
                roots = join_blocks(a, b, same, least, eps)
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                links = a.links if same else np.concatenate([a.links, b.links])
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[roots[some]])], schema=FOUND)

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    leading: int = 6,
    block_rows: int = 2048,
) -> DataFrame:
    """id_col, n_links, component_id, kept: one row per vector.

    Vectors link when their labels are equal and not null and their cosine in double precision is `least` or more. A
    null or zero vector, one with a null or non-finite component, or one without a label links with nothing and is its
    own component. Vectors of different length never link. Repeated rows are rows like others. Null ids never become
    a component_id unless nothing else is in the component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    narrow = dict(vectors.dtypes)[vector_col] == "array<float>"  # other numbers are kept in double precision
    kind = "<f4" if narrow else "<f8"
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).cast(f"array<{'float' if narrow else 'double'}>").alias("embedding"),
        F.col(label_col).cast("bigint").alias("label"),
    )
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good, rest = rows.where(fine), rows.where(~fine)
    distinct = good.groupBy("label", "embedding").agg(F.min("id").alias("least_id"), F.count("*").alias("n"))
    distinct = scratch(distinct.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    axes = spark.sparkContext.broadcast(principal(distinct, leading))  # a matrix of dim x leading
    placed = scratch(distinct.select("rid", "label", "n", "embedding").mapInArrow(_place(axes, eps, kind), ddl(PLACED)), "placed-vectors")
    order = ["label", "dim", "cells", "rid"]
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block_rows), ddl(BLOCKS))
    blocks = scratch(blocks.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    meta = blocks.select("block", "label", "dim", "low", "high")
    near = _meeting(meta)
    one, two = blocks.select(F.col("block").alias("one"), F.col("data").alias("left")), blocks.select(
        F.col("block").alias("two"), F.col("data").alias("right"),
    )
    joined = near.join(one, "one").join(two, "two").select("dim", "one", "two", "left", "right")
    found = scratch(joined.mapInArrow(_join(axes, least, eps, kind), ddl(FOUND)), "vector-links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("rid", "root"), "rid", "root").withColumnRenamed("node", "rid")
    named = distinct.select("rid", "label", "embedding", "n", "least_id").join(parts, "rid", "left").join(links, "rid", "left")
    named = named.withColumn("component", F.coalesce("component", "rid")).withColumn(
        "n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)),
    )
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select("label", "embedding", "n_links", "component_id")
    out = good.join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    out = out.unionByName(rest.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _meeting(meta: DataFrame) -> DataFrame:
    """dim, one, two: pairs of blocks (one <= two) that aren't provably distant: cells at most one apart everywhere.

    Joined on label and the cells of the first two dimensions that a block covers; the rest is a filter.
    """
    def covered(k: int, margin: int):
        return F.sequence(F.col("low")[k] - margin, F.col("high")[k] + margin)

    def spread(df: DataFrame, margin: int) -> DataFrame:
        first = df.withColumn("c1", F.explode(covered(0, margin)))
        return first.withColumn("c2", F.explode(F.when(F.size("low") > 1, covered(1, margin)).otherwise(F.array(F.lit(0).cast("bigint")))))

    a = spread(meta, 0).select(
        "label", "dim", "c1", "c2", F.col("block").alias("one"), F.col("low").alias("low1"), F.col("high").alias("high1"),
    )
    b = spread(meta, 1).select("label", "dim", "c1", "c2", F.col("block").alias("two"), "low", "high")
    apart = F.expr("NOT exists(arrays_zip(low1, high1, low, high), z -> z.low1 > z.high + 1 OR z.low > z.high1 + 1)")
    return a.join(b, ["label", "dim", "c1", "c2"]).where((F.col("one") <= F.col("two")) & apart).select("dim", "one", "two").distinct()
