"""What the training-data operators share: shipping the package, scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: SparkContexts (by application id) that already have the package.
_SHIPPED: set[str] = set()
#: Scratch tables by application id.
_WRITTEN: dict[str, list[str]] = {}


#: Most bytes and rows of an Arrow batch: batches hold whole texts, and the rows that Spark takes for one by itself may
#: be gigabytes.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it, and lower this
    session's limits for Arrow batches to BATCH_BYTES and BATCH_ROWS where they are higher."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="loomframe-"), "loomframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder of our own in
    local mode (tests), and an error on a cluster, whose executors don't share local folders."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomframe-checkpoint-")
        sc.setCheckpointDir(base)
    return base


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    base = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)


#: Session setting by which Spark deletes a query's shuffle files once the query is done.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write df once as a compressed table in the shared folder and read it back with its columns prunable.

    free: delete the shuffle files of the writing when it is done, for a df that is run this once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomframe-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_FREE, "false")
    try:
        spark.conf.set(_FREE, str(free or before == "true").lower())
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for several tables; drop_scratch deletes it like a scratch table."""
    path = f"{shared_dir(spark).rstrip('/')}/loomframe-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> int:
    """Delete the scratch tables that this application has written, but for the first `since` and those in keep (paths);
    returns their number.

    The DataFrames that operators return still read them, so call this once their results are written.
    """
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = [p for p in paths[since:] if p not in set(keep)]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)
    return len(gone)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Paths of the scratch tables that this application has written and not deleted."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of the columns (case doesn't tell)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield to_batch(part, schema)
            part = []
    if part:
        yield to_batch(part, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def per_document(fn: Callable[[str], tuple], schema: pa.Schema, keep: tuple[str, ...] = ("doc_id",)):
    """A mapInArrow function: fn's values for every text, beside the columns in keep."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            values = list(zip(*map(fn, texts(batch)), strict=True))
            own = [pa.array(v, f.type) for v, f in zip(values, list(schema)[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).cast(schema.field(k).type) for k in keep] + own, schema=schema)

    return run


def released(run: Callable) -> Callable:
    """A mapInArrow function that gives the memory it has freed back to the system when a task ends. Workers live on
    and go from stage to stage, and what the allocator keeps counts against the executor."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return task


def ddl(schema: pa.Schema) -> str:
    """The same schema for Spark."""
    plain = {
        pa.int64(): "bigint",
        pa.int32(): "int",
        pa.float64(): "double",
        pa.string(): "string",
        pa.bool_(): "boolean",
        pa.binary(): "binary",
    }
    names = plain | {pa.list_(t): f"array<{name}>" for t, name in plain.items()}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def bytes_of(obj) -> bytes:
    """numpy archive of a dict of arrays."""
    import numpy as np

    buffer = io.BytesIO()
    np.savez(buffer, **obj)
    return buffer.getvalue()
