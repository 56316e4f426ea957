"""What flows decide about samples, laid over the session folder when it is read.

A store is a folder of tables that are only added to. A flow writes the rows of a part to a folder of their own and then
commits that folder by an entry of the store's log; what isn't committed isn't there, so a run that fails half way or is
repeated changes nothing that others see. Parts are

* event: event, image_path of samples that no session folder has,
* label: the whole nested label,
* review: review_status, corrections (JSON, null: none),
* metadata: key and value (JSON) of a top-level entry of a sample's metadata.

Of the rows of a sample (metadata: and key) the one of the latest commit holds. compact() writes those once more into one
folder, from which reading then starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import labels
from loomframe.sources import commits, readers

KEYS = ["session_id", "sample_id"]
#: Columns of each part after the keys.
PARTS = {
    "event": f"event {labels.EVENT}, image_path string",
    "label": f"label {labels.LABEL}",
    "review": "review_status string, corrections string",
    "metadata": "key string, value string",
}


def _schema(part: str) -> str:
    return f"session_id string, sample_id string, {PARTS[part]}"


def _keys(part: str) -> list[str]:
    return [*KEYS, "key"] if part == "metadata" else KEYS


def save(store: str, **parts: DataFrame) -> int:
    """Append rows of one or more parts (session_id, sample_id and the part's columns) in one commit; returns its number."""
    written = {}
    for name, rows in parts.items():
        spark = rows.sparkSession
        kept = rows.to(spark.createDataFrame([], _schema(name)).schema)
        written[name] = f"{name}/{uuid.uuid4().hex}"
        kept.write.parquet(f"{store}/{written[name]}")
    return commits.append(spark, f"{store}/_log", {"add": written})


def live(spark: SparkSession, store: str, part: str) -> list[tuple[int, str]]:
    """(version, folder) of the folders that hold a part."""
    found: list[tuple[int, str]] = []
    for number, entry in commits.read(spark, f"{store}/_log"):
        if part in entry.get("add", {}):
            found.append((number, f"{store}/{entry['add'][part]}"))
        if part in entry.get("compact", {}):
            folded = entry["compact"][part]  # holds the commits up to one of them, which may lie before others
            found = [(folded["upto"], f"{store}/{folded['path']}"), *((n, p) for n, p in found if n > folded["upto"])]
    return found


def current(spark: SparkSession, store: str, part: str) -> DataFrame:
    """The row that holds of each sample (metadata: and key), and its version."""
    rows = spark.createDataFrame([], f"{_schema(part)}, version bigint")
    for number, folder in live(spark, store, part):
        rows = rows.unionByName(spark.read.schema(_schema(part)).parquet(folder).withColumn("version", F.lit(number).cast("bigint")))
    keys = _keys(part)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, store: str) -> list[str]:
    """Write every part of several folders into one; returns the parts. Appends that run meanwhile are kept."""
    done = {}
    for part in PARTS:
        folders = live(spark, store, part)
        if len(folders) > 1:
            path = f"{part}/{uuid.uuid4().hex}"
            current(spark, store, part).drop("version").write.parquet(f"{store}/{path}")
            done[part] = {"path": path, "upto": folders[-1][0]}
    if done:
        commits.append(spark, f"{store}/_log", {"compact": done})
    return sorted(done)


def vacuum(spark: SparkSession, store: str) -> int:
    """Delete folders of parts that aren't read any more; returns their number. Not while flows run."""
    gone = 0
    for part in PARTS:
        kept = {p.rsplit("/", 1)[1] for _, p in live(spark, store, part)}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{part}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in files.listStatus(path) if files.exists(path) else ():
            if s.getPath().getName() not in kept:
                files.delete(s.getPath(), True)
                gone += 1
    return gone


def merged(spark: SparkSession, folder: str, store: str | None = None) -> DataFrame:
    """readers.sessions() with what the store holds: labels and reviews in place of a sample's own, metadata by key."""
    rows = readers.sessions(spark, folder).drop("ord")
    if store is None:
        return rows
    event, label, review, metadata = (current(spark, store, p).drop("version") for p in ("event", "label", "review", "metadata"))
    told = lambda df, *names: df.select(*KEYS, *(F.col(n).alias(f"__{n}") for n in names), F.lit(True).alias("__told"))
    rows = rows.join(told(event, "event", "image_path").drop("__told"), KEYS, "full")
    rows = rows.withColumn("event", F.coalesce("event", "__event")).withColumn("image_path", F.coalesce("image_path", "__image_path"))
    rows = rows.join(told(label, "label").drop("__told"), KEYS, "left").withColumn("label", F.coalesce("__label", "label"))
    rows = rows.join(told(review, "review_status", "corrections"), KEYS, "left")
    rows = rows.withColumn("corrections", F.when(F.col("__told"), F.col("__corrections")).otherwise(F.col("corrections")))
    rows = rows.withColumn("review_status", F.coalesce("__review_status", "review_status", F.lit("pending")))
    entries = F.map_from_entries(F.collect_list(F.struct("key", F.parse_json("value"))))
    rows = rows.join(metadata.groupBy(*KEYS).agg(entries.alias("__new")), KEYS, "left")
    own = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,variant>")
    both = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key("__new", k)), F.col("__new"))
    rows = rows.withColumn("metadata", F.when(F.col("__new").isNull(), F.col("metadata")).otherwise(F.to_json(both)))
    return rows.select(*KEYS, "event", "label", "review_status", "corrections", "metadata", "image_path")


def decide(spark: SparkSession, store: str, decisions: DataFrame) -> int:
    """Approve, reject or edit: session_id, sample_id, review_status, corrections (JSON or null). Returns the commit.

    An unknown status, a null sample or corrections without an edit are an error, and nothing is written.
    """
    status = F.col("review_status")
    bad = (
        ~F.coalesce(status.isin("approved", "rejected", "edited"), F.lit(False))
        | F.col("session_id").isNull()
        | F.col("sample_id").isNull()
        | (F.col("corrections").isNotNull() & ((status != "edited") | F.json_object_keys("corrections").isNull()))
    )
    wrong = decisions.where(bad).limit(1).collect()
    if wrong:
        raise ValueError(f"not a decision: {wrong[0]}")
    return save(store, review=decisions.select(*KEYS, "review_status", "corrections"))
