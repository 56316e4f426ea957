"""Readers: session folders, input logs, label files, image folders. Every reader takes any path that Spark opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomframe.functions.text import blank_to_null, frame_index, frame_timestamp_ms
from loomframe.operators import labels

LOG_FIELDS = ("timestamp_ms", "event_type", "x", "y", "key", "button")
IMAGE_TYPES = ("png", "jpg", "jpeg", "webp")


#: What an event or a review may say.
ACTIONS = ("click", "hover", "press", "drag", "type", "scroll")
REVIEWS = ("pending", "approved", "edited", "rejected")
REVIEW = "struct<review_status:string,review_corrections:string>"


def _documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """session_id, sample_id, body of folder/<session>/samples/sample_*/name; none found: empty."""
    try:
        raw = spark.read.text(f"{folder}/*/samples/sample_*/{name}", wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "session_id string, sample_id string, body string")
    return raw.select(*place(F.input_file_name()), F.col("value").alias("body"))


def place(path: Column) -> tuple[Column, Column]:
    session = F.regexp_extract(path, r"/([^/]+)/samples/[^/]+/[^/]+$", 1)
    return session.alias("session_id"), F.regexp_extract(path, r"/(sample_[^/]+)/[^/]+$", 1).alias("sample_id")


def _folders(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, sample_id, image_path (pre.png, null without one) of sample folders that hold any file."""
    try:
        files = spark.read.format("binaryFile").load(f"{folder}/*/samples/sample_*/*").select("path")  # contents aren't read
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "session_id string, sample_id string, image_path string")
    pre = F.max(F.when(F.col("path").endswith("/pre.png"), F.col("path")))
    files = files.where(F.col("path").rlike(r"/samples/sample_[^/]+/[^/]+$"))  # not those of a folder in it, such as clip
    return files.groupBy(*place(F.col("path"))).agg(pre.alias("image_path"))


def _only(body: Column, kind: str) -> Column:
    """Whether a JSON object has no other keys than the struct type; what isn't an object passes."""
    keys = F.json_object_keys(body)
    return F.coalesce(F.size(F.array_except(keys, F.array(*(F.lit(k) for k in labels.fields(kind))))) == 0, F.lit(True))


def _good_label(body: Column) -> Column:
    """Whether a label file has known keys alone, in all its parts, and names each element."""
    part = lambda k: F.get_json_object(body, f"$.{k}")
    known = F.array(*(F.lit(k) for k in LABEL_KEYS))
    top = F.size(F.array_except(F.json_object_keys(body), known)) == 0
    elements = F.from_json(part("elements"), "array<map<string,string>>")
    own = F.array(*(F.lit(k) for k in labels.fields(labels.ELEMENT_FILE)))
    named = F.forall(elements, lambda e: F.map_contains_key(e, "element_id") & (F.size(F.array_except(F.map_keys(e), own)) == 0))
    return top & _only(part("page"), labels.PAGE) & _only(part("route_label"), labels.ROUTE) & F.coalesce(named, F.lit(True))


LABEL_KEYS = (
    *("page", "route_label", "elements", "evidence", "confidence", "transition_detected", "candidates", *labels.BOX),
    *("semantic_text", "semantic_id", "function_id", "hotkeys", "available_actions", "situation_id", "screen_type"),
)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, sample_id, event, label, review_status (default pending), corrections, metadata, image_path, ord.

    One row per sample folder that holds any file; what it has none of is null, image_path is its pre.png. Flat labels
    come back nested. A sample with a file that can't be read as its kind is left out as a whole: broken JSON, an
    unknown key in event or label, an event without time or known action, an element without id, an unknown review
    status. ord is the place of the sample's name within its session.
    """
    keys = ["session_id", "sample_id"]
    body = F.col("body")
    valid = F.try_parse_json(body).isNotNull()
    event, review = F.from_json(body, labels.EVENT), F.from_json(body, REVIEW)
    kinds = {
        "event": (event, _only(body, labels.EVENT) & event["timestamp_ms"].isNotNull() & event["action"].isin(*ACTIONS)),
        "label": (F.from_json(body, labels.LABEL_FILE), _good_label(body)),
        "review": (review, review["review_status"].isin(*REVIEWS)),
        "metadata": (body, F.lit(True)),
    }
    out = _folders(spark, folder)
    for name, (value, good) in kinds.items():
        found = _documents(spark, folder, f"{name}.json").select(
            *keys, value.alias(name), (valid & F.coalesce(good, F.lit(False))).alias(f"__{name}"),
        )
        out = out.join(found, keys, "left")
    whole = F.least(*(F.coalesce(F.col(f"__{n}"), F.lit(True)) for n in kinds))
    out = labels.nested_label(out.where(whole).withColumnRenamed("label", "__raw"), "__raw")
    status = F.coalesce("review.review_status", F.lit("pending")).alias("review_status")
    metadata = F.when(F.trim("metadata") != "null", F.col("metadata")).alias("metadata")
    out = out.select(*keys, "event", "label", status, F.col("review.review_corrections").alias("corrections"), metadata, "image_path")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("sample_id")) - 1)


def input_log_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Input events; a missing type is click; keys that have no column go to metadata, none of them: null."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    m = F.from_json("value", "map<string,string>")
    rest = F.map_filter(m, lambda k, v: ~k.isin(*LOG_FIELDS))
    get = lambda k: F.try_element_at(m, F.lit(k))
    return raw.select(
        get("timestamp_ms").cast("double").alias("timestamp_ms"),
        F.coalesce(get("event_type"), F.lit("click")).alias("event_type"),
        get("x").cast("double").alias("x"),
        get("y").cast("double").alias("y"),
        get("key").alias("key"),
        get("button").alias("button"),
        F.when(F.size(F.map_keys(rest)) > 0, rest).alias("metadata"),
    )


def input_log_csv(
    spark: SparkSession,
    path: str,
    ts_col: str = "timestamp_ms",
    type_col: str = "event_type",
    x_col: str = "x",
    y_col: str = "y",
    key_col: str = "key",
    button_col: str = "button",
) -> DataFrame:
    """Input events from CSV with named columns; empty cells are null, a missing type column means click."""
    raw = spark.read.csv(path, header=True)
    cell = lambda c, kind="string": (blank_to_null(F.col(c)) if c in raw.columns else F.lit(None)).cast(kind)
    return raw.select(
        cell(ts_col, "double").alias("timestamp_ms"),
        F.coalesce(cell(type_col), F.lit("click")).alias("event_type"),
        cell(x_col, "double").alias("x"),
        cell(y_col, "double").alias("y"),
        cell(key_col).alias("key"),
        cell(button_col).alias("button"),
    )


GROUNDING = "image_path string, prompt string, bbox array<double>, image_id string"


def grounding_jsonl(spark: SparkSession, path: str, image_root: str | None = None) -> DataFrame:
    """Grounding rows; one without path, prompt or a box of four is an error that quotes it. image_id: the file name."""
    raw = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", GROUNDING).alias("r"))
    good = F.coalesce(F.col("r.image_path").isNotNull() & F.col("r.prompt").isNotNull() & (F.size("r.bbox") == 4), F.lit(False))
    checked = raw.where(
        F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad grounding line: "), F.col("value"))).cast("boolean"))
    )
    image = F.col("r.image_path")
    full = image if image_root is None else F.when(image.startswith("/"), image).otherwise(
        F.concat(F.lit(image_root.rstrip("/") + "/"), image)
    )
    return checked.select(
        full.alias("image_path"), "r.prompt", "r.bbox", F.coalesce("r.image_id", F.substring_index(image, "/", -1)).alias("image_id"),
    )


def router_csv(spark: SparkSession, path: str, label_col: str = "primitive_id") -> DataFrame:
    """Router rows; label and image_path are mandatory columns, other nulls become empty."""
    raw = spark.read.csv(path, header=True)
    for c in (label_col, "image_path"):
        if c not in raw.columns:
            raise ValueError(f"missing column: {c}")
    return raw.na.fill("")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of a COCO document."""
    kind = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int,score:double>>, categories array<struct<id:long,name:string>>"
    doc = spark.read.schema(kind).json(path, multiLine=True)
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, rank of images in order of type, then path."""
    every = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(IMAGE_TYPES) + "}").load(folder).select("path")
    kind = F.lower(F.substring_index("path", ".", -1))
    return every.withColumn("type_rank", F.array_position(F.array(*(F.lit(t) for t in IMAGE_TYPES)), kind)).orderBy("type_rank", "path")


def frame_files(spark: SparkSession, folder: str, fps: float) -> DataFrame:
    """frame_path, frame_index (first digits of the name), frame_ts_ms."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(IMAGE_TYPES) + "}").load(folder)
    index = frame_index(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))
    return files.select(
        F.col("path").alias("frame_path"), index.alias("frame_index"), frame_timestamp_ms(index, F.lit(float(fps))).alias("frame_ts_ms"),
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (BGR bytes) by the engine's own image source."""
    return spark.read.format("image").option("dropInvalid", True).load(folder)


def images_base64(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", F.base64("content").alias("data"))


def json_log(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Append logs (failures, review queue, metrics, preferences); a missing path is an empty log."""
    try:
        out = spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return out if limit is None else out.limit(limit)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document (tool profile, model package file) as a row."""
    return spark.read.json(path, multiLine=True)
