"""Exports: router CSV, routing JSONL, COCO, YOLO, grounding, region states, append logs.

Frames of rows come first (each a DataFrame that a query can check), files after.
Input rows hold sample_id, session_id, ord, label (effective), review_status, flags, image_path (null: no frame),
width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, corner_crop, xyxy_to_xywh
from loomframe.functions.text import first_nonzero, first_truthy, numeric_suffix
from loomframe.operators.labels import flat_fields, roi_crop, routing_record
from loomframe.operators.quality import is_duplicate
from loomframe.operators.split import by_session, head_tail, numbered
from loomframe.runtime import checkpoint
from loomframe.sources import image_files


def with_frame(rows: DataFrame) -> DataFrame:
    """Labeled rows that aren't rejected and have a frame."""
    return rows.where(F.col("label").isNotNull() & (F.col("review_status") != "rejected") & F.col("image_path").isNotNull())


def router_rows(rows: DataFrame) -> DataFrame:
    """The six router columns of eligible rows: also not a duplicate and with a primitive; null ids become empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    label = F.col("label")
    out = with_frame(rows).where(~is_duplicate(F.col("flags")) & (text(label["route_label"]["primitive_id"]) != ""))
    return out.select(
        "sample_id",
        "image_path",
        label["route_label"]["primitive_id"].alias("primitive_id"),
        text(label["page"]["situation_id"]).alias("situation_id"),
        text(label["page"]["screen_type"]).alias("screen_type"),
        "session_id",
    )


def router_split(rows: DataFrame) -> DataFrame:
    return by_session(router_rows(rows), "session_id", "sample_id", numeric_suffix(F.col("sample_id")))


#: Regions of a crop where neither the label nor its situation names one that is known.
ROI_FALLBACKS = ["bottom_right", "popup_center", "unit_panel", "main_map"]
PARTS = ("train", "val")


def _write_parts(split: DataFrame, folder: str) -> None:
    """labels, train and val CSV folders."""
    split.drop("split").write.mode("overwrite").csv(f"{folder}/labels.csv", header=True)
    for part in PARTS:
        split.where(F.col("split") == part).drop("split").write.mode("overwrite").csv(f"{folder}/{part}.csv", header=True)


def router_crops(rows: DataFrame, situations: DataFrame, rois: DataFrame, fallbacks: list[str] | None = None) -> DataFrame:
    """sample_id, image_path, crop of the eligible router rows: the region of interest in pixels."""
    kept = rows.join(router_rows(rows).select("sample_id"), "sample_id", "left_semi")
    return roi_crop(kept, situations, rois, "width", "height", fallbacks or ROI_FALLBACKS).select("sample_id", "image_path", "crop")


def write_router_full(rows: DataFrame, folder: str) -> DataFrame:
    """images and the CSV parts, whose image_path is the copy; rows whose image isn't there are left out. Returns them."""
    split = checkpoint(router_split(rows))
    named = split.select(_image_name(), "image_path")
    return _finish(split, image_files.write_copies(named, f"{folder}/images"), folder)


def write_router_roi(rows: DataFrame, folder: str, situations: DataFrame, rois: DataFrame, fallbacks: list[str] | None = None) -> DataFrame:
    """As write_router_full, with the crop of each image."""
    split = checkpoint(router_split(rows))
    boxes = router_crops(rows, situations, rois, fallbacks).select(_image_name(), "image_path", "crop")
    return _finish(split, image_files.write_crops(boxes, f"{folder}/images"), folder)


def _image_name() -> Column:
    return F.concat("sample_id", F.lit(".png")).alias("name")


def write_router(rows: DataFrame, folder: str, situations: DataFrame, rois: DataFrame, fallbacks: list[str] | None = None) -> None:
    """Both variants, under full and roi."""
    write_router_full(rows, f"{folder}/full")
    write_router_roi(rows, f"{folder}/roi", situations, rois, fallbacks)


def _with_files(split: DataFrame, written: DataFrame) -> DataFrame:
    """Rows whose file is written, with its path as image_path."""
    written = checkpoint(written.where("path IS NOT NULL").select("name", "path"))
    by_name = written.select(F.regexp_replace("name", r"\.png$", "").alias("sample_id"), F.col("path").alias("image_path"))
    return split.drop("image_path").join(by_name, "sample_id").select(*split.columns)


def _finish(split: DataFrame, written: DataFrame, folder: str) -> DataFrame:
    out = _with_files(split, written)
    _write_parts(out, folder)
    return out


def routing_rows(rows: DataFrame) -> DataFrame:
    """sample_id, record (JSON with nulls) of rows that are neither rejected nor duplicates; a frame isn't needed."""
    kept = rows.where(F.col("label").isNotNull() & (F.col("review_status") != "rejected") & ~is_duplicate(F.col("flags")))
    return kept.select(
        "sample_id",
        F.to_json(
            routing_record(F.col("sample_id"), F.col("event"), F.col("label"), F.col("metadata")), {"ignoreNullFields": "false"},
        ).alias("record"),
    )


def write_text(rows: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)


def elements(rows: DataFrame) -> DataFrame:
    """sample_id, ord, at, e, label, width, height: elements of eligible rows that aren't disabled."""
    out = with_frame(rows).select(
        "sample_id", "ord", "label", "image_path", "width", "height", F.posexplode("label.elements").alias("at", "e"),
    )
    return out.where(F.coalesce(F.col("e.enabled_state") != "disabled", F.lit(True)))


def box_of(e: Column | str) -> Box:
    return Box.of(e, ("bbox_x_min", "bbox_y_min", "bbox_x_max", "bbox_y_max"))


def category(names: list[str], e: Column, first: int) -> Column:
    """Number of the element's semantic id among the names, the first name's number where it isn't there."""
    at = F.array_position(F.array(*(F.lit(n) for n in names)), e["semantic_id"])
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1 + first).otherwise(F.lit(first).cast("long"))


def register_categories(existing: DataFrame, names: list[str]) -> DataFrame:
    """id, name: the categories of a document and one more for each name, numbered on from their count. A name that the
    document has already gets another number, as the original gives it."""
    start = existing.count() + 1
    new = existing.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names, start)], "id bigint, name string")
    return existing.select(F.col("id").cast("bigint").alias("id"), "name").unionByName(new)


def coco_annotations(rows: DataFrame, names: list[str]) -> DataFrame:
    """image_no, annotation_no, category_id, x, y, w, h, area, score; numbers from 1 in sample order."""
    images = numbered(
        with_frame(rows).select("sample_id", "ord"), ["ord"], "image_no",
    ).select("sample_id", (F.col("image_no") + 1).alias("image_no"))
    every = numbered(elements(rows), ["ord", "at"], "annotation_no")
    parts = xyxy_to_xywh(box_of("e"))
    return every.join(images, "sample_id").select(
        "image_no",
        (F.col("annotation_no") + 1).alias("annotation_no"),
        category(names, F.col("e"), 1).alias("category_id"),
        *(c.alias(n) for n, c in parts.items()),
        first_nonzero(F.col("e.confidence"), F.col("label.confidence")).alias("score"),
    )


def coco_parts(rows: DataFrame, names: list[str], path: str) -> None:
    """images, annotations and categories as JSON lines folders: the document in parts, so it may have any size."""
    images = numbered(with_frame(rows).select("image_path", "width", "height", "ord"), ["ord"], "id").select(
        (F.col("id") + 1).alias("id"), F.col("image_path").alias("file_name"), "width", "height",
    )
    a = coco_annotations(rows, names)
    annotations = a.select(
        F.col("annotation_no").alias("id"),
        F.col("image_no").alias("image_id"),
        "category_id",
        F.array("x", "y", "w", "h").alias("bbox"),
        "area",
        F.lit(0).alias("iscrowd"),
        "score",
    )
    categories = rows.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names, 1)], "id int, name string")
    for name, part in (("images", images), ("annotations", annotations), ("categories", categories)):
        part.write.mode("overwrite").json(f"{path}/{name}")


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with the whole document; for exchange files, which fit a single JSON text by their nature."""
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return pack(images, "images").crossJoin(pack(annotations, "annotations")).crossJoin(pack(categories, "categories")).select(
        F.to_json(F.struct("images", "annotations", "categories")).alias("value")
    )


def yolo_lines(rows: DataFrame, names: list[str]) -> DataFrame:
    """sample_id, lines: one text per eligible sample, a line per proper box, six decimals."""
    b, w, h = box_of("e"), F.col("width"), F.col("height")
    line = F.format_string(
        "%d %.6f %.6f %.6f %.6f",
        category(names, F.col("e"), 0),
        (b.x1 + b.x2) / 2.0 / w,
        (b.y1 + b.y2) / 2.0 / h,
        (b.x2 - b.x1) / w,
        (b.y2 - b.y1) / h,
    )
    kept = elements(rows).where((b.x2 > b.x1) & (b.y2 > b.y1)).select("sample_id", F.struct("at", line.alias("line")).alias("l"))
    lines = kept.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("lines"))  # one screen's elements
    return with_frame(rows).select("sample_id", "ord").join(lines, "sample_id", "left").withColumn("lines", F.coalesce("lines", F.lit("")))


def write_yolo(rows: DataFrame, names: list[str], folder: str, share: float = 0.9) -> None:
    """images, labels (a text a sample, each in one folder), train and val lists of the images that are there, data.yaml."""
    kept = checkpoint(with_frame(rows).select("sample_id", "ord", "image_path"))
    written = image_files.write_copies(kept.select(_image_name(), "image_path"), f"{folder}/images")
    there = checkpoint(_with_files(kept, written))
    lines = yolo_lines(rows, names).join(there.select("sample_id"), "sample_id", "left_semi")
    text = F.when(F.col("lines") == "", "").otherwise(F.concat("lines", F.lit("\n")))
    files = lines.select(F.concat("sample_id", F.lit(".txt")).alias("name"), text.cast("binary").alias("content"))
    image_files.write_files(files, f"{folder}/labels").count()
    split = checkpoint(head_tail(there.select("sample_id", "ord"), ["ord"], share))
    for part in ("train", "val"):
        split.where(F.col("split") == part).select(
            F.concat(F.lit("images/"), "sample_id", F.lit(".png")).alias("value")
        ).write.mode("overwrite").text(f"{folder}/{part}.txt")
    data = f"path: {folder}\ntrain: train.txt\nval: val.txt\nnc: {len(names)}\nnames: [{', '.join(names)}]"
    rows.sparkSession.createDataFrame([(data,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/data.yaml")


def grounding_rows(rows: DataFrame, top: int = 1000) -> DataFrame:
    """One row per proper element: box cut to whole parts of `top`, prompt the first of five that isn't empty."""
    b, w, h, e, label = box_of("e"), F.col("width"), F.col("height"), F.col("e"), F.col("label")
    part = lambda v, size: (v / size * top).cast("int")
    prompt = first_truthy(
        e["semantic_text"], e["semantic_id"], e["function_id"], label["route_label"]["primitive_id"], F.lit("interactive_element"),
    )
    return elements(rows).where((b.x2 > b.x1) & (b.y2 > b.y1)).select(
        "sample_id",
        "at",
        "image_path",
        prompt.alias("prompt"),
        F.array(part(b.x1, w), part(b.y1, h), part(b.x2, w), part(b.y2, h)).alias("bbox"),
        e["semantic_id"].alias("semantic_id"),
        e["function_id"].alias("function_id"),
        label["route_label"]["primitive_id"].alias("primitive_id"),
        label["page"]["situation_id"].alias("situation_id"),
        first_nonzero(e["confidence"], label["confidence"]).alias("confidence"),
    )


def region_states(rows: DataFrame) -> DataFrame:
    """sample_id, session_id, ord, turn_state (correction, metadata, situation, primitive, element, unknown), crop."""
    label, flat = F.col("label"), flat_fields(F.col("label"))
    state = first_truthy(
        F.get_json_object("corrections", "$.turn_state"),
        F.get_json_object("metadata", "$.turn_state"),
        label["page"]["situation_id"],
        label["route_label"]["primitive_id"],
        flat["semantic_id"],
        F.lit("unknown"),
    )
    return with_frame(rows).select(
        "sample_id", "session_id", "ord", state.alias("turn_state"), corner_crop(F.col("width"), F.col("height")).struct().alias("crop"),
    )


def region_split(rows: DataFrame, share: float = 0.9) -> DataFrame:
    """region_states with split: the first int(n * share) in order are train."""
    return head_tail(region_states(rows), ["ord"], share)


def write_region_states(rows: DataFrame, folder: str) -> DataFrame:
    """The corner crops under images, and labels, train and val CSV folders of the rows whose crop is there. Returns them."""
    own = region_states(rows).join(with_frame(rows).select("sample_id", "image_path"), "sample_id")
    states = checkpoint(own.where("crop IS NOT NULL"))
    written = image_files.write_crops(states.select(_image_name(), "image_path", "crop"), f"{folder}/images")
    there = checkpoint(_with_files(states.drop("crop"), written))
    split = head_tail(there, ["ord"], 0.9).select("sample_id", "image_path", "turn_state", "session_id", "split")
    _write_parts(split, folder)
    return split


def click_boxes(pairs: DataFrame, names: list[str], radius: float = 64.0) -> DataFrame:
    """COCO annotations of matched clicks: a box about the point, score 0.5; an unknown label counts as the first name.

    pairs: event_id, frame_path, x, y, auto_label. image_no follows the first appearance of the file name.
    """
    zero = F.lit(0.0)
    first = pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy("frame_path").agg(F.min("event_id").alias("__first"))
    images = numbered(first, ["__first"], "image_no").select("frame_path", (F.col("image_no") + 1).alias("image_no"))
    at = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("auto_label"))
    b = Box(F.greatest(zero, F.col("x") - radius), F.greatest(zero, F.col("y") - radius), F.col("x") + radius, F.col("y") + radius)
    return pairs.where("x IS NOT NULL AND y IS NOT NULL").join(images, "frame_path").select(
        "event_id",
        "image_no",
        F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(1).cast("long")).alias("category_id"),
        *(c.alias(n) for n, c in xyxy_to_xywh(b).items()),
        F.lit(0.5).alias("score"),
    )


def grounding_pairs(pairs: DataFrame, radius: float = 64.0) -> DataFrame:
    """event_id, frame_path, text, box of matched clicks with a point; text is the label or the event type."""
    zero = F.lit(0.0)
    box = F.array(F.greatest(zero, F.col("x") - radius), F.greatest(zero, F.col("y") - radius), F.col("x") + radius, F.col("y") + radius)
    return pairs.where("x IS NOT NULL AND y IS NOT NULL").select(
        "event_id", "frame_path", F.coalesce("auto_label", "event_type").alias("text"), box.alias("bbox"),
    )


def correction_boxes(queue: DataFrame, default: str) -> DataFrame:
    """frame_id, image_path, label, box of reviewed rows with corrections (JSON with boxes)."""
    kind = "array<struct<label:string,bbox:array<double>>>"
    out = queue.where(F.col("reviewed") & F.col("corrections").isNotNull()).select(
        "frame_id", "image_path", F.explode(F.from_json(F.get_json_object("corrections", "$.boxes"), kind)).alias("b"),
    )
    return out.select("frame_id", "image_path", F.coalesce("b.label", F.lit(default)).alias("label"), F.col("b.bbox").alias("bbox"))


def candidate_annotations(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """image_no, annotation_no, category_id (1), x, y, w, h, area, score (0.5) of prelabelled boxes, numbered from 1.

    images: key, ord; boxes: key, at, x1, y1, x2, y2. Images without a box keep their number.
    """
    placed = numbered(images.select(key, "ord"), ["ord"], "__image")
    every = numbered(placed.join(boxes.select(key, "at", "x1", "y1", "x2", "y2"), key), ["__image", "at"], "__annotation")
    parts = [c.alias(n) for n, c in xyxy_to_xywh(Box.cols()).items()]
    numbers = [(F.col("__image") + 1).alias("image_no"), (F.col("__annotation") + 1).alias("annotation_no")]
    return every.select(*numbers, F.lit(1).cast("long").alias("category_id"), *parts, F.lit(0.5).alias("score"))


def clip_files(samples: DataFrame) -> DataFrame:
    """name, image_path of the clip files of recorded samples: pre_NNN and post_NNN in order of time, and post_effect
    (the frame at place effect) and post_stable (the last) of samples with a post clip.

    samples: sample_id, pre_clip, post_clip (arrays of paths), effect (place in post_clip, null: the first). Copy them
    with image_files.write_copies.
    """
    item = lambda part, i, path: F.struct(F.format_string("%s_%03d", F.lit(part), i).alias("part"), path.alias("image_path"))
    clip = lambda part: F.transform(F.coalesce(f"{part}_clip", F.array().cast("array<string>")), lambda p, i: item(part, i, p))
    last = F.size("post_clip") - 1
    named = lambda name, at: F.struct(F.lit(name).alias("part"), F.get("post_clip", at).alias("image_path"))
    picks = F.when(last >= 0, F.array(named("post_effect", F.coalesce("effect", F.lit(0))), named("post_stable", last)))
    every = F.concat(clip("pre"), clip("post"), F.coalesce(picks, F.array().cast("array<struct<part:string,image_path:string>>")))
    rows = samples.select("sample_id", F.explode(every).alias("f"))
    return rows.select(
        F.concat("sample_id", F.lit("/clip/"), F.col("f.part"), F.lit(".png")).alias("name"), F.col("f.image_path").alias("image_path"),
    )


FAILURE_ELEMENTS = "array<struct<class_name:string,x1:double,y1:double,x2:double,y2:double,score:double>>"


def failure_annotations(failures: DataFrame, names: list[str] | None = None) -> DataFrame:
    """image_no, annotation_no, category_id, x, y, w, h, area, score of failures' elements, numbered in order from 1.

    failures: ord, elements (FAILURE_ELEMENTS). Every failure takes an image number, even one whose image is gone. An
    unknown class counts as the first name (default: button).
    """
    names = names or ["button"]
    placed = numbered(failures.select("ord", "elements"), ["ord"], "__image")
    every = numbered(placed.select("__image", F.posexplode("elements").alias("__at", "e")), ["__image", "__at"], "__annotation")
    at = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("e.class_name"))
    category = F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(1).cast("long"))
    parts = [c.alias(n) for n, c in xyxy_to_xywh(Box.of("e")).items()]
    return every.select(
        (F.col("__image") + 1).alias("image_no"),
        (F.col("__annotation") + 1).alias("annotation_no"),
        category.alias("category_id"),
        *parts,
        F.col("e.score").alias("score"),
    )


def failure_images(failures: DataFrame, files: DataFrame, stored: str) -> DataFrame:
    """id, file_name of failures whose image is there: the stored copy (stored/frame_id.png), else the original path.

    failures: ord, frame_id, image_path; files: path of every file that exists.
    """
    placed = numbered(failures.select("ord", "frame_id", "image_path"), ["ord"], "__image")
    own = F.concat(F.lit(stored.rstrip("/") + "/"), "frame_id", F.lit(".png"))
    there = files.select("path").distinct()
    found = placed.withColumn("__own", own)
    found = found.join(there.select(F.col("path").alias("__a")), F.col("__own") == F.col("__a"), "left")
    found = found.join(there.select(F.col("path").alias("__b")), F.col("image_path") == F.col("__b"), "left")
    return found.select((F.col("__image") + 1).alias("id"), F.coalesce("__a", "__b").alias("file_name")).where("file_name IS NOT NULL")


def extract_manifest(raw: DataFrame, kept: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row of counts of an extraction: raw, dedup, dropped and sample."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(raw, "raw_count").crossJoin(n(kept, "dedup_count")).crossJoin(n(sampled, "sample_count"))  # one row each
    return counts.select("raw_count", "dedup_count", (F.col("raw_count") - F.col("dedup_count")).alias("dropped_count"), "sample_count")


def failure_reviews(failures: DataFrame) -> DataFrame:
    """Review rows of failures: 1 - least score, 1 without elements."""
    return failures.withColumn("uncertainty", 1 - F.coalesce(F.array_min("scores"), F.lit(0.0)))


def append_log(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; judgments of one run overwrite, all other logs append."""
    rows.write.mode("overwrite" if overwrite else "append").json(path)


def stats_report(counts: DataFrame, key: str) -> DataFrame:
    """line: counts from large to small, then by name."""
    return counts.orderBy(F.desc("n"), key).select(F.format_string("  %s: %d", F.col(key), F.col("n")).alias("line"))


def leaderboard(trials: DataFrame, score: str, name: str) -> DataFrame:
    """trials with place by falling score."""
    w = Window.orderBy(F.desc(score), name)
    return trials.withColumn("place", F.row_number().over(w))  # a search has tens of trials


def leaderboard_table(trials: DataFrame, score: str, name: str) -> DataFrame:
    """place, line: the leaderboard as text, a line a trial."""
    placed = leaderboard(trials, score, name)
    return placed.select(
        "place",
        F.format_string("%3d  %-24s  %8.4f", F.col("place"), F.col(name).cast("string"), F.col(score).cast("double")).alias("line"),
    )
