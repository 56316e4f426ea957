"""Model boundaries: teacher labels, prelabels, detectors, and the flows around them.

A model is a Python callable that the caller brings; it runs once a worker in pandas batches, and everything before
and after it is columns. The default teacher answers nothing, so that every flow also runs offline.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, guess_pixels, semantic_id, valid
from loomframe.functions.text import lookup
from loomframe.operators.dedup import suppress_overlaps

CHOICE = "primitive_id string, situation_id string, screen_type string, roi_name string, confidence double"
#: What a teacher may answer besides: a box, evidence and ranked candidates, kept as JSON.
DETAILS = "roi_bbox_norm array<double>, function_id string, evidence string, candidates string"
BOXES = "prompt string, label string, x1 double, y1 double, x2 double, y2 double, score double"


def offline(payload: str) -> dict | None:
    """The teacher without a teacher."""
    return None


def with_retries(call: Callable, retries: int = 3, first_wait: float = 0.8) -> Callable:
    """The call again after a fault, each wait twice the one before; null once all tries are used up."""

    def run(payload):
        for k in range(retries):
            try:
                return call(payload)
            except Exception:
                if k + 1 < retries:
                    time.sleep(first_wait * 2**k)
        return None

    return run


def payload(sample_id: Column, event: Column, primitives: list[str], situations: list[str], **more: Column) -> Column:
    """JSON request for one sample: the event and the ids to choose from, and what else is given by name (such as
    metadata, current_label, rois, pre_image_b64); a null part is left out."""
    words = lambda v: F.array(*(F.lit(x) for x in v)) if v else F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            sample_id.alias("sample_id"),
            event.alias("event"),
            words(primitives).alias("primitives"),
            words(situations).alias("situations"),
            *(c.alias(n) for n, c in more.items()),
        )
    )


def teach(rows: DataFrame, key: str, request: str, teacher: Callable = offline, retries: int = 3) -> DataFrame:
    """key, chosen (null: no answer), attempted for each row; the teacher sees the request column.

    An answer is a dict of CHOICE and DETAILS, any of which may be missing.
    """
    names = [c.split()[0] for c in f"{CHOICE}, {DETAILS}".split(", ")]
    call = with_retries(teacher, retries)
    kind = dict(rows.dtypes)[key]

    def field(answer, name):
        found = None if answer is None else answer.get(name)
        return json.dumps(found) if name in ("evidence", "candidates") and found is not None else found

    def run(frames):
        for f in frames:
            answers = [call(p) for p in f[request]]
            out = pd.DataFrame({key: f[key], "answered": [a is not None for a in answers]})
            for n in names:
                out[n] = [field(a, n) for a in answers]
            yield out[[key, "answered", *names]]

    told = rows.select(key, request).mapInPandas(run, f"{key} {kind}, answered boolean, {CHOICE}, {DETAILS}")
    return told.select(key, F.when(F.col("answered"), F.struct(*names)).alias("chosen"), F.lit(True).alias("attempted"))


def label_clusters(members: DataFrame, representatives: DataFrame, order: str) -> DataFrame:
    """order, leader, primitive_id, status: own, copied, or blocked_by_representative_failure.

    members: order, leader; representatives: order, primitive_id (null: the representative got no label).
    """
    led = representatives.select(F.col(order).alias("leader"), "primitive_id")
    out = members.join(led, "leader", "left")
    status = F.when(
        F.col("primitive_id").isNull(), "blocked_by_representative_failure",
    ).when(F.col(order) == F.col("leader"), "own").otherwise("copied")
    return out.select(order, "leader", "primitive_id", status.alias("status"))


def label_counts(labeled: DataFrame) -> DataFrame:
    """status, n: what label-auto reports."""
    return labeled.groupBy("status").agg(F.count("*").alias("n"))


def relabel(
    rows: DataFrame, key: str, order: str, request: str, teacher: Callable = offline, most: int | None = None, retries: int = 3,
) -> DataFrame:
    """key, chosen, status (ok or failed) of the first `most` labeled rows in order (None: all); no answer is a failure.

    rows hold label and the request column.
    """
    labeled = rows.where(F.col("label").isNotNull())
    taken = labeled if most is None else labeled.orderBy(order).limit(most)
    told = teach(taken, key, request, teacher, retries)
    return told.select(key, "chosen", F.when(F.col("chosen").isNotNull(), "ok").otherwise("failed").alias("status"))


def relabel_counts(done: DataFrame) -> DataFrame:
    """processed, success, failed of relabel's rows."""
    return done.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") == "ok").alias("success"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )


def stamp(metadata: Column, part: str, values: dict[str, Column]) -> Column:
    """metadata (JSON string, null: none) with an object under `part`, in place of one of that name."""
    kept = F.map_filter(F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>"), lambda k, v: k != part)
    own = F.create_map(F.lit(part), F.parse_json(F.to_json(F.struct(*(c.alias(n) for n, c in values.items())))))
    return F.to_json(F.map_concat(kept, own))


def prelabel(
    images: DataFrame, key: str, content: str, model: Callable[[bytes], list[dict]], width: Column, height: Column, overlap: float = 0.6,
) -> DataFrame:
    """key, at, label, box, score of a model's boxes: guessed to pixels, valid ones only, overlaps suppressed in order."""
    kind = dict(images.dtypes)[key]

    def run(frames):
        for f in frames:
            rows = [(k, i, b.get("label"), *map(float, b["bbox"]), float(b.get("score", 0.5))) for k, c in zip(f[key], f[content], strict=True) for i, b in enumerate(model(c))]
            yield pd.DataFrame(rows, columns=[key, "at", "label", "x1", "y1", "x2", "y2", "score"])

    raw = images.select(key, content).mapInPandas(
        run, f"{key} {kind}, at int, label string, x1 double, y1 double, x2 double, y2 double, score double",
    )
    return clean_boxes(raw, key, width, height, overlap)


def clean_boxes(raw: DataFrame, key: str, width: Column, height: Column, overlap: float = 0.6) -> DataFrame:
    """The part of prelabel after the model, for boxes that are a table already."""
    p = guess_pixels(Box.cols(), width, height)
    pixels = raw.select(key, "at", "label", *(c.alias(n) for n, c in zip(p._fields, p, strict=True)), "score")
    good = pixels.where(valid(Box.cols(), width, height))
    return good.join(suppress_overlaps(good, key, "at", overlap), [key, "at"])


#: What can be done with a class of element, and its type.
AFFORDANCES = {
    "button": ("click",),
    "text_field": ("type", "click"),
    "scroll_area": ("scroll",),
    "slider": ("drag",),
    "toggle": ("click", "toggle"),
    "menu_item": ("click",),
    "icon": ("click", "double_click"),
}
ELEMENT_TYPES = {
    "button": "button",
    "text_field": "type",
    "scroll_area": "scroll",
    "slider": "drag",
    "toggle": "toggle",
    "menu_item": "button",
    "icon": "button",
}


def analyze(
    detections: DataFrame,
    affordances: dict[str, tuple[str, ...]] | None = None,
    low: float = 0.25,
    width: Column | None = None,
    height: Column | None = None,
) -> DataFrame:
    """Detections of at least `low` with affordances (array, default click) and element_type (default button), by the
    label without case. A map of the caller's takes part as literals. With the size of the frame also semantic_id: the
    label and the cell of the centre of the box in columns x1, y1, x2, y2."""
    label = F.lower("label")
    texts = {k: ",".join(v) for k, v in (affordances or AFFORDANCES).items()}
    kept = detections.where(F.col("score") >= low)
    kept = kept.withColumn(
        "affordances", F.split(lookup(label, texts, "click"), ","),
    ).withColumn("element_type", lookup(label, ELEMENT_TYPES, "button"))
    return kept if width is None else kept.withColumn("semantic_id", semantic_id(label, Box.cols(), width, height))


def training_records(pairs: DataFrame) -> DataFrame:
    """prompt, chosen, rejected rows of preference training."""
    return pairs.select(
        F.col("chosen_prompt").alias("prompt"), F.to_json("chosen_bbox").alias("chosen"), F.to_json("rejected_bbox").alias("rejected"),
    )


def tuning_rows(samples: DataFrame, box: str, path: str) -> DataFrame:
    """Rows usable for supervised tuning: a path and a box of four."""
    return samples.where(F.col(path).isNotNull() & (F.size(box) == 4))
