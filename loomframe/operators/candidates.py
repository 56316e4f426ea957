"""Candidate boxes of samples: text boxes, the nearest to a click, the largest first; event positions and regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, area, center
from loomframe.functions.hashing import gray_pair, image_pairs
from loomframe.functions.regions import changed_boxes, changed_near
from loomframe.operators.labels import primary_roi

#: A candidate of any signal.
CANDIDATE = ("x1", "y1", "x2", "y2", "signal", "confidence", "semantic_text")


def text_boxes(found: DataFrame, points: str, text: str, confidence: str, least: float = 0.3) -> DataFrame:
    """found with a candidate's columns: recognised texts of at least `least`, boxes about their corner points.

    points: array of structs x, y. A null confidence isn't enough; no points give a null box.
    """
    kept = found.where(F.col(confidence) >= least)
    side = lambda pick, k: pick(F.transform(points, lambda p: p[k].cast("double")))
    values = {"x1": side(F.array_min, "x"), "y1": side(F.array_min, "y"), "x2": side(F.array_max, "x"), "y2": side(F.array_max, "y")}
    values |= {"signal": F.lit("ocr"), "confidence": F.col(confidence).cast("double"), "semantic_text": F.trim(text)}
    rest = [F.col(c) for c in found.columns if c not in (*CANDIDATE, points, text, confidence)]
    return kept.select(*rest, *(c.alias(n) for n, c in values.items()))


def nearest_to_click(candidates: DataFrame, key: str, order: str, x: str, y: str, most: float = 200.0) -> DataFrame:
    """The candidate of each key whose centre is nearest to the click, at most `most` away, ties to the first in order.

    A key without such a candidate has no row. Partial minima are taken before the shuffle.
    """
    cx, cy = center(Box.cols())
    dx, dy = cx - F.col(x), cy - F.col(y)
    near = candidates.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= most)
    rest = F.struct(*(c for c in near.columns if c != key))
    return near.groupBy(key).agg(F.min_by(rest, F.struct("distance", order)).alias("__best")).select(key, "__best.*")


def largest_first(boxes: Column) -> Column:
    """An array of boxes (structs x1, y1, x2, y2, ...) by falling area; equal areas keep their order."""
    numbered = F.transform(boxes, lambda b, i: F.struct((-area(Box.of(b))).alias("a"), i.alias("i"), b.alias("b")))
    by_area = F.array_sort(numbered, lambda p, q: F.when(p["a"] < q["a"], -1).when(p["a"] > q["a"], 1).otherwise(p["i"] - q["i"]))
    return F.transform(by_area, lambda s: s["b"])


def contour_boxes(found: DataFrame, total_pixels: Column, least_area: float = 100.0) -> DataFrame:
    """Changed regions (x, y, w, h, area of the shape) of at least least_area as candidates; confidence is a hundredfold
    share of the image by the shape's area."""
    kept = found.where(F.col("area") >= least_area)
    values = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")}
    rest = [F.col(c) for c in found.columns if c not in (*CANDIDATE, "x", "y", "w", "h", "area")]
    confidence = F.least(F.lit(1.0), F.col("area").cast("double") / total_pixels * 100)
    own = [c.cast("double").alias(n) for n, c in values.items()]
    return kept.select(
        *rest, *own, F.lit("diff").alias("signal"), confidence.alias("confidence"), F.lit(None).cast("string").alias("semantic_text"),
    )


def diff_boxes(
    pairs: DataFrame, key: str, threshold: float = 0.02, least_area: float = 100.0, align: bool = False,
) -> DataFrame:
    """key, at, and a candidate's columns: the regions that differ between before and after (image structs), the largest
    first (at from 0). Images of different size have none."""
    return _diff(pairs, key, "diff", lambda r, a, b: changed_boxes(a, b, threshold, least_area, align))


def local_diff_boxes(
    pairs: DataFrame, key: str, x: str, y: str, radius: int = 180, threshold: float = 0.02, least_area: float = 40.0, align: bool = True,
) -> DataFrame:
    """diff_boxes within `radius` pixels of the point in columns x and y; rows without a point have none."""

    def find(r, a, b):
        return [] if pd.isna(r.px) or pd.isna(r.py) else changed_near(a, b, r.px, r.py, radius, threshold, least_area, align)

    return _diff(pairs.withColumn("px", F.col(x).cast("double")).withColumn("py", F.col(y).cast("double")), key, "diff_local", find, "px", "py")


def _diff(pairs: DataFrame, key: str, signal: str, find, *more: str) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                found = find(r, *gray_pair(r))
                rows += [(r.key, k, *box[:4], signal, box[4], None) for k, box in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "at", *CANDIDATE])

    kind = dict(pairs.dtypes)[key]
    schema = f"{key} {kind}, at int, x1 double, y1 double, x2 double, y2 double, signal string, confidence double, semantic_text string"
    rows = pairs.where("before IS NOT NULL AND after IS NOT NULL").withColumn("key", F.col(key))
    return image_pairs(rows, "key", *more).mapInPandas(run, schema)


def event_position(metadata: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Struct x, y within [0, 1]: the recorded normalised point if both parts are there, else the event's over the size.

    Null without a point, or without a size where the event's own point is used.
    """
    part = lambda k: F.get_json_object(metadata, f"$.coordinates.event_normalized_xy.{k}").try_cast("double")
    recorded = F.struct(part("x").alias("x"), part("y").alias("y"))
    own = F.struct((x / width).cast("double").alias("x"), (y / height).cast("double").alias("y"))
    known = part("x").isNotNull() & part("y").isNotNull()
    return F.when(known, recorded).when(x.isNotNull() & y.isNotNull() & (width > 0) & (height > 0), own)


def default_roi(rows: DataFrame, situations: DataFrame, rois: DataFrame, label: str, situation: str, roi: str) -> DataFrame:
    """rows with roi_default and bbox_default, what a reviewer sees first.

    The label's own box if it has four parts, named by the label, else by roi; else the box of roi, else of the
    situation's primary region; an unknown region has the whole image. situations: situation_id, roi_priority,
    likely_rois; rois: roi_name, x1, y1, x2, y2.
    """
    route = F.col(label)["route_label"]
    own = F.coalesce(F.size(route["roi_bbox_norm"]) == 4, F.lit(False))
    primary = situations.select(
        F.col("situation_id").alias("__sid"), primary_roi(F.col("roi_priority"), F.col("likely_rois")).alias("__primary"),
    )
    boxes = rois.select(F.col("roi_name").alias("__name"), F.array("x1", "y1", "x2", "y2").alias("__box"))
    asked = F.nullif(F.trim(F.coalesce(roi, F.lit(""))), F.lit(""))
    named = rows.join(primary, F.col(situation) == F.col("__sid"), "left").withColumn("__asked", F.coalesce(asked, "__primary", F.lit("")))
    found = named.join(boxes, F.col("__asked") == F.col("__name"), "left")
    name = F.when(own, F.coalesce(F.nullif(route["roi_name"], F.lit("")), roi, F.lit(""))).otherwise(F.col("__asked"))
    whole = F.array(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)))
    box = F.when(own, route["roi_bbox_norm"]).otherwise(F.coalesce("__box", whole))
    return found.withColumn("roi_default", name).withColumn("bbox_default", box).drop("__sid", "__primary", "__asked", "__name", "__box")
