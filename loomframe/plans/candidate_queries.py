"""Candidate boxes, event positions, default regions, region splits, failure annotations, manifests, relabelling."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomframe.operators import candidates, labels, review, split, teaching
from loomframe.plans.export_queries import _rows
from loomframe.plans.label_queries import EFFECTIVE_SQL, ROI_SQL, _dims, samples
from loomframe.plans.registry import BOXES_SQL, boxes, query
from loomframe.runtime import table
from loomframe.sources import writers

#: Twenty vectors in a row are one sample's text boxes; the click is at the first one's corner.
OCR_SQL = f"""{BOXES_SQL}, t AS (SELECT vec_id, vec_id // 20 AS sample, least(x1, x2) AS a, y1 AS b, greatest(x1, x2) AS c, y2 AS d, (vec_id % 10) / 10.0 AS conf
 FROM boxes),
k AS (SELECT * FROM t WHERE conf >= 0.3),
p AS (SELECT sample, min_by(a, vec_id) AS px, min_by(b, vec_id) AS py FROM t GROUP BY 1),
n AS (SELECT k.*, sqrt(((a + c) / 2 - px) ** 2 + ((b + d) / 2 - py) ** 2) AS distance FROM k JOIN p USING (sample))"""


def _texts(spark, d):
    b = boxes(spark, d).withColumn("sample", F.floor(F.col("vec_id") / 20))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    found = b.select(
        "vec_id", "sample", corners.alias("points"), F.lit(" word ").alias("text"), ((F.col("vec_id") % 10) / 10.0).alias("conf"),
    )
    clicks = b.groupBy("sample").agg(F.min_by(F.struct("x1", "y1"), "vec_id").alias("p")).select(
        "sample", F.col("p.x1").alias("px"), F.col("p.y1").alias("py"),
    )
    return candidates.text_boxes(found, "points", "text", "conf"), clicks


@query("ocr_boxes", f"WITH {OCR_SQL} SELECT vec_id, 'ocr' AS signal, round(a, 6) AS x1, round(c, 6) AS x2, 'word' AS semantic_text FROM k")
def ocr_boxes(spark, d):
    found, _ = _texts(spark, d)
    return found.select("vec_id", "signal", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"), "semantic_text")


@query("ocr_nearest", f"""WITH {OCR_SQL} SELECT sample, min_by(vec_id, distance) AS vec_id, round(min(distance), 6) AS distance FROM n WHERE distance <= 200 GROUP BY 1""")
def ocr_nearest(spark, d):
    found, clicks = _texts(spark, d)
    return candidates.nearest_to_click(
        found.join(clicks, "sample"), "sample", "vec_id", "px", "py",
    ).select("sample", "vec_id", F.round("distance", 6).alias("distance"))


@query("largest_first", f"""WITH {BOXES_SQL} SELECT vec_id // 20 AS sample, array_to_string(list(vec_id ORDER BY greatest(0, x2 - x1) * greatest(0, y2 - y1) DESC, vec_id),
 ',') AS ids FROM boxes GROUP BY 1""")
def largest_first(spark, d):
    packed = boxes(spark, d).groupBy(F.floor(F.col("vec_id") / 20).alias("sample")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "x1", "y1", "x2", "y2"))).alias("b")
    )
    return packed.select(
        "sample", F.array_join(F.transform(candidates.largest_first(F.col("b")), lambda b: b["vec_id"].cast("string")), ",").alias("ids"),
    )


@query("contour_boxes", """SELECT p_partkey, (p_size * 3)::DOUBLE AS x1, (p_size * 4)::DOUBLE AS x2, least(1::DOUBLE, p_size * 4 / 1e6 * 100) AS confidence
 FROM part WHERE p_size * 4 >= 100""")
def contour_boxes(spark, d):
    size = F.col("p_size")
    found = table(spark, d, "part").select(
        "p_partkey",
        (size * 3).alias("x"),
        size.alias("y"),
        size.alias("w"),
        (F.col("p_partkey") % 50).alias("h"),
        (size * 4).alias("area"),
    )
    return candidates.contour_boxes(found, F.lit(1e6)).select("p_partkey", "x1", "x2", "confidence")


def _frames(spark, d):
    """Two frames of 32 by 32 gray pixels a vector: its first 64 values as squares, and the same with those of the next id's
    label (every fourth square or so) in other shades."""
    shade = lambda v: f"abs(cast({v} * 997 AS int)) % 256"
    pixel = "embedding[(p div 128) * 8 + (p % 32) div 4]"
    other = f"CASE WHEN ((p div 128) * 8 + (p % 32) div 4 + vec_id) % 11 < 3 THEN ({shade(pixel)} + 60 + vec_id % 40) % 256 ELSE {shade(pixel)} END"
    data = lambda v: F.expr(f"unhex(array_join(transform(sequence(0, 1023), p -> lpad(hex({v}), 2, '0')), ''))")
    image = lambda c: F.struct(F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(1).alias("nChannels"), c.alias("data"))
    return table(spark, d, "embeddings").where("size(embedding) >= 64").select(
        "vec_id", image(data(shade(pixel))).alias("before"), image(data(other)).alias("after"),
    )


@query("diff_boxes")
def diff_boxes(spark, d):
    """Boxes of changed squares; connected shapes have no SQL, tests hold them against a flood fill."""
    return candidates.diff_boxes(_frames(spark, d), "vec_id", least_area=4.0)


@query("local_diff_boxes")
def local_diff_boxes(spark, d):
    frames = _frames(spark, d).withColumn("cx", F.col("vec_id") % 32).withColumn("cy", (F.col("vec_id") * 7) % 32)
    return candidates.local_diff_boxes(frames, "vec_id", "cx", "cy", radius=10, least_area=4.0, align=False)


@query("event_position", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.25 WHEN event_id % 7 <> 0 THEN value / 1920 END AS x, CASE WHEN event_id % 3 = 0 THEN 0.5
 WHEN event_id % 7 <> 0 THEN user_id / 1080 END AS y FROM events""")
def event_position(spark, d):
    n = F.col("event_id")
    metadata = F.when(
        n % 3 == 0, '{"coordinates":{"event_normalized_xy":{"x":0.25,"y":0.5}}}',
    ).when(n % 3 == 1, '{"coordinates":{"event_normalized_xy":{"x":0.9}}}')
    at = candidates.event_position(metadata, F.when(n % 7 != 0, F.col("value")), F.col("user_id"), F.lit(1920), F.lit(1080))
    return table(spark, d, "events").select("event_id", at["x"].alias("x"), at["y"].alias("y"))


@query("default_roi", f"""WITH {ROI_SQL}, c AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'overview' WHEN 2 THEN 'nowhere' END AS sid, CASE
 WHEN vec_id % 5 = 0 THEN ' minimap ' WHEN vec_id % 5 = 1 THEN 'unknown' END AS asked, vec_id % 6 = 0 AS own FROM embeddings),
n AS (SELECT *, coalesce(trim(asked), CASE sid WHEN 'idle' THEN 'end_turn_zone' WHEN 'overview' THEN 'minimap' END, '') AS name FROM c)
SELECT vec_id, CASE WHEN own THEN coalesce(asked, '') ELSE name END AS roi_default, CASE WHEN own THEN 0.1::DOUBLE ELSE coalesce(x1,
 0)::DOUBLE END AS x1, CASE WHEN own THEN 0.4::DOUBLE ELSE coalesce(y2, 1)::DOUBLE END AS y2 FROM n LEFT JOIN rois ON roi_name = name""")
def default_roi(spark, d):
    rois, situations, _ = _dims(spark)
    v = F.col("vec_id")
    route = F.col("label.route_label").withField("roi_bbox_norm", F.when(v % 6 == 0, F.array(*(F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)))))
    named = samples(spark, d).select(
        "vec_id",
        F.col("label").withField("route_label", route).alias("label"),
        F.when(v % 4 == 0, "idle").when(v % 4 == 1, "overview").when(v % 4 == 2, "nowhere").alias("sid"),
        F.when(v % 5 == 0, " minimap ").when(v % 5 == 1, "unknown").alias("asked"),
    )
    out = candidates.default_roi(named, situations, rois, "label", "sid", "asked")
    return out.select("vec_id", "roi_default", F.col("bbox_default")[0].alias("x1"), F.col("bbox_default")[3].alias("y2"))


@query("roi_state_split", f"""WITH {EFFECTIVE_SQL}, k AS (SELECT sample_id, row_number() OVER (ORDER BY vec_id) AS k, count(*) OVER () AS n FROM eff
 WHERE review_status <> 'rejected' AND vec_id % 17 <> 0)
SELECT sample_id, CASE WHEN k <= trunc(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM k""")
def roi_state_split(spark, d):
    return writers.region_split(_rows(spark, d)).select("sample_id", "split")


@query("router_crops", f"""WITH {EFFECTIVE_SQL}, {ROI_SQL}, r AS (SELECT * FROM eff WHERE review_status <> 'rejected' AND vec_id % 17 <> 0 AND vec_id % 13 <> 0
 AND primitive_id IS NOT NULL)
SELECT sample_id, 0 AS x1, greatest(0, round_even(rois.x2 * 1920, 0)::INT) AS x2 FROM r, rois WHERE roi_name = 'top_bar'""")
def router_crops(spark, d):
    rois, situations, _ = _dims(spark)
    return writers.router_crops(_rows(spark, d), situations, rois, ["no_such", "top_bar"]).select(
        "sample_id", F.col("crop.x1").alias("x1"), F.col("crop.x2").alias("x2"),
    )


def _failures(spark, d):
    """Eight events in a row are one failed frame's elements; every ninth frame has none."""
    e = table(spark, d, "events").withColumn("ord", F.floor(F.col("event_id") / 8))
    element = F.struct(
        F.col("event_type").alias("class_name"),
        F.col("value").alias("x1"),
        F.col("value").alias("y1"),
        (F.col("value") * 2).alias("x2"),
        (F.col("value") * 3).alias("y2"),
        (F.col("value") / 100).alias("score"),
    )
    every = e.groupBy("ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", element.alias("e")))), lambda s: s["e"]).alias("elements")
    )
    return every.withColumn(
        "elements", F.when(F.col("ord") % 9 != 0, F.col("elements")).otherwise(F.array().cast(writers.FAILURE_ELEMENTS)),
    )


@query("failure_coco", """WITH f AS (SELECT event_id // 8 AS ord, event_id, event_type, value, dense_rank() OVER (ORDER BY event_id // 8) AS image_no
 FROM events), k AS (SELECT * FROM f WHERE ord % 9 <> 0)
SELECT image_no, row_number() OVER (ORDER BY event_id) AS annotation_no, CASE event_type WHEN 'view' THEN 2 ELSE 1 END::BIGINT AS category_id,
 round(value, 6) AS x, round(value * 2 * value, 6) AS area, round(value / 100, 6) AS score FROM k""")
def failure_coco(spark, d):
    out = writers.failure_annotations(_failures(spark, d), ["click", "view"])
    return out.select(
        "image_no",
        "annotation_no",
        "category_id",
        F.round("x", 6).alias("x"),
        F.round("area", 6).alias("area"),
        F.round("score", 6).alias("score"),
    )


@query("failure_count", """SELECT count(*) AS failures, count(*) FILTER (WHERE n = 0) AS empty
 FROM (SELECT event_id // 8 AS ord, count(*) FILTER (WHERE (event_id // 8) % 9 <> 0) AS n FROM events GROUP BY 1)""")
def failure_count(spark, d):
    return _failures(spark, d).agg(F.count("*").alias("failures"), F.count_if(F.size("elements") == 0).alias("empty"))


@query("extract_manifest", """WITH h AS (SELECT DISTINCT event_id // 3 AS g FROM events) SELECT (SELECT count(*) FROM events) AS raw_count, (SELECT count(*)
 FROM h) AS dedup_count, (SELECT count(*) FROM events) - (SELECT count(*) FROM h) AS dropped_count, least(25, (SELECT count(*)
 FROM h)) AS sample_count""")
def extract_manifest(spark, d):
    """Three events in a row stand for near-equal frames; 25 of what is left are sampled."""
    raw = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("g"))
    kept = raw.groupBy("g").agg(F.min("event_id").alias("event_id"))
    return writers.extract_manifest(raw, kept, split.hash_sample(kept, "event_id", 25))


def _answer(request: str):
    """A stand-in teacher without an answer for every fourth sample."""
    n = json.loads(request)["sample_id"]
    return None if n % 4 == 0 else {"primitive_id": f"prim_{n % 3}", "confidence": 0.8}


def _relabeled(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.struct("vec_id")).alias("label"))
    rows = rows.withColumn("request", teaching.payload(F.col("vec_id"), F.lit(None).cast("string"), ["a"], []))
    return teaching.relabel(rows, "vec_id", "vec_id", "request", _answer, most=150)


RELABEL_SQL = "t AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY vec_id LIMIT 150)"


@query("relabel", f"""WITH {RELABEL_SQL} SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE
 WHEN vec_id % 4 <> 0 THEN 'prim_' || (vec_id % 3) END AS primitive_id FROM t""")
def relabel(spark, d):
    return _relabeled(spark, d).select("vec_id", "status", F.col("chosen.primitive_id").alias("primitive_id"))


@query("relabel_counts", f"""WITH {RELABEL_SQL} SELECT count(*) AS processed, count(*) FILTER (WHERE vec_id % 4 <> 0) AS success, count(*) FILTER (WHERE vec_id % 4 = 0) AS failed
 FROM t""")
def relabel_counts(spark, d):
    return teaching.relabel_counts(_relabeled(spark, d))


@query("review_queue", f"""WITH {EFFECTIVE_SQL} SELECT sample_id, CASE WHEN confidence >= 0.9 THEN 'approved' ELSE 'review' END AS decision, CASE
 WHEN confidence < 0.9 THEN round(confidence, 6) END AS priority FROM eff WHERE review_status = 'pending' AND vec_id % 13 <> 0""")
def review_queue(spark, d):
    """The queue of what is labeled, pending and no duplicate, by confidence alone."""
    confidence = F.col("label.confidence")
    return review.load_queue(_rows(spark, d), confidence, "ord", 0.9, confidence).select(
        "sample_id", "decision", F.round("priority", 6).alias("priority"),
    )


@query("prelabel_coco", f"""WITH {BOXES_SQL}, p AS (SELECT vec_id, dense_rank() OVER (ORDER BY vec_id // 20) AS image_no, x1, x2, y1, y2 FROM boxes)
SELECT image_no, row_number() OVER (ORDER BY vec_id) AS annotation_no, round(x1, 6) AS x, round((x2 - x1) * (y2 - y1), 6) AS area,
 0.5::DOUBLE AS score FROM p""")
def prelabel_coco(spark, d):
    """Twenty boxes in a row stand for a model's candidates of an image."""
    b = boxes(spark, d).withColumn("image", F.floor(F.col("vec_id") / 20)).withColumn("at", (F.col("vec_id") % 20).cast("int"))
    images = b.select("image").distinct().withColumn("ord", F.col("image"))
    out = writers.candidate_annotations(images, b, "image")
    return out.select("image_no", "annotation_no", F.round("x", 6).alias("x"), F.round("area", 6).alias("area"), "score")


@query("analyze_frames", """SELECT event_id, CASE event_type WHEN 'click' THEN 'drag' WHEN 'view' THEN 'type,click' ELSE 'click' END AS affordances, CASE event_type
 WHEN 'click' THEN 'drag' WHEN 'view' THEN 'type' ELSE 'button' END AS element_type FROM events WHERE value / 100 >= 0.25""")
def analyze_frames(spark, d):
    """Events as detections: clicks are sliders, views are text fields, other types aren't known."""
    kind = F.when(F.col("event_type") == "click", "Slider").when(F.col("event_type") == "view", "TEXT_FIELD").otherwise(F.col("event_type"))
    found = teaching.analyze(table(spark, d, "events").select("event_id", kind.alias("label"), (F.col("value") / 100).alias("score")))
    return found.select("event_id", F.array_join("affordances", ",").alias("affordances"), "element_type")


@query("analyze_elements", f"""WITH {BOXES_SQL}, s AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'toggle' WHEN 1 THEN 'icon' ELSE 'other' END AS label, (x1 + x2) / 2 AS cx,
 (y1 + y2) / 2 AS cy FROM boxes WHERE (vec_id % 10) / 10.0 >= 0.25)
SELECT vec_id, label || '_r' || least(2, trunc(cy / 1080 * 3)::INT) || 'c' || least(2, trunc(cx / 1920 * 3)::INT) AS semantic_id, CASE label
 WHEN 'toggle' THEN 'toggle' ELSE 'button' END AS element_type FROM s""")
def analyze_elements(spark, d):
    """Boxes as elements of a screen with their semantic ids."""
    v = F.col("vec_id")
    label = F.when(v % 3 == 0, "Toggle").when(v % 3 == 1, "icon").otherwise("OTHER")
    rows = boxes(spark, d).withColumn("label", label).withColumn("score", (v % 10) / 10.0)
    return teaching.analyze(rows, width=F.lit(1920), height=F.lit(1080)).select("vec_id", "semantic_id", "element_type")


@query("coco_categories", """SELECT r_regionkey + 1 AS id, r_name AS name FROM region UNION ALL
 SELECT (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_name), n_name FROM (SELECT DISTINCT n_name FROM nation)""")
def coco_categories(spark, d):
    """A document's categories (regions) and more that go on from them (nations)."""
    names = [r[0] for r in table(spark, d, "nation").select("n_name").distinct().orderBy("n_name").collect()]  # a taxonomy's names
    return writers.register_categories(table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name")), names)


@query("clip_files", """WITH s AS (SELECT event_id // 8 AS s, list('f' || event_id ORDER BY event_id) AS frames FROM events GROUP BY 1),
c AS (SELECT s, frames[1:3] AS pre, frames[4:] AS post FROM s),
e AS (SELECT s, unnest(pre) AS path, 'pre_' || lpad((generate_subscripts(pre, 1) - 1)::VARCHAR, 3, '0') AS part FROM c UNION ALL
 SELECT s, unnest(post), 'post_' || lpad((generate_subscripts(post, 1) - 1)::VARCHAR, 3, '0') FROM c UNION ALL
 SELECT s, post[2], 'post_effect' FROM c WHERE len(post) > 0 UNION ALL SELECT s, post[len(post)], 'post_stable' FROM c WHERE len(post) > 0)
SELECT 'sample_' || s || '/clip/' || part || '.png' AS name, path AS image_path FROM e""")
def clip_files(spark, d):
    """Eight events in a row are a sample: three frames before it, the rest after."""
    e = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 8).alias("s")).agg(
        F.array_sort(F.collect_list("event_id")).alias("ids")
    )
    frames = F.transform("ids", lambda i: F.concat(F.lit("f"), i.cast("string")))
    rows = e.select(
        F.concat(F.lit("sample_"), F.col("s").cast("string")).alias("sample_id"),
        F.slice(frames, 1, 3).alias("pre_clip"),
        F.slice(frames, 4, 100).alias("post_clip"),
        F.lit(1).alias("effect"),
    )
    return writers.clip_files(rows)
