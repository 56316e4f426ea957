"""Geometry, metrics, profiles, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import geometry as G
from loomframe.operators import metrics, profile
from loomframe.plans.registry import BOXES_SQL, IOU_SQL, boxes, query
from loomframe.runtime import table

W, H = 1920, 1080
#: Each vector's box and a second one from its next four components.
TWO_SQL = """two AS (SELECT vec_id, label, {'x1': embedding[1]::DOUBLE * 1000, 'y1': embedding[2]::DOUBLE * 1000,
 'x2': embedding[1]::DOUBLE * 1000 + abs(embedding[3]::DOUBLE) * 1000, 'y2': embedding[2]::DOUBLE * 1000 + abs(embedding[4]::DOUBLE) * 1000} AS a,
 {'x1': embedding[5]::DOUBLE * 1000, 'y1': embedding[6]::DOUBLE * 1000, 'x2': embedding[5]::DOUBLE * 1000 + abs(embedding[7]::DOUBLE) * 1000,
 'y2': embedding[6]::DOUBLE * 1000 + abs(embedding[8]::DOUBLE) * 1000} AS b FROM embeddings)"""


def _two(spark, d):
    e = lambda k: F.col("embedding")[k].cast("double") * 1000
    box = lambda k: G.Box(e(k), e(k + 1), e(k) + F.abs(e(k + 2)), e(k + 1) + F.abs(e(k + 3)))
    return table(spark, d, "embeddings").select("vec_id", "label", box(0).struct().alias("a"), box(4).struct().alias("b"))


@query("iou_pairs", f"WITH {TWO_SQL} SELECT vec_id, round({IOU_SQL.format(a='a', b='b')}, 6) AS iou FROM two")
def iou_pairs(spark, d):
    return _two(spark, d).select("vec_id", F.round(G.iou(G.Box.of("a"), G.Box.of("b")), 6).alias("iou"))


@query("center_distance", f"""WITH {TWO_SQL} SELECT vec_id, round(sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)),
 6) AS distance_px FROM two""")
def center_distance(spark, d):
    return _two(spark, d).select("vec_id", F.round(G.center_distance(G.Box.of("a"), G.Box.of("b")), 6).alias("distance_px"))


@query("mean_iou", f"""WITH {TWO_SQL} SELECT round(coalesce(avg({IOU_SQL.format(a='a', b='b')}), 0), 6) AS mean_iou,
 round(coalesce(avg(sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2))), 0), 6) AS mean_distance_px,
 count(*) AS n FROM two""")
def mean_iou(spark, d):
    a, b = G.Box.of("a"), G.Box.of("b")
    return _two(spark, d).agg(
        F.round(metrics.mean_or_zero(G.iou(a, b)), 6).alias("mean_iou"),
        F.round(metrics.mean_or_zero(G.center_distance(a, b)), 6).alias("mean_distance_px"),
        F.count("*").alias("n"),
    )


@query("bbox_normalize", f"""WITH {BOXES_SQL} SELECT vec_id, round(x1 / 1920 * 1000, 6) AS x1, round(y1 / 1080 * 1000, 6) AS y1, round(x2 / 1920 * 1000, 6) AS x2,
 round(y2 / 1080 * 1000, 6) AS y2, round(x1 / 1920, 6) AS ux1, x2 > x1 AND y2 > y1 AND x2 > 0 AND y2 > 0 AND x1 < 1920 AND y1 < 1080 AS valid
 FROM boxes""")
def bbox_normalize(spark, d):
    b = boxes(spark, d)
    n = G.normalize(G.Box.cols(), "0-1000", F.lit(W), F.lit(H))
    u = G.normalize(G.Box.cols(), "0-1", F.lit(W), F.lit(H))
    return b.select(
        "vec_id",
        *(F.round(c, 6).alias(k) for k, c in zip(n._fields, n, strict=True)),
        F.round(u.x1, 6).alias("ux1"),
        G.valid(G.Box.cols(), F.lit(W), F.lit(H)).alias("valid"),
    )


@query("bbox_guess_scale", f"""WITH {BOXES_SQL}, s AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 10 END AS f, x1, y1, x2, y2
 FROM boxes), t AS (SELECT vec_id, x1 * f AS x1, y1 * f AS y1, x2 * f AS x2, y2 * f AS y2 FROM s),
m AS (SELECT *, greatest(abs(x1), abs(y1), abs(x2), abs(y2)) AS m FROM t)
SELECT vec_id, round(x1 * CASE WHEN m <= 1.5 THEN 1920 WHEN m <= 1200 THEN 1.92 ELSE 1 END, 6) AS x1, round(y2 * CASE WHEN m <= 1.5 THEN 1080
 WHEN m <= 1200 THEN 1.08 ELSE 1 END, 6) AS y2 FROM m""")
def bbox_guess_scale(spark, d):
    f = F.when(F.col("vec_id") % 3 == 0, 0.001).when(F.col("vec_id") % 3 == 1, 1.0).otherwise(10.0)
    b = boxes(spark, d).select("vec_id", *((F.col(c) * f).alias(c) for c in ("x1", "y1", "x2", "y2")))
    p = G.guess_pixels(G.Box.cols(), F.lit(W), F.lit(H))
    return b.select("vec_id", F.round(p.x1, 6).alias("x1"), F.round(p.y2, 6).alias("y2"))


@query("coco_xywh", f"""WITH {BOXES_SQL} SELECT vec_id, round(x1, 6) AS x, round(y1, 6) AS y, round(greatest(0, x2 - x1), 6) AS w, round(greatest(0, y2 - y1), 6) AS h,
 round(greatest(0, x2 - x1) * greatest(0, y2 - y1), 4) AS area FROM boxes""")
def coco_xywh(spark, d):
    parts = G.xyxy_to_xywh(G.Box.cols())
    return boxes(spark, d).select("vec_id", *(F.round(c, 4 if n == "area" else 6).alias(n) for n, c in parts.items()))


@query("spatial_bucket", f"""WITH {BOXES_SQL} SELECT vec_id, 'class' || label || '_r' || least(2, trunc((y1 + y2) / 2 / 1080 * 3)::INT) || 'c' || least(2,
 trunc((x1 + x2) / 2 / 1920 * 3)::INT) AS semantic_id FROM boxes""")
def spatial_bucket(spark, d):
    return boxes(spark, d).select(
        "vec_id",
        G.semantic_id(F.concat(F.lit("class"), F.col("label").cast("string")), G.Box.cols(), F.lit(W), F.lit(H)).alias("semantic_id"),
    )


@query("unit_clamp", f"""WITH {BOXES_SQL}, c AS (SELECT vec_id, greatest(0, least(1, x1 / 500)) AS a, greatest(0, least(1, y1 / 500)) AS b, greatest(0, least(1,
 x2 / 500)) AS c, greatest(0, least(1, y2 / 500)) AS d FROM boxes)
SELECT vec_id, round(a, 6) AS x1, round(b, 6) AS y1, round(CASE WHEN c <= a THEN least(1, a + 0.01) ELSE c END, 6) AS x2, round(CASE
 WHEN d <= b THEN least(1, b + 0.01) ELSE d END, 6) AS y2 FROM c""")
def unit_clamp(spark, d):
    u = G.clamp_unit(G.Box(*(F.col(c) / 500 for c in ("x1", "y1", "x2", "y2"))))
    return boxes(spark, d).select("vec_id", *(F.round(c, 6).alias(n) for n, c in zip(u._fields, u, strict=True)))


PREDICTED_SQL = "p AS (SELECT vec_id, label AS target, (vec_id % 10)::INT AS predicted FROM embeddings)"


def _predicted(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("target"), (F.col("vec_id") % 10).cast("int").alias("predicted"),
    )


@query("accuracy", f"WITH {PREDICTED_SQL} SELECT round(avg((target = predicted)::INT), 6) AS accuracy FROM p")
def accuracy(spark, d):
    return metrics.accuracy(_predicted(spark, d), "predicted", "target").select(F.round("accuracy", 6).alias("accuracy"))


@query("macro_f1", f"""WITH {PREDICTED_SQL}, l AS (SELECT target AS label FROM p UNION SELECT predicted FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE target = label AND predicted = label) AS tp, (SELECT count(*) FROM p
 WHERE predicted = label) AS np, (SELECT count(*) FROM p WHERE target = label) AS nt FROM l),
f AS (SELECT CASE WHEN tp = 0 THEN 0 ELSE 2.0 * (tp / np) * (tp / nt) / (tp / np + tp / nt) END AS f1 FROM c) SELECT round(avg(f1), 6) AS macro_f1
 FROM f""")
def macro_f1(spark, d):
    return metrics.macro_f1(_predicted(spark, d), "predicted", "target").select(F.round("macro_f1", 6).alias("macro_f1"))


@query("aux_accuracy", f"""WITH {PREDICTED_SQL}, q AS (SELECT predicted, CASE WHEN vec_id % 4 = 0 THEN -100 ELSE target END AS target FROM p)
 SELECT round(coalesce(avg((target = predicted)::INT) FILTER (WHERE target <> -100), 0), 6) AS accuracy FROM q""")
def aux_accuracy(spark, d):
    p = _predicted(spark, d).withColumn("target", F.when(F.col("vec_id") % 4 == 0, -100).otherwise(F.col("target")))
    return metrics.accuracy(p, "predicted", "target", ignore=-100).select(F.round("accuracy", 6).alias("accuracy"))


@query("click_success", f"""WITH {TWO_SQL}, t AS (SELECT vec_id, vec_id // 10 AS image, label % 3 AS c, a
 FROM two), p AS (SELECT vec_id // 10 AS image, label % 3 AS c, {{'x1': a.x1 + 15, 'y1': a.y1, 'x2': a.x2, 'y2': a.y2 + 10}} AS b FROM two)
SELECT round(avg(EXISTS (SELECT 1 FROM p WHERE p.image = t.image AND p.c = t.c AND {IOU_SQL.format(a='t.a', b='p.b')} >= 0.5)::INT),
 6) AS click_success FROM t""")
def click_success(spark, d):
    """Ten vectors in a row are an image; predictions are the boxes with two sides moved."""
    b = boxes(spark, d).select(
        "vec_id", F.floor(F.col("vec_id") / 10).alias("image"), (F.col("label") % 3).alias("c"), "x1", "y1", "x2", "y2",
    )
    moved = b.withColumn("x1", F.col("x1") + 15).withColumn("y2", F.col("y2") + 10)
    return metrics.click_success(b, moved, "image", "c", "vec_id").select(F.round("click_success", 6).alias("click_success"))


@query("p95_nearest_rank", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, round(mean, 6) AS mean, v[least(len(v) - 1, round_even(0.95 * (len(v) - 1), 0)::BIGINT) + 1] AS p95 FROM s""")
def p95_nearest_rank(spark, d):
    out = metrics.nearest_rank(table(spark, d, "events").where("value IS NOT NULL"), "value", ["event_type"])
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.col("p").alias("p95"))


@query("detector_objective", """SELECT event_type, round(0.6 * coalesce(avg(value) / 100, 0) + 0.4 * avg((value > 20)::INT) - greatest(0, (avg(value) * 2 - 30) / 1000), 6) AS score
 FROM events GROUP BY 1""")
def detector_objective(spark, d):
    a = table(spark, d, "events").groupBy("event_type").agg(
        (F.avg("value") / 100).alias("m"), F.avg((F.col("value") > 20).cast("int")).alias("s"), (F.avg("value") * 2).alias("ms"),
    )
    return a.select("event_type", F.round(metrics.detector_score(F.col("m"), F.col("s"), F.col("ms")), 6).alias("score"))


@query("class_balance", """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM c)
 SELECT round(-sum(n / t * ln(n / t)) / ln(any_value(k)), 6) AS balance FROM c, t""")
def class_balance(spark, d):
    return profile.class_balance(table(spark, d, "orders"), "o_orderpriority").select(F.round("balance", 6).alias("balance"))


PROFILE_SQL = f"""{BOXES_SQL}, im AS (SELECT DISTINCT vec_id // 5 AS image FROM boxes), an AS (SELECT vec_id // 5 AS image, label, x2 - x1 AS w, y2 - y1 AS h
 FROM boxes),
sz AS (SELECT image, 1920 AS width, 1080 AS height FROM im WHERE image % 2 = 0),
a AS (SELECT count(*) AS na, avg(w * h / greatest(1, coalesce(width * height, 640 * 480))) AS r, count(DISTINCT label) AS k FROM an LEFT
 JOIN sz USING (image)),
c AS (SELECT label, count(*) AS n FROM an GROUP BY 1), bl AS (SELECT -sum(n / na * ln(n / na)) / ln(any_value(k)) AS b
 FROM c, a), ni AS (SELECT count(*) AS ni FROM sz),
prof AS (SELECT ni AS num_images, na AS num_annotations, k AS num_classes, round(na / greatest(1, ni), 2) AS avg_annotations_per_image, round(r,
 4) AS avg_box_area_ratio, round(b, 4) AS class_balance_score,
CASE WHEN ni < 50 AND k <= 1 THEN 'trivial' WHEN ni < 200 AND k <= 3 THEN 'simple' WHEN ni < 1000 OR k <= 5 THEN 'moderate'
 ELSE 'complex' END AS estimated_complexity FROM a, bl, ni)"""


def _profile(spark, d):
    """Five vectors in a row are an image; images with an odd number have no size on file."""
    b = boxes(spark, d).withColumn("image", F.floor(F.col("vec_id") / 5))
    images = b.select("image").distinct().where("image % 2 = 0").withColumn("width", F.lit(W)).withColumn("height", F.lit(H))
    return profile.profile(
        images,
        b.select("image", "label", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")),
        "image",
        "label",
    )


@query("dataset_profile", f"WITH {PROFILE_SQL} SELECT * FROM prof")
def dataset_profile(spark, d):
    return _profile(spark, d)


@query("strategy_pick", f"""WITH {PROFILE_SQL} SELECT CASE WHEN avg_annotations_per_image <= 1 AND num_classes <= 2 AND estimated_complexity IN ('trivial',
 'simple') THEN 'microsoft/Florence-2-base'
WHEN num_images < 200 AND num_classes <= 1 THEN 'yolov8n.pt' WHEN num_images < 1000 AND num_classes <= 5 THEN 'yolov8s.pt'
 ELSE 'yolov8m.pt' END AS model_name FROM prof""")
def strategy_pick(spark, d):
    return profile.strategy(_profile(spark, d)).select("model_name")


@query("vocab_index", "SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS index FROM (SELECT DISTINCT p_brand FROM part)")
def vocab_index(spark, d):
    return profile.vocabulary(table(spark, d, "part"), "p_brand").select("p_brand", F.col("index").cast("int").alias("index"))


@query("aux_encode", """WITH v AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part WHERE p_partkey % 3 = 0))
 SELECT p_partkey, coalesce(i, -100)::INT AS p_type_index FROM part LEFT JOIN v USING (p_type)""")
def aux_encode(spark, d):
    p = table(spark, d, "part")
    out = profile.encode(p, profile.vocabulary(p.where("p_partkey % 3 = 0"), "p_type", True), "p_type")
    return out.select("p_partkey", F.col("p_type_index").cast("int").alias("p_type_index"))
