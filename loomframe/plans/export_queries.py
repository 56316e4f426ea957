"""Export shapes over the nested samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators.quality import DUPLICATE
from loomframe.plans.label_queries import EFFECTIVE_SQL, effective
from loomframe.plans.registry import query
from loomframe.runtime import checkpoint, table
from loomframe.sources import writers

NAMES = ["sem_0", "sem_1", "sem_2"]


def _rows(spark, d):
    v = F.col("vec_id")
    frame = F.when(v % 17 != 0, F.concat(F.lit("/frames/"), "sample_id", F.lit(".png")))
    rows = effective(spark, d).select(
        "sample_id",
        "session_id",
        v.alias("ord"),
        "label",
        "review_status",
        "corrections",
        F.when(v % 13 == 0, F.array(F.lit(DUPLICATE))).alias("flags"),
        frame.alias("image_path"),
        F.lit(1920).alias("width"),
        F.lit(1080).alias("height"),
        F.lit(None).cast("string").alias("event"),
        F.when(v % 19 == 0, '{"turn_state":"waiting","secret":1,"session_id":"s"}').alias("metadata"),
    )
    return checkpoint(rows)  # exports read labels several times; without a cut every filter holds the whole overlay


ELEMENTS_SQL = f"""{EFFECTIVE_SQL}, el AS (SELECT *, unnest(range(n_elements)) AS pos FROM eff),
ex AS (SELECT vec_id, sample_id, pos, situation_id, primitive_id, confidence AS lconf, CASE WHEN m = 6 THEN NULL
 ELSE 'sem_' || cls END AS semantic_id, CASE WHEN m = 6 THEN 'fn_new' ELSE 'fn_' || pos END AS function_id,
 CASE WHEN m = 6 THEN NULL WHEN vec_id % 2 = 0 THEN '' ELSE 'text' END AS semantic_text, CASE WHEN m = 6 THEN 'enabled' WHEN vec_id % 10 = 9
 AND pos = 1 THEN 'disabled' ELSE 'enabled' END AS state,
 CASE WHEN m = 6 THEN NULL WHEN vec_id % 3 = 0 THEN 0 ELSE 0.5 + 0.1 * pos END AS econf,
 CASE WHEN m = 6 THEN 1.0 WHEN m = 3 AND pos = n_elements - 1 THEN 1 ELSE x1 + 5 * pos END AS a, CASE WHEN m = 6 THEN 1.0 WHEN m = 3
 AND pos = n_elements - 1 THEN 2 ELSE y1 END AS b,
 CASE WHEN m = 6 THEN 9.0 WHEN m = 3 AND pos = n_elements - 1 THEN 30 ELSE x2 + 5 * pos END AS c, CASE WHEN m = 6 THEN 9.0 WHEN m = 3
 AND pos = n_elements - 1 THEN 40 ELSE y2 END AS d
 FROM el WHERE review_status <> 'rejected' AND vec_id % 17 <> 0),
ok AS (SELECT * FROM ex WHERE state <> 'disabled')"""


@query("router_export", f"""WITH {EFFECTIVE_SQL}, r AS (SELECT * FROM eff WHERE review_status <> 'rejected' AND vec_id % 17 <> 0 AND vec_id % 13 <> 0
 AND primitive_id IS NOT NULL),
s AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT session_id FROM r))
SELECT sample_id, primitive_id, coalesce(situation_id, '') AS situation_id, screen_type, session_id, CASE WHEN k > n - greatest(1, round_even(n * 0.1,
 0)) THEN 'val' ELSE 'train' END AS split FROM r JOIN s USING (session_id)""")
def router_export(spark, d):
    return writers.router_split(_rows(spark, d)).drop("image_path")


@query("unified_export", f"""WITH {EFFECTIVE_SQL} SELECT sample_id, situation_id, CASE WHEN vec_id % 19 = 0 THEN 's' END AS session, false AS leaked FROM eff
 WHERE review_status <> 'rejected' AND vec_id % 13 <> 0""")
def unified_export(spark, d):
    out = writers.routing_rows(_rows(spark, d))
    get = lambda p: F.get_json_object("record", p)
    return out.select(
        "sample_id",
        get("$.page.situation_id").alias("situation_id"),
        get("$.metadata.session_id").alias("session"),
        get("$.metadata.secret").isNotNull().alias("leaked"),
    )


@query("coco_export", f"""WITH {ELEMENTS_SQL}, im AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS image_no FROM eff
 WHERE review_status <> 'rejected' AND vec_id % 17 <> 0)
SELECT image_no, row_number() OVER (ORDER BY vec_id, pos) AS annotation_no, CASE semantic_id WHEN 'sem_1' THEN 2 WHEN 'sem_2' THEN 3
 ELSE 1 END::BIGINT AS category_id, round(a, 6) AS x, round(greatest(0, c - a), 6) AS w, round(coalesce(nullif(econf, 0), lconf), 6) AS score FROM ok
 JOIN im USING (vec_id)""")
def coco_export(spark, d):
    return writers.coco_annotations(_rows(spark, d), NAMES).select(
        "image_no",
        "annotation_no",
        "category_id",
        F.round("x", 6).alias("x"),
        F.round("w", 6).alias("w"),
        F.round("score", 6).alias("score"),
    )


@query("yolo_lines", f"""WITH {ELEMENTS_SQL}, l AS (SELECT sample_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', CASE semantic_id WHEN 'sem_1' THEN 1 WHEN 'sem_2' THEN 2
 ELSE 0 END, (a + c) / 2.0 / 1920, (b + d) / 2.0 / 1080, (c - a) / 1920, (d - b) / 1080), chr(10) ORDER BY pos) AS lines FROM ok WHERE c > a AND d > b
 GROUP BY 1)
SELECT sample_id, coalesce(lines, '') AS lines FROM eff LEFT JOIN l USING (sample_id) WHERE review_status <> 'rejected' AND vec_id % 17 <> 0""")
def yolo_lines(spark, d):
    return writers.yolo_lines(_rows(spark, d), NAMES).select("sample_id", "lines")


@query("grounding_rows", f"""WITH {ELEMENTS_SQL} SELECT sample_id, pos::INT AS pos, coalesce(nullif(semantic_text, ''), nullif(semantic_id, ''), function_id, primitive_id,
 'interactive_element') AS prompt, trunc(a / 1920 * 1000)::INT AS bx1, trunc(d / 1080 * 1000)::INT AS by2, situation_id, round(coalesce(nullif(econf,
 0), lconf), 6) AS confidence FROM ok WHERE c > a AND d > b""")
def grounding_rows(spark, d):
    out = writers.grounding_rows(_rows(spark, d))
    return out.select(
        "sample_id",
        F.col("at").alias("pos"),
        "prompt",
        F.col("bbox")[0].alias("bx1"),
        F.col("bbox")[3].alias("by2"),
        "situation_id",
        F.round("confidence", 6).alias("confidence"),
    )


@query("roi_state", f"""WITH {EFFECTIVE_SQL} SELECT sample_id, CASE WHEN vec_id % 19 = 0 THEN 'waiting' ELSE coalesce(situation_id, primitive_id, 'sem_' || cls,
 'unknown') END AS turn_state, 1920 - 537 AS crop_x1, 1080 - 237 AS crop_y1 FROM eff WHERE review_status <> 'rejected' AND vec_id % 17 <> 0""")
def roi_state(spark, d):
    return writers.region_states(_rows(spark, d)).select(
        "sample_id", "turn_state", F.col("crop.x1").alias("crop_x1"), F.col("crop.y1").alias("crop_y1"),
    )


@query("click_boxes", """WITH p AS (SELECT event_id, 'f' || (event_id % 50) AS frame_path, value * 10 AS x, value AS y, event_type FROM events
 WHERE event_type IN ('click', 'view')),
f AS (SELECT frame_path, row_number() OVER (ORDER BY min(event_id)) AS image_no FROM p GROUP BY 1)
SELECT event_id, image_no, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END::BIGINT AS category_id, round(greatest(0, x - 64), 6) AS x,
 round(x + 64 - greatest(0, x - 64), 6) AS w FROM p JOIN f USING (frame_path)""")
def click_boxes(spark, d):
    p = table(spark, d, "events").where("event_type IN ('click', 'view')").select(
        "event_id",
        F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("frame_path"),
        (F.col("value") * 10).alias("x"),
        F.col("value").alias("y"),
        F.col("event_type").alias("auto_label"),
    )
    return writers.click_boxes(p, ["button", "view"]).select(
        "event_id", "image_no", "category_id", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"),
    )


@query("failure_reviews", """WITH f AS (SELECT event_id // 8 AS frame, min(value / 100) AS m FROM events GROUP BY 1) SELECT frame, round(1 - m, 6) AS uncertainty FROM f""")
def failure_reviews(spark, d):
    f = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 8).alias("frame")).agg(
        F.collect_list(F.col("value") / 100).alias("scores")
    )
    return writers.failure_reviews(f).select("frame", F.round("uncertainty", 6).alias("uncertainty"))
