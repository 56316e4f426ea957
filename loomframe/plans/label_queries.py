"""Regions, hotkeys, the local labeler, overlays, filters and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import text as T
from loomframe.functions.geometry import point_to_unit
from loomframe.operators import labels, quality
from loomframe.plans.registry import boxes, query
from loomframe.runtime import checkpoint, table

#: Inline dimension rows of these queries: (ord, name, box), (ord, situation, screens, primitives, regions), (ord, element, function, hotkeys, description).
ROIS = [
    (0, "top_bar", 0.0, 0.0, 1.0, 0.1),
    (1, "left_panel", 0.0, 0.1, 0.3, 1.0),
    (2, "minimap", 0.0, 0.6, 0.2, 1.0),
    (3, "end_turn_zone", 0.1, 0.05, 0.9, 0.5),
]
SITUATIONS = [
    (0, "idle", ["map"], ["END_TURN"], ["end_turn_zone"], []),
    (1, "city", ["city_screen"], ["choose_build", "close_city"], ["left_panel"], []),
    (2, "overview", ["map", "report"], ["open_map"], [], ["minimap"]),
    (3, "alert", ["popup"], ["popup_primitive"], [], ["top_bar"]),
]
ELEMENTS = [
    (0, "btn_end_turn", "END_TURN", ["ENTER", "SHIFT+ENTER"], "end turn button"),
    (1, "btn_map", "open_map", ["M"], "world map"),
    (2, "btn_build", "choose_build", ["B", "CTRL+B"], "build list"),
    (3, "btn_close", "close_city", ["ESC"], "close window"),
]


def _dims(spark):
    rois = spark.createDataFrame(ROIS, "ord int, roi_name string, x1 double, y1 double, x2 double, y2 double")
    situations = spark.createDataFrame(
        SITUATIONS,
        "ord int, situation_id string, screen_types array<string>, allowed_primitives array<string>, roi_priority array<string>, likely_rois array<string>",
    )
    elements = spark.createDataFrame(ELEMENTS, "ord int, semantic_id string, function_id string, hotkeys array<string>, description string")
    return rois, situations, elements


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


ROI_SQL = "rois AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', {a}, {b}, {c}, {e})" for o, n, a, b, c, e in ROIS) + ") t(ord, roi_name, x1, y1, x2, y2))"
SIT_SQL = "sits AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', {_list(s)}, {_list(p)}, {_list(r)})" for o, n, s, p, r, _ in SITUATIONS) + ") t(ord, situation_id, screens, prims, regions))"
ELEM_SQL = "elems AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', '{f}', {_list(h)}, '{x}')" for o, n, f, h, x in ELEMENTS) + ") t(ord, semantic_id, function_id, hotkeys, description))"
POINTS_SQL = "pts AS (SELECT vec_id, greatest(0, least(1, embedding[1]::DOUBLE * 1000 / 300)) AS px, greatest(0, least(1, embedding[2]::DOUBLE * 1000 / 300)) AS py, CASE vec_id % 8 WHEN 0 THEN 'm' WHEN 1 THEN 'Enter' WHEN 2 THEN 'esc' WHEN 3 THEN 'Q' ELSE NULL END AS key, CASE WHEN vec_id % 8 < 4 THEN 'press' ELSE 'click' END AS action FROM embeddings)"
HITS_SQL = f"{ROI_SQL}, {POINTS_SQL}, hits AS (SELECT pts.*, coalesce((SELECT list(roi_name ORDER BY roi_name) FROM rois WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2), []) AS roi_hits FROM pts)"
HOTKEY_SQL = f"{HITS_SQL}, {ELEM_SQL}, hk AS (SELECT hits.*, (SELECT arg_min(function_id, ord) FROM elems WHERE hits.key IS NOT NULL AND len(list_filter(hotkeys, lambda h: contains(upper(h), upper(hits.key)))) > 0) AS hot FROM hits)"
LABELS_SQL = f"""{HOTKEY_SQL}, {SIT_SQL},
al AS (SELECT hk.*, coalesce((SELECT flatten(list(prims ORDER BY ord)) FROM sits
 WHERE list_has_any(regions, roi_hits)), []) AS allowed, action = 'press' AND upper(trim(coalesce(key, ''))) IN ('ENTER', 'RETURN', 'ESC',
 'ESCAPE') AS pop FROM hk),
pr AS (SELECT *, CASE WHEN hot IS NOT NULL THEN hot WHEN len(allowed) > 0 THEN allowed[1] WHEN pop THEN 'popup_primitive' END AS primitive_id,
  CASE WHEN hot IS NOT NULL THEN 'hotkey_match' WHEN len(allowed) = 1 THEN 'roi_match' WHEN len(allowed) > 1 THEN 'roi_ambiguous'
 WHEN pop THEN 'default_popup_key' END AS by1 FROM al),
st AS (SELECT *, (SELECT arg_min(situation_id, ord) FROM sits
 WHERE list_contains(prims, primitive_id) AND list_has_any(regions, roi_hits)) AS s1, (SELECT arg_min(situation_id, ord) FROM sits
 WHERE list_contains(prims, primitive_id)) AS s2 FROM pr),
sc AS (SELECT st.*, coalesce(s1, s2) AS situation_id, CASE WHEN s1 IS NOT NULL THEN 'roi_match'
 WHEN s2 IS NOT NULL THEN 'primitive_default' END AS by2, (SELECT screens[1] FROM sits WHERE sits.situation_id = coalesce(s1, s2)) AS screen_type
 FROM st),
lab AS (SELECT vec_id, primitive_id, situation_id, screen_type, concat_ws(',', by1, by2) AS signals, round(least(0.75,
 (primitive_id IS NOT NULL)::INT * 0.35 + (situation_id IS NOT NULL)::INT * 0.25 + (screen_type IS NOT NULL)::INT * 0.10 + coalesce(by1 = 'hotkey_match', false)::INT * 0.20 + (coalesce(by1 = 'roi_match', false) OR coalesce(by2 = 'roi_match', false))::INT * 0.15), 6)::DOUBLE AS confidence FROM sc)"""


def _points(spark, d):
    """Points and keys derived from the vectors."""
    e = lambda k: point_to_unit(F.col("embedding")[k].cast("double") * 1000, F.lit(300))
    m = F.col("vec_id") % 8
    return table(spark, d, "embeddings").select(
        "vec_id",
        e(0).alias("px"),
        e(1).alias("py"),
        F.when(m == 0, "m").when(m == 1, "Enter").when(m == 2, "esc").when(m == 3, "Q").alias("key"),
        F.when(m < 4, "press").otherwise("click").alias("action"),
    )


@query("roi_hits", f"WITH {HITS_SQL} SELECT vec_id, array_to_string(roi_hits, ',') AS roi_hits FROM hits")
def roi_hits(spark, d):
    out = labels.roi_hits(_points(spark, d), _dims(spark)[0], "px", "py")
    return out.select("vec_id", F.array_join("roi_hits", ",").alias("roi_hits"))


@query("hotkey_lookup", f"WITH {HOTKEY_SQL} SELECT vec_id, hot AS hotkey_primitive FROM hk")
def hotkey_lookup(spark, d):
    return labels.hotkey_match(_points(spark, d), _dims(spark)[2], "key").select("vec_id", "hotkey_primitive")


def _local(spark, d):
    rois, situations, elements = _dims(spark)
    hits = labels.hotkey_match(labels.roi_hits(_points(spark, d), rois, "px", "py"), elements, "key")
    return labels.local_labels(hits, situations)


@query("roi_labeler", f"WITH {LABELS_SQL} SELECT * FROM lab")
def roi_labeler(spark, d):
    return _local(spark, d).select(
        "vec_id",
        "primitive_id",
        "situation_id",
        "screen_type",
        F.array_join("signals", ",").alias("signals"),
        F.round("confidence", 6).alias("confidence"),
    )


@query("primitive_counts", f"WITH {LABELS_SQL} SELECT primitive_id, count(*) AS n FROM lab WHERE primitive_id IS NOT NULL GROUP BY 1")
def primitive_counts(spark, d):
    return quality.counted(_local(spark, d), F.col("primitive_id"), "primitive_id")


@query("ontology_map", f"""WITH {ELEM_SQL}, t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'btn_map' ELSE 'x' END AS pid, CASE p_partkey % 5 WHEN 1 THEN ' BTN_CLOSE '
 WHEN 2 THEN 'the build list here' WHEN 3 THEN 'turn' ELSE NULL END AS ptext FROM part),
n AS (SELECT *, lower(trim(coalesce(ptext, ''))) AS x FROM t)
SELECT p_partkey, coalesce((SELECT arg_min(semantic_id, ord) FROM elems WHERE semantic_id = pid), (SELECT arg_min(semantic_id, ord) FROM elems
 WHERE x <> '' AND lower(semantic_id) = x),
 (SELECT arg_min(semantic_id, ord) FROM elems WHERE x <> '' AND (contains(description, x) OR contains(x, description)))) AS mapped_id FROM n""")
def ontology_map(spark, d):
    m = F.col("p_partkey") % 5
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.when(m == 0, "btn_map").otherwise("x").alias("pid"),
        F.when(m == 1, " BTN_CLOSE ").when(m == 2, "the build list here").when(m == 3, "turn").alias("ptext"),
    )
    return labels.ontology_match(rows, _dims(spark)[2], "pid", "ptext").select("p_partkey", "mapped_id")


@query("roi_crop", f"""WITH {ROI_SQL}, c AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'overview' ELSE NULL END AS sid, CASE
 WHEN vec_id % 4 = 2 THEN 'minimap' END AS own FROM embeddings),
n AS (SELECT vec_id, coalesce(own, CASE sid WHEN 'idle' THEN 'end_turn_zone' WHEN 'overview' THEN 'minimap' END, 'top_bar') AS roi_name FROM c),
b AS (SELECT vec_id, greatest(0, least(1919, round_even(x1 * 1920, 0)::INT)) AS x1, greatest(0, least(1079, round_even(y1 * 1080, 0)::INT)) AS y1,
 round_even(x2 * 1920, 0)::INT AS x2, round_even(y2 * 1080, 0)::INT AS y2 FROM n JOIN rois USING (roi_name))
SELECT vec_id, x1, y1, greatest(x1 + 1, least(1920, x2)) AS x2, greatest(y1 + 1, least(1080, y2)) AS y2 FROM b""")
def roi_crop(spark, d):
    rois, situations, _ = _dims(spark)
    m = F.col("vec_id") % 4
    rows = samples(spark, d).select(
        "vec_id",
        F.col("label").withField("page", F.col("label.page").withField("situation_id", F.when(m == 0, "idle").when(m == 1, "overview"))).withField(
            "route_label",
            F.col("label.route_label").withField("roi_name", F.when(m == 2, "minimap")).withField(
                "roi_bbox_norm", F.lit(None).cast("array<double>"),
            ),
        ).alias("label"),
        F.lit(1920).alias("w"),
        F.lit(1080).alias("h"),
    )
    return labels.roi_crop(rows, situations, rois, "w", "h", ["no_such", "top_bar"]).select("vec_id", "crop.*")


def samples(spark, d):
    """Nested samples from the vectors' boxes: one or two elements, every third edited with one kind of correction."""
    b = boxes(spark, d)
    v, m = F.col("vec_id"), F.col("vec_id") % 9
    null = lambda kind: F.lit(None).cast(kind)

    def element(k: int, target):
        part = {
            "element_id": F.format_string("elem_%03d", F.lit(k)),
            "bbox_x_min": F.col("x1") + 5.0 * k,
            "bbox_y_min": F.col("y1"),
            "bbox_x_max": F.col("x2") + 5.0 * k,
            "bbox_y_max": F.col("y2"),
            "semantic_id": F.concat(F.lit("sem_"), F.col("label").cast("string")),
            "semantic_text": F.when(v % 2 == 0, F.lit("")).otherwise("text"),
            "function_id": F.lit(f"fn_{k}"),
            "hotkeys": F.array().cast("array<string>"),
            "available_actions": F.array(F.lit("click")),
            "enabled_state": F.when((v % 10 == 9) & F.lit(k == 1), "disabled").otherwise("enabled"),
            "roi_name": null("string"),
            "is_route_target": target,
            "confidence": F.when(v % 3 == 0, 0.0).otherwise(0.5 + 0.1 * k),
            "metadata": null("string"),
        }
        return F.struct(*(c.alias(n) for n, c in part.items()))

    page = F.struct(
        F.lit("map").alias("screen_type"),
        F.when(v % 6 != 5, F.concat(F.lit("sit_"), (v % 4).cast("string"))).alias("situation_id"),
        F.array().cast("array<string>").alias("state_flags"),
        F.lit(0.8).alias("confidence"),
    )
    names = labels.fields(labels.ROUTE)
    kinds = {"roi_bbox_norm": "array<double>", "confidence": "double"}
    route = F.struct(
        *(
            (
                F.when(
                    v % 7 != 6, F.concat(F.lit("prim_"), (v % 5).cast("string")),
                ) if n == "primitive_id" else null(kinds.get(n, "string"))
            ).alias(n) for n in names
        )
    )
    elements = F.when(v % 4 == 0, F.array(element(0, F.lit(False)))).otherwise(F.array(element(0, F.lit(False)), element(1, F.lit(True))))
    label = F.struct(
        page.alias("page"),
        route.alias("route_label"),
        elements.alias("elements"),
        null("string").alias("evidence"),
        ((v % 11) / 10.0).alias("confidence"),
        F.lit(False).alias("transition_detected"),
    )
    corrections = F.when(m == 0, '{"primitive_id":"fixed","situation_id":null}').when(m == 3, '{"page":{"screen_type":"city"},"bbox_xyxy":[1,2,30,40]}').when(
        m == 6,
        '{"elements":[{"element_id":"new","bbox_x_min":1.0,"bbox_y_min":1.0,"bbox_x_max":9.0,"bbox_y_max":9.0,"enabled_state":"enabled","function_id":"fn_new"}],"route_label":{}}',
    )
    status = F.when(v % 3 == 0, "edited").when(v % 10 == 1, "rejected").when(v % 10 == 2, "approved").otherwise("pending")
    return b.select(
        "vec_id",
        T.sample_id(v).alias("sample_id"),
        F.concat(F.lit("session_"), F.col("label").cast("string")).alias("session_id"),
        label.alias("label"),
        status.alias("review_status"),
        corrections.alias("corrections"),
        "x1",
        "y1",
        "x2",
        "y2",
    )


#: Flat view of the effective labels of samples() in SQL.
EFFECTIVE_SQL = """b0 AS (SELECT vec_id, label AS cls, embedding[1]::DOUBLE * 1000 AS x1, embedding[2]::DOUBLE * 1000 AS y1,
 embedding[1]::DOUBLE * 1000 + abs(embedding[3]::DOUBLE) * 1000 AS x2, embedding[2]::DOUBLE * 1000 + abs(embedding[4]::DOUBLE) * 1000 AS y2,
 vec_id % 9 AS m FROM embeddings),
eff AS (SELECT vec_id, cls, 'session_' || cls AS session_id, 'sample_' || lpad(vec_id::VARCHAR, 6, '0') AS sample_id, CASE WHEN m = 3 THEN 'city'
 ELSE 'map' END AS screen_type,
 CASE WHEN m IN (0, 3) THEN NULL WHEN vec_id % 6 <> 5 THEN 'sit_' || (vec_id % 4) END AS situation_id,
 CASE WHEN m = 0 THEN 'fixed' WHEN m = 6 THEN 'fn_new' WHEN m = 3 THEN coalesce(CASE WHEN vec_id % 7 <> 6 THEN 'prim_' || (vec_id % 5) END, CASE
 WHEN vec_id % 4 = 0 THEN 'fn_0' ELSE 'fn_1' END) WHEN vec_id % 7 <> 6 THEN 'prim_' || (vec_id % 5) END AS primitive_id,
 CASE WHEN m = 6 THEN 1 WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END AS n_elements, CASE WHEN m = 6 THEN 9.0 WHEN m = 3 THEN 30.0 WHEN vec_id % 4 = 0 THEN x2
 ELSE x2 + 5 END AS primary_x2,
 CASE WHEN vec_id % 3 = 0 THEN 'edited' WHEN vec_id % 10 = 1 THEN 'rejected' WHEN vec_id % 10 = 2 THEN 'approved' ELSE 'pending' END AS review_status,
 (vec_id % 11) / 10.0 AS confidence, x1, y1, x2, y2, m FROM b0)"""


def effective(spark, d):
    return labels.effective_label(samples(spark, d))


@query("effective_label", f"""WITH {EFFECTIVE_SQL} SELECT vec_id, screen_type, situation_id, primitive_id, n_elements, round(primary_x2, 6) AS primary_x2 FROM eff""")
def effective_label(spark, d):
    flat = labels.flat_fields(F.col("label"))
    return effective(spark, d).select(
        "vec_id",
        flat["screen_type"].alias("screen_type"),
        flat["situation_id"].alias("situation_id"),
        flat["primitive_id"].alias("primitive_id"),
        F.size("label.elements").alias("n_elements"),
        F.round(flat["bbox_x_max"], 6).alias("primary_x2"),
    )


QUALITY_SQL = """dup AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY text) AS dup FROM documents),
q AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS labeled, l.quality, l.toxic, length(text) < 400 AS short, d.lang <> 'en' AS foreign_, dup FROM dup d
 LEFT JOIN labels l USING (doc_id))"""


def _documents(spark, d):
    """Documents as samples: short texts have a quality issue, equal texts after the first are duplicates."""
    docs = table(spark, d, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"))
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("labeled"))
    return docs.withColumn("h", F.sha2("text", 256)).join(first, "h").join(lab, "doc_id", "left").select(
        "doc_id",
        F.coalesce("labeled", F.lit(False)).alias("labeled"),
        "quality",
        "toxic",
        (F.length("text") < 400).alias("short"),
        (F.col("lang") != "en").alias("foreign_"),
        (F.col("doc_id") > F.col("first_id")).alias("dup"),
    )


def _flagged(spark, d):
    tests = {
        "quality_issue": F.col("short"),
        "missing_primitive_id": F.col("labeled") & (F.col("quality") == 0),
        "missing_situation_id": F.col("labeled") & (F.col("toxic") == 1),
        "legacy_invalid_action": F.col("foreign_"),
        "duplicate_non_representative": F.col("dup"),
    }
    return _documents(spark, d).withColumn("flags", quality.flags(tests))


FLAGS_SQL = f"{QUALITY_SQL}, f AS (SELECT *, list_filter([CASE WHEN short THEN 'quality_issue' END, CASE WHEN labeled AND quality = 0 THEN 'missing_primitive_id' END, CASE WHEN labeled AND toxic = 1 THEN 'missing_situation_id' END, CASE WHEN foreign_ THEN 'legacy_invalid_action' END, CASE WHEN dup THEN 'duplicate_non_representative' END], lambda x: x IS NOT NULL) AS flags FROM q)"
SCORE_SQL = "round(greatest(0, least(1, 1 - CASE WHEN list_contains(flags, 'quality_issue') THEN 0.25 ELSE 0 END - CASE WHEN list_contains(flags, 'duplicate_non_representative') THEN 0.2 ELSE 0 END - CASE WHEN list_contains(flags, 'missing_primitive_id') THEN 0.35 ELSE 0 END - CASE WHEN list_contains(flags, 'missing_situation_id') THEN 0.25 ELSE 0 END - CASE WHEN list_contains(flags, 'legacy_invalid_action') THEN 0.1 ELSE 0 END)), 6)::DOUBLE"


@query("quality_score", f"WITH {FLAGS_SQL} SELECT doc_id, array_to_string(flags, ',') AS flags, {SCORE_SQL} AS score FROM f")
def quality_score(spark, d):
    return _flagged(spark, d).select(
        "doc_id", F.array_join("flags", ",").alias("flags"), F.round(quality.score(F.col("flags")), 6).alias("score"),
    )


@query("flag_counts", f"WITH {FLAGS_SQL} SELECT unnest(flags) AS flag, count(*) AS n FROM f GROUP BY 1")
def flag_counts(spark, d):
    return quality.flag_counts(_flagged(spark, d))


@query("merge_flags", f"""WITH {FLAGS_SQL}, b AS (SELECT doc_id, dup, list_filter(flags, lambda x: x <> 'duplicate_non_representative') AS o FROM f)
 SELECT doc_id, array_to_string(list_concat(list_concat(o, CASE WHEN list_contains(o, 'quality_issue') THEN []::VARCHAR[] ELSE ['quality_issue'] END),
 CASE WHEN dup THEN ['duplicate_non_representative'] ELSE []::VARCHAR[] END), ',') AS flags FROM b""")
def merge_flags(spark, d):
    merged = quality.merge_flags(F.col("flags"), F.array(F.lit("quality_issue")), ~F.col("dup"))
    return _flagged(spark, d).select("doc_id", F.array_join(merged, ",").alias("flags"))


@query("filter_cascade", f"""WITH {QUALITY_SQL} SELECT CASE WHEN foreign_ THEN 'invalid_action' WHEN short THEN 'quality' WHEN coalesce(toxic = 1, false) THEN 'transition'
 WHEN dup THEN 'dedup' ELSE 'kept' END AS drop_stage, count(*) AS n FROM q GROUP BY 1""")
def filter_cascade(spark, d):
    stages = {"invalid_action": F.col("foreign_"), "quality": F.col("short"), "transition": F.col("toxic") == 1, "dedup": F.col("dup")}
    return quality.drop_counts(quality.cascade(_documents(spark, d), stages))


@query("persist_rejections", f"""WITH {QUALITY_SQL} SELECT doc_id, CASE WHEN (short OR foreign_) AND doc_id % 4 <> 0 THEN 'rejected' WHEN doc_id % 4 = 0 THEN 'approved'
 ELSE 'pending' END AS review_status FROM q""")
def persist_rejections(spark, d):
    rows = _documents(spark, d).withColumn("review_status", F.when(F.col("doc_id") % 4 == 0, "approved").otherwise("pending"))
    return quality.reject_dropped(rows, rows.where("NOT short AND NOT foreign_"), "doc_id").select("doc_id", "review_status")


@query("dataset_stats", f"""WITH {EFFECTIVE_SQL} SELECT count(*) AS total, count(*) AS labeled, 0::BIGINT AS unlabeled,
 count(*) FILTER (WHERE review_status = 'approved') AS approved, count(*) FILTER (WHERE review_status = 'edited') AS edited,
 count(*) FILTER (WHERE review_status = 'rejected') AS rejected,
count(*) FILTER (WHERE review_status = 'pending') AS pending, round(avg(confidence), 6) AS avg_confidence,
 count(*) FILTER (WHERE primitive_id IS NULL) AS missing_primitive_id, count(*) FILTER (WHERE situation_id IS NULL) AS missing_situation_id,
 count(*) FILTER (WHERE vec_id % 13 = 0) AS duplicates FROM eff""")
def dataset_stats(spark, d):
    rows = effective(spark, d).withColumn("flags", F.when(F.col("vec_id") % 13 == 0, F.array(F.lit(quality.DUPLICATE))))
    flat = labels.flat_fields(F.col("label"))
    out = quality.dataset_stats(
        rows,
        F.col("label.confidence"),
        flat["primitive_id"],
        flat["situation_id"],
        F.col("review_status"),
        F.col("flags"),
        F.col("label").isNotNull(),
    )
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("situation_counts", f"WITH {EFFECTIVE_SQL} SELECT situation_id, count(*) AS n FROM eff WHERE situation_id IS NOT NULL GROUP BY 1")
def situation_counts(spark, d):
    situations = checkpoint(effective(spark, d).select(F.col("label.page.situation_id").alias("situation")))
    return quality.counted(situations, F.col("situation"), "situation_id")


@query("teacher_apply", f"""WITH {EFFECTIVE_SQL} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'taught' ELSE CASE
 WHEN vec_id % 7 <> 6 THEN 'prim_' || (vec_id % 5) END END AS primitive_id, CASE WHEN vec_id % 6 <> 5 THEN 'sit_' || (vec_id % 4) END AS situation_id,
 CASE WHEN vec_id % 2 = 0 AND vec_id % 3 = 0 THEN confidence WHEN vec_id % 2 = 0 THEN 0.9 ELSE confidence END AS confidence FROM eff""")
def teacher_apply(spark, d):
    s = samples(spark, d)
    even = s.where("vec_id % 2 = 0").select(
        "vec_id",
        F.struct(
            F.lit("taught").alias("primitive_id"),
            F.lit("").alias("situation_id"),
            F.lit(None).cast("string").alias("screen_type"),
            F.lit("minimap").alias("roi_name"),
            F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(0.9).alias("confidence"),
        ).alias("chosen"),
        F.lit("[]").alias("route_candidates"),
    )
    out = labels.apply_teacher(s, even, "vec_id")
    return out.select("vec_id", F.col("label.route_label.primitive_id"), F.col("label.page.situation_id"), F.col("label.confidence"))
