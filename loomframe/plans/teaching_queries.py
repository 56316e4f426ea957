"""The labelling flow over clusters, and prelabels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import dedup, teaching
from loomframe.plans.dedup_queries import LEADERS_SQL
from loomframe.plans.registry import BOXES_SQL, HASHES_SQL, IOU_SQL, boxes, hashes, query

LABELED_SQL = LEADERS_SQL.format(hashes=HASHES_SQL, most=15) + """, t AS (SELECT vec_id, leader, CASE WHEN leader % 5 <> 0 THEN 'prim_' || (leader % 4) END AS primitive_id FROM l),
s AS (SELECT *, CASE WHEN primitive_id IS NULL THEN 'blocked_by_representative_failure' WHEN vec_id = leader THEN 'own' ELSE 'copied' END AS status
 FROM t)"""


def _teacher(request: str):
    """A stand-in teacher: answers all but every fifth sample."""
    import json

    n = json.loads(request)["sample_id"]
    return None if n % 5 == 0 else {"primitive_id": f"prim_{n % 4}", "confidence": 0.9}


def _labeled(spark, d):
    """One teacher call a cluster of near-equal hashes, copied to the rest."""
    members = dedup.greedy_leaders(hashes(spark, d), "h", "vec_id", 15)
    reps = members.where("vec_id = leader").select(
        "vec_id", teaching.payload(F.col("vec_id"), F.lit(None).cast("string"), ["a"], []).alias("request"),
    )
    told = teaching.teach(reps, "vec_id", "request", _teacher).select("vec_id", F.col("chosen.primitive_id").alias("primitive_id"))
    return teaching.label_clusters(members, told, "vec_id")


@query("label_auto", LABELED_SQL + " SELECT vec_id, leader, primitive_id, status FROM s")
def label_auto(spark, d):
    return _labeled(spark, d)


@query("label_auto_counts", LABELED_SQL + " SELECT status, count(*) AS n FROM s GROUP BY 1")
def label_auto_counts(spark, d):
    return teaching.label_counts(_labeled(spark, d))


@query("prelabel_boxes", f"""WITH RECURSIVE {BOXES_SQL}, p AS (SELECT vec_id // 20 AS image, (vec_id % 20)::INT AS pos, greatest(abs(x1), abs(y1), abs(x2), abs(y2)) AS m, x1, y1,
 x2, y2 FROM boxes),
g AS (SELECT image, pos, x1 * f * 1.92 AS x1, y1 * f * 1.08 AS y1, x2 * f * 1.92 AS x2, y2 * f * 1.08 AS y2
 FROM (SELECT *, CASE WHEN m <= 1.5 THEN 1000 WHEN m <= 1200 THEN 1 END AS f FROM p)),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY pos) AS k FROM g
 WHERE x2 > x1 AND y2 > y1 AND x2 > 0 AND y2 > 0 AND x1 < 1920 AND y1 < 1080),
r(image, k, kept, ok) AS (SELECT image, 0::BIGINT, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[], false FROM (SELECT DISTINCT image FROM o)
 UNION ALL
SELECT o.image, o.k, CASE WHEN c.n = 0 THEN list_append(r.kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE r.kept END, c.n = 0
FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1, LATERAL (SELECT count(*) AS n FROM (SELECT unnest(r.kept) AS p)
 WHERE {IOU_SQL.format(a="p", b="o")} >= 0.6) c)
SELECT image, pos, round(x1, 6) AS x1 FROM r JOIN o USING (image, k) WHERE ok""")
def prelabel_boxes(spark, d):
    raw = boxes(spark, d).select(
        F.floor(F.col("vec_id") / 20).alias("image"),
        (F.col("vec_id") % 20).cast("int").alias("at"),
        F.lit("x").alias("label"),
        "x1",
        "y1",
        "x2",
        "y2",
        F.lit(0.5).alias("score"),
    )
    return teaching.clean_boxes(raw, "image", F.lit(1920), F.lit(1080)).select(
        "image", F.col("at").alias("pos"), F.round("x1", 6).alias("x1"),
    )
