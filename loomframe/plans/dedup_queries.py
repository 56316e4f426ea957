"""Perceptual hashes, near-duplicate links and leaders, suppression, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.operators import dedup
from loomframe.plans.registry import BOXES_SQL, HASHES_SQL, IOU_SQL, boxes, hashes, query
from loomframe.runtime import table

LEADERS_SQL = """WITH RECURSIVE {hashes}, o AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, h FROM hashes),
r(k, leads, ids, found) AS (SELECT 0::BIGINT, []::UBIGINT[], []::BIGINT[], NULL::BIGINT UNION ALL
SELECT o.k, CASE WHEN m.i IS NULL THEN list_append(r.leads, o.h) ELSE r.leads END, CASE WHEN m.i IS NULL THEN list_append(r.ids, o.vec_id)
 ELSE r.ids END, CASE WHEN m.i IS NULL THEN o.vec_id ELSE r.ids[m.i] END
FROM r JOIN o ON o.k = r.k + 1, LATERAL (SELECT min(i) AS i FROM (SELECT unnest(range(1, len(r.leads) + 1)) AS i)
 WHERE bit_count(xor(r.leads[i], o.h)) <= {most}) m),
l AS (SELECT o.vec_id, r.found AS leader FROM r JOIN o USING (k) WHERE r.k > 0)
"""


@query("phash_bits", f"WITH {HASHES_SQL} SELECT vec_id, lower(hex(h)) AS hash FROM hashes")
def phash_bits(spark, d):
    return hashes(spark, d).select("vec_id", F.lower(F.hex("h")).alias("hash"))


@query("hamming_pairs", f"""WITH {HASHES_SQL} SELECT a.vec_id AS before, b.vec_id AS after, bit_count(xor(a.h, b.h))::INT AS distance FROM hashes a
 JOIN hashes b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 15""")
def hamming_pairs(spark, d):
    return dedup.close_pairs(hashes(spark, d), "h", "vec_id", 15)


@query("hamming_far", f"""WITH {HASHES_SQL}, u AS (SELECT DISTINCT h, CASE WHEN h >= 9223372036854775808::UBIGINT THEN (h::HUGEINT - 18446744073709551616)::BIGINT
 ELSE h::BIGINT END AS s FROM hashes)
SELECT a.s AS h, b.s AS g, bit_count(xor(a.h, b.h))::INT AS distance FROM u a JOIN u b ON a.s < b.s WHERE bit_count(xor(a.h, b.h)) <= 20""")
def hamming_far(spark, d):
    """Distinct hashes up to 20 bits apart, where no key of bits selects: tiles of blocks."""
    return dedup.close_hashes(hashes(spark, d).select("h").distinct(), 20)


@query("dedup_greedy", LEADERS_SQL.format(hashes=HASHES_SQL, most=15) + "SELECT vec_id FROM l WHERE vec_id = leader")
def dedup_greedy(spark, d):
    return dedup.deduplicate(hashes(spark, d), "h", "vec_id", 16).select("vec_id")


@query("dedup_le", LEADERS_SQL.format(hashes=HASHES_SQL, most=15) + "SELECT vec_id FROM l WHERE vec_id = leader")
def dedup_le(spark, d):
    return dedup.deduplicate(hashes(spark, d), "h", "vec_id", 15, inclusive=True).select("vec_id")


@query("dedup_clusters", LEADERS_SQL.format(hashes=HASHES_SQL, most=15) + ", n AS (SELECT leader, row_number() OVER (ORDER BY leader) AS c FROM (SELECT DISTINCT leader FROM l)) SELECT vec_id, leader, 'cluster_' || lpad(c::VARCHAR, 6, '0') AS cluster_id, vec_id = leader AS is_representative FROM l JOIN n USING (leader)")
def dedup_clusters(spark, d):
    return dedup.cluster_ids(hashes(spark, d), "h", "vec_id", 16)


@query("label_propagation", LEADERS_SQL.format(hashes=HASHES_SQL, most=15) + ", v AS (SELECT vec_id, CASE WHEN label % 3 <> 0 THEN label END AS value FROM embeddings) SELECT l.vec_id, leader, v.value::VARCHAR AS value, CASE WHEN v.value IS NULL THEN 'blocked' WHEN l.vec_id = leader THEN 'own' ELSE 'copied' END AS status FROM l LEFT JOIN v ON v.vec_id = l.leader")
def label_propagation(spark, d):
    """The leader's label for its cluster; a leader without one (every third label) blocks it."""
    members = dedup.greedy_leaders(hashes(spark, d), "h", "vec_id", 15)
    labels = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 3 != 0, F.col("label")).alias("value"))
    return dedup.propagate(members, labels, "vec_id", "value").withColumn("value", F.col("value").cast("string"))


@query("exact_text_groups", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text")
def exact_text_groups(spark, d):
    return table(spark, d, "documents").groupBy(
        F.sha2("text", 256).alias("h"), F.octet_length("text").alias("b"),
    ).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")


@query("iou_nms", f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT *, vec_id // 20 AS image, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS k FROM boxes),
r(image, k, kept, ok) AS (SELECT image, 0::BIGINT, []::STRUCT(vec_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[], false
 FROM (SELECT DISTINCT image FROM o) UNION ALL
SELECT o.image, o.k, CASE WHEN c.n = 0 THEN list_append(r.kept, {{'vec_id': o.vec_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}})
 ELSE r.kept END, c.n = 0
FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1, LATERAL (SELECT count(*) AS n FROM (SELECT unnest(r.kept) AS p)
 WHERE {IOU_SQL.format(a="p", b="o")} >= 0.6) c)
SELECT image, vec_id FROM r JOIN o USING (image, k) WHERE ok""")
def iou_nms(spark, d):
    """Twenty vectors in a row stand for one image."""
    return dedup.suppress_overlaps(boxes(spark, d).withColumn("image", F.floor(F.col("vec_id") / 20)), "image", "vec_id", 0.6)


@query("drift_min_distance", f"""WITH {HASHES_SQL}, r AS (SELECT h FROM hashes WHERE vec_id < 10), m AS (SELECT a.vec_id, min(bit_count(xor(a.h, r.h)))::INT AS distance
 FROM hashes a, r GROUP BY a.vec_id)
SELECT vec_id, distance, distance / 64.0 AS drift_score, distance / 64.0 > 12 / 64.0 AS is_drifted FROM m""")
def drift_min_distance(spark, d):
    """The first ten hashes are the known screens."""
    h = hashes(spark, d)
    out = dedup.drift(h, h.where("vec_id < 10"), "h", "vec_id")
    return out.withColumn("is_drifted", F.col("drift_score") > 12 / 64.0)
