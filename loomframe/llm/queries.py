"""The training-data queries and their SQL, with production parameters, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm.common import table


def op1_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.grid_order_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = x LEFT JOIN n ON vec_id = a
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.sentencepiece_codec import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.toxicity import toxicity_scores

    out = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.line_dedup import drop_boilerplate

    out = drop_boilerplate(table(spark, sf_dir, "documents"), ratio=0.1)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


OP4_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT l.source, line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE trim(line) <> ''
      GROUP BY l.source, line, total HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) > 0.1 * total),
m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') END AS text,
       count(m.k) AS n_lines, count(m.k) FILTER (WHERE gone) AS n_dropped
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text
"""


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.resharding import reshard_documents

    return reshard_documents(table(spark, sf_dir, "documents"), shards=24)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), limit=2048)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomframe.llm.repeated_passages import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.expr("aggregate(zip_with(starts, ends, (s, e) -> e - s), 0L, (x, y) -> x + y)").alias("n_removed")
    return out.select("doc_id", "n_bytes", removed, F.size("starts").cast("bigint").alias("n_spans"), "kept_sha256")


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, j, substr(h, 2048 * j + 1, 2848) AS t, least(1024, len(h) // 2 - 399 - 1024 * j) AS n
  FROM (SELECT r, h, unnest(range(0, (len(h) // 2 + 624) // 1024)) AS j FROM d)),
p AS (SELECT r, 1024 * j + i AS i, md5(substr(t, 2 * i + 1, 800)) AS s FROM (SELECT r, j, t, unnest(range(0, n)) AS i FROM b)),
k AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
m AS (SELECT r, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM p SEMI JOIN k USING (s) WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, sum(least(400, coalesce(after - i, 400))) AS removed, list(i ORDER BY i) FILTER (WHERE before IS NULL OR i - before > 400) AS starts,
  list(i + 400 ORDER BY i) FILTER (WHERE after IS NULL OR after - i > 400) AS ends FROM m GROUP BY r),
x AS (SELECT doc_id, h, len(h) // 2 AS n, coalesce(removed, 0) AS removed, list_append(coalesce(starts, []), len(h) // 2) AS stops,
  list_prepend(0, coalesce(ends, [])) AS begins FROM d LEFT JOIN g USING (r))
SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, (len(stops) - 1)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(begins, lambda b, j: substr(h, 2 * b + 1, 2 * (stops[j] - b))), ''))) AS kept_sha256 FROM x
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
e AS MATERIALIZED (SELECT lang, source, term, k.n AS in_lang, coalesce(c.n, 0) AS n, v.v, v.n AS total FROM g JOIN k USING (lang) JOIN v USING (lang)
  LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS n FROM e GROUP BY lang, source),
w AS MATERIALIZED (SELECT e.lang, e.source, term, e.n, 1 + (1000000000 * (e.n + 1)::HUGEINT) // (s.n + v) AS p,
  1 + (1000000000 * (in_lang + 1)::HUGEINT) // (total + v) AS q FROM e JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term
  AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM w WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200
"""


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_grid_order_join": OP1_SQL, "op4_line_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op11_repeated_passages": OP11_SQL, "op13_source_divergence": OP13_SQL}
