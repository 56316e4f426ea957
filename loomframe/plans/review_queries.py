"""Review queues, splits, judging, preference pairs, iteration history, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe import improvement
from loomframe.functions import text as T
from loomframe.functions.geometry import Box
from loomframe.operators import improve, monitor, review, search, split
from loomframe.plans.registry import BOXES_SQL, EVENTS_SQL, IOU_SQL, SQL, boxes, events, query
from loomframe.runtime import table

AMBIGUITY_SQL = f"""{BOXES_SQL}, s AS (SELECT *, vec_id // 20 AS image, (vec_id % 97) / 97.0 AS score FROM boxes),
a AS (SELECT vec_id, image, round(CASE WHEN EXISTS (SELECT 1 FROM s o
 WHERE o.image = s.image AND o.vec_id <> s.vec_id AND {IOU_SQL.format(a='o', b='s')} > 0.3) THEN least(1, 1 - score + 0.2) ELSE 1 - score END,
 4) AS uncertainty FROM s)"""


def _unsure(spark, d):
    b = boxes(spark, d).withColumn("image", F.floor(F.col("vec_id") / 20)).withColumn("score", (F.col("vec_id") % 97) / 97.0)
    return review.ambiguity(b, "image", "vec_id", "score")


@query("ambiguity_uncertainty", f"WITH {AMBIGUITY_SQL} SELECT * FROM a")
def ambiguity_uncertainty(spark, d):
    return _unsure(spark, d)


@query("needs_review", f"WITH {AMBIGUITY_SQL} SELECT vec_id FROM a WHERE uncertainty > 0.6")
def needs_review(spark, d):
    return _unsure(spark, d).where(review.needs_review(F.col("uncertainty"))).select("vec_id")


@query("review_topn", f"WITH {AMBIGUITY_SQL} SELECT vec_id, uncertainty FROM a WHERE vec_id % 5 <> 0 ORDER BY uncertainty DESC, vec_id LIMIT 10")
def review_topn(spark, d):
    return review.top_uncertain(
        _unsure(spark, d).withColumn("reviewed", F.col("vec_id") % 5 == 0), 10, "uncertainty", "vec_id", "reviewed",
    ).select("vec_id", "uncertainty")


PRIORITY_SQL = """base AS (SELECT event_id, value / 100 AS conf, event_id % 3 = 0 AS mp, event_id % 5 = 0 AS ms, event_id % 7 = 0 AS rep, event_id % 11 AS hard,
 event_id % 13 = 0 AS conflict, event_id % 17 = 0 AS popup, [0.5, 0.5 - (event_id % 30) / 100.0] AS cands FROM events),
p AS (SELECT event_id, conf, greatest(0, conf - (CASE WHEN mp THEN 0.35 ELSE 0 END + CASE WHEN ms THEN 0.25 ELSE 0 END + CASE WHEN rep THEN 0.1
 ELSE 0 END + least(0.2, 0.05 * hard) + CASE WHEN conflict THEN 0.15 ELSE 0 END + CASE WHEN popup THEN 0.25 ELSE 0 END + CASE
 WHEN cands[1] - cands[2] < 0.1 THEN 0.2 WHEN cands[1] - cands[2] < 0.2 THEN 0.1 ELSE 0 END)) AS priority FROM base)"""


@query("review_priority", f"""WITH {PRIORITY_SQL} SELECT event_id, CASE WHEN conf >= 0.45 THEN 'approved' ELSE 'review' END AS decision, CASE WHEN conf < 0.45 THEN round(priority,
 6) END AS priority FROM p""")
def review_priority(spark, d):
    n = F.col("event_id")
    flags = F.array_compact(F.array(F.when(n % 3 == 0, "missing_primitive_id"), F.when(n % 5 == 0, "missing_situation_id")))
    conf = F.col("value") / 100
    score = review.priority(
        conf, flags, n % 7 == 0, F.lit(False), n % 11, n % 13 == 0, n % 17 == 0, F.array(F.lit(0.5), F.lit(0.5) - (n % 30) / 100.0),
    )
    out = review.queue(table(spark, d, "events"), score, "event_id", 0.45, conf)
    return out.select("event_id", "decision", F.round("priority", 6).alias("priority"))


@query("queue_stats", """SELECT count(*) AS total, count(*) FILTER (WHERE value > 20) AS reviewed, count(*) FILTER (WHERE value <= 20) AS pending,
 count(*) FILTER (WHERE value > 20 AND event_id % 2 = 0) AS with_corrections FROM events""")
def queue_stats(spark, d):
    return review.queue_stats(table(spark, d, "events"), F.col("value") > 20, F.col("event_id") % 2 == 0)


@query("latest_decision", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS version FROM events GROUP BY 1")
def latest_decision(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    return review.latest_decision(e, "user_id", "version")


@query("mark_reviewed", """WITH k AS (SELECT event_id, user_id, value > 30 AS reviewed, row_number() OVER (PARTITION BY user_id, value > 30 ORDER BY event_id) AS k FROM events)
 SELECT event_id, reviewed OR (NOT reviewed AND k = 1 AND user_id % 2 = 0) AS reviewed FROM k""")
def mark_reviewed(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "user_id", (F.col("value") > 30).alias("reviewed"), F.lit(None).cast("string").alias("corrections"),
    )
    decided = e.where("user_id % 2 = 0").select("user_id").distinct().withColumn("corrections", F.lit("{}"))
    return review.mark_reviewed(e, decided, "user_id", "event_id").select("event_id", "reviewed")


#: Five candidates an event from its numbers: equal ranks and confidences, absent, empty and repeated values among them.
CHOICES_SQL = """v AS (SELECT *, (event_id * 7 + user_id) AS k FROM events),
c AS (SELECT event_id, user_id, k, i, 1 + (k + i) % 3 AS rank, ((k + 2 * i) % 4) / 4.0 AS conf, CASE WHEN (k + i) % 5 = 0 THEN NULL WHEN (k + i) % 7 = 0
 THEN '' ELSE 'v' || ((k * (i + 1)) % 6) END AS value FROM v, (SELECT unnest(range(5)) AS i)),
t AS (SELECT event_id, user_id, i, value, row_number() OVER (PARTITION BY event_id ORDER BY rank, -conf, value NULLS FIRST) AS n FROM c),
f AS (SELECT event_id, value, min(n) AS n FROM t WHERE n <= 3 AND value <> '' GROUP BY 1, 2)"""


def _choices(spark, d):
    k = F.col("event_id") * 7 + F.col("user_id")
    value = lambda i: F.when((k + i) % 5 == 0, None).when((k + i) % 7 == 0, "").otherwise(F.concat(F.lit("v"), ((k * (i + 1)) % 6).cast("string")))
    made = [F.struct((1 + (k + i) % 3).alias("rank"), (((k + 2 * i) % 4) / 4.0).alias("confidence"), value(i).alias("value")) for i in range(5)]
    current = F.when(F.col("user_id") % 4 == 0, None).when(F.col("user_id") % 4 == 1, "").otherwise(F.concat(F.lit("v"), (F.col("user_id") % 9).cast("string")))
    return table(spark, d, "events").withColumn("made", F.array(*made)).withColumn("current", current)


@query("candidate_choices", f"""WITH {CHOICES_SQL}, l AS (SELECT event_id, list(value ORDER BY n) AS top FROM f GROUP BY 1),
w AS (SELECT event_id, coalesce(top, []::VARCHAR[]) AS top, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'v' || (user_id % 9) END AS cur
 FROM v LEFT JOIN l USING (event_id)),
x AS (SELECT event_id, CASE WHEN coalesce(cur, '') = '' OR list_contains(top, cur) THEN top ELSE list_prepend(cur, top) END AS firsts FROM w)
SELECT event_id, array_to_string(firsts || list_filter(['v1', 'x', 'v8'], lambda t: NOT list_contains(firsts, t)), ',') AS choices FROM x""")
def candidate_choices(spark, d):
    taxonomy = F.array(F.lit("v1"), F.lit("x"), F.lit("v8"))
    return _choices(spark, d).select("event_id", F.array_join(review.candidate_choices(F.col("made"), F.col("current"), taxonomy), ",").alias("choices"))


@query("preferred_first", """WITH l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN []::VARCHAR[] ELSE [event_type, 'u' || (user_id % 5)] END AS had,
 ['view', 'u' || (event_id % 5), 'click', 'u3', 'error'] AS every FROM events),
o AS (SELECT event_id, every, list_filter(had, lambda x: list_contains(every, x)) AS p FROM l)
SELECT event_id, array_to_string(p || list_filter(every, lambda x, i: NOT list_contains(p, x) AND list_position(every, x) = i), ',') AS ordering FROM o""")
def preferred_first(spark, d):
    """A type and a user's group come first where they are known; none on every eleventh event, repeated ones count once."""
    pref = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")), "event_type")
    pref = F.when(F.col("event_id") % 11 == 0, F.array().cast("array<string>")).otherwise(pref)
    group = F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string"))
    every = F.array_distinct(F.array(F.lit("view"), group, F.lit("click"), F.lit("u3"), F.lit("error")))
    return table(spark, d, "events").select("event_id", F.array_join(review.preferred_first(pref, every), ",").alias("ordering"))


@query("parse_numbers", "SELECT page_id, list_transform(regexp_extract_all(html, '(-?\\d+(?:\\.\\d+)?)', 1)[1:4], lambda x: x::DOUBLE)[1] AS n1, len(regexp_extract_all(html, '(-?\\d+(?:\\.\\d+)?)', 1)) >= 4 AS enough FROM pages")
def parse_numbers(spark, d):
    p = table(spark, d, "pages")
    found = F.regexp_extract_all("html", F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return p.select(
        "page_id",
        F.coalesce(F.get(T.numbers_or_null(F.col("html")), F.lit(0)), F.get(found, F.lit(0)).cast("double")).alias("n1"),
        T.numbers_or_null(F.col("html")).isNotNull().alias("enough"),
    )


@query("json_clean", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_clean(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.clean_json(fenced), "$.k").cast("int").alias("k"))


@query("event_labels", """SELECT event_id, CASE event_type WHEN 'click' THEN 'button' END AS label, upper(event_type[1]) || event_type[2:] AS pretty FROM events""")
def event_labels(spark, d):
    return table(spark, d, "events").select(
        "event_id", T.event_label(F.col("event_type")).alias("label"), T.prettify(F.col("event_type")).alias("pretty"),
    )


@query("split_sessions", """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CASE WHEN k > n - greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM documents JOIN s USING (source)""")
def split_sessions(spark, d):
    return split.by_session(table(spark, d, "documents"), "source", "doc_id", F.col("doc_id")).select("doc_id", "split")


@query("split_rows", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events)
 SELECT event_id, CASE WHEN k > n - greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_rows(spark, d):
    e = table(spark, d, "events").withColumn("session", F.lit("samples")).withColumn("sid", T.sample_id(F.col("event_id")))
    return split.by_session(e, "session", "sid", T.numeric_suffix(F.col("sid"))).select("event_id", "split")


@query("split_head_tail", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events)
 SELECT event_id, CASE WHEN k <= trunc(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM r""")
def split_head_tail(spark, d):
    return split.head_tail(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "split")


@query("every_nth", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) SELECT event_id FROM r WHERE k % 10 = 0 AND k < 5000""")
def every_nth(spark, d):
    return split.every_nth(table(spark, d, "events"), ["ts", "event_id"], 10, 500).select("event_id")


@query("hash_sample", "SELECT event_id FROM (SELECT event_id FROM events ORDER BY md5(concat_ws(':', event_id, 7)), event_id LIMIT 100)")
def hash_sample(spark, d):
    """A sampling operator: its size is the request."""
    return split.hash_sample(table(spark, d, "events"), "event_id", 100).select("event_id")


JUDGE_SQL = f"""{BOXES_SQL}, j0 AS (SELECT vec_id, x1, y1, x2, y2, x1 + (vec_id % 60) AS cx, y1 + 5 AS cy, (vec_id % 10) / 10.0 AS conf FROM boxes),
j1 AS (SELECT *, x2 - x1 AS bw, y2 - y1 AS bh, greatest(0, (x2 - x1) * (y2 - y1)) / (1920 * 1080) AS ratio, coalesce(cx BETWEEN x1 AND x2
 AND cy BETWEEN y1 AND y2, false) AS inside FROM j0),
j2 AS (SELECT *, CASE WHEN bw > 0 AND bh > 0 THEN greatest(bw / bh, bh / bw) END AS aspect FROM j1),
j AS (SELECT vec_id, inside, conf, CASE WHEN bw <= 0 OR bh <= 0 THEN 0 ELSE greatest(0, least(1, 1 - CASE WHEN ratio < 0.0001 THEN 0.3
 ELSE 0 END - CASE WHEN ratio > 0.5 THEN 0.3 ELSE 0 END - CASE WHEN aspect IS NULL OR aspect > 10 THEN 0.2 ELSE 0 END - CASE WHEN NOT inside THEN 0.3
 ELSE 0 END - CASE WHEN conf < 0.3 THEN 0.2 ELSE 0 END)) END AS score,
 array_to_string(list_filter([CASE WHEN ratio < 0.0001 THEN 'bbox_too_small' END, CASE WHEN ratio > 0.5 THEN 'bbox_too_large' END, CASE
 WHEN aspect IS NULL OR aspect > 10 THEN 'extreme_aspect_ratio' END, CASE WHEN NOT inside THEN 'click_outside_bbox' END, CASE
 WHEN conf < 0.3 THEN 'low_confidence' END, CASE WHEN bw <= 0 OR bh <= 0 THEN 'degenerate_bbox' END], lambda x: x IS NOT NULL), ',') AS penalties
 FROM j2),
en AS (SELECT vec_id, round(0.6 * ((vec_id * 37 % 101) / 101.0) + 0.4 * score, 6) AS score FROM j)"""


def _judged(spark, d):
    b = boxes(spark, d).withColumn("conf", (F.col("vec_id") % 10) / 10.0)
    return b.withColumn(
        "j", improve.heuristic(Box.cols(), F.col("x1") + F.col("vec_id") % 60, F.col("y1") + 5, F.col("conf"), F.lit(1920), F.lit(1080)),
    )


def _ensemble(spark, d):
    return _judged(spark, d).select(
        "vec_id", F.round(improve.ensemble((F.col("vec_id") * 37 % 101) / 101.0, F.col("j.score")), 6).alias("score"),
    )


@query("heuristic_judge", f"WITH {JUDGE_SQL} SELECT vec_id, inside AS click_inside, round(score, 6)::DOUBLE AS score, penalties FROM j")
def heuristic_judge(spark, d):
    return _judged(spark, d).select(
        "vec_id", F.col("j.click_inside"), F.round("j.score", 6).alias("score"), F.array_join("j.penalties", ",").alias("penalties"),
    )


@query("ensemble_score", f"WITH {JUDGE_SQL} SELECT * FROM en")
def ensemble_score(spark, d):
    return _ensemble(spark, d)


@query("rank_judgments", f"WITH {JUDGE_SQL} SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM en")
def rank_judgments(spark, d):
    return improve.ranked(_ensemble(spark, d), "score", "vec_id").select("vec_id", "rank")


@query("pref_top_bottom", f"""WITH {JUDGE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS k, count(*) OVER () AS n FROM en)
 SELECT a.vec_id AS chosen, b.vec_id AS rejected, a.score AS chosen_score, b.score AS rejected_score FROM r a
 JOIN r b ON a.k <= greatest(1, trunc(a.n * 0.3)) AND b.k > b.n - greatest(1, trunc(b.n * 0.3)) AND a.score - b.score >= 0.1""")
def pref_top_bottom(spark, d):
    return improve.top_bottom_pairs(_ensemble(spark, d), "vec_id", "score", "vec_id")


@query("pref_pairwise", f"""WITH {JUDGE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS k, score - lead(score) OVER (ORDER BY score DESC, vec_id) AS gap
 FROM en) SELECT a.vec_id AS chosen, b.vec_id AS rejected, a.score AS chosen_score, b.score AS rejected_score FROM r a JOIN r b ON a.k < b.k
 WHERE a.gap >= 0.1""")
def pref_pairwise(spark, d):
    return improve.ranked_pairs(_ensemble(spark, d), "vec_id", "score", "vec_id")


LEVELS_SQL = f"{JUDGE_SQL}, lv AS (SELECT vec_id, floor(score * 4) / 4 AS score FROM en)"


@query("pref_pairwise_levels", f"""WITH {LEVELS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS k, score - lead(score) OVER (ORDER BY score DESC, vec_id) AS gap
 FROM lv) SELECT a.vec_id AS chosen, b.vec_id AS rejected, a.score AS chosen_score, b.score AS rejected_score FROM r a JOIN r b ON a.k < b.k
 WHERE a.gap >= 0.1""")
def pref_pairwise_levels(spark, d):
    """pref_pairwise over scores in quarters: many ties, and gaps that make pairs."""
    quarters = _ensemble(spark, d).withColumn("score", F.floor(F.col("score") * 4) / 4)
    return improve.ranked_pairs(quarters, "vec_id", "score", "vec_id")


def _predicted(spark, d):
    """Boxes of two prompts a vector: one moved, one of twice the width or none on every third."""
    b = boxes(spark, d).select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").cast("string").alias("sample_id"), "vec_id", "x1", "y1", "x2", "y2")
    keys = ["session_id", "sample_id"]
    moved = b.select(*keys, F.lit("a").alias("prompt"), (F.col("x1") + F.col("vec_id") % 50).alias("x1"), "y1", (F.col("x2") + F.col("vec_id") % 50).alias("x2"), "y2")
    there = F.col("vec_id") % 3 != 0
    wide = b.select(*keys, F.lit("b").alias("prompt"), *(F.when(there, c).alias(n) for n, c in (("x1", F.col("x1")), ("y1", F.col("y1")), ("x2", 2 * F.col("x2") - F.col("x1")), ("y2", F.col("y2")))))
    return b, moved.unionByName(wide).where("cast(sample_id AS int) % 7 <> 0")


PREDICTED_SQL = f"""{BOXES_SQL}, p AS (SELECT vec_id, 'a' AS prompt, x1 + vec_id % 50 AS x1, y1, x2 + vec_id % 50 AS x2, y2 FROM boxes UNION ALL
 SELECT vec_id, 'b', CASE WHEN vec_id % 3 <> 0 THEN x1 END, y1, 2 * x2 - x1, y2 FROM boxes),
i AS (SELECT a.vec_id, CASE WHEN b.x1 IS NULL THEN 0 ELSE {IOU_SQL.format(a="b", b="a")} END AS iou FROM boxes a JOIN p b ON a.vec_id = b.vec_id AND a.vec_id % 7 <> 0),
s AS (SELECT b.vec_id, coalesce(avg(iou), 0) AS score FROM boxes b LEFT JOIN i USING (vec_id) GROUP BY 1)"""


@query("judge_predictions", f"WITH {PREDICTED_SQL} SELECT vec_id, round(score, 9)::DOUBLE AS vision_score FROM s")
def judge_predictions(spark, d):
    samples, predictions = _predicted(spark, d)
    found = improvement.prediction_score(samples.drop("vec_id"), predictions)
    return found.select(F.col("sample_id").cast("bigint").alias("vec_id"), F.round("vision_score", 9).alias("vision_score"))


@query("mean_rewards", f"""WITH {PREDICTED_SQL} SELECT count(*) AS n, round(avg(greatest(0, least(1, score * 1.5))), 9)::DOUBLE AS mean_reward,
 round(avg(score), 9)::DOUBLE AS mean_iou FROM s""")
def mean_rewards(spark, d):
    samples, predictions = _predicted(spark, d)
    judged = improvement.prediction_score(samples.drop("vec_id"), predictions).withColumn("reward", improve.clamp(F.col("vision_score") * 1.5))
    out = improvement.mean_rewards(judged)
    return out.select("n", F.round("mean_reward", 9).alias("mean_reward"), F.round("mean_iou", 9).alias("mean_iou"))


@query("parzen_search")
def parzen_search(spark, d):
    """Twelve trials for two weights of the judged boxes; the estimator has no SQL, tests hold it against known functions."""
    space = {"rule": search.Range(0.0, 1.0), "confidence": search.Range(0.0, 1.0)}
    goal = -((F.col("w.rule") * F.col("j.score") + F.col("w.confidence") * F.col("conf") - 0.5) ** 2)
    trials = search.search(_judged(spark, d).select("vec_id", "j", "conf"), space, goal, "vec_id", trials=12, seed=3)
    rows = [(t.number, t.params["rule"], t.params["confidence"], t.value, t.pruned) for t in trials]
    return spark.createDataFrame(rows, "trial int, rule double, confidence double, value double, pruned boolean")


@query("pref_margin", f"""WITH {JUDGE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS k FROM en)
 SELECT a.vec_id AS chosen, b.vec_id AS rejected, a.score AS chosen_score, b.score AS rejected_score FROM r a
 JOIN r b ON a.k < b.k AND a.score - b.score >= 0.1""")
def pref_margin(spark, d):
    return improve.margin_pairs(_ensemble(spark, d), "vec_id", "score", "vec_id")


@query("preference_records", f"""WITH {JUDGE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS k, count(*) OVER () AS n FROM en)
 SELECT a.vec_id AS chosen, b.vec_id AS rejected, CASE WHEN a.vec_id % 2 = 0 THEN 'detect the UI element' ELSE 'text' END AS chosen_prompt FROM r a
 JOIN r b ON a.k <= greatest(1, trunc(a.n * 0.3)) AND b.k > b.n - greatest(1, trunc(b.n * 0.3)) AND a.score - b.score >= 0.1
 WHERE a.vec_id % 3 <> 0 AND b.vec_id % 3 <> 0""")
def preference_records(spark, d):
    known = boxes(spark, d).where("vec_id % 3 <> 0").select(
        "vec_id",
        F.when(F.col("vec_id") % 2 == 0, "").otherwise("text").alias("prompt"),
        F.array("x1", "y1", "x2", "y2").alias("box"),
        T.sample_id(F.col("vec_id")).alias("path"),
    )
    out = improve.top_bottom_records(_ensemble(spark, d), known, "vec_id", "score", "vec_id", "prompt", "box", "path")
    return out.select("chosen", "rejected", "chosen_prompt")


HISTORY_SQL = "d AS (SELECT date_trunc('day', ts) AS day, round(avg(value), 4) AS score FROM events GROUP BY 1), h AS (SELECT row_number() OVER (ORDER BY day) AS it, score FROM d)"


def _history(spark, d):
    """One iteration a day: the mean of that day's values."""
    days = table(spark, d, "events").groupBy(
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")
    ).agg(F.round(F.avg("value"), 4).alias("score"))
    return split.numbered(days, ["day"], "it", groups=1).select((F.col("it") + 1).alias("it"), "score")


@query("iteration_trend", f"""WITH {HISTORY_SQL} SELECT it, CASE WHEN it <= 1 THEN ' ' WHEN abs(score - lag(score) OVER (ORDER BY it)) < 0.001 THEN '='
 WHEN score > lag(score) OVER (ORDER BY it) THEN '^' ELSE 'v' END AS trend FROM h""")
def iteration_trend(spark, d):
    return improve.trends(_history(spark, d), "score", "it").select("it", "trend")


@query("best_iteration", f"""WITH {HISTORY_SQL} SELECT (SELECT it FROM h ORDER BY score DESC, it LIMIT 1) AS best, max(score) AS best_score, max(it) AS last FROM h""")
def best_iteration(spark, d):
    return improve.best_iteration(_history(spark, d), "score", "it")


@query("stalled", f"""WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY it DESC) AS k FROM h)
 SELECT count(*) >= 4 AS stalled, count(*) >= 4 AND max(score) FILTER (WHERE k <= 3) - max(score) FILTER (WHERE k > 3) <= 0.01 AS no_gain FROM r""")
def stalled(spark, d):
    return improve.stalled(_history(spark, d), "score", "it", 3, 0.01)


@query("improved_flags", f"""WITH {HISTORY_SQL} SELECT it, coalesce(score > max(score) OVER (ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
 FROM h""")
def improved_flags(spark, d):
    return improve.improved(_history(spark, d), "score", "it").select("it", "improved")


@query("last_best_epoch", f"WITH {HISTORY_SQL} SELECT arg_max(it, (round(score), it)) AS epoch FROM h")
def last_best_epoch(spark, d):
    return improve.last_best(_history(spark, d).withColumn("score", F.round("score")), "score", "it")


@query("weight_search", f"""WITH {JUDGE_SQL}, c AS (SELECT * FROM (VALUES (1, 0.2), (2, 0.5), (3, 0.9)) t(candidate, w))
 SELECT candidate, round(avg(w * score + (1 - w) * conf), 6) AS value FROM j, c GROUP BY 1""")
def weight_search(spark, d):
    cands = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.9)], "candidate int, w double")
    out = improve.search_weights(_judged(spark, d), cands, F.col("w") * F.col("j.score") + (1 - F.col("w")) * F.col("conf"))
    return out.select("candidate", F.round("value", 6).alias("value"))


@query("normalized_weights", """WITH w AS (SELECT event_id, (event_id % 5)::DOUBLE AS a, (event_id % 3)::DOUBLE AS b, abs(user_id % 2)::DOUBLE AS c FROM events)
SELECT event_id, round(CASE WHEN a + b + c = 0 THEN a ELSE a / (a + b + c) END, 6) AS a, round(CASE WHEN a + b + c = 0 THEN c ELSE c / (a + b + c) END, 6) AS c FROM w""")
def normalized_weights(spark, d):
    """Weights from an event's numbers; all three are 0 on some."""
    w = F.create_map(
        F.lit("a"), (F.col("event_id") % 5).cast("double"), F.lit("b"), (F.col("event_id") % 3).cast("double"), F.lit("c"), F.abs(F.col("user_id") % 2).cast("double"),
    )
    n = improve.normalize_weights(w)
    return table(spark, d, "events").select("event_id", F.round(n["a"], 6).alias("a"), F.round(n["c"], 6).alias("c"))


@query("confidence_window", f"""WITH {EVENTS_SQL} SELECT event_id, count(value) OVER w AS window_n, round(avg(value) OVER w, 9) AS window_mean
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def confidence_window(spark, d):
    e = events(spark, d).withColumn("o", F.struct("ms", "event_id"))
    return monitor.confidence_window(e, "value", "o", "user_id").select(
        "event_id", "window_n", F.round("window_mean", 9).alias("window_mean"),
    )


@query("drift_latch", f"""WITH {EVENTS_SQL} SELECT event_id, max(value > 60) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING
 AND CURRENT ROW) AS latched FROM ev""")
def drift_latch(spark, d):
    e = events(spark, d).withColumn("o", F.struct("ms", "event_id")).withColumn("flag", F.col("value") > 60)
    return monitor.latch(e, "flag", "o", "user_id").select("event_id", "latched")


@query("confidence_window_spread", SQL.get("confidence_window"))
def confidence_window_spread(spark, d):
    """confidence_window with every user's rows spread over ranges."""
    e = events(spark, d).withColumn("o", F.struct("ms", "event_id"))
    return monitor.confidence_window(e, "value", "o", "user_id", spread=True).select(
        "event_id", "window_n", F.round("window_mean", 9).alias("window_mean"),
    )


@query("drift_latch_spread", SQL.get("drift_latch"))
def drift_latch_spread(spark, d):
    """drift_latch with every user's rows spread over ranges."""
    e = events(spark, d).withColumn("o", F.struct("ms", "event_id")).withColumn("flag", F.col("value") > 60)
    return monitor.latch(e, "flag", "o", "user_id", spread=True).select("event_id", "latched")


@query("frame_signals", """WITH f AS (SELECT event_id // 8 AS frame, list(value / 100) AS s FROM events
 GROUP BY 1), g AS (SELECT frame, coalesce(list_avg(s), 0) AS m, len(list_filter(s, lambda x: x < 0.25)) AS u, len(s) AS n FROM f)
 SELECT frame, round(m, 9) AS mean_confidence, u::INT AS uncertain_count, m < 0.25 OR u > n / 2 AS should_collect FROM g""")
def frame_signals(spark, d):
    f = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 8).alias("frame")).agg(
        F.collect_list(F.col("value") / 100).alias("s")
    )
    g = monitor.frame_signals(F.col("s"))
    return f.select(
        "frame",
        F.round(g["mean_confidence"], 9).alias("mean_confidence"),
        g["uncertain_count"].alias("uncertain_count"),
        monitor.should_collect(F.lit(False), g["mean_confidence"], g["uncertain_count"], F.size("s")).alias("should_collect"),
    )


@query("retrain_decision", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'signup') AS c, max(value) > 80 AS d
 FROM events GROUP BY 1)
SELECT user_id, f >= 22 OR c >= 20 OR d AS should_retrain, coalesce(nullif(concat_ws('; ', CASE WHEN f >= 22 THEN 'failures=' || f || '>=22' END, CASE
 WHEN c >= 20 THEN 'corrections=' || c || '>=20' END, CASE WHEN d THEN 'drift_detected' END), ''), 'no retrain conditions met') AS reason,
CASE WHEN NOT (f >= 22 OR c >= 20 OR d) THEN 'none' WHEN d THEN 'full' ELSE 'incremental' END AS recommended_strategy FROM c""")
def retrain_decision(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("f"),
        F.count_if(F.col("event_type") == "signup").alias("c"),
        (F.max("value") > 80).alias("d"),
    )
    return monitor.retrain_decision(c, "f", "c", "d", failure_threshold=22).drop("f", "c", "d")
