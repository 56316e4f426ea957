"""Time joins, gestures, hover, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.operators import temporal
from loomframe.plans.registry import EVENTS_SQL, SQL, events, query


def _frames(spark, d):
    """A frame each minute over the span of the events, as a table of our own."""
    span = events(spark, d).agg(F.floor(F.min("ms") / 60000).alias("a"), F.floor(F.max("ms") / 60000).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("frame_no")).select(
        F.col("frame_no").cast("long"), (F.col("frame_no") * 60000.0).alias("frame_ms"),
    )


FRAMES_SQL = "frames AS (SELECT unnest(range((SELECT floor(min(ms) / 60000)::BIGINT FROM ev), (SELECT floor(max(ms) / 60000)::BIGINT FROM ev) + 1)) AS frame_no), fr AS (SELECT frame_no, frame_no * 60000.0 AS frame_ms FROM frames)"


@query("nearest_frame_join", f"""WITH {EVENTS_SQL}, {FRAMES_SQL},
c AS (SELECT event_id, frame_no, abs(ms - frame_ms) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(ms - frame_ms), frame_no) AS k
 FROM ev JOIN fr ON abs(ms - frame_ms) <= 20000 WHERE event_type = 'click')
SELECT event_id, frame_no, round(gap, 3) AS time_delta FROM c WHERE k = 1""")
def nearest_frame_join(spark, d):
    clicks = events(spark, d).where("event_type = 'click'").select("event_id", "ms")
    out = temporal.nearest_asof(clicks, _frames(spark, d), "ms", "frame_ms", "frame_no", 20000.0)
    return out.select("event_id", "frame_no", F.round("time_delta", 3).alias("time_delta"))


@query("nearest_frame_unbounded", f"""WITH {EVENTS_SQL}, v AS (SELECT user_id, event_id, ms FROM ev WHERE event_type = 'view'), c AS (SELECT user_id, event_id, ms FROM ev
 WHERE event_type = 'click'),
p AS (SELECT c.event_id, v.ms AS frame_ts, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.ms - c.ms), v.ms) AS k FROM c
 JOIN v USING (user_id))
SELECT event_id, round(frame_ts, 3) AS frame_ts FROM p WHERE k = 1""")
def nearest_frame_unbounded(spark, d):
    e = events(spark, d).select("user_id", "event_id", "ms", "event_type")
    out = temporal.nearest_unbounded(
        e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "ms", "ms", ["user_id"],
    )
    return out.where("frame_ts IS NOT NULL").select("event_id", F.round("frame_ts", 3).alias("frame_ts"))


@query("interval_clip_join", f"""WITH {EVENTS_SQL}
SELECT c.event_id AS click_id, v.event_id AS view_id, CASE WHEN v.ms <= c.ms THEN 'pre' ELSE 'post' END AS clip FROM ev c
 JOIN ev v ON c.user_id = v.user_id AND v.ms BETWEEN c.ms - 3600000 AND c.ms + 3600000
WHERE c.event_type = 'click' AND v.event_type = 'view'""")
def interval_clip_join(spark, d):
    e = events(spark, d)
    c = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ms").alias("click_ms"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ms").alias("view_ms"))
    out = temporal.interval_join(c, v, "click_ms", "view_ms", 3_600_000.0, 3_600_000.0, ["user_id"])
    return out.select("click_id", "view_id", F.when(F.col("view_ms") <= F.col("click_ms"), "pre").otherwise("post").alias("clip"))


@query("double_click", f"""WITH {EVENTS_SQL}, c AS (SELECT *, lag(ms) OVER w AS p FROM ev WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT event_id, coalesce(ms - p <= 3600000, false) AS is_double FROM c""")
def double_click(spark, d):
    clicks = events(spark, d).where("event_type = 'click'")
    return temporal.double_clicks(clicks, "user_id", "ms", "event_id", within_ms=3_600_000.0).select("event_id", "is_double")


@query("nearest_frame_spread", SQL.get("nearest_frame_unbounded"))
def nearest_frame_spread(spark, d):
    """nearest_frame_unbounded with every user's rows spread over ranges."""
    e = events(spark, d).select("user_id", "event_id", "ms", "event_type")
    out = temporal.nearest_unbounded(
        e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "ms", "ms", ["user_id"], spread=True,
    )
    return out.where("frame_ts IS NOT NULL").select("event_id", F.round("frame_ts", 3).alias("frame_ts"))


@query("double_click_spread", SQL.get("double_click"))
def double_click_spread(spark, d):
    """double_click with every user's rows spread over ranges."""
    clicks = events(spark, d).where("event_type = 'click'")
    return temporal.double_clicks(clicks, "user_id", "ms", "event_id", within_ms=3_600_000.0, spread=True).select("event_id", "is_double")


@query("hover_throttle", f"""WITH RECURSIVE {EVENTS_SQL}, v AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM ev
 WHERE event_type = 'view'),
r AS (SELECT user_id, k, ms AS last, true AS emit FROM v WHERE k = 1 UNION ALL
SELECT v.user_id, v.k, CASE WHEN v.ms - r.last >= 21600000 THEN v.ms ELSE r.last END, v.ms - r.last >= 21600000 FROM r
 JOIN v ON v.user_id = r.user_id AND v.k = r.k + 1)
SELECT user_id, round(last, 3) AS emitted FROM r WHERE emit""")
def hover_throttle(spark, d):
    views = events(spark, d).where("event_type = 'view'")
    return temporal.throttle(views, "user_id", "ms", "event_id", 21_600_000.0).select("user_id", F.round("emitted", 3).alias("emitted"))


@query("gesture_classify", f"""WITH {EVENTS_SQL}, n AS (SELECT *, lead(ms) OVER w AS t2, lead(event_type) OVER w AS k2, lead(value) OVER w AS v2
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
g AS (SELECT event_id, user_id, t2, abs(v2 - value) AS dist, t2 - ms AS dur, CASE WHEN event_id % 7 = 0 THEN 'right' ELSE 'left' END AS b FROM n
 WHERE event_type = 'click' AND k2 <> 'click' AND k2 IS NOT NULL),
q AS (SELECT event_id, t2 - lag(t2) OVER (PARTITION BY user_id ORDER BY t2, event_id) <= 43200000 AS dbl FROM g
 WHERE dist <= 50 AND b <> 'right' AND dur < 7200000)
SELECT g.event_id, CASE WHEN dist > 50 THEN 'drag' WHEN b = 'right' THEN 'right_click' WHEN dur >= 7200000 THEN 'hold' WHEN coalesce(dbl,
 false) THEN 'double_click' ELSE 'click' END AS action FROM g LEFT JOIN q USING (event_id)""")
def gesture_classify(spark, d):
    """A click row is a press, the user's next row of another kind its release; the value axis stands for position."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    e = events(spark, d).select(
        "event_id",
        "user_id",
        "ms",
        "event_type",
        "value",
        F.lead("ms").over(w).alias("t2"),
        F.lead("event_type").over(w).alias("k2"),
        F.lead("value").over(w).alias("v2"),
    )
    g = e.where("event_type = 'click' AND k2 <> 'click'").withColumn("dist", F.abs(F.col("v2") - F.col("value"))).withColumn("dur", F.col("t2") - F.col("ms")).withColumn(
        "b", F.when(F.col("event_id") % 7 == 0, "right").otherwise("left"),
    )
    quick = temporal.double_clicks(
        g.where("dist <= 50 AND b <> 'right' AND dur < 7200000"), "user_id", "t2", "event_id", within_ms=43_200_000.0,
    ).select("event_id", "is_double")
    named = g.join(quick, "event_id", "left")
    return named.select(
        "event_id",
        temporal.classify_release(
            F.col("dist"), F.col("b"), F.col("dur"), F.coalesce("is_double", F.lit(False)), 50.0, 7_200_000.0,
        ).alias("action"),
    )


@query("clip_summary", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT user_id, coalesce(min(k) FILTER (WHERE value > 60), 0) AS effect, max(k) AS stable FROM e GROUP BY user_id""")
def clip_summary(spark, d):
    e = events(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1)
    return temporal.clip_summary(e, "user_id", "k", "value", 60.0).select(
        "user_id", F.col("effect").cast("long").alias("effect"), F.col("stable").cast("long").alias("stable"),
    )


@query("ring_latest", f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC) AS k FROM ev) SELECT user_id, event_id
 FROM r WHERE k <= 5""")
def ring_latest(spark, d):
    return temporal.latest_per_key(events(spark, d), "user_id", "ms", 5).select("user_id", "event_id")


@query("record_samples", f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, event_id, ms FROM ev WHERE event_type = 'click'), v AS (SELECT user_id, event_id AS f, ms AS fms FROM ev
 WHERE event_type = 'view')
SELECT c.event_id, coalesce(arg_max(f, fms) FILTER (WHERE fms <= ms), -1) AS pre_frame, arg_max(f,
 fms) FILTER (WHERE fms <= ms + 7200000) AS post_frame, count(*) FILTER (WHERE fms BETWEEN ms - 3600000 AND ms) AS pre_clip
FROM c JOIN v ON c.user_id = v.user_id AND fms BETWEEN ms - 86400000 AND ms + 7200000 GROUP BY c.event_id""")
def record_samples(spark, d):
    """The recorder in batch form: newest frame before the click, newest frame after a delay, frames of the clip before."""
    e = events(spark, d)
    c = e.where("event_type = 'click'").select("user_id", "event_id", "ms")
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("f"), F.col("ms").alias("fms"))
    near = temporal.interval_join(c, v, "ms", "fms", 86_400_000.0, 7_200_000.0, ["user_id"])
    return near.groupBy("event_id").agg(
        F.coalesce(F.max_by("f", F.when(F.col("fms") <= F.col("ms"), F.col("fms"))), F.lit(-1)).alias("pre_frame"),
        F.max_by("f", "fms").alias("post_frame"),
        F.count_if(F.col("fms").between(F.col("ms") - 3_600_000, F.col("ms"))).alias("pre_clip"),
    )


@query("tumbling_ext", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_ext(spark, d):
    """Extension: counts in windows of a day."""
    e = events(spark, d)
    return e.groupBy(
        F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type",
    ).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("session_ext", f"""WITH {EVENTS_SQL}, g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER w > 3600000 OR lag(ms) OVER w IS NULL THEN 1 ELSE 0 END AS s,
 row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
i AS (SELECT user_id, ms, sum(s) OVER (PARTITION BY user_id ORDER BY k) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n
 FROM i GROUP BY ALL""")
def session_ext(spark, d):
    """Extension: sessions of a user with gaps of at most an hour."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    e = events(spark, d).withColumn("s", F.when(F.col("ms") - F.lag("ms").over(w) <= 3_600_000, 0).otherwise(1))
    return e.withColumn("session", F.sum("s").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))
