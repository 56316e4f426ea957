"""Time joins and gesture reconstruction over event tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators import scans


def nearest_asof(
    events: DataFrame, frames: DataFrame, event_ts: str, frame_ts: str, frame_ord: str, tolerance: float, keys: tuple[str, ...] = (),
) -> DataFrame:
    """Each event with the frame nearest in time, kept if at most `tolerance` away; of ties the first frame in order.

    events needs a unique row number column named __row only if rows repeat; here one is made from all columns. The
    time axis is cut into buckets of the tolerance, a frame stands in its own and both neighbouring buckets, so the
    join is an equi-join whose size follows the number of frames within two buckets.
    """
    own = [c for c in frames.columns if c not in keys]
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(tolerance))).cast("long")
    left = events.withColumn("__row", F.monotonically_increasing_id()).withColumn("__bucket", bucket(event_ts))
    base = bucket(frame_ts)
    right = frames.select(*keys, F.struct(*own).alias("__frame"), F.explode(F.array(base - 1, base, base + 1)).alias("__bucket"))
    gap = F.abs(F.col(event_ts) - F.col("__frame")[frame_ts])
    near = left.join(right, [*keys, "__bucket"]).withColumn("__gap", gap).where(F.col("__gap") <= tolerance)
    best = near.groupBy("__row").agg(
        *(F.first(c).alias(c) for c in events.columns),
        F.min_by("__frame", F.struct("__gap", F.col("__frame")[frame_ord])).alias("__frame"),
        F.min("__gap").alias("time_delta"),
    )
    return best.select(*events.columns, *(F.col("__frame")[c].alias(c) for c in own), "time_delta")


def nearest_unbounded(
    probes: DataFrame, frames: DataFrame, probe_ts: str, frame_ts: str, keys: list[str], spread: bool | None = None,
) -> DataFrame:
    """Each probe with the nearest frame of its keys, however far; ties to the earlier frame.

    spread: whether a key's rows are spread over ranges (scans); None: if one has more than scans.HOT rows.
    """
    cols = [F.col(k) for k in keys]
    both = probes.select(*cols, F.col(probe_ts).alias("__t"), F.struct(*probes.columns).alias("__probe"), F.lit(None).cast("double").alias("__f")).unionByName(
        frames.select(*cols, F.col(frame_ts).alias("__t"), F.col(frame_ts).cast("double").alias("__f")), allowMissingColumns=True)
    spread = scans.crowded(both.select(*keys), keys) if spread is None else spread
    if spread:
        both = scans.parted(both, keys, ["__t"])
        both = scans.carried(both, "__low", F.max("__f"), lambda c: F.max(c))
        both = scans.carried(both, "__high", F.min("__f"), lambda c: F.min(c), ahead=True)
    w = (scans.within() if spread else Window.partitionBy(*keys)).orderBy("__t")
    none = F.lit(None).cast("double")
    seen = both.withColumn(
        "__before", F.coalesce(F.last("__f", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.col("__low") if spread else none),
    ).withColumn(
        "__after", F.coalesce(F.first("__f", True).over(w.rangeBetween(0, Window.unboundedFollowing)), F.col("__high") if spread else none),
    )
    before, after, t = F.col("__before"), F.col("__after"), F.col("__t")
    pick = F.when(after.isNull() | (t - before <= after - t), before).otherwise(after)
    return seen.where(F.col("__probe").isNotNull()).select("__probe.*", pick.alias("frame_ts"))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    before: float,
    after: float,
    keys: list[str],
    width: float | None = None,
) -> DataFrame:
    """Rows of both within [left_ts - before, left_ts + after], ends included, on equal keys; in time buckets."""
    width = float(width or before + after or 1.0)
    base = F.floor(F.col(left_ts) / width).cast("long")
    low, high = F.floor((F.col(left_ts) - before) / width).cast("long"), F.floor((F.col(left_ts) + after) / width).cast("long")
    a = left.withColumn("__bucket", F.explode(F.sequence(F.least(low, base), high)))
    b = right.withColumn("__bucket", F.floor(F.col(right_ts) / width).cast("long"))
    return a.join(b, [*keys, "__bucket"]).where(
        (F.col(right_ts) >= F.col(left_ts) - before) & (F.col(right_ts) <= F.col(left_ts) + after)
    ).drop("__bucket")


def double_clicks(
    clicks: DataFrame,
    key: str,
    ts: str,
    order: str,
    x: str | None = None,
    y: str | None = None,
    within_ms: float = 300.0,
    within_px: float = 12.0,
    spread: bool | None = None,
) -> DataFrame:
    """is_double: the click-like row before it of the same key is near in time and, given x and y, in place.

    spread: whether a key's rows are spread over ranges (scans); None: if one has more than scans.HOT rows.
    """
    own = clicks.columns
    spread = scans.crowded(clicks.select(key), [key]) if spread is None else spread
    if spread:
        clicks = scans.with_rows_before(scans.parted(clicks, [key], [ts, order]), [ts, order], 1)
    w = (scans.within() if spread else Window.partitionBy(key)).orderBy(ts, order)
    near = F.col(ts) - F.lag(ts).over(w) <= within_ms
    if x and y:
        dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
        near = near & (F.sqrt(dx * dx + dy * dy) <= within_px)
    out = clicks.withColumn("is_double", F.coalesce(near, F.lit(False)))
    return out.where(f"NOT {scans.HALO}").select(*own, "is_double") if spread else out


def throttle(rows: DataFrame, key: str, ts: str, order: str, gap: float) -> DataFrame:
    """key, emitted: times of the rows let through, each at least `gap` after the last one let through.

    The rule looks back at what was emitted, not at the row before, so no window expresses it: each task goes through
    its keys' rows in order of time and keeps the last emitted time, whatever the number of a key's rows. Null times go.
    """
    sorted_ = rows.where(F.col(ts).isNotNull()).select(F.col(key), F.col(ts).cast("double").alias("emitted"), F.col(order).alias("__order"))
    sorted_ = sorted_.repartition(key).sortWithinPartitions(key, "emitted", "__order").select(key, "emitted")

    def run(batches):
        current, last = object(), None
        for batch in batches:
            kept = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if k != current:
                    current, last = k, None
                if last is None or t - last >= gap:
                    kept.append(i)
                    last = t
            yield batch.take(pa.array(kept, pa.int32()))

    return sorted_.mapInArrow(run, sorted_.schema)


def classify_release(
    distance: Column, button: Column, duration_ms: Column, is_double: Column, drag_px: float = 10.0, hold_ms: float = 400.0,
) -> Column:
    """Gesture of a press and its release, tests in this order."""
    return F.when(distance > drag_px, "drag").when(button == "right", "right_click").when(duration_ms >= hold_ms, "hold").when(is_double, "double_click").otherwise("click")


def gestures(
    raw: DataFrame, key: str, ts: str, order: str, kind: str = "kind", x: str = "x", y: str = "y", button: str = "button",
) -> DataFrame:
    """Press and release rows to gestures: key, ts (of the press), action, x, y, end_x, end_y, duration_ms, button."""
    w = Window.partitionBy(key).orderBy(ts, order)
    after = lambda c: F.lead(c).over(w)
    pairs = raw.withColumn("__kind", after(kind)).withColumn("end_ts", after(ts)).withColumn("end_x", after(x)).withColumn("end_y", after(y)).where(
        (F.col(kind) == "press") & (F.col("__kind") == "release")
    )
    dx, dy = F.col("end_x") - F.col(x), F.col("end_y") - F.col(y)
    pairs = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy)).withColumn("duration_ms", F.col("end_ts") - F.col(ts))
    clicklike = (F.col("distance") <= 10) & (F.col(button) != "right") & (F.col("duration_ms") < 400)
    quick = double_clicks(pairs.where(clicklike), key, "end_ts", order, "end_x", "end_y").select(key, order, "is_double")
    named = pairs.join(quick, [key, order], "left")
    action = classify_release(F.col("distance"), F.col(button), F.col("duration_ms"), F.coalesce("is_double", F.lit(False)))
    return named.select(key, F.col(ts).alias("ts"), action.alias("action"), x, y, "end_x", "end_y", "duration_ms", button)


def clip_summary(clips: DataFrame, sample: str, order: str, ratio: str, least: float = 0.01) -> DataFrame:
    """effect: order of the first frame whose change ratio is over `least`, else 0; stable: the last frame's order."""
    return clips.groupBy(sample).agg(
        F.coalesce(F.min(F.when(F.col(ratio) > least, F.col(order))), F.lit(0)).alias("effect"), F.max(order).alias("stable"),
    )


def latest_per_key(rows: DataFrame, key: str, ts: str, n: int = 1) -> DataFrame:
    """The newest n rows of each key: a ring buffer of n."""
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")
