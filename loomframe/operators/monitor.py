"""Runtime monitoring: frame signals, drift latch, retrain decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators import scans


def frame_signals(scores: Column, low: float = 0.25) -> dict[str, Column]:
    """mean_confidence (0 without elements) and uncertain_count of a frame's array of scores."""
    n = F.size(scores)
    mean = F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))
    return {"mean_confidence": mean, "uncertain_count": F.size(F.filter(scores, lambda s: s < low))}


def should_collect(drifted: Column, mean: Column, uncertain: Column, n: Column, low: float = 0.25) -> Column:
    return drifted | (mean < low) | (uncertain > n / 2)


def is_drifted(score: Column, bits: int = 12) -> Column:
    return score > bits / 64.0


def latch(rows: DataFrame, flag: str, order: str, key: str, spread: bool | None = None) -> DataFrame:
    """latched: the flag has been true on this row or one before it of the same key.

    spread: whether a key's rows are spread over ranges (scans); None: if one has more than scans.HOT rows.
    """
    own = rows.columns
    spread = scans.crowded(rows.select(key), [key]) if spread is None else spread
    if not spread:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("latched", F.max(flag).over(w))
    parts = scans.carried(scans.parted(rows, [key], [order]), "__before", F.max(flag), lambda c: F.max(c))
    w = scans.within().orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(*own, F.greatest(F.max(flag).over(w), F.col("__before")).alias("latched"))


def confidence_window(rows: DataFrame, value: str, order: str, key: str, n: int = 100, spread: bool | None = None) -> DataFrame:
    """window_n, window_mean over the last n rows of the key. spread: as in latch."""
    own = rows.columns
    spread = scans.crowded(rows.select(key), [key]) if spread is None else spread
    if spread:
        rows = scans.with_rows_before(scans.parted(rows, [key], [order]), [order], n - 1)
    w = (scans.within() if spread else Window.partitionBy(key)).orderBy(order).rowsBetween(-(n - 1), 0)
    out = rows.withColumn("window_n", F.count(value).over(w)).withColumn("window_mean", F.avg(value).over(w))
    return out.where(f"NOT {scans.HALO}").select(*own, "window_n", "window_mean") if spread else out


def retrain_decision(
    counts: DataFrame,
    failures: str,
    corrections: str,
    drift: str,
    hours_since: str | None = None,
    failure_threshold: int = 50,
    correction_threshold: int = 20,
    cooldown_hours: float = 24.0,
) -> DataFrame:
    """counts with should_retrain, reason, recommended_strategy; within the cooldown nothing is recommended."""
    f, c, d = F.col(failures), F.col(corrections), F.col(drift)
    reasons = F.array_compact(F.array(
        F.when(f >= failure_threshold, F.concat(F.lit("failures="), f.cast("string"), F.lit(f">={failure_threshold}"))),
        F.when(c >= correction_threshold, F.concat(F.lit("corrections="), c.cast("string"), F.lit(f">={correction_threshold}"))),
        F.when(d, F.lit("drift_detected"))))
    should = F.size(reasons) > 0
    reason = F.when(should, F.array_join(reasons, "; ")).otherwise("no retrain conditions met")
    plan = F.when(~should, "none").when(d, "full").otherwise("incremental")
    if hours_since:
        wait = F.coalesce(F.col(hours_since) < cooldown_hours, F.lit(False))
        reason = F.when(wait, F.format_string(f"cooldown active (%.1fh < {cooldown_hours}h)", hours_since)).otherwise(reason)
        plan, should = F.when(wait, "none").otherwise(plan), should & ~wait
    return counts.withColumn("should_retrain", should).withColumn("reason", reason).withColumn("recommended_strategy", plan)
