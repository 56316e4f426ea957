"""Filter cascade, flags and scores, dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each flag takes off the score.
PENALTIES = {
    "quality_issue": 0.25,
    "duplicate_non_representative": 0.20,
    "missing_primitive_id": 0.35,
    "missing_situation_id": 0.25,
    "legacy_invalid_action": 0.10,
    "legacy_transition": 0.05,
}
DUPLICATE = "duplicate_non_representative"


def invalid_action(has_before: Column, has_after: Column, ratio: Column, least: float = 0.005) -> Column:
    return ~has_before | ~has_after | (ratio < least)


def quality_issue(has_frame: Column, blur: Column, brightness: Column, least_blur: float = 50.0, least_bright: float = 30.0) -> Column:
    return ~has_frame | (blur < least_blur) | (brightness < least_bright)


def screen_transition(ratio: Column, most: float = 0.4) -> Column:
    return ratio > most


def flags(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


def score(flag_list: Column) -> Column:
    """1 less the penalties, within [0, 1]."""
    total = sum((F.when(F.array_contains(flag_list, n), F.lit(p)).otherwise(F.lit(0.0)) for n, p in PENALTIES.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total))


def is_duplicate(flag_list: Column) -> Column:
    return F.coalesce(F.array_contains(flag_list, DUPLICATE), F.lit(False))


def merge_flags(old: Column, new: Column, representative: Column) -> Column:
    """Old flags without the duplicate flag, new ones not there yet, and the duplicate flag where it applies."""
    none = F.array().cast("array<string>")
    base = F.array_union(F.array_remove(F.coalesce(old, none), DUPLICATE), F.coalesce(new, none))
    return F.when(representative, base).otherwise(F.array_union(base, F.array(F.lit(DUPLICATE))))


def cascade(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """rows and drop_stage: the first stage whose test holds, null for rows that stay; one pass."""
    stage = F.lit(None).cast("string")
    for name, test in reversed(list(stages.items())):
        stage = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(stage)
    return rows.withColumn("drop_stage", stage)


def drop_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_stage", F.lit("kept")).alias("drop_stage")).agg(F.count("*").alias("n"))


def flag_counts(rows: DataFrame, flag_col: str = "flags") -> DataFrame:
    return rows.select(F.explode(flag_col).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def reject_dropped(rows: DataFrame, kept: DataFrame, key: str, status: str = "review_status", corrections: str | None = None) -> DataFrame:
    """Rows not kept become rejected where they are pending; others stay as they are.

    corrections: a column of JSON objects (null: none) that gets auto_filter_rejected where it doesn't say so already.
    """
    marked = rows.join(kept.select(key, F.lit(True).alias("__kept")), key, "left")
    gone = F.col("__kept").isNull() & (F.col(status) == "pending")
    if corrections:
        own = F.from_json(F.coalesce(F.col(corrections), F.lit("{}")), "map<string,variant>")
        told = F.map_concat(F.create_map(F.lit("auto_filter_rejected"), F.parse_json(F.lit("true"))), F.map_filter(own, lambda k, v: k != "auto_filter_rejected"))
        named = F.when(F.map_contains_key(own, "auto_filter_rejected"), own).otherwise(told)
        marked = marked.withColumn(corrections, F.when(gone, F.to_json(named)).otherwise(F.col(corrections)))
    return marked.withColumn(status, F.when(gone, "rejected").otherwise(F.col(status))).drop("__kept")


def exportable(label: Column, status: Column) -> Column:
    return label.isNotNull() & (status != "rejected")


def dataset_stats(
    rows: DataFrame, confidence: Column, primitive: Column, situation: Column, status: Column, flag_list: Column, labeled: Column,
) -> DataFrame:
    """One row of counts and the mean confidence; a status of none of the three kinds is pending."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    n = lambda test: F.count_if(test)
    return rows.agg(
        F.count("*").alias("total"), n(labeled).alias("labeled"), n(~labeled).alias("unlabeled"), n(status == "approved").alias("approved"), n(status == "edited").alias("edited"), n(status == "rejected").alias("rejected"),
        n(
            ~F.coalesce(status.isin("approved", "edited", "rejected"), F.lit(False))
        ).alias("pending"), F.coalesce(F.avg(F.when(labeled, confidence)), F.lit(0.0)).alias("avg_confidence"),
        n(labeled & ~has(primitive)).alias("missing_primitive_id"), n(labeled & ~has(situation)).alias("missing_situation_id"), n(is_duplicate(flag_list)).alias("duplicates"),
    )


def counted(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """name, n of rows with a value."""
    return rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias(name)).agg(F.count("*").alias("n"))
