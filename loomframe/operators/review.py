"""Review queues: priorities, uncertainty, choices, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, iou
from loomframe.operators.quality import is_duplicate


def priority(
    confidence: Column,
    flag_list: Column,
    representative: Column,
    novelty: Column,
    hard_negatives: Column,
    conflict_pair: Column,
    popup_open: Column,
    candidate_confidences: Column,
) -> Column:
    """Confidence less the bonuses, not below 0; lower comes first.

    hard_negatives: their number; candidate_confidences: array<double> of the route candidates.
    """
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), F.lit(n)).otherwise(F.lit(0.0))
    flagged = {"missing_primitive_id": 0.35, "missing_situation_id": 0.25, "candidate_conflict": 0.15, "taxonomy_mismatch": 0.15}
    total = sum((points(F.array_contains(flag_list, f), n) for f, n in flagged.items()), F.lit(0.0))
    ranked = F.sort_array(candidate_confidences, asc=False)
    gap = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
    total = total + points(representative, 0.10) + points(novelty, 0.10) + F.least(
        F.lit(0.20), 0.05 * F.coalesce(hard_negatives, F.lit(0)),
    ) + points(conflict_pair, 0.15) + points(popup_open, 0.25)
    total = total + F.when(
        F.size(candidate_confidences) >= 2, F.when(gap < 0.10, 0.20).when(gap < 0.20, 0.10).otherwise(0.0),
    ).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), confidence - total)


def _truthy(document: Column, path: str) -> Column:
    """Whether a part of a JSON document is there and not empty, zero or false."""
    value = F.get_json_object(document, path)
    return F.coalesce(~F.trim(value).isin("", "[]", "{}", "false", "null", "0", "0.0"), F.lit(False))


def sample_priority(label: str, metadata: str, flag_list: str) -> Column:
    """priority() of a sample from its nested label with evidence (JSON), its metadata (JSON) and its flags."""
    evidence, none = F.col(label)["evidence"], F.array().cast("array<string>")
    negatives = F.from_json(F.get_json_object(evidence, "$.triggered_hard_negatives"), "array<string>")
    ranked = F.from_json(F.get_json_object(evidence, "$.route_candidates"), "array<struct<confidence:double>>")
    confidences = F.transform(F.array_compact(ranked), lambda c: F.coalesce(c["confidence"], F.lit(0.0)))
    popup = (F.col(label)["route_label"]["primitive_id"] == "popup_primitive") & _truthy(evidence, "$.open_screen_detected")
    return priority(
        F.col(label)["confidence"],
        F.coalesce(F.col(flag_list), none),
        _truthy(F.col(metadata), "$.filter.cluster_representative"),
        _truthy(F.col(metadata), "$.screen_novelty"),
        F.greatest(F.size(F.coalesce(negatives, none)), F.lit(0)),
        _truthy(evidence, "$.conflict_pair"),
        popup,
        F.coalesce(confidences, F.array().cast("array<double>")),
    )


def queue(rows: DataFrame, score: Column, order: str, auto_approve: float | None = None, confidence: Column | None = None) -> DataFrame:
    """rows, decision (approved or review), priority. Ties keep the order column; sort by (priority, order) to read."""
    approved = F.lit(False) if auto_approve is None else confidence >= auto_approve
    return rows.withColumn("decision", F.when(approved, "approved").otherwise("review")).withColumn("priority", F.when(~approved, score))


def eligible(rows: DataFrame, label: str = "label", status: str = "review_status", flags: str = "flags") -> DataFrame:
    """Rows that a review queue takes: labeled, still pending, not a duplicate of another sample."""
    return rows.where(F.col(label).isNotNull() & (F.col(status) == "pending") & ~is_duplicate(F.col(flags)))


def load_queue(
    rows: DataFrame, score: Column, order: str, auto_approve: float | None = None, confidence: Column | None = None,
) -> DataFrame:
    """queue() of the eligible rows alone; label, review_status and flags are columns of rows."""
    return queue(eligible(rows), score, order, auto_approve, confidence)


def ambiguity(boxes: DataFrame, group: str, order: str, score: str, least: float = 0.3) -> DataFrame:
    """group, order, uncertainty: 1 - score, 0.2 more (at most 1) if any other box of the group overlaps more than `least`.

    Done in an array per image: an image holds a screen's boxes.
    """
    item = F.struct(F.col(order).alias("o"), "x1", "y1", "x2", "y2", F.col(score).alias("s"))
    every = boxes.groupBy(group).agg(F.collect_list(item).alias("b"))
    unsure = F.transform("b", lambda e: F.struct(e["o"].alias("o"), F.round(F.when(F.exists("b", lambda k: (k["o"] != e["o"]) & (iou(Box.of(k), Box.of(e)) > least)), F.least(F.lit(1.0), 1 - e["s"] + 0.2)).otherwise(1 - e["s"]), 4).alias("u")))
    return every.select(group, F.explode(unsure).alias("x")).select(group, F.col("x.o").alias(order), F.col("x.u").alias("uncertainty"))


def needs_review(uncertainty: Column, low: float = 0.4) -> Column:
    return uncertainty > 1 - low


def top_uncertain(rows: DataFrame, n: int, uncertainty: str, order: str, reviewed: str) -> DataFrame:
    return rows.where(~F.col(reviewed)).orderBy(F.desc(uncertainty), order).limit(n)


def queue_stats(rows: DataFrame, reviewed: Column, corrections: Column) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(~reviewed).alias("pending"),
        F.count_if(reviewed & corrections).alias("with_corrections"),
    )


def latest_decision(decisions: DataFrame, key: str, version: str) -> DataFrame:
    """The newest decision of each sample; an edit replaces corrections whole."""
    return decisions.groupBy(key).agg(
        F.max_by(F.struct(*(c for c in decisions.columns if c != key)), version).alias("d")
    ).select(key, "d.*")


def mark_reviewed(rows: DataFrame, decided: DataFrame, frame: str, order: str) -> DataFrame:
    """reviewed becomes true on the first unreviewed row of each decided frame. decided: frame, corrections."""
    w = Window.partitionBy(frame, "reviewed").orderBy(order)
    joined = rows.withColumn("__k", F.row_number().over(w)).join(
        decided.select(frame, F.col("corrections").alias("__new"), F.lit(True).alias("__hit")), frame, "left",
    )
    hit = F.coalesce(F.col("__hit"), F.lit(False)) & ~F.col("reviewed") & (F.col("__k") == 1)
    return joined.withColumn(
        "corrections", F.when(hit, F.col("__new")).otherwise(F.col("corrections")),
    ).withColumn("reviewed", F.col("reviewed") | hit).drop("__k", "__new", "__hit")


def replace_annotations(old: DataFrame, new: DataFrame, image: str, key: str, order: str) -> DataFrame:
    """An image's new rows replace its old ones; new keys go on from the largest key of all."""
    stay = old.join(new.select(image).distinct(), image, "left_anti")
    most = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("__most"))
    added = new.withColumn("__k", F.row_number().over(Window.orderBy(order))).crossJoin(F.broadcast(most)).withColumn(key, F.col("__most") + F.col("__k")).drop("__most", "__k")  # one screen's hand-drawn boxes
    return stay.unionByName(added.select(*stay.columns))


def failure_uncertainty(scores: Column) -> Column:
    """1 - least score, 1 where there are no elements."""
    return 1 - F.coalesce(F.array_min(scores), F.lit(0.0))


def candidate_choices(candidates: Column, current: Column, taxonomy: Column, n: int = 3) -> Column:
    """Values of the first n candidates by (rank, -confidence), the current value before them if absent, then the taxonomy."""
    ordered = F.array_sort(
        F.transform(candidates, lambda c: F.struct(c["rank"].alias("r"), (-c["confidence"]).alias("c"), c["value"].alias("v")))
    )
    top = F.array_distinct(F.array_compact(F.transform(F.slice(ordered, 1, n), lambda c: F.nullif(c["v"], F.lit("")))))
    first = F.when(F.coalesce(current, F.lit("")).isin("") | F.array_contains(top, current), top).otherwise(F.concat(F.array(current), top))
    return F.array_union(first, taxonomy)


def preferred_first(preferred: Column, every: Column) -> Column:
    """Preferred values that exist, then the rest, each once."""
    return F.array_union(F.array_intersect(preferred, every), every)
