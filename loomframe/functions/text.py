"""Strings, ids, JSON and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event type -> rough label; class -> actions and element type.
EVENT_LABELS = {
    "click": "button",
    "double_click": "button",
    "right_click": "context_menu",
    "drag": "draggable",
    "scroll": "scroll_area",
    "type": "text_field",
    "press": "shortcut",
}


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    """Value of a small fixed map; the default or null where the key is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, F.lit(default))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_truthy(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(v) for v in values))


def first_nonzero(*values: Column) -> Column:
    """The first that is neither null nor 0, else the last."""
    return F.coalesce(*(F.nullif(v, F.lit(0.0)) for v in values), values[-1])


def numbers(text: Column, n: int = 4) -> Column:
    """The first n numbers of a text as doubles; fewer are an error."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.when(F.size(found) >= n, F.slice(found, 1, n)).otherwise(F.raise_error(F.lit("too few numbers in text")).cast("array<double>"))


def numbers_or_null(text: Column, n: int = 4) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.when(F.size(found) >= n, F.slice(found, 1, n))


def clean_json(text: Column) -> Column:
    """Text of a JSON document without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def response_text(response: Column) -> Column:
    """First text part of the first candidate of a model response (JSON string)."""
    parts = F.from_json(F.get_json_object(response, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.get(F.filter(parts, lambda p: p["text"].isNotNull()), F.lit(0))["text"]


def numeric_suffix(identifier: Column) -> Column:
    """Number after the last underscore, 0 where there is none."""
    return F.coalesce(F.substring_index(identifier, "_", -1).try_cast("long"), F.lit(0))


def frame_index(stem: Column) -> Column:
    """First run of digits, 0 where there is none."""
    return F.coalesce(blank_to_null(F.regexp_extract(stem, r"(\d+)", 1)).try_cast("int"), F.lit(0))


def frame_timestamp_ms(index: Column, fps: Column) -> Column:
    return F.when(fps > 0, index / fps * 1000.0).otherwise(F.lit(0.0))


def session_id(metadata_json: Column, folder: Column) -> Column:
    return first_truthy(F.get_json_object(metadata_json, "$.session_id"), folder)


def padded(number: Column) -> Column:
    """A whole number with zeros before it up to six digits; longer ones stay whole, which lpad would cut."""
    return F.when(number.isNotNull(), F.format_string("%06d", number))


def sample_id(number: Column) -> Column:
    return F.concat(F.lit("sample_"), padded(number))


def prettify(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def friendly(value: Column, names: dict, empty: str = "Unknown") -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(empty)).otherwise(F.coalesce(lookup(value, names), prettify(value)))


def event_label(event_type: Column) -> Column:
    return lookup(event_type, EVENT_LABELS)


def evidence_lines(evidence: Column) -> Column:
    """Map of evidence as sorted key: value lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(evidence)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def softmax_top(logits: Column) -> Column:
    """Index and probability of the largest logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("index"), (F.lit(1.0) / total).alias("confidence"))
