"""Labels of samples: overlay of reviews, projections, the local labeler, teacher results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.geometry import Box, contains, crop_pixels
from loomframe.functions.text import first_nonzero, first_truthy

PAGE = "struct<screen_type:string,situation_id:string,state_flags:array<string>,confidence:double>"
ROUTE = (
    "struct<primitive_id:string,target_element_id:string,roi_name:string,roi_bbox_norm:array<double>,trigger_modality:string,"
    "trigger_action_type:string,trigger_mouse_button:string,trigger_key:string,confidence:double>"
)
ELEMENT = (
    "struct<element_id:string,bbox_x_min:double,bbox_y_min:double,bbox_x_max:double,bbox_y_max:double,semantic_id:string,"
    "semantic_text:string,function_id:string,hotkeys:array<string>,available_actions:array<string>,enabled_state:string,"
    "roi_name:string,is_route_target:boolean,confidence:double,metadata:string>"
)
LABEL = f"struct<page:{PAGE},route_label:{ROUTE},elements:array<{ELEMENT}>,evidence:string,confidence:double,transition_detected:boolean>"
EVENT = (
    "struct<timestamp_ms:double,action:string,x:double,y:double,end_x:double,end_y:double,button:string,duration_ms:double,"
    "key:string,text:string,reasoning:string>"
)


def fields(kind: str) -> list[str]:
    """Field names of one of the flat struct types above."""
    return [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]


BOX = ("bbox_x_min", "bbox_y_min", "bbox_x_max", "bbox_y_max")
PAGE_KEYS = ("screen_type", "situation_id", "state_flags")
ROUTE_KEYS = tuple(fields(ROUTE))[:-1]
ELEMENT_KEYS = ("semantic_id", "semantic_text", "function_id", "hotkeys", "available_actions", "enabled_state", "roi_name")
#: An element as files have it: corners one by one or as a list.
ELEMENT_FILE = ELEMENT[:-1] + ",bbox_xyxy:array<double>>"
#: A label file: nested parts, and the flat fields of labels that have none.
LABEL_FILE = (
    f"struct<page:{PAGE},route_label:{ROUTE},elements:array<{ELEMENT_FILE}>,evidence:string,confidence:double,transition_detected:boolean,"
    "bbox_x_min:double,bbox_y_min:double,bbox_x_max:double,bbox_y_max:double,semantic_text:string,semantic_id:string,function_id:string,"
    "hotkeys:array<string>,available_actions:array<string>,situation_id:string,screen_type:string,candidates:string>"
)
#: A review's corrections: whole parts, or single fields.
CORRECTIONS = (
    f"struct<page:{PAGE},route_label:{ROUTE},elements:array<{ELEMENT_FILE}>,screen_type:string,situation_id:string,state_flags:array<string>,"
    + ROUTE[len("struct<") : -len(",confidence:double>")]
    + ",bbox_xyxy:array<double>,semantic_id:string,semantic_text:string,function_id:string,hotkeys:array<string>,"
    "available_actions:array<string>,enabled_state:string>"
)


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(n) for n, c in values.items()))


def _page(p: Column) -> Column:
    """A page object with its defaults."""
    return _struct(
        {
            "screen_type": p["screen_type"],
            "situation_id": p["situation_id"],
            "state_flags": _texts(p["state_flags"]),
            "confidence": F.coalesce(p["confidence"], F.lit(0.0)),
        }
    )


def _route(r: Column, primitive: Column, target: Column) -> Column:
    """A route object whose primitive and target are filled where it has none."""
    own = {n: r[n] for n in fields(ROUTE)}
    filled = {
        "primitive_id": F.coalesce(r["primitive_id"], primitive),
        "target_element_id": F.coalesce(r["target_element_id"], target),
        "confidence": F.coalesce(r["confidence"], F.lit(0.0)),
    }
    return _struct(own | filled)


def _element(e: Column) -> Column:
    """An element of a file with its defaults; corners win over the list of four."""
    corners = {n: F.coalesce(e[n], F.get(e["bbox_xyxy"], F.lit(k)), F.lit(float(k >= 2))) for k, n in enumerate(BOX)}
    rest = {
        "hotkeys": _texts(e["hotkeys"]),
        "available_actions": _texts(e["available_actions"]),
        "enabled_state": F.coalesce(e["enabled_state"], F.lit("enabled")),
        "is_route_target": F.coalesce(e["is_route_target"], F.lit(False)),
        "confidence": F.coalesce(e["confidence"], F.lit(0.0)),
        "metadata": F.coalesce(e["metadata"], F.lit("{}")),
    }
    return _struct({n: e[n] for n in fields(ELEMENT)} | corners | rest)


def primary_index(elements: Column) -> Column:
    """0-based place of the first route target, else 0."""
    targets = F.transform(elements, lambda e: F.coalesce(e["is_route_target"], F.lit(False)))
    return F.greatest(F.lit(1), F.coalesce(F.array_position(targets, True), F.lit(1)).cast("int")) - 1


def primary_element(elements: Column) -> Column:
    """The first route target, else the first element, else null."""
    return F.get(elements, primary_index(elements))


def flat_fields(label: Column) -> dict[str, Column]:
    """The flat view of a nested label."""
    e = primary_element(label["elements"])
    page, route = label["page"], label["route_label"]
    of_element = {n: e[n] for n in ("semantic_id", "semantic_text", *BOX)}
    return {
        "screen_type": page["screen_type"],
        "situation_id": page["situation_id"],
        "primitive_id": route["primitive_id"],
        "function_id": F.coalesce(e["function_id"], route["primitive_id"]),
    } | of_element


def nested_label(rows: DataFrame, raw: str, name: str = "label") -> DataFrame:
    """rows with a nested label (LABEL) from a label file's struct (LABEL_FILE) in raw; null stays null.

    A file without page, route or elements has them from its flat fields: the page from screen type and situation, an
    element elem_001 where it has a box, a meaning, hotkeys or actions, and the route from function and element.
    """
    r = F.col(raw)
    corner = {n: F.coalesce(r[n], F.lit(float(k >= 2))) for k, n in enumerate(BOX)}
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    boxed = F.greatest(*(~c.isin(0.0, 1.0) for c in corner.values()))
    has = boxed | some(r["semantic_id"]) | some(r["semantic_text"]) | (F.size(_texts(r["hotkeys"])) > 0) | (
        F.size(_texts(r["available_actions"])) > 0
    )
    confidence = F.coalesce(r["confidence"], F.lit(0.0))
    flat = {n: r[n] for n in ("semantic_id", "semantic_text", "function_id")}
    one = {"element_id": F.lit("elem_001")} | corner | flat | {
        "hotkeys": _texts(r["hotkeys"]), "available_actions": _texts(r["available_actions"]),
    }
    one |= {
        "enabled_state": F.lit("enabled"),
        "roi_name": F.lit(None).cast("string"),
        "is_route_target": F.lit(True),
        "confidence": confidence,
        "metadata": F.lit("{}"),
    }
    listed = F.transform(r["elements"], _element)
    elements = F.when(
        F.size(F.coalesce(r["elements"], F.array().cast(f"array<{ELEMENT_FILE}>"))) > 0, listed,
    ).when(has, F.array(_struct(one))).otherwise(F.array().cast(f"array<{ELEMENT}>"))
    staged = rows.withColumn("__elements", elements).withColumn("__primary", primary_element(F.col("__elements")))
    primary = F.col("__primary")
    page = F.when(r["page"].isNotNull(), _page(r["page"])).otherwise(
        _struct(
            {
                "screen_type": r["screen_type"],
                "situation_id": r["situation_id"],
                "state_flags": _texts(F.lit(None)),
                "confidence": confidence,
            }
        )
    )
    function = F.when(primary.isNotNull(), primary["function_id"]).otherwise(r["function_id"])
    bare = _struct(
        {n: F.lit(None).cast("array<double>" if n == "roi_bbox_norm" else "string") for n in ROUTE_KEYS} | {"confidence": confidence}
    )
    given = _route(r["route_label"], function, primary["element_id"])
    made = _route(bare, F.coalesce(r["function_id"], function), primary["element_id"])
    parts = {
        "page": page,
        "route_label": F.when(r["route_label"].isNotNull(), given).otherwise(made),
        "elements": F.col("__elements"),
        "evidence": r["evidence"],
        "confidence": confidence,
        "transition_detected": F.coalesce(r["transition_detected"], F.lit(False)),
    }
    return staged.withColumn(name, F.when(r.isNotNull(), _struct(parts))).drop("__elements", "__primary")


def effective_label(
    rows: DataFrame, label: str = "label", status: str = "review_status", corrections: str = "corrections", name: str | None = None,
) -> DataFrame:
    """rows with the label that holds after review, in place of label or under another name.

    Only an edited row with corrections (JSON string) changes. A page or route object replaces the whole struct,
    otherwise keys that are present replace fields, null included; a list of elements replaces them, otherwise the
    primary one is patched. A route without primitive or target then has those of the primary element. The corrections
    are parsed once a row; each struct is built by one constructor.
    """
    whole = F.col(corrections)
    parsed = F.struct(F.from_json(whole, CORRECTIONS).alias("c"), F.json_object_keys(whole).alias("keys"))
    staged = rows.withColumn(
        "__edit", F.when((F.col(status) == "edited") & F.col(label).isNotNull() & (F.json_object_keys(whole).isNotNull()), parsed),
    )
    base, c, keys = F.col(label), F.col("__edit.c"), F.col("__edit.keys")
    new = lambda k, old: F.when(F.array_contains(keys, k), c[k]).otherwise(old[k])

    def patch(e: Column) -> Column:
        corners = {n: F.when(F.array_contains(keys, "bbox_xyxy"), F.get(c["bbox_xyxy"], F.lit(k))).otherwise(e[n]) for k, n in enumerate(BOX)}
        return _struct({n: e[n] for n in fields(ELEMENT)} | corners | {k: new(k, e) for k in ELEMENT_KEYS})

    primary = primary_index(base["elements"])
    patched = F.transform(base["elements"], lambda e, i: F.when(i == primary, patch(e)).otherwise(e))
    elements = F.when(c["elements"].isNotNull(), F.transform(c["elements"], _element)).otherwise(patched)
    edited = F.size(keys) > 0
    staged = staged.withColumn("__elements", F.when(edited, elements)).withColumn("__primary", primary_element(F.col("__elements")))
    old, first = primary_element(base["elements"]), F.col("__primary")
    function = F.when(first.isNotNull(), first["function_id"]).otherwise(old["function_id"])
    own_page = _struct({n: base["page"][n] for n in fields(PAGE)} | {k: new(k, base["page"]) for k in PAGE_KEYS})
    own_route = _struct({n: base["route_label"][n] for n in fields(ROUTE)} | {k: new(k, base["route_label"]) for k in ROUTE_KEYS})
    staged = staged.withColumn("__route", F.when(edited, F.when(c["route_label"].isNotNull(), c["route_label"]).otherwise(own_route)))
    parts = {
        "page": F.when(c["page"].isNotNull(), _page(c["page"])).otherwise(own_page),
        "route_label": _route(F.col("__route"), function, first["element_id"]),
        "elements": F.col("__elements"),
        **{n: base[n] for n in ("evidence", "confidence", "transition_detected")},
    }
    out = F.when(F.coalesce(edited, F.lit(False)), _struct(parts)).otherwise(base)
    return staged.withColumn(name or label, out).drop("__edit", "__elements", "__primary", "__route")


def routing_record(sample_id: Column, event: Column, label: Column, metadata: Column) -> Column:
    """Struct of the routing export; of the metadata only session, run, pipeline, capture, coordinates and filter."""
    keep = ("session_id", "run_config", "pipeline_version", "capture", "coordinates", "filter")
    md = F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k in keep)), F.array(*(F.get_json_object(metadata, f"$.{k}") for k in keep))), lambda k, v: v.isNotNull())
    return F.struct(
        sample_id.alias("sample_id"),
        event.alias("event"),
        label["page"].alias("page"),
        label["route_label"].alias("route_label"),
        label["elements"].alias("elements"),
        label["confidence"].alias("confidence"),
        md.alias("metadata"),
    )


def page_sample(sample_id: Column, label: Column) -> Column:
    return F.struct(sample_id.alias("sample_id"), label["page"].alias("page"), label["elements"].alias("elements"))


def primary_roi(priority: Column, likely: Column) -> Column:
    return F.coalesce(F.get(priority, F.lit(0)), F.get(likely, F.lit(0)))


def roi_crop(rows: DataFrame, situations: DataFrame, rois: DataFrame, width: str, height: str, fallbacks: list[str]) -> DataFrame:
    """rows and crop (x1, y1, x2, y2): the label's own box, else its ROI, the situation's, the first known fallback.

    rows hold label, width and height. Dimension tables have a fixed, small size.
    """
    known = [r["roi_name"] for r in rois.where(F.col("roi_name").isin(fallbacks)).select("roi_name").collect()] if fallbacks else []
    default = next((f for f in fallbacks if f in known), None)
    primary = situations.select(
        F.col("situation_id").alias("__sid"), primary_roi(F.col("roi_priority"), F.col("likely_rois")).alias("__roi"),
    )
    named = rows.join(primary, F.col("label.page.situation_id") == F.col("__sid"), "left").withColumn(
        "__name", F.coalesce(F.col("label.route_label.roi_name"), F.col("__roi"), F.lit(default)),
    )
    boxes = rois.select(F.col("roi_name").alias("__name"), F.struct("x1", "y1", "x2", "y2").alias("__box"))
    found = named.join(boxes, "__name", "left")
    own = F.col("label.route_label.roi_bbox_norm")
    part = lambda k, n: F.when(F.size(own) == 4, F.get(own, F.lit(k))).otherwise(F.col("__box")[n])
    w, h = F.col(width), F.col(height)
    crop = crop_pixels(Box(part(0, "x1"), part(1, "y1"), part(2, "x2"), part(3, "y2")), w, h)
    whole = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), w.alias("x2"), h.alias("y2"))
    return found.withColumn(
        "crop", F.when((F.size(own) == 4) | F.col("__box").isNotNull(), crop.struct()).otherwise(whole),
    ).drop("__sid", "__roi", "__name", "__box")


def roi_hits(points: DataFrame, rois: DataFrame, x: str, y: str) -> DataFrame:
    """points and roi_hits: names of the regions that hold the point, borders included, sorted.

    The regions are a fixed, small dimension table packed into one row, so a point scans them in place.
    """
    packed = rois.agg(F.collect_list(F.struct("roi_name", "x1", "y1", "x2", "y2")).alias("__rois"))
    inside = F.filter("__rois", lambda r: contains(Box.of(r), F.col(x), F.col(y)))
    return points.crossJoin(F.broadcast(packed)).withColumn(
        "roi_hits", F.coalesce(F.array_sort(F.transform(inside, lambda r: r["roi_name"])), F.array().cast("array<string>")),
    ).drop("__rois")


def hotkey_match(rows: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """rows and hotkey_primitive: function of the first element (declared order) with a hotkey that equals or holds the key."""
    packed = elements.agg(F.array_sort(F.collect_list(F.struct("ord", "function_id", "hotkeys"))).alias("__elements"))
    upper = F.upper(F.col(key))
    hit = F.filter("__elements", lambda e: F.exists(e["hotkeys"], lambda h: F.contains(F.upper(h), upper)))
    out = rows.crossJoin(F.broadcast(packed))  # one row
    return out.withColumn(
        "hotkey_primitive", F.when(F.coalesce(F.col(key), F.lit("")) != "", F.get(hit, F.lit(0))["function_id"]),
    ).drop("__elements")


def ontology_match(rows: DataFrame, ontology: DataFrame, proposed_id: str, proposed_text: str, strict: bool = True) -> DataFrame:
    """rows, mapped_id, unmapped: exact id, then equal text without case, then text in description or the reverse.

    ontology: ord, semantic_id, description; first in order wins. Strict: no match gives null, else the proposed id.
    """
    packed = ontology.agg(F.array_sort(F.collect_list(F.struct("ord", "semantic_id", "description"))).alias("__terms"))
    text = F.lower(F.trim(F.coalesce(F.col(proposed_text), F.lit(""))))
    pick = lambda test: F.get(F.filter("__terms", test), F.lit(0))["semantic_id"]
    exact = pick(lambda t: t["semantic_id"] == F.col(proposed_id))
    equal = pick(lambda t: (text != "") & (F.lower(t["semantic_id"]) == text))
    near = pick(lambda t: (text != "") & (F.contains(F.lower(t["description"]), text) | F.contains(text, F.lower(t["description"]))))
    mapped = F.coalesce(exact, equal, near)
    out = rows.crossJoin(F.broadcast(packed)).withColumn("__m", mapped)  # one row
    return out.withColumn(
        "mapped_id", F.col("__m") if strict else F.coalesce("__m", F.col(proposed_id)),
    ).withColumn("unmapped", F.col("__m").isNull()).drop("__terms", "__m")


def local_labels(rows: DataFrame, situations: DataFrame, popup: bool = True) -> DataFrame:
    """rows with primitive_id, situation_id, screen_type, signals, confidence.

    rows hold roi_hits, hotkey_primitive, action and key. situations (fixed, small): ord, situation_id, screen_types,
    allowed_primitives, roi_priority. Hotkey first, then regions (one allowed primitive: a match, several: ambiguous,
    the first), then the popup keys. Confidence: .35 primitive, .25 situation, .10 screen, .20 hotkey, .15 region, at
    most .75.
    """
    packed = situations.agg(
        F.array_sort(F.collect_list(F.struct("ord", "situation_id", "screen_types", "allowed_primitives", "roi_priority"))).alias("__s")
    )
    out = rows.crossJoin(F.broadcast(packed))  # one row
    hits = F.col("roi_hits")
    touched = lambda s: F.coalesce(F.arrays_overlap(s["roi_priority"], hits), F.lit(False))
    allowed = F.flatten(F.transform(F.filter("__s", touched), lambda s: s["allowed_primitives"]))
    out = out.withColumn("__allowed", allowed)
    popup_key = F.col("action").isin("press", "type") & F.upper(
        F.trim(F.coalesce(F.col("key"), F.lit("")))
    ).isin("ENTER", "RETURN", "ESC", "ESCAPE") & F.lit(popup)
    out = out.withColumn("primitive_id", F.coalesce("hotkey_primitive", F.get("__allowed", F.lit(0)), F.when(popup_key, "popup_primitive")))
    by = F.when(
        F.col("hotkey_primitive").isNotNull(), "hotkey_match",
    ).when(F.size("__allowed") == 1, "roi_match").when(F.size("__allowed") > 1, "roi_ambiguous").when(popup_key, "default_popup_key")
    may = F.filter("__s", lambda s: F.array_contains(s["allowed_primitives"], F.col("primitive_id")))
    out = out.withColumn("__may", may).withColumn(
        "__at", F.get(F.filter("__may", touched), F.lit(0)),
    ).withColumn("__any", F.get("__may", F.lit(0)))
    chosen = F.coalesce("__at", "__any")
    where = F.when(F.col("__at").isNotNull(), "roi_match").when(F.col("__any").isNotNull(), "primitive_default")
    out = out.withColumn("situation_id", chosen["situation_id"]).withColumn(
        "screen_type", F.get(chosen["screen_types"], F.lit(0)),
    ).withColumn("signals", F.array_compact(F.array(by, where)))
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0.0))
    total = points(F.col("primitive_id").isNotNull(), 0.35) + points(F.col("situation_id").isNotNull(), 0.25) + points(F.col("screen_type").isNotNull(), 0.10) + points(
        F.array_contains("signals", "hotkey_match"), 0.20,
    ) + points(F.array_contains("signals", "roi_match"), 0.15)
    return out.withColumn("confidence", F.least(F.lit(0.75), total)).drop("__s", "__allowed", "__may", "__at", "__any")


def teacher_choice(candidates: Column) -> Column:
    """Candidates (structs rank, confidence, ...) without bad ones, by rank then falling confidence, ranks below 1 renumbered."""
    good = F.filter(candidates, lambda c: c["confidence"].isNotNull() & c["primitive_id"].isNotNull())
    ordered = F.array_sort(good, lambda a, b: F.when(a["rank"] != b["rank"], F.signum((a["rank"] - b["rank"]).cast("double")).cast("int")).otherwise(F.signum(b["confidence"] - a["confidence"]).cast("int")))
    return F.transform(ordered, lambda c, i: c.withField("rank", F.when(F.coalesce(c["rank"], F.lit(0)) < 1, i + 1).otherwise(c["rank"])))


def apply_teacher(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Labels with the teacher's choice: ids fall back to the label's, the region doesn't, confidence to the first not 0.

    results: key, chosen struct<primitive_id, situation_id, screen_type, roi_name, confidence>, route_candidates (JSON).
    """
    out = rows.join(results.select(key, "chosen", "route_candidates"), key, "left")
    label, chosen = F.col("label"), F.col("chosen")
    confidence = first_nonzero(chosen["confidence"], label["confidence"])
    page = label["page"].withField(
        "situation_id", first_truthy(chosen["situation_id"], label["page"]["situation_id"]),
    ).withField("screen_type", first_truthy(chosen["screen_type"], label["page"]["screen_type"])).withField("confidence", confidence)
    route = label["route_label"].withField(
        "primitive_id", first_truthy(chosen["primitive_id"], label["route_label"]["primitive_id"]),
    ).withField("roi_name", chosen["roi_name"]).withField("confidence", confidence)
    new = label.withField("page", page).withField("route_label", route).withField("confidence", confidence).withField(
        "evidence", F.to_json(F.struct(F.col("route_candidates"))),
    )
    return out.withColumn("label", F.when(chosen.isNotNull(), new).otherwise(label)).drop("chosen", "route_candidates")


def trigger(event: Column) -> dict[str, Column]:
    """The trigger fields of a route from an event struct."""
    keyboard = event["action"].isin("press", "type")
    return {
        "trigger_modality": F.when(keyboard, "keyboard").otherwise("mouse"),
        "trigger_action_type": event["action"],
        "trigger_mouse_button": event["button"],
        "trigger_key": event["key"],
    }


def routing_label(
    event: Column, primitive: Column, situation: Column, screen: Column, roi: Column, box: Column, confidence: Column, evidence: Column,
) -> Column:
    """A whole label that routes only: page, route with the event's trigger, evidence (JSON), no elements."""
    page = {"screen_type": screen, "situation_id": situation, "state_flags": _texts(F.lit(None)), "confidence": confidence}
    route = {"primitive_id": primitive, "target_element_id": F.lit(None).cast("string"), "roi_name": roi, "roi_bbox_norm": box}
    return _struct(
        {
            "page": _struct(page),
            "route_label": _struct(route | trigger(event) | {"confidence": confidence}),
            "elements": F.array().cast(f"array<{ELEMENT}>"),
            "evidence": evidence,
            "confidence": confidence,
            "transition_detected": F.lit(False),
        }
    ).cast(LABEL)


def teacher_evidence(chosen: Column) -> Column:
    """JSON of the teacher's evidence with its candidates as route_candidates."""
    own = F.coalesce(F.from_json(chosen["evidence"], "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    ranked = F.create_map(F.lit("route_candidates"), F.parse_json(F.coalesce(chosen["candidates"], F.lit("[]"))))
    return F.to_json(F.map_concat(F.map_filter(own, lambda k, v: k != "route_candidates"), ranked))


def taught_label(label: Column, chosen: Column, event: Column) -> Column:
    """The label of a teacher's answer: ids fall back to the label's own (null: none), the region doesn't, the primitive
    to the answer's function, confidence to the first that isn't 0. Elements go: the teacher routes only."""
    page, route = label["page"], label["route_label"]
    confidence = F.coalesce(first_nonzero(chosen["confidence"], label["confidence"]), F.lit(0.0))
    primitive = first_truthy(chosen["primitive_id"], chosen["function_id"], route["primitive_id"])
    situation = first_truthy(chosen["situation_id"], page["situation_id"])
    screen = first_truthy(chosen["screen_type"], page["screen_type"])
    box = F.when(F.size(chosen["roi_bbox_norm"]) > 0, chosen["roi_bbox_norm"])
    return routing_label(event, primitive, situation, screen, chosen["roi_name"], box, confidence, teacher_evidence(chosen))


def element_norm(e: Column, width: Column, height: Column) -> Column:
    """The element with bbox_xyxy and bbox_norm (null without an image size)."""
    box = F.array(e["bbox_x_min"], e["bbox_y_min"], e["bbox_x_max"], e["bbox_y_max"])
    sized = F.when(
        (width > 0) & (height > 0),
        F.array(e["bbox_x_min"] / width, e["bbox_y_min"] / height, e["bbox_x_max"] / width, e["bbox_y_max"] / height),
    )
    return e.withField("bbox_xyxy", box).withField("bbox_norm", sized)
