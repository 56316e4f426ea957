"""Taxonomy YAML to ordered dimension tables, and settings files."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import yaml
from pyspark.sql import DataFrame, SparkSession

PRIMITIVES = "ord int, primitive_id string, router_enabled boolean, criteria string"
SITUATIONS = "ord int, situation_id string, screen_types array<string>, allowed_primitives array<string>, roi_priority array<string>, likely_rois array<string>"
ELEMENTS = "ord int, semantic_id string, semantic_text string, function_id string, hotkeys array<string>, available_actions array<string>, roi_hint string, aliases array<string>"
ROIS = "ord int, roi_name string, x1 double, y1 double, x2 double, y2 double"
_LOADERS: dict[str, object] = {}


def register_profile(name: str):
    """Register a loader (spark, path) -> dict of dimension tables under a name."""

    def keep(f):
        _LOADERS[name] = f
        return f

    return keep


def profiles() -> list[str]:
    return sorted(_LOADERS)


def load(spark: SparkSession, name: str, path: str) -> dict[str, DataFrame]:
    if name not in _LOADERS:
        raise KeyError(f"unknown profile {name}; known: {', '.join(profiles())}")
    return _LOADERS[name](spark, path)


def _texts(value) -> list[str]:
    return [str(v) for v in value or [] if v is not None]


def _named(value, key: str) -> list[tuple[str, dict]]:
    """Items of a mapping, or of a list whose entries name themselves."""
    if isinstance(value, dict):
        return [(str(k), v or {}) for k, v in value.items()]
    return [(str(v[key]), v) if isinstance(v, dict) else (str(v), {}) for v in value or []]


@register_profile("yaml")
def from_yaml(spark: SparkSession, path: str, defaults: dict | None = None) -> dict[str, DataFrame]:
    """dim tables primitive, situation, element, roi in declared order; a missing or empty part falls back to defaults.

    The file is read through Spark, so it may be in any store.
    """
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one settings file
    doc = yaml.safe_load(text) or {}
    part = lambda k: doc.get(k) or (defaults or {}).get(k) or {}
    primitives = [(i, n, bool(v.get("router_enabled", True)), v.get("criteria")) for i, (n, v) in enumerate(_named(part("primitives"), "primitive_id"))]
    situations = [(i, n, _texts(v.get("screen_types")), _texts(v.get("allowed_primitives")), _texts(v.get("roi_priority")), _texts(v.get("likely_rois"))) for i, (n, v) in enumerate(_named(part("situations"), "situation_id"))]
    elements = [(i, n, v.get("semantic_text"), v.get("function_id") or v.get("function_id_or_related_primitive"), _texts(v.get("hotkeys")), _texts(v.get("available_actions")), v.get("roi_hint"), _texts(v.get("text_aliases")) + _texts(v.get("icon_aliases"))) for i, (n, v) in enumerate(_named(part("elements"), "semantic_id"))]
    boxes = [(n, v if isinstance(v, (list, tuple)) else v.get("bbox_norm") or v.get("bbox")) for n, v in _named(part("rois"), "roi_name")]
    rois = [(i, n, *map(float, b)) for i, (n, b) in enumerate((n, b) for n, b in boxes if b is not None and len(b) == 4)]
    return {
        "primitive": spark.createDataFrame(primitives, PRIMITIVES),
        "situation": spark.createDataFrame(situations, SITUATIONS),
        "element": spark.createDataFrame(elements, ELEMENTS),
        "roi": spark.createDataFrame(rois, ROIS),
    }


def router_primitives(primitives: DataFrame) -> DataFrame:
    return primitives.where("coalesce(router_enabled, true)")


def _check(name: str, value, low=None, high=None) -> None:
    if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
        raise ValueError(f"{name} must be within {low} and {'any' if high is None else high}, not {value}")


@dataclass(frozen=True)
class RecorderSettings:
    capture_fps: int = 10
    buffer_seconds: int = 5
    post_action_delay_ms: int = 500
    monitor_index: int = 0
    ui_scale: float | None = None
    enable_hover: bool = False

    def __post_init__(self):
        _check("capture_fps", self.capture_fps, 1, 60)
        _check("buffer_seconds", self.buffer_seconds, 1)
        _check("post_action_delay_ms", self.post_action_delay_ms, 100)
        _check("monitor_index", self.monitor_index, 0)
        if self.ui_scale is not None and self.ui_scale <= 0:
            raise ValueError("ui_scale must be above 0")

    @property
    def ring_frames(self) -> int:
        return self.capture_fps * self.buffer_seconds


@dataclass(frozen=True)
class LabelerSettings:
    routing_only: bool = True
    provider: str = "gemini"
    provider_fallback_to_local: bool = True
    click_crop_radius_px: int = 80
    diff_threshold: float = 0.02
    contour_min_area_px: int = 100
    ocr_languages: list = field(default_factory=lambda: ["en"])
    use_ocr: bool = False
    legacy_weak_signals: bool = False
    #: Weights of the signals in a fused label.
    fusion_weights: dict = field(default_factory=lambda: {"click_proximity": 0.25, "diff": 0.35, "vlm": 0.3, "ocr": 0.0, "profile_hint": 0.1})

    def __post_init__(self):
        _check("click_crop_radius_px", self.click_crop_radius_px, 10)
        _check("diff_threshold", self.diff_threshold, 0.0, 1.0)
        _check("contour_min_area_px", self.contour_min_area_px, 1)


@dataclass(frozen=True)
class FilterSettings:
    min_diff_ratio: float = 0.005
    blur_laplacian_threshold: float = 50.0
    dark_overlay_threshold: float = 30.0
    transition_max_diff_ratio: float = 0.4
    dedup_hash_threshold: int = 8

    def __post_init__(self):
        _check("dedup_hash_threshold", self.dedup_hash_threshold, 0, 64)
        _check("min_diff_ratio", self.min_diff_ratio, 0.0, 1.0)
        _check("blur_laplacian_threshold", self.blur_laplacian_threshold, 0.0)
        _check("dark_overlay_threshold", self.dark_overlay_threshold, 0.0)
        _check("transition_max_diff_ratio", self.transition_max_diff_ratio, 0.0, 1.0)


@dataclass(frozen=True)
class ReviewSettings:
    server_port: int = 7861
    auto_approve_confidence: float = 0.9
    enable_auto_approve: bool = False
    legacy_mode: bool = False

    def __post_init__(self):
        _check("server_port", self.server_port, 1024, 65535)
        _check("auto_approve_confidence", self.auto_approve_confidence, 0.0, 1.0)


@dataclass(frozen=True)
class ExportSettings:
    normalizing_range: int = 1000
    routing_only: bool = True
    router_roi_fallbacks: list = field(default_factory=lambda: ["bottom_right", "popup_center", "unit_panel", "main_map"])

    def __post_init__(self):
        _check("normalizing_range", self.normalizing_range, 1)


@dataclass(frozen=True)
class RelabelSettings:
    enabled: bool = False
    provider: str = "gemini"
    model_name: str = "gemini-2.0-flash-preview"
    temperature: float = 0.0
    max_retries: int = 3
    timeout_sec: int = 20
    ontology_strict: bool = True
    max_samples: int | None = None

    def __post_init__(self):
        _check("temperature", self.temperature, 0.0, 1.0)
        _check("max_retries", self.max_retries, 0)
        _check("timeout_sec", self.timeout_sec, 1)
        _check("max_samples", self.max_samples, 1)


@dataclass(frozen=True)
class Settings:
    """All settings groups of a session; unknown keys are left out, a value out of bounds is an error."""

    workdir: str = "runs/session_01"
    game_profile: str | None = None
    recorder: RecorderSettings = field(default_factory=RecorderSettings)
    labeler: LabelerSettings = field(default_factory=LabelerSettings)
    filter: FilterSettings = field(default_factory=FilterSettings)
    review: ReviewSettings = field(default_factory=ReviewSettings)
    export: ExportSettings = field(default_factory=ExportSettings)
    relabel: RelabelSettings = field(default_factory=RelabelSettings)

    @staticmethod
    def from_yaml(text: str) -> Settings:
        doc = yaml.safe_load(text) or {}
        pick = lambda kind, d: kind(**{f.name: d[f.name] for f in fields(kind) if f.name in (d or {})})
        groups = {f.name: f.default_factory for f in fields(Settings) if f.name not in ("workdir", "game_profile")}
        plain = {k: doc[k] for k in ("workdir", "game_profile") if k in doc}
        return Settings(**plain, **{name: pick(kind, doc.get(name)) for name, kind in groups.items()})
