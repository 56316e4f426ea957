"""Boxes and points. A box is four columns (x1, y1, x2, y2) of doubles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(struct: str | Column, names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Box:
        """The box in the fields of a struct column."""
        base = F.col(struct) if isinstance(struct, str) else struct
        return Box(*(base[n] for n in names))

    @staticmethod
    def cols(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + n) for n in ("x1", "y1", "x2", "y2")))

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip(self._fields, self, strict=True)))


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b.x2 - b.x1) * F.greatest(zero, b.y2 - b.y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    zero = F.lit(0.0)
    shared = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    union = area(a) + area(b) - shared
    return F.when(union <= 0, zero).otherwise(shared / union)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def contains(b: Box, x: Column, y: Column) -> Column:
    """Borders included."""
    return (b.x1 <= x) & (x <= b.x2) & (b.y1 <= y) & (y <= b.y2)


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def xyxy_to_xywh(b: Box) -> dict[str, Column]:
    """x, y, w, h and area, extents not below 0."""
    w, h = F.greatest(F.lit(0.0), b.x2 - b.x1), F.greatest(F.lit(0.0), b.y2 - b.y1)
    return {"x": b.x1, "y": b.y1, "w": w, "h": h, "area": w * h}


SCALES = {"none": None, "0-1": 1.0, "0-1000": 1000.0}


def normalize(b: Box, mode: str, width: Column, height: Column) -> Box:
    """Pixel box to a declared range; an unknown mode or an empty image is an error."""
    if mode not in SCALES:
        raise ValueError(f"unknown bbox mode: {mode}")
    if SCALES[mode] is None:
        return b
    top = F.lit(SCALES[mode])
    good = (width > 0) & (height > 0)
    part = lambda v, size: F.when(good, v / size * top).otherwise(F.raise_error(F.lit("image size must be positive")).cast("double"))
    return Box(part(b.x1, width), part(b.y1, height), part(b.x2, width), part(b.y2, height))


def denormalize(b: Box, mode: str, width: Column, height: Column) -> Box:
    if mode not in SCALES:
        raise ValueError(f"unknown bbox mode: {mode}")
    if SCALES[mode] is None:
        return b
    top = SCALES[mode]
    return Box(b.x1 / top * width, b.y1 / top * height, b.x2 / top * width, b.y2 / top * height)


def guess_pixels(b: Box, width: Column, height: Column) -> Box:
    """By the largest magnitude: up to 1.5 units, up to 1200 thousandths, beyond that pixels."""
    most = F.greatest(*(F.abs(c) for c in b))
    scale = lambda size: F.when(most <= 1.5, size).when(most <= 1200, size / 1000).otherwise(F.lit(1.0))
    sx, sy = scale(width.cast("double")), scale(height.cast("double"))
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def valid(b: Box, width: Column, height: Column) -> Column:
    """Positive extent that meets the image."""
    return (b.x2 > b.x1) & (b.y2 > b.y1) & (b.x2 > 0) & (b.y2 > 0) & (b.x1 < width) & (b.y1 < height)


def clamp_unit(b: Box, least: float = 0.01) -> Box:
    """Into [0, 1] with an extent of at least `least`."""
    c = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in b]
    right = F.when(c[2] <= c[0], F.least(F.lit(1.0), c[0] + least)).otherwise(c[2])
    low = F.when(c[3] <= c[1], F.least(F.lit(1.0), c[1] + least)).otherwise(c[3])
    return Box(c[0], c[1], right, low)


def point_to_unit(v: Column, size: Column) -> Column:
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)))


def to_local(v: Column, origin: Column) -> Column:
    """Screen coordinate to monitor coordinate."""
    return v - origin


def bucket(v: Column, size: Column, cells: int = 3) -> Column:
    """0-based cell of a grid over the image."""
    return F.least(F.lit(cells - 1), (v / F.greatest(F.lit(1), size) * cells).cast("int"))


def semantic_id(name: Column, b: Box, width: Column, height: Column) -> Column:
    """class_rRcC for the cell of the box's center."""
    x, y = center(b)
    return F.concat(name, F.lit("_r"), bucket(y, height), F.lit("c"), bucket(x, width))


def crop_pixels(b: Box, width: Column, height: Column) -> Box:
    """Unit box to pixel crop: half-even rounding, inside the image, one pixel at least."""
    x1 = F.greatest(F.lit(0), F.least(width - 1, F.bround(b.x1 * width).cast("int")))
    y1 = F.greatest(F.lit(0), F.least(height - 1, F.bround(b.y1 * height).cast("int")))
    x2 = F.greatest(x1 + 1, F.least(width, F.bround(b.x2 * width).cast("int")))
    y2 = F.greatest(y1 + 1, F.least(height, F.bround(b.y2 * height).cast("int")))
    return Box(x1, y1, x2, y2)


def corner_crop(width: Column, height: Column, across: float = 0.28, down: float = 0.22) -> Box:
    """Bottom right part of the image, sizes cut to whole pixels, one at least."""
    w, h = F.greatest(F.lit(1), (width * across).cast("int")), F.greatest(F.lit(1), (height * down).cast("int"))
    return Box(width - w, height - h, width, height)


def around(x: Column, y: Column, radius: float) -> Box:
    """Box about a click; its low side isn't below 0."""
    zero = F.lit(0.0)
    return Box(F.greatest(zero, x - radius), F.greatest(zero, y - radius), x + radius, y + radius)
