"""Box algebra as column expressions. Boxes are (x1, y1, x2, y2) or (x, y, w, h) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def corners(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def clip(box: Box, width: Column, height: Column) -> Box:
    zero = F.lit(0.0)
    return tuple(F.greatest(zero, F.least(v, width if i % 2 == 0 else height)) for i, v in enumerate(box))


def area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def iou(a: Box, b: Box, floor: float = 0.0) -> Column:
    """Overlap over union; 0 where the union is empty, or the union floored."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - wide * high
    if floor:
        return wide * high / F.greatest(union, F.lit(floor))
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def intersects(a: Box, b: Box) -> Column:
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def yolo(box: Box, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre form of the clipped box; null where it has no area."""
    x1, y1, x2, y2 = clip(box, width, height)
    ok = (x2 > x1) & (y2 > y1)
    form = {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}
    return {k: F.when(ok, v) for k, v in form.items()}


def lenient_yolo(box: Box, width: Column, height: Column) -> dict[str, Column]:
    """Centre form of corners, its centre clipped to the image and its size capped at 1; null where the box has no size."""
    w, h = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    one, zero = F.lit(1.0), F.lit(0.0)
    ok = (w > 0) & (h > 0)
    form = {"cx": F.greatest(zero, F.least(one, (box[0] + box[2]) / 2 / width)), "cy": F.greatest(zero, F.least(one, (box[1] + box[3]) / 2 / height)), "w": F.least(one, w), "h": F.least(one, h)}
    return {k: F.when(ok, v) for k, v in form.items()}


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def flip(box: Box, size: Column, vertical: bool = False) -> Box:
    """Mirrored across the image's middle; size: its width, or height."""
    if vertical:
        return box[0], size - box[3], box[2], size - box[1]
    return size - box[2], box[1], size - box[0], box[3]


def centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return x + w / 2, y + h / 2, w, h


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return cx - w / 2, cy - h / 2, w, h


def letterbox(box: Box, width: Column, height: Column, size: float) -> Box:
    scale = F.lit(size) / F.greatest(width, height)
    dx, dy = (F.lit(size) - width * scale) / 2, (F.lit(size) - height * scale) / 2
    return tuple(v * scale + (dx if i % 2 == 0 else dy) for i, v in enumerate(box))


def rotated(box: Box, width: Column, height: Column, degrees: float, scale: float = 1.0) -> Box:
    """The box around the box's inscribed ellipse after a turn about the image's centre."""
    from math import cos, radians, sin

    c, s = cos(radians(degrees)), sin(radians(degrees))
    cx, cy, a, b = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, (box[2] - box[0]) / 2, (box[3] - box[1]) / 2
    dx, dy = cx - width / 2, cy - height / 2
    x, y = width / 2 + scale * (c * dx + s * dy), height / 2 + scale * (c * dy - s * dx)
    wide = scale * F.sqrt(a * a * c * c + b * b * s * s)
    high = scale * F.sqrt(a * a * s * s + b * b * c * c)
    return x - wide, y - high, x + wide, y + high
