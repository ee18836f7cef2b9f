"""Boxes: STRUCT<x1, y1, x2, y2> as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BOX  # noqa: F401  the type these expressions are over


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def width(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0))


def height(b: Column) -> Column:
    return F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def hull(points: Column) -> Column:
    """The box around an array of [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def vertical_overlap(ay1: Column, ay2: Column, by1: Column, by2: Column) -> Column:
    """Shared height over the smaller height (over 1 where that is 0)."""
    shared = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0.0))
    small = F.least(ay2 - ay1, by2 - by1)
    return shared / F.when(small == 0, F.lit(1.0)).otherwise(small)


def reading_order(y1: Column, x1: Column) -> list[Column]:
    """Rows of ten pixels from the top (half to even), then from the left."""
    return [F.bround(y1 / 10).cast("bigint"), x1]
