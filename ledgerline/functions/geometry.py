"""Boxes as fractions of a page: structs of left, top, width, height; origin top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of all comparisons.
EPSILON = 1e-6


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))


def right(b: Column) -> Column:
    return b["left"] + b["width"]


def bottom(b: Column) -> Column:
    return b["top"] + b["height"]


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def valid(b: Column) -> Column:
    """Whether a box has positive size and lies on the page."""
    return (b["left"] >= -EPSILON) & (b["top"] >= -EPSILON) & (b["width"] > 0) & (b["height"] > 0) & (right(b) <= 1 + EPSILON) & (bottom(b) <= 1 + EPSILON)


def clipped(b: Column) -> Column:
    left, top = F.greatest(b["left"], F.lit(0.0)), F.greatest(b["top"], F.lit(0.0))
    return box(left, top, F.least(right(b), F.lit(1.0)) - left, F.least(bottom(b), F.lit(1.0)) - top)


def padded(b: Column, margin: float) -> Column:
    return clipped(box(b["left"] - margin, b["top"] - margin, b["width"] + 2 * margin, b["height"] + 2 * margin))


def from_pixels(left: Column, top: Column, right_: Column, bottom_: Column, width: Column, height: Column) -> Column:
    return box(left / width, top / height, (right_ - left) / width, (bottom_ - top) / height)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Half-open pixels: floor of the near edges, ceiling of the far ones, at least one pixel."""
    left, top = F.floor(b["left"] * width).cast("int"), F.floor(b["top"] * height).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.ceil(right(b) * width).cast("int"), left + 1).alias("right"), F.greatest(F.ceil(bottom(b) * height).cast("int"), top + 1).alias("bottom"))


def intersection_area(a: Column, b: Column) -> Column:
    """The common area; null where the boxes share none."""
    width = F.least(right(a), right(b)) - F.greatest(a["left"], b["left"])
    height = F.least(bottom(a), bottom(b)) - F.greatest(a["top"], b["top"])
    return F.when((width > EPSILON) & (height > EPSILON), width * height)


def iou(a: Column, b: Column) -> Column:
    both = F.coalesce(intersection_area(a, b), F.lit(0.0))
    return both / (area(a) + area(b) - both)


def contains(a: Column, b: Column) -> Column:
    return (b["left"] >= a["left"] - EPSILON) & (b["top"] >= a["top"] - EPSILON) & (right(b) <= right(a) + EPSILON) & (bottom(b) <= bottom(a) + EPSILON)
