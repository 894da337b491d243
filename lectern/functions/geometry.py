"""Boxes as arrays x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rules import choose


def valid(b: Column) -> Column:
    return b.isNotNull() & (F.size(b) == 4)


def area(b: Column) -> Column:
    return F.when(valid(b), F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))).otherwise(0.0)


def center(b: Column) -> Column:
    return F.struct(((b[0] + b[2]) / 2).alias("x"), ((b[1] + b[3]) / 2).alias("y"))


def distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def union(b: Column) -> Column:
    """Aggregate: the box around all valid ones, null if there is none."""
    good = F.when(valid(b), b)
    box = F.array(F.min(good[0]), F.min(good[1]), F.max(good[2]), F.max(good[3]))
    return F.when(F.count(good) > 0, box)


def overlaps(a: Column, b: Column, tolerance: float = 20.0) -> Column:
    return (a[0] - tolerance <= b[2]) & (b[0] <= a[2] + tolerance) & (a[1] - tolerance <= b[3]) & (b[1] <= a[3] + tolerance)


def parsed(json: Column) -> Column:
    box = F.from_json(json, "array<double>")
    return F.when(valid(box), box)


def reject_reason(b: Column, page_area: Column) -> Column:
    """Why a detection is not used, or null."""
    return choose((~valid(b) | (area(b) <= 0), "invalid_bbox"), (area(b) < 300, "too_small"), (area(b) / page_area > 0.85, "covers_page"))


def in_margin(b: Column, page_height: Column) -> Column:
    return (b[3] <= 0.06 * page_height) | (b[1] >= 0.94 * page_height)


def confidence(object_spans: Column, caption_spans: Column) -> Column:
    return choose((object_spans <= caption_spans, "caption_only"), (object_spans < 5, "inferred"), other="high")
