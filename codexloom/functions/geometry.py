"""Rectangles [x0, y0, x1, y1] as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(box: Column) -> Column:
    """Four finite numbers."""
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(box) == 4) & finite, F.lit(False))


def within(box: Column, width: Column, height: Column) -> Column:
    """A valid box with an area, on the page."""
    return is_valid(box) & (box[0] >= 0) & (box[1] >= 0) & (box[2] > box[0]) & (box[3] > box[1]) & (box[2] <= width) & (box[3] <= height)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def distance(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.hypot(dx, dy)


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def overlap_ratio(a: Column, b: Column) -> Column:
    """The shared area over the smaller one's, which counts as 1 at least."""
    shared = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return shared / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def rotate_180(a: Column, width: Column, height: Column) -> Column:
    return F.array(width - a[2], height - a[3], width - a[0], height - a[1])


def to_page(a: Column, left: Column, top: Column, scale: Column) -> Column:
    """A box in a crop at (left, top), drawn at ``scale``, in page coordinates."""
    return F.array(left + a[0] / scale, top + a[1] / scale, left + a[2] / scale, top + a[3] / scale)


def union(box: Column) -> Column:
    """The box around a group's boxes; an aggregate."""
    return F.array(F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3]))


def polygon_box(points: Column) -> Column:
    """The box around an array of [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def coverage(box: Column, page_area: Column) -> Column:
    """Share of a page under a group's boxes, 1 at most; an aggregate."""
    return F.round(F.least(F.lit(1.0), F.sum(area(box)) / F.greatest(F.lit(1.0), F.max(page_area))), 4)


def column_region(box: Column, text: Column, width: Column, height: Column) -> Column:
    """header, footer, left or right, for pages of two columns."""
    title = (F.lower(F.trim(text)) == "index") & (box[1] <= 120)
    return F.when((box[3] <= 52) | title, "header").when(box[1] >= height - 52, "footer").when(box[0] < width * 0.48, "left").otherwise("right")
