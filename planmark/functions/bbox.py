"""Box algebra on STRUCT<x, y, width, height> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(
        x.cast("int").alias("x"),
        y.cast("int").alias("y"),
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
    )


def left(b: Column) -> Column:
    return b["x"]


def top(b: Column) -> Column:
    return b["y"]


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def center_x(b: Column) -> Column:
    return b["x"] + b["width"] / F.lit(2.0)


def center_y(b: Column) -> Column:
    return b["y"] + b["height"] / F.lit(2.0)


def area(b: Column) -> Column:
    return b["width"].cast("bigint") * b["height"].cast("bigint")


def _overlap_width(a: Column, b: Column) -> Column:
    return F.least(right(a), right(b)) - F.greatest(left(a), left(b))


def _overlap_height(a: Column, b: Column) -> Column:
    return F.least(bottom(a), bottom(b)) - F.greatest(top(a), top(b))


def overlaps(a: Column, b: Column) -> Column:
    """Edges count as overlap."""
    return (_overlap_width(a, b) >= 0) & (_overlap_height(a, b) >= 0)


def contains(outer: Column, inner: Column) -> Column:
    return (
        (left(inner) >= left(outer))
        & (top(inner) >= top(outer))
        & (right(inner) <= right(outer))
        & (bottom(inner) <= bottom(outer))
    )


def point_in(x: Column, y: Column, b: Column) -> Column:
    return x.between(left(b), right(b)) & y.between(top(b), bottom(b))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(_overlap_width(a, b), F.lit(0)).cast("bigint")
    h = F.greatest(_overlap_height(a, b), F.lit(0)).cast("bigint")
    common = w * h
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Common box; all zero where the boxes are apart."""
    zero = F.lit(0)
    hit = overlaps(a, b)
    pick = lambda value: F.when(hit, value).otherwise(zero)
    return box(
        pick(F.greatest(left(a), left(b))),
        pick(F.greatest(top(a), top(b))),
        pick(_overlap_width(a, b)),
        pick(_overlap_height(a, b)),
    )


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def expand(b: Column, pixels: int, max_width: int | None = None, max_height: int | None = None) -> Column:
    x1 = F.greatest(F.lit(0), left(b) - pixels)
    y1 = F.greatest(F.lit(0), top(b) - pixels)
    x2 = F.greatest(x1, right(b) + pixels) if max_width is None else F.least(right(b) + pixels, F.lit(max_width))
    y2 = F.greatest(y1, bottom(b) + pixels) if max_height is None else F.least(bottom(b) + pixels, F.lit(max_height))
    return from_corners(x1, y1, x2, y2)


def clip(b: Column, width: int, height: int) -> Column:
    cut = lambda value, limit: F.greatest(F.lit(0), F.least(value, F.lit(limit)))
    return from_corners(
        cut(left(b), width), cut(top(b), height), cut(right(b), width), cut(bottom(b), height)
    )


def scale(b: Column, factor: float) -> Column:
    """Around the center; halves round to even."""
    w = F.bround(b["width"] * F.lit(float(factor)), 0)
    h = F.bround(b["height"] * F.lit(float(factor)), 0)
    x = F.bround(center_x(b) - w / 2.0, 0)
    y = F.bround(center_y(b) - h / 2.0, 0)
    return box(F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y), w, h)


def aspect_ratio(b: Column) -> Column:
    return F.try_divide(b["width"], b["height"])


def _unit_range(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def normalize(b: Column, width: int, height: int) -> Column:
    w, h = float(width), float(height)
    return F.struct(
        _unit_range(center_x(b) / w).alias("x_center"),
        _unit_range(center_y(b) / h).alias("y_center"),
        _unit_range(b["width"] / w).alias("width"),
        _unit_range(b["height"] / h).alias("height"),
    )


def denormalize(n: Column, width: int, height: int) -> Column:
    w, h = n["width"] * float(width), n["height"] * float(height)
    x = F.bround(n["x_center"] * float(width) - w / 2.0, 0)
    y = F.bround(n["y_center"] * float(height) - h / 2.0, 0)
    return box(
        F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y), F.bround(w, 0), F.bround(h, 0)
    )


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def center_distance(a: Column, b: Column) -> Column:
    return point_distance(center_x(a), center_y(a), center_x(b), center_y(b))


def distance(a: Column, b: Column) -> Column:
    """Gap between two boxes; 0 where they overlap."""
    dx = F.greatest(-_overlap_width(a, b), F.lit(0))
    dy = F.greatest(-_overlap_height(a, b), F.lit(0))
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def edge_distance(x: Column, y: Column, b: Column) -> Column:
    """Point to outline: inside the least gap to a side, outside the distance to the box."""
    inside = F.least(x - left(b), right(b) - x, y - top(b), bottom(b) - y)
    dx = F.greatest(left(b) - x, F.lit(0.0), x - right(b))
    dy = F.greatest(top(b) - y, F.lit(0.0), y - bottom(b))
    return F.when(point_in(x, y, b), inside).otherwise(F.sqrt(dx * dx + dy * dy))


def points_to_bbox(points: Column) -> Column:
    """ARRAY<STRUCT<x,y>> to the enclosing box, truncated to whole pixels."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return from_corners(
        F.array_min(xs).cast("int"),
        F.array_min(ys).cast("int"),
        F.array_max(xs).cast("int"),
        F.array_max(ys).cast("int"),
    )


def points_to_pixels(value: Column, dpi: int) -> Column:
    return (value * F.lit(dpi / 72.0)).cast("int")


def valid(b: Column, width: int, height: int) -> Column:
    return (
        (b["width"] > 0)
        & (b["height"] > 0)
        & (left(b) >= 0)
        & (top(b) >= 0)
        & (right(b) <= width)
        & (bottom(b) <= height)
    )


def in_bounds(x: Column, y: Column, width: int, height: int) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def segment_hits(x1: Column, y1: Column, x2: Column, y2: Column, b: Column) -> Column:
    """Exact slab clipping of a segment against a box, edges included."""

    def slab(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
        step = end - start
        flat_hit = start.between(low, high)
        a, c = F.try_divide(low - start, step), F.try_divide(high - start, step)
        enter = F.when(step == 0, F.when(flat_hit, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(a, c))
        leave = F.when(step == 0, F.when(flat_hit, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(a, c))
        return enter, leave

    enter_x, leave_x = slab(x1, x2, left(b), right(b))
    enter_y, leave_y = slab(y1, y2, top(b), bottom(b))
    return F.greatest(enter_x, enter_y, F.lit(0.0)) <= F.least(leave_x, leave_y, F.lit(1.0))
