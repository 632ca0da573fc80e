"""Box geometry and small numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def clean(c: Column) -> Column:
    """NaN to NULL: inside the engine a missing number is NULL only."""
    return F.when(F.isnan(c), None).otherwise(c)


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def area(b: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes; negative extents count as 0, and so does an empty union."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-12))


def clip(c: Column, low: float, high: float | Column) -> Column:
    return F.greatest(F.lit(low), F.least(high if isinstance(high, Column) else F.lit(high), c))


def center(b: list[Column], width: Column, height: Column) -> tuple[Column, Column]:
    """Box centre in shares of the frame."""
    return (b[0] + b[2]) / 2 / width, (b[1] + b[3]) / 2 / height


def radial(x: Column, y: Column) -> Column:
    """Distance of a normalized point from the middle of the frame."""
    return F.sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """Normalized centre and size to normalized corners."""
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def pixel_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Normalized centre and size to corners in pixels, not clipped."""
    x1, y1, x2, y2 = corners(cx, cy, w, h)
    return [x1 * width, y1 * height, x2 * width, y2 * height]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
