"""Box arithmetic on columns named <prefix>x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (
        F.col(f"{prefix}y1") - F.col(f"{prefix}y0")
    )


def overlap_area(a: str = "a_", b: str = "b_") -> Column:
    """Shared area; boxes that only touch at an edge share none."""
    w = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    h = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: str = "a_", b: str = "b_") -> Column:
    shared = overlap_area(a, b)
    return shared / (area(a) + area(b) - shared)
