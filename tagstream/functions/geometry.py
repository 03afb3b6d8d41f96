"""Column expressions over boxes, circles, angles and vectors. No Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1, y1, x2, y2) -> Column:
    return (F.col(x2) - F.col(x1)) * (F.col(y2) - F.col(y1))


def center(lo: str, hi: str) -> Column:
    return (F.col(lo) + F.col(hi)) / 2


def overlap(a: str, b: str) -> Column:
    """Intersection area of boxes with column prefixes a and b."""
    w = F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")
    h = F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a, b)
    union = area(*(f"{a}{c}" for c in ("x1", "y1", "x2", "y2"))) + area(*(f"{b}{c}" for c in ("x1", "y1", "x2", "y2"))) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def inside(x: Column, y: Column, box: str, pad: float = 0) -> Column:
    """Inclusive."""
    return x.between(F.col(f"{box}x1") - pad, F.col(f"{box}x2") + pad) & y.between(F.col(f"{box}y1") - pad, F.col(f"{box}y2") + pad)


def clamped(lo: str, hi: str, pad: float, most: int) -> tuple[Column, Column]:
    """A padded, truncated interval inside 0..most."""
    side = (F.col(hi) - F.col(lo)) * pad
    return F.greatest(F.lit(0), (F.col(lo) - side).cast("int")), F.least(F.lit(most), (F.col(hi) + side).cast("int"))


def hamming(a, b) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
