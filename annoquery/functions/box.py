"""Box expressions on columns x0, y0, x1, y1 with a prefix; JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(p: str) -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlap(a: str, b: str) -> Column:
    """Area of the intersection, 0 if apart."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(f"{a}{k}1", f"{b}{k}1") - F.greatest(f"{a}{k}0", f"{b}{k}0"))
    return side("x") * side("y")


def iou(a: str, b: str) -> Column:
    """Intersection over union; null if both are empty."""
    common = overlap(a, b)
    return F.try_divide(common, area(a) + area(b) - common)


def coverage(inner: str, outer: str) -> Column:
    """Share of the inner box that the outer one covers."""
    return F.try_divide(overlap(inner, outer), area(inner))


def grown(p: str, ratio: float, width: float, height: float) -> list[Column]:
    """Corners of a box grown by a share of its size on each side, to whole pixels, clipped to the image."""
    w, h = F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0")
    low = lambda c, size: F.greatest(F.lit(0.0), F.floor(F.col(c) - ratio * size).cast("double"))
    high = lambda c, size, most: F.least(F.lit(float(most)), F.ceil(F.col(c) + ratio * size).cast("double"))
    return [low(f"{p}x0", w).alias("x0"), low(f"{p}y0", h).alias("y0"), high(f"{p}x1", w, width).alias("x1"), high(f"{p}y1", h, height).alias("y1")]


def letterbox(width: Column, height: Column, size: int) -> Column:
    """Struct of scale, scaled size (1 to ``size`` pixels a side) and padding that centre an image in a square."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w, h = (F.greatest(F.lit(1), F.least(F.lit(size), F.bround(side * scale).cast("int"))) for side in (width, height))
    return F.struct(F.round(scale, 9).alias("scale"), w.alias("width"), h.alias("height"), F.floor((size - w) / 2).cast("int").alias("pad_x"), F.floor((size - h) / 2).cast("int").alias("pad_y"))
