"""Column expressions of planar geometry; coordinates are float32, centres and distances double."""

from __future__ import annotations

from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F


def single(c: Column) -> Column:
    """A coordinate rounded to float32, as a double."""
    return c.cast("float").cast("double")


def distance(x: Column, y: Column, cx: float, cy: float) -> Column:
    """Euclidean distance of (x, y) to (cx, cy)."""
    return F.sqrt(F.pow(single(x) - F.lit(cx), F.lit(2.0)) + F.pow(single(y) - F.lit(cy), F.lit(2.0)))


def near_box(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    """A box that holds every point within ``radius``, on the unrounded columns so that scans can skip by it."""
    slack = (max(abs(cx), abs(cy)) + radius) * 2.0**-22 + 1e-37
    if not slack < inf:
        return F.lit(True)
    reach = radius + slack
    return x.between(cx - reach, cx + reach) & y.between(cy - reach, cy + reach)


def within(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    """Whether (x, y) is within ``radius`` of the centre, its border included."""
    if not radius >= 0:
        return F.lit(False)
    return near_box(x, y, cx, cy, radius) & (distance(x, y, cx, cy) <= F.lit(radius))


def box_area(box: Column) -> Column:
    """Area of a struct of min_x, min_y, max_x, max_y."""
    return (box["max_x"] - box["min_x"]) * (box["max_y"] - box["min_y"])


def box_union(a: Column, b: Column) -> Column:
    """The least box around two."""
    return F.struct(
        F.least(a["min_x"], b["min_x"]).alias("min_x"), F.least(a["min_y"], b["min_y"]).alias("min_y"),
        F.greatest(a["max_x"], b["max_x"]).alias("max_x"), F.greatest(a["max_y"], b["max_y"]).alias("max_y"),
    )


def box_enlargement(a: Column, b: Column) -> Column:
    """How much area ``a`` gains to hold ``b``."""
    return box_area(box_union(a, b)) - box_area(a)


def box_distance(box: Column, cx: float, cy: float) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(box["min_x"] - F.lit(cx), F.lit(0.0), F.lit(cx) - box["max_x"])
    dy = F.greatest(box["min_y"] - F.lit(cy), F.lit(0.0), F.lit(cy) - box["max_y"])
    return F.sqrt(dx * dx + dy * dy)
