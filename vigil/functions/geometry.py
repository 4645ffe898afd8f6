"""Boxes, points and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ON_EDGE = 1e-9


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Corners rounded half-even and clipped to the last pixel of the frame."""
    side = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, F.bround(v).cast("int")))
    return [side(x1, width), side(y1, height), side(x2, width), side(y2, height)]


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.12) -> list[Column]:
    """The box widened by a share of its size, inside 0..width and 0..height."""
    px, py = F.bround((x2 - x1) * pad).cast("int"), F.bround((y2 - y1) * pad).cast("int")
    return [F.greatest(F.lit(0), x1 - px), F.greatest(F.lit(0), y1 - py), F.least(width, x2 + px), F.least(height, y2 + py)]


def bottom_centre(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return F.floor((x1 + x2) / 2).cast("int"), y2


def edges(polygon: Column) -> Column:
    """array<struct<x,y>> to array<struct<x1,y1,x2,y2>>, closed."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def point_in_polygon(x: Column, y: Column, sides: Column) -> Column:
    """Whether a point lies in a polygon given by its edges; its border belongs to it."""

    def touches(e: Column) -> Column:
        turn = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return (
            (F.abs(turn) <= ON_EDGE)
            & (x >= F.least(e["x1"], e["x2"]) - ON_EDGE) & (x <= F.greatest(e["x1"], e["x2"]) + ON_EDGE)
            & (y >= F.least(e["y1"], e["y2"]) - ON_EDGE) & (y <= F.greatest(e["y1"], e["y2"]) + ON_EDGE)
        )

    def crosses(e: Column) -> Column:
        at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    return F.exists(sides, touches) | (F.size(F.filter(sides, crosses)) % 2 == 1)


def bounds(polygon: Column) -> Column:
    """The box around a polygon, widened by the tolerance of its border."""
    x, y = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct((F.array_min(x) - ON_EDGE).alias("x1"), (F.array_min(y) - ON_EDGE).alias("y1"), (F.array_max(x) + ON_EDGE).alias("x2"), (F.array_max(y) + ON_EDGE).alias("y2"))


def in_box(x: Column, y: Column, box: Column) -> Column:
    return (x >= box["x1"]) & (x <= box["x2"]) & (y >= box["y1"]) & (y <= box["y2"])


def area(sides: Column) -> Column:
    """The area a polygon's edges enclose."""
    return F.abs(F.aggregate(sides, F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2
