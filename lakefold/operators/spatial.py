"""Boxes and polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def overlaps(box: list[tuple[str, str]], low: list[float], high: list[float]) -> Column:
    """Whether a row's box, (least, greatest) columns per dimension, meets the given one."""
    return reduce(lambda a, b: a & b, [(F.col(x) <= h) & (F.col(y) >= lo) for (x, y), lo, h in zip(box, low, high, strict=True)])


def within(box: list[tuple[str, str]], low: list[float], high: list[float]) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(x) >= lo) & (F.col(y) <= h) for (x, y), lo, h in zip(box, low, high, strict=True)])


def contains_point(box: list[tuple[str, str]], point: list[float]) -> Column:
    return overlaps(box, point, point)


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs (left_id, right_id) of overlapping boxes (id, x0, x1, y0, y1), by way of grid cells.

    A pair that meets in several cells is kept in the one that holds the lower corner of its common
    part, so nothing is compared across cells and no pair is counted twice.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        grid = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
        out = df.select("*", F.explode(grid("x0", "x1")).alias("cx")).select("*", F.explode(grid("y0", "y1")).alias("cy"))
        return out.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "x0", "x1", "y0", "y1")], "cx", "cy")

    both = cells(left, "left").join(cells(right, "right"), ["cx", "cy"])
    meet = "left_x0 <= right_x1 and left_x1 >= right_x0 and left_y0 <= right_y1 and left_y1 >= right_y0"
    here = (F.floor(F.greatest("left_x0", "right_x0") / cell) == F.col("cx")) & (F.floor(F.greatest("left_y0", "right_y0") / cell) == F.col("cy"))
    return both.where(meet).where(here).select("left_id", "right_id")


def polygon_area(points: Column) -> Column:
    """Signed area of an array of (x, y) structs, positive when counter-clockwise."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(points, i)["x"] * F.element_at(points, i % n + 1)["y"] - F.element_at(points, i % n + 1)["x"] * F.element_at(points, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2


def polygon_bbox(points: Column) -> Column:
    """Struct (x0, x1, y0, y1)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))


def polygon_contains(points: Column, px: Column, py: Column) -> Column:
    """Whether a point lies inside, by counting crossings of the ray to its right."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(points, i), F.element_at(points, i % n + 1)
        apart = (a["y"] > py) != (b["y"] > py)
        return (apart & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])).cast("int")

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), crosses), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 2 == 1


def polygon_transform(points: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + e, y' = c x + d y + f."""
    return F.transform(points, lambda p: F.struct((p["x"] * a + p["y"] * b + e).alias("x"), (p["x"] * c + p["y"] * d + f).alias("y")))


def regular_polygon(x: Column, y: Column, radius: Column, sides: int) -> Column:
    """Counter-clockwise, first corner to the right."""
    return F.array(*[F.struct((x + radius * F.cos(F.lit(k * 6.283185307179586 / sides))).alias("x"), (y + radius * F.sin(F.lit(k * 6.283185307179586 / sides))).alias("y")) for k in range(sides)])
