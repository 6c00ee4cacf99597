"""Crops to polygons given as a table.

A polygon is rows (poly, ring, seq, px, py): the corners of its rings in order; a point is inside if
a ray from it crosses the rings' edges an odd number of times, so holes are rings like any other.

A pixel belongs to a polygon if its closed square touches it. The polygon is covered by disjoint
squares of a few sizes, from large to single pixels: squares that no edge touches and whose centre is
inside are kept whole; those that an edge touches are cut into squares of the next size, down
to single pixels, which are kept. So the cover grows with the outline, not with the area, an edge is
cut exactly at the rows of squares it passes, and pixels meet the cover in joins on equal squares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col

#: Sides of the squares of a cover in pixels; each divides the one before.
SIZES = (256, 16, 1)


def edges(polygons: DataFrame) -> DataFrame:
    """Rows (poly, x1, y1, x2, y2) of the corners' table; the last corner of a ring is joined to its first."""
    ring = Window.partitionBy("poly", "ring").orderBy("seq")
    first = Window.partitionBy("poly", "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.coalesce(F.lead(c).over(ring), F.first(c).over(first)).alias(n) for c, n in (("px", "x2"), ("py", "y2"))]
    return polygons.where("px IS NOT NULL AND py IS NOT NULL").select("poly", F.col("px").cast("double").alias("x1"), F.col("py").cast("double").alias("y1"), *[e.cast("double") for e in ends])


def _rows(lines: DataFrame, size: int) -> DataFrame:
    """Edges in units of `size`, once for each closed row of squares that they touch."""
    lines = lines.select("poly", *[(F.col(c) / size).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return lines.withColumn("cy", F.explode(F.sequence(F.ceil(F.least("y1", "y2")) - 1, F.floor(F.greatest("y1", "y2")))))


def _x_at(y: Column) -> Column:
    """Where an edge that isn't level passes a height, held to its own ends."""
    x = F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x))


def touched(lines: DataFrame, size: int) -> DataFrame:
    """The squares (poly, cx, cy) that an edge touches: in each row the part of the edge within it."""
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(_x_at(F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))))
    low, high = at(F.col("cy").cast("double")), at((F.col("cy") + 1).cast("double"))
    left, right = F.coalesce(F.least(low, high), F.least("x1", "x2")), F.coalesce(F.greatest(low, high), F.greatest("x1", "x2"))
    return _rows(lines, size).select("poly", F.explode(F.sequence(F.ceil(left) - 1, F.floor(right))).alias("cx"), "cy").distinct()


def inside(squares: DataFrame, lines: DataFrame, size: int) -> DataFrame:
    """Those of the squares (poly, cx, cy) whose centre is inside: the edges that cross the height of a
    row's centres, and the centres themselves, lie in one order, in which crossings are counted."""
    middle = F.col("cy") + 0.5
    crosses = (F.col("y1") <= middle) != (F.col("y2") <= middle)
    marks = _rows(lines, size).where(crosses).select("poly", "cy", _x_at(middle).alias("at"), F.lit(1).alias("edge"), F.lit(None).cast("long").alias("cx"))
    centres = squares.select("poly", "cy", (F.col("cx") + 0.5).alias("at"), F.lit(0).alias("edge"), "cx")
    before = F.sum("edge").over(Window.partitionBy("poly", "cy").orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.unionByName(centres).withColumn("before", before).where("edge = 0 AND before % 2 = 1").select("poly", "cx", "cy")


def cover(polygons: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Rows (poly, size, cx, cy): disjoint squares, counted from 0 in units of their size, that make up
    all pixels [i, i + 1) x [j, j + 1) that a polygon touches."""
    lines, parts, todo = edges(polygons), [], None
    for k, size in enumerate(sizes):
        border = touched(lines, size)
        if todo is None:  # all squares of the polygon's box
            box = lines.groupBy("poly").agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("x0", F.min, F.least, "x1", "x2"), ("xn", F.max, F.greatest, "x1", "x2"), ("y0", F.min, F.least, "y1", "y2"), ("yn", F.max, F.greatest, "y1", "y2"))])
            span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))  # noqa: B023, E731
            todo = box.withColumn("cx", span("x0", "xn")).withColumn("cy", span("y0", "yn")).select("poly", "cx", "cy")
        else:
            step = sizes[k - 1] // size
            parts_of = lambda c: F.explode(F.sequence(F.col(c) * step, F.col(c) * step + (step - 1)))  # noqa: B023, E731
            todo = todo.withColumn("x", parts_of("cx")).withColumn("y", parts_of("cy")).select("poly", F.col("x").alias("cx"), F.col("y").alias("cy"))
        free = todo.join(border, ["poly", "cx", "cy"], "left_anti")
        parts.append(inside(free, lines, size).withColumn("size", F.lit(size)))
        todo = border
    parts.append(todo.withColumn("size", F.lit(sizes[-1])))
    return reduce(DataFrame.unionByName, parts).select("poly", "size", "cx", "cy")


def crop_polygons(df: DataFrame, polygons: DataFrame, half: float = 0.5, x: str = "x", y: str = "y", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Rows of df whose pixel touches a polygon, once for each polygon, with its poly. Pixels are
    squares of half a side `half` around x, y, which lie a whole number of sides apart from 0."""
    side = 2.0 * half
    unit = polygons.withColumns({"px": F.col("px") / side + 0.5, "py": F.col("py") / side + 0.5})
    pixel = df.withColumns({"_px": F.round(col(x) / side).cast("long"), "_py": F.round(col(y) / side).cast("long")})
    # A pixel lies in one square of each size; the squares of a polygon are disjoint, so it is met once.
    squares = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.floor(F.col("_px") / s).alias("cx"), F.floor(F.col("_py") / s).alias("cy")) for s in sizes]))
    at = pixel.select("_px", "_py").distinct().withColumn("s", squares).select("_px", "_py", "s.*")
    met = at.join(cover(unit, sizes), ["size", "cx", "cy"]).select("poly", "_px", "_py")
    return pixel.join(met, ["_px", "_py"]).select("poly", *df.columns)
