"""Rasters in several projections: which source pixel each target pixel takes, and unions of tiles.

A grid has square-edged cells: column and row count from its upper left corner (x0, y0), dx and dy
are positive. Projections are "lonlat" (degrees, -180 to 180) and "sinusoidal" (metres on the sphere).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, col
from ..functions.physics import RADIUS, sinusoidal, sinusoidal_inverse

TILE = ["tile", "crs", "x0", "y0", "dx", "dy", "nx", "ny"]


@dataclass(frozen=True)
class Grid:
    crs: str
    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int

    def centre(self, column, row) -> tuple[Column, Column]:
        return self.x0 + (col(column) + 0.5) * self.dx, self.y0 - (col(row) + 0.5) * self.dy

    def over(self, tiles: DataFrame) -> Grid:
        """The grid with whole columns and rows added on each side, so that it covers the tiles too."""
        box = _boxes(tiles, self).agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("r0").alias("r0"), F.max("r1").alias("r1")).first()
        if box.c0 is None:
            return self
        left, top = min(0, box.c0), min(0, box.r0)
        return Grid(self.crs, self.x0 + left * self.dx, self.y0 - top * self.dy, self.dx, self.dy, max(self.nx, box.c1 + 1) - left, max(self.ny, box.r1 + 1) - top)


def project(x, y, source: str | Column, target: str) -> tuple[Column, Column]:
    """A point in another projection; source may be a column, missing where no point is."""
    x, y, source = col(x), col(y), source if isinstance(source, Column) else F.lit(source)
    to = sinusoidal(x, y) if target == "sinusoidal" else sinusoidal_inverse(x, y)
    return tuple(F.when(source == target, own).otherwise(other) for own, other in zip((x, y), to, strict=True))


def _boxes(tiles: DataFrame, target: Grid) -> DataFrame:
    """The target's columns c0..c1 and rows r0..r1 that each tile meets. In both projections one
    coordinate alone gives the latitude, and at a longitude or a distance from the middle the other
    one runs one way from the equator to a pole; so the extremes lie at corners or at the equator."""
    to_equator = F.least(F.greatest(F.lit(0.0), F.col("y0") - F.col("ny") * F.col("dy")), F.col("y0"))
    points = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x in (F.col("x0"), F.col("x0") + F.col("nx") * F.col("dx")) for y in (F.col("y0"), F.col("y0") - F.col("ny") * F.col("dy"), to_equator)]))
    found = tiles.select(*TILE, points.alias("p"))
    x, y = project("p.x", "p.y", F.col("crs"), target.crs)
    if target.crs == "lonlat":  # near a pole a corner may lie off the sphere
        x = clip(F.coalesce(x, F.sign("p.x") * 180.0), -180, 180)
    at = found.select(*TILE, x.alias("x"), y.alias("y")).withColumns({"c": (F.col("x") - target.x0) / target.dx, "r": (target.y0 - F.col("y")) / target.dy})
    return at.groupBy(*TILE).agg(F.floor(F.min("c")).alias("c0"), F.floor(F.max("c")).alias("c1"), F.floor(F.min("r")).alias("r0"), F.floor(F.max("r")).alias("r1"))


def inverse_map(tiles: DataFrame, target: Grid, block: int = 256) -> DataFrame:
    """Rows (tile, sx, sy, col, row): the source pixel in which the centre of each target pixel lies,
    for every tile that holds one. Tiles are rows of TILE. A tile's part of the target is cut in
    blocks, so one large tile is many tasks; source column and row are arithmetic."""
    boxes = _boxes(tiles, target).select(*TILE, F.greatest("c0", F.lit(0)).alias("c0"), F.least("c1", F.lit(target.nx - 1)).alias("c1"), F.greatest("r0", F.lit(0)).alias("r0"), F.least("r1", F.lit(target.ny - 1)).alias("r1"))
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block)))
    blocks = boxes.where("c0 <= c1 AND r0 <= r1").withColumn("bc", steps("c0", "c1")).withColumn("br", steps("r0", "r1")).repartition("tile", "bc", "br")
    within = lambda b, a, z: F.explode(F.sequence(F.greatest(F.col(b) * block, F.col(a)), F.least(F.col(b) * block + (block - 1), F.col(z))))
    pixels = blocks.withColumn("col", within("bc", "c0", "c1")).withColumn("row", within("br", "r0", "r1"))
    x, y = target.centre("col", "row")
    # To the tile's own projection: the one of two that the target may or may not share.
    there = project(x, y, target.crs, "sinusoidal"), project(x, y, target.crs, "lonlat")
    sx, sy = (F.when(F.col("crs") == "sinusoidal", a).otherwise(b) for a, b in zip(*there, strict=True))
    pixels = pixels.select("tile", "col", "row", F.floor((sx - F.col("x0")) / F.col("dx")).alias("sx"), F.floor((F.col("y0") - sy) / F.col("dy")).alias("sy"), "nx", "ny")
    return pixels.where("sx >= 0 AND sx < nx AND sy >= 0 AND sy < ny").select("tile", "sx", "sy", "col", "row")


def reproject(pixels: DataFrame, tiles: DataFrame, target: Grid, block: int = 256) -> DataFrame:
    """Pixels (tile, sx, sy, values) on the target grid: each target pixel (col, row) of a tile takes the
    source pixel that its centre lies in; target pixels whose source pixel has no row get none. Other
    columns, such as a day, pass through."""
    return pixels.join(inverse_map(tiles, target, block), ["tile", "sx", "sy"]).drop("sx", "sy")


def add_tiles_reprojected(own: DataFrame, grid: Grid, new: DataFrame, tiles: DataFrame, values: list[str], more: tuple[str, ...] = (), block: int = 256) -> tuple[DataFrame, Grid]:
    """Union of a raster (own: col, row on `grid`, values) with tiles in any projection (new: tile, sx,
    sy, values; tiles: TILE and a rank): rows (col, row, more, values) on the grid grown over all, and that
    grid. For each value the tile of the least rank that has it wins, then the raster itself."""
    wide = grid.over(tiles)
    left, top = round((grid.x0 - wide.x0) / grid.dx), round((wide.y0 - grid.y0) / grid.dy)
    mine = own.select((F.col("col") + left).cast("long").alias("col"), (F.col("row") + top).cast("long").alias("row"), *more, *values, F.lit(None).cast("long").alias("rank"))
    ranks = tiles.select("tile", F.col("rank").cast("long").alias("rank"))
    theirs = reproject(new.select("tile", "sx", "sy", *more, *values).join(ranks, "tile"), tiles, wide, block).drop("tile")
    both = mine.unionByName(theirs)
    # Only rows that have the value compete for it.
    first = lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), F.coalesce("rank", F.lit((1 << 62)))))
    return both.groupBy("col", "row", *more).agg(*[first(v).alias(v) for v in values]), wide


def sinusoidal_tile(h: int, v: int, cells: int) -> Grid:
    """The grid of a tile of the 36 x 18 sinusoidal tiles of the sphere."""
    width = 2 * math.pi * RADIUS / 36
    return Grid("sinusoidal", (h - 18) * width, (9 - v) * width, width / cells, width / cells, cells, cells)


def as_tiles(spark, grids: dict[str, Grid]) -> DataFrame:
    """A table of tiles from grids, ranked in their order."""
    rows = [(name, g.crs, float(g.x0), float(g.y0), float(g.dx), float(g.dy), g.nx, g.ny, k) for k, (name, g) in enumerate(grids.items())]
    return spark.createDataFrame(rows, ", ".join(["tile string", "crs string", *[f"{c} double" for c in TILE[2:6]], "nx long", "ny long", "rank long"]))
