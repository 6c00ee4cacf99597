"""Reprojection, polygon covers and the distance transform against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import distance as D
from fluxloom.operators import grids as Z
from fluxloom.operators import polygons as L
from fluxloom.operators import spatial as G

R = 6371007.181


def there(x, y, source, target):
    if source == target:
        return x, y
    if target == "sinusoidal":
        return R * math.radians(x) * math.cos(math.radians(y)), R * math.radians(y)
    lat = math.degrees(y / R)
    return math.degrees(x / (R * math.cos(math.radians(lat)))), lat


@pytest.mark.parametrize("target", [Z.Grid("lonlat", -7.03, 4.07, 0.131, 0.117, 110, 70), Z.Grid("sinusoidal", -811_003.0, 455_117.0, 14_011.0, 13_007.0, 120, 65)])
def test_each_target_pixel_takes_the_pixel_its_centre_lies_in(spark, target):
    grids = {"south": Z.Grid("sinusoidal", -502_013.0, 300_019.0, 21_013.0, 20_011.0, 40, 30), "east": Z.Grid("lonlat", 1.013, 2.017, 0.171, 0.193, 20, 15), "away": Z.Grid("lonlat", 60.0, 20.0, 1.0, 1.0, 3, 3), "polar": Z.sinusoidal_tile(18, 0, 10)}
    found = {tuple(r) for r in Z.inverse_map(Z.as_tiles(spark, grids), target, block=16).collect()}
    want = set()
    for row in range(target.ny):
        for column in range(target.nx):
            x, y = target.x0 + (column + 0.5) * target.dx, target.y0 - (row + 0.5) * target.dy
            for name, g in grids.items():
                px, py = there(x, y, target.crs, g.crs)
                sx, sy = math.floor((px - g.x0) / g.dx), math.floor((g.y0 - py) / g.dy)
                if 0 <= sx < g.nx and 0 <= sy < g.ny:
                    want.add((name, sx, sy, column, row))
    assert found == want and {w[0] for w in want} == {"south", "east"}


def test_union_grows_the_grid_and_the_first_tile_wins(spark):
    own = Z.Grid("lonlat", 0.0, 2.0, 1.0, 1.0, 2, 2)
    tiles = {"b": Z.Grid("lonlat", -1.0, 3.0, 1.0, 1.0, 2, 2), "a": Z.Grid("lonlat", 0.0, 3.0, 1.0, 1.0, 1, 2)}
    new = spark.createDataFrame([("b", 0, 0, 1.0), ("b", 1, 1, 2.0), ("b", 0, 1, None), ("a", 0, 1, 3.0), ("a", 0, 0, 4.0)], "tile string, sx long, sy long, v double")
    mine = spark.createDataFrame([(0, 0, 7.0), (1, 1, 8.0)], "col long, row long, v double")
    out, wide = Z.add_tiles_reprojected(mine, own, new, Z.as_tiles(spark, tiles), ["v"])
    assert (wide.x0, wide.y0, wide.nx, wide.ny) == (-1.0, 3.0, 3, 3)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 1.0), (0, 1, None), (1, 0, 4.0), (1, 1, 2.0), (2, 2, 8.0)]
    assert Z.add_tiles_reprojected(mine, own, new.limit(0), Z.as_tiles(spark, {}), ["v"])[0].count() == 2


def touches(rings, i, j):
    """Whether the square [i, i + 1] x [j, j + 1] touches a polygon: corners of its rings."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            t0, t1 = 0.0, 1.0
            for p, d, lo in ((x1, x2 - x1, i), (y1, y2 - y1, j)):
                if d == 0:
                    if not lo <= p <= lo + 1:
                        t0, t1 = 1.0, 0.0
                else:
                    a, b = sorted(((lo - p) / d, (lo + 1 - p) / d))
                    t0, t1 = max(t0, a), min(t1, b)
            if t0 <= t1:
                return True
            c = j + 0.5
            odd ^= (y1 <= c) != (y2 <= c) and x1 + (c - y1) * (x2 - x1) / (y2 - y1) < i + 0.5
    return odd


@pytest.mark.parametrize("sizes", [(1,), (8, 2, 1), (64, 16, 4, 1)])
def test_covers_hold_all_pixels_that_a_polygon_touches(spark, sizes):
    random.seed(7)
    shapes = {
        "star": [[(40 + r * math.cos(a), 30 + r * math.sin(a)) for a, r in ((k * math.pi / 9 + 0.01, random.uniform(4, 28)) for k in range(18))]],
        "ring": [[(3.3, 3.4), (50.7, 5.1), (44.2, 52.3)], [(20.1, 14.2), (36.3, 15.7), (35.8, 30.9)]],
        "thin": [[(0.3, 60.2), (70.8, 1.7), (70.8, 1.71)]],
        "crossed": [[(60.1, 40.2), (80.3, 58.7), (80.9, 41.1), (60.7, 59.9)]],
        "dot": [[(-5.4, -6.6), (-5.3, -6.6), (-5.3, -6.5)]],
        "level": [[(-30.5, 10.5), (-20.5, 10.5), (-20.5, 12.5), (-30.5, 12.5)]],
    }
    rows = [(n, k, s, *p) for n, rings in shapes.items() for k, ring in enumerate(rings) for s, p in enumerate(ring)]
    found = L.cover(spark.createDataFrame(rows, "poly string, ring int, seq int, px double, py double"), sizes).collect()
    pixels = [(r.poly, r.cx * r["size"] + a, r.cy * r["size"] + b) for r in found for a in range(r["size"]) for b in range(r["size"])]
    assert len(pixels) == len(set(pixels))  # disjoint
    want = {(n, i, j) for n, rings in shapes.items() for i in range(-40, 95) for j in range(-10, 70) if touches(rings, i, j)}
    assert set(pixels) == want
    assert sizes == (1,) or len(found) < len(pixels)


def test_pixels_meet_each_polygon_once(spark):
    pixels = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), F.lit(1).alias("poly2")).unionAll(spark.createDataFrame([(3, 3, 2)], "x long, y long, poly2 int"))
    corners = [(n, 0, k, x, y) for n, s in (("a", 0.0), ("b", 1.0)) for k, (x, y) in enumerate([(2.6 + s, 2.6), (9.4, 2.6), (9.4, 9.4), (2.6 + s, 9.4)])]
    found = L.crop_polygons(pixels, spark.createDataFrame(corners, "poly string, ring int, seq int, px double, py double"))
    assert found.columns == ["poly", "x", "y", "poly2"]
    counts = {r.poly: r["count"] for r in found.groupBy("poly").count().collect()}
    assert counts == {"a": 50, "b": 42}


def test_nearest_targets_equal_a_search_of_all(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS", 7)
    random.seed(8)
    targets = [(random.randrange(60), random.randrange(40), k) for k in range(150)] + [(500, 500, -1)]
    targets = list({(x, y): (x, y, v) for x, y, v in targets}.values())
    points = [(k, float(random.randrange(-5, 65)), float(random.randrange(-5, 45))) for k in range(300)] + [(1000 + k, random.uniform(0, 60), random.uniform(0, 40)) for k in range(50)] + [(2000, None, 1.0), (2001, 400.0, 399.0)]
    found = D.nearest_targets(spark.createDataFrame(points, "id long, px double, py double").repartition(3), spark.createDataFrame(targets, "tx long, ty long, v long").repartition(3), ["id"])
    want = []
    for i, px, py in points:
        if px is not None:
            *_, x, y, v = min(((px - x) ** 2 + (py - y) ** 2, x, y, v) for x, y, v in targets)
            want.append((i, x, y, v))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert D.nearest_targets(spark.createDataFrame(points, "id long, px double, py double"), spark.createDataFrame([], "tx long, ty long"), ["id"]).count() == 0
    assert D.nearest_targets(spark.createDataFrame([], "id long, px double, py double"), spark.createDataFrame(targets, "tx long, ty long, v long"), ["id"]).count() == 0


def test_class_of_the_nearest_pixel_far_away(spark):
    grid = spark.range(300 * 300).select((F.col("id") % 300).alias("x"), F.floor(F.col("id") / 300).alias("y")).withColumn("code", F.when((F.col("x") > 280) & (F.col("y") > 280), 1 + F.col("x") % 3).when(F.col("x") < 3, 9).otherwise(5))
    found = G.nearest_of_class(grid, 9, [1, 2, 3]).where("x < 3")
    assert found.select("code").distinct().collect()[0].code == 1 + 281 % 3 and found.where("code = 9").count() == 0


def test_envelope_prefers_the_left_at_ties():
    xs, heights = np.array([0.0, 1.0, 2.0, 4.0]), np.array([1.0, 3.0, 1.0, 1.0])
    kept, ends = D.envelope(xs, heights)
    assert kept.tolist() == [0, 2, 3] and ends.tolist() == [1.0, 3.0]
