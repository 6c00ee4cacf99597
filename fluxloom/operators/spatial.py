"""Crops, nearest and interpolated lookups in space and time, and regridding by weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, safe_divide
from .distance import nearest_targets
from .polygons import crop_polygons

EARTH = 6_371_000.0


def bounds(df: DataFrame, x: str = "x", y: str = "y", prefix: str = "") -> DataFrame:
    """One row: the bounding box."""
    return df.agg(*[f(c).alias(f"{prefix}{n}{c}") for c in (x, y) for f, n in ((F.min, "min_"), (F.max, "max_"))])


def crop_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def clip_to(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows within the bounding box of another table."""
    box = bounds(other, prefix="_")
    inside = F.col("x").between(F.col("_min_x"), F.col("_max_x")) & F.col("y").between(F.col("_min_y"), F.col("_max_y"))
    return df.join(F.broadcast(box), inside).select(*df.columns)


def is_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether the bounding boxes don't overlap."""
    p, q = bounds(a, prefix="a_"), bounds(b, prefix="b_")
    apart = [F.col(f"a_min_{c}") > F.col(f"b_max_{c}") for c in "xy"] + [F.col(f"b_min_{c}") > F.col(f"a_max_{c}") for c in "xy"]
    return p.crossJoin(q).select((apart[0] | apart[1] | apart[2] | apart[3]).alias("disjoint"))


def crop_circle_box(df: DataFrame, lon: float, lat: float, radius_km: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """The bounding box of a circle on the sphere."""
    d = radius_km * 1000 / EARTH
    dlat, dlon = math.degrees(d), math.degrees(math.asin(min(1.0, math.sin(d) / math.cos(math.radians(lat)))))
    return crop_box(df, lon - dlon, lat - dlat, lon + dlon, lat + dlat, x, y)


def crop_polygon(df: DataFrame, polygon: list[tuple[float, float]], half: float = 0.5, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels that touch one polygon, given as its corners."""
    corners = [(0, 0, k, float(px), float(py)) for k, (px, py) in enumerate(polygon)]
    table = df.sparkSession.createDataFrame(corners, "poly int, ring int, seq int, px double, py double")
    return crop_polygons(df, table, half, x, y).drop("poly")


def crop_pixels(grid: DataFrame, at_x: float, at_y: float, n: int, x: str = "x", y: str = "y") -> DataFrame:
    """n // 2 pixels on each side of the pixel nearest to a point, on an integer grid."""
    near = grid.orderBy((F.col(x) - at_x) ** 2 + (F.col(y) - at_y) ** 2, x, y).limit(1).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    inside = (F.abs(F.col(x) - F.col("_x")) <= n // 2) & (F.abs(F.col(y) - F.col("_y")) <= n // 2)
    return grid.join(F.broadcast(near), inside).select(*grid.columns)


def central_mean(grid: DataFrame, value: str, n: int, size: int, x: str = "x", y: str = "y") -> DataFrame:
    """Mean of the n x n pixels around the centre of a size x size grid; n is odd."""
    if n % 2 == 0:
        raise ValueError("n must be odd")
    c = size // 2
    return crop_box(grid, c - n // 2, c - n // 2, c + n // 2, c + n // 2, x, y).agg(F.avg(value).alias(value))


def nearest_in_time(rows: DataFrame, scenes: DataFrame, keys: list[str], at: str = "day", last: str | None = None, buckets: int = 0) -> DataFrame:
    """As-of nearest join: the scene of the same keys with the least distance in time, the
    earlier of equals. Rows before 0 or after the last of all scenes are dropped.

    Both sides are laid on one time line, so the join is a window over each series. Where one series
    may hold a large part of all rows, `buckets` cuts the time from the first to the last scene in
    as many parts, each a window of its own: the last scene before a part and the first one after it
    are carried in from the other parts, over empty ones."""
    values = [c for c in scenes.columns if c not in (*keys, at)]
    scene = scenes.select(*keys, F.col(at).cast("double").alias("_t"), F.struct(F.col(at), *values).alias("_scene"), F.lit(None).alias("_row"))
    own = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    row = rows.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(None).alias("_scene"), own.alias("_row"))
    ends = F.broadcast(scenes.agg(F.min(F.col(at).cast("double")).alias("_first"), F.max(F.col(at).cast("double")).alias("_last")))  # one row
    line, group = scene.unionByName(row), keys
    if buckets:
        width = F.greatest((F.col("_last") - F.col("_first")) / buckets, F.lit(1e-9))
        place = F.greatest(F.lit(0), F.least(F.floor((F.col("_t") - F.col("_first")) / width), F.lit(buckets - 1)))
        line, group = line.crossJoin(ends).withColumn("_bucket", place).drop("_first", "_last"), [*keys, "_bucket"]
        line = line.unionByName(_carried(line.where("_row IS NULL"), keys, buckets).select(*line.columns))
    w = Window.partitionBy(*group).orderBy("_t", F.col("_row").isNotNull())
    line = line.withColumn("_before", F.last("_scene", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The way back has an order of its own: a frame up to the end would be read anew for each row.
    back = Window.partitionBy(*group).orderBy(F.desc("_t"), F.col("_row").isNotNull().desc())
    line = line.withColumn("_after", F.last("_scene", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.where("_row IS NOT NULL")
    early = F.col("_before").isNotNull() & (F.col("_after").isNull() | (F.col("_t") - F.col(f"_before.{at}") <= F.col(f"_after.{at}") - F.col("_t")))
    line = line.withColumn("_near", F.when(early, F.col("_before")).otherwise(F.col("_after"))).where("_near IS NOT NULL")
    line = line.crossJoin(ends).where(F.col("_t").between(0, F.col("_last")))
    mine = [F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in keys]
    return line.select(*keys, *mine, F.col(f"_near.{at}").alias(last or f"scene_{at}"), *[F.col(f"_near.{v}").alias(v) for v in values])


def _carried(scenes: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """For each of the buckets of each series the nearest scene in the buckets before it, and after it."""
    ends = scenes.groupBy(*keys, "_bucket").agg(F.min_by("_scene", "_t").alias("_early"), F.max_by("_scene", "_t").alias("_late"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    # A series has no more rows here than there are buckets.
    every = scenes.select(*keys).distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    ends = every.join(ends, [*keys, "_bucket"], "left")
    there = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    late, early = F.struct(F.col("_t1").alias("_t"), F.col("_late").alias("_scene")), F.struct(F.col("_t0").alias("_t"), F.col("_early").alias("_scene"))
    met = F.array(F.last(F.when(F.col("_late").isNotNull(), late), True).over(there), F.last(F.when(F.col("_early").isNotNull(), early), True).over(back))
    found = ends.withColumn("_met", met).select(*keys, "_bucket", F.explode("_met").alias("_c")).where("_c IS NOT NULL")
    return found.select(*keys, "_bucket", "_c._t", "_c._scene", F.lit(None).alias("_row"))


def extract_points(grid: DataFrame, sites: DataFrame, values: list[str], method: str = "nearest", x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = 1.0, more: tuple[str, ...] = ()) -> DataFrame:
    """Values of a regular grid (integer columns x, y) at sites (site, px, py): the nearest
    pixel, or bilinear of the four around. `more` are grid columns to keep apart, such as a day."""
    fx, fy = (F.col("px") - x0) / dx, (F.col("py") - y0) / dy
    if method == "nearest":
        at = sites.withColumns({"x": F.round(fx).cast("long"), "y": F.round(fy).cast("long")})
        return grid.join(at, ["x", "y"]).select("site", *more, *values)
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = sites.withColumns({"_fx": fx, "_fy": fy}).withColumn("_c", corners)
    ux, uy = F.col("_fx") - F.floor("_fx"), F.col("_fy") - F.floor("_fy")
    weight = F.when(F.col("_c.i") == 1, ux).otherwise(1 - ux) * F.when(F.col("_c.j") == 1, uy).otherwise(1 - uy)
    at = at.select("site", (F.floor("_fx") + F.col("_c.i")).alias("x"), (F.floor("_fy") + F.col("_c.j")).alias("y"), weight.alias("_w")).where("_w > 0")
    joined = grid.join(at, ["x", "y"])
    whole = F.abs(F.sum("_w") - 1) < 1e-9
    return joined.groupBy("site", *more).agg(*[F.when(whole & (F.count(v) == F.count("*")), F.sum(F.col(v) * F.col("_w"))).alias(v) for v in values])


def elevation_at(dem: DataFrame, sites: DataFrame, lon0: float, dlon: float, lat0: float, dlat: float) -> DataFrame:
    """Elevation of sites (site, px, py in degrees) from the nearest cell of a terrain grid (integer
    x, y and elevation) that begins at lon0, lat0."""
    return extract_points(dem, sites, ["elevation"], "nearest", lon0, dlon, lat0, dlat)


def nearest_valid_cell(cells: DataFrame, sites: DataFrame, values: list[str]) -> DataFrame:
    """For each site (site, px, py) the nearest cell with at least one value, the least x, y of
    equals."""
    some = cells.where(F.coalesce(*values).isNotNull())
    found = nearest_targets(sites, some.select(F.col("x").alias("tx"), F.col("y").alias("ty"), *values), ["site"])
    return found.select("site", F.col("tx").alias("x"), F.col("ty").alias("y"), *values)


def nearest_of_class(grid: DataFrame, wrong: int, wanted: list[int], cls: str = "code") -> DataFrame:
    """Replace a class by that of the nearest pixel of the wanted classes, where there is one."""
    todo = grid.where(F.col(cls) == wrong).select("x", "y", F.col("x").alias("px"), F.col("y").alias("py"))
    targets = grid.where(F.col(cls).isin(wanted)).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col(cls).alias("found"))
    found = nearest_targets(todo, targets, ["x", "y"]).select("x", "y", "found")
    return grid.join(found, ["x", "y"], "left").withColumn(cls, F.coalesce("found", cls)).drop("found")


def recode(land_cover: DataFrame, lc_map: DataFrame, code: str = "code", out: str = "veg_class") -> DataFrame:
    """Land-cover codes to classes; codes without one pass through. lc_map has one row per code."""
    return land_cover.join(F.broadcast(lc_map.select(F.col("code").alias("_code"), F.col("veg_class").alias("_class"))), F.col(code) == F.col("_code"), "left").withColumn(out, F.coalesce("_class", code)).drop("_code", "_class")


def overlaps(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Overlap of one-dimensional cells (i, lo, hi): src, dst and the length in common. Cells are
    put in bins of the largest width, so the join is on equal bins."""
    width = src.unionByName(dst).agg(F.max(F.col("hi") - F.col("lo")).alias("_w"))

    def binned(cells: DataFrame, name: str) -> DataFrame:
        cells = cells.select(F.col("i").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi")).join(F.broadcast(width))
        return cells.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{name}_lo") / F.col("_w")), F.floor(F.col(f"{name}_hi") / F.col("_w"))))).drop("_w")

    both = binned(src, "src").join(binned(dst, "dst"), "bin")
    length = F.least("src_hi", "dst_hi") - F.greatest("src_lo", "dst_lo")
    return both.where(length > 0).select("src", "dst", length.alias("length")).distinct()


def conservative_weights(src_x: DataFrame, src_y: DataFrame, dst_x: DataFrame, dst_y: DataFrame) -> DataFrame:
    """Weights of rectilinear grids from their axes (i, lo, hi): overlap area over the
    destination cell's area."""
    ox, oy = (overlaps(a, b) for a, b in ((src_x, dst_x), (src_y, dst_y)))
    ox = ox.join(dst_x.select(F.col("i").alias("dst"), (F.col("hi") - F.col("lo")).alias("size")), "dst").select(F.col("src").alias("sx"), F.col("dst").alias("dx"), (F.col("length") / F.col("size")).alias("wx"))
    oy = oy.join(dst_y.select(F.col("i").alias("dst"), (F.col("hi") - F.col("lo")).alias("size")), "dst").select(F.col("src").alias("sy"), F.col("dst").alias("dy"), (F.col("length") / F.col("size")).alias("wy"))
    # An axis has the square root of its grid's cells; every pair of overlaps is a weight.
    return ox.crossJoin(F.broadcast(oy)).select("sx", "sy", "dx", "dy", (F.col("wx") * F.col("wy")).alias("w"))


def axis(n: int, start: float, step: float, spark) -> DataFrame:
    """An axis of n equal cells: centre start + i * step, edges half a step beside it."""
    c = F.lit(start) + F.col("id") * step
    return spark.range(n).select(F.col("id").alias("i"), (c - step / 2).alias("lo"), (c + step / 2).alias("hi"))


def bilinear_weights(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """Weights (dst, sx, sy, w) of points (dst, px, py) in an nx by ny grid of unit cells; a point
    outside takes the nearest cell."""
    inside = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), F.col(c)))
    points = points.withColumns({"_x": inside("px", nx), "_y": inside("py", ny)})
    outside = (F.col("_x") != F.col("px")) | (F.col("_y") != F.col("py"))
    points = points.withColumns({"_x": F.when(outside, F.round("_x")).otherwise(F.col("_x")), "_y": F.when(outside, F.round("_y")).otherwise(F.col("_y"))})
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    points = points.withColumn("_c", corners)
    ux, uy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    w = F.when(F.col("_c.i") == 1, ux).otherwise(1 - ux) * F.when(F.col("_c.j") == 1, uy).otherwise(1 - uy)
    return points.select("dst", (F.floor("_x") + F.col("_c.i")).alias("sx"), (F.floor("_y") + F.col("_c.j")).alias("sy"), w.alias("w")).where("w > 0")


def regrid(values: DataFrame, weights: DataFrame, value: str, src: list[str], dst: list[str], more: tuple[str, ...] = (), skip_missing: bool = False) -> DataFrame:
    """Weighted sums onto the destination cells; with skip_missing over the weight of the cells
    that have a value."""
    joined = values.join(weights, src)
    if skip_missing:
        v = safe_divide(F.sum(F.col("w") * F.col(value)), F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col("w"))), F.lit(0.0)))
    else:
        v = F.when(F.count(value) == F.count("*"), F.sum(F.col("w") * F.col(value)))
    return joined.groupBy(*dst, *more).agg(v.alias(value))


def coverage(weights: DataFrame, dst: list[str], enough: float = 0.99) -> DataFrame:
    total = F.sum("w")
    return weights.groupBy(*dst).agg(total.alias("coverage"), (total > enough).alias("is_fully_covered"))


def land_cover_fractions(land_cover: DataFrame, weights: DataFrame, classes: DataFrame, src: list[str], dst: list[str], cls: str = "veg_class") -> DataFrame:
    """Share of each class in each destination cell, 0 for classes a cell has none of."""
    shares = land_cover.join(weights, src).groupBy(*dst, cls).agg(F.sum("w").alias("frac"))
    cells = weights.select(*dst).distinct().crossJoin(F.broadcast(classes.select(cls).distinct()))
    return cells.join(shares, [*dst, cls], "left").withColumn("frac", F.coalesce("frac", F.lit(0.0)))


def box_mean(cells: DataFrame, sites: DataFrame, value: str, radius_m: float) -> DataFrame:
    """Mean of cells (lon, lat) within radius_m / 111 km of sites (site, slon, slat) each way. Cells
    lie in bins as wide as the radius; a site is in all bins that its box meets."""
    w = radius_m / 111_000.0
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / w), F.floor(b / w)))
    dlon = F.lit(w) / F.greatest(F.cos(F.radians("slat")), F.lit(1e-6))
    sites = sites.select("site", "slon", "slat", F.least(dlon, F.lit(360.0)).alias("dlon"))
    sites = sites.withColumn("blat", bins(F.col("slat") - w, F.col("slat") + w)).withColumn("blon", bins(F.col("slon") - F.col("dlon"), F.col("slon") + F.col("dlon")))
    near = F.col("lat").between(F.col("slat") - w, F.col("slat") + w) & F.col("lon").between(F.col("slon") - F.col("dlon"), F.col("slon") + F.col("dlon"))
    cells = cells.withColumns({"blat": F.floor(F.col("lat") / w), "blon": F.floor(F.col("lon") / w)})
    return cells.join(sites, ["blat", "blon"]).where(near).groupBy("site").agg(F.avg(value).alias(value))


def met_select(met: DataFrame, lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, t0=None, t1=None) -> DataFrame:
    """Inclusive selection; longitudes wrap where the lower bound is not below the upper."""
    if lat:
        met = met.where(F.col("lat").between(*lat))
    if lon:
        lo, hi = lon
        met = met.where(F.col("lon").between(lo, hi) if lo < hi else (F.col("lon") >= lo) | (F.col("lon") <= hi))
    if (t0 is None) != (t1 is None):
        raise ValueError("t0 and t1 come together")
    return met if t0 is None else met.where(F.col("valid_time").between(F.lit(t0), F.lit(t1)))


def reduce_time(met: DataFrame, window: tuple, asked: tuple) -> DataFrame:
    """Asked times within the configured window; an empty overlap is an error."""
    t0, t1 = max(window[0], asked[0]), min(window[1], asked[1])
    if t0 > t1:
        raise ValueError("the asked times lie outside of the window")
    return met_select(met, t0=t0, t1=t1)


def instant_from_accumulated(met: DataFrame, value: str, cell: list[str], ts: str = "valid_time") -> DataFrame:
    """Differences of a value accumulated from each midnight on: the first of a day is kept, the
    others less the one before. The first time step of all is dropped."""
    day = F.to_date(F.timestamp_micros(F.unix_micros(ts) - 3_600_000_000))
    w = Window.partitionBy(*cell, day).orderBy(ts)
    first = met.agg(F.min(ts).alias("_first"))
    met = met.withColumn(value, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)))
    return met.join(F.broadcast(first), F.col(ts) > F.col("_first")).drop("_first")


def chunk_id(index, size, n: int) -> Column:
    """Chunk of a dense index when `size` is cut in n chunks of (size + i) // n."""
    size = size if isinstance(size, Column) else F.lit(size)
    ends = [F.lit(0)]
    for i in range(n):
        ends.append(ends[-1] + F.floor((size + i) / n))
    out = F.lit(None).cast("int")
    for i in range(n):
        out = F.when((col(index) >= ends[i]) & (col(index) < ends[i + 1]), i).otherwise(out)
    return out


def grid_chunk(grid: DataFrame, n: int, cx: int, cy: int, nx: int, ny: int, x: str = "x", y: str = "y") -> DataFrame:
    """One of n x n chunks of an nx by ny grid with edges floor(n_cells * i / n)."""
    return grid.where((F.col(x) >= nx * cx // n) & (F.col(x) < nx * (cx + 1) // n) & (F.col(y) >= ny * cy // n) & (F.col(y) < ny * (cy + 1) // n))
