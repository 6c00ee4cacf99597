"""From satellite scenes to gap-filled daily stacks. Keys are the pixel's or site's columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, exact_mean
from ..functions.physics import days_between
from .quantiles import exact_quantiles
from .smoothing import PIXEL


def merge_same_day(scenes: DataFrame, values: list[str], keys: list[str] = PIXEL, ts: str = "scene_ts") -> DataFrame:
    """One row per key and day: mean of the day's scenes, the same in whichever order they come.
    Where one of them shows snow the day is snow and has no value. `day` counts from the first scene
    of all."""
    start = scenes.agg(F.min(F.to_date(ts)).alias("_start"))  # one row
    snow = F.coalesce(F.bool_or("is_snow"), F.lit(False)) if "is_snow" in scenes.columns else F.lit(False)
    days = scenes.groupBy(*keys, F.to_date(ts).alias("_date")).agg(snow.alias("is_snow"), *[exact_mean(v).alias(v) for v in values])
    days = days.crossJoin(F.broadcast(start)).withColumn("day", F.datediff("_date", "_start").cast("long"))
    return days.select(*keys, "day", "is_snow", *[F.when(~F.col("is_snow"), F.col(v)).alias(v) for v in values])


def mean_of_duplicates(series: DataFrame, value: str, keys: list[str], day: str = "day") -> DataFrame:
    return series.groupBy(*keys, day).agg(F.avg(value).alias(value))


def growing_season_stats(stack: DataFrame, keys: list[str] = PIXEL, share: float = 0.55) -> DataFrame:
    """Range of EVI, its growing-season threshold, and the range of LSWI above it."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("evi").over(w), F.max("evi").over(w)
    grown = stack.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("th", F.col("_lo") + share * (F.col("_hi") - F.col("_lo")))
    above = F.when(F.col("evi") > F.col("th"), F.col("lswi"))
    return grown.groupBy(*keys).agg(F.first("_lo").alias("min_evi"), F.first("_hi").alias("max_evi"), F.first("th").alias("th"), F.min(above).alias("min_lswi"), F.max(above).alias("max_lswi"))


def snow_run_length(stack: DataFrame, days: float = 21.0) -> int:
    """Steps of a snow run: days over the mean step between the stack's days."""
    step = stack.select("day").distinct().agg(((F.max("day") - F.min("day")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("step")).first()["step"]
    return max(1, int(days / step)) if step else 1


def replace_snow_runs(stack: DataFrame, value: str, n: int, keys: list[str] = PIXEL, percentile: float = 0.05) -> DataFrame:
    """Within a run of days without a value, snow days take the pixel's low percentile if the run
    has at least n of them; otherwise they are missing, as missing days stay."""
    ordered = Window.partitionBy(*keys).orderBy("day")
    island = F.count(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    marked = stack.withColumn("_island", island)
    low = exact_quantiles(stack, keys, value, {"_low": percentile})
    run = Window.partitionBy(*keys, "_island")
    snow = F.col("is_snow") & F.col(value).isNull()
    marked = marked.withColumn("_snow", F.sum(snow.cast("int")).over(run)).join(low, keys)
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(snow & (F.col("_snow") >= n), F.col("_low"))
    return marked.withColumn(value, filled).drop("_island", "_snow", "_low")


def target_days(spark, last: int, days: list[float] | str | None, own: DataFrame | None = None) -> DataFrame:
    """Days to smooth onto: "daily" for 0 .. last, a list inside the record, or the own days."""
    if days == "daily":
        return spark.range(last + 1).select(F.col("id").alias("day"))
    if days is None:
        return own.select("day").distinct()
    kept = sorted({int(round(d)) for d in days if 0 <= round(d) <= last})
    return spark.createDataFrame([(d,) for d in kept], "day long")


def smoothing_keys(stack: DataFrame, smooth_all: bool = False) -> list[str]:
    """By site where sites are set, unless all pixels are asked for."""
    return ["site"] if "site" in stack.columns and not smooth_all else PIXEL


def add_observation_day(scenes: DataFrame, ts: str, first: str = "scene_ts") -> DataFrame:
    """Days from the first scene to each pixel's own observation time, rounded."""
    start = scenes.agg(F.min(first).alias("_first"))
    return scenes.crossJoin(F.broadcast(start)).withColumn("obs_day", days_between(ts, "_first", rounded=True)).drop("_first")


def prototype_scene(scenes: DataFrame, scene: str = "scene_ts") -> DataFrame:
    """The scene with most pixels, the earliest of equals: the grid's prototype."""
    return scenes.groupBy(scene).agg(F.count("*").alias("pixels")).orderBy(F.desc("pixels"), scene).limit(1)


def add_tiles(tiles: list[DataFrame], values: list[str], keys: list[str]) -> DataFrame:
    """Union of overlapping tiles: for each value the first listed tile that has it."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("_rank", F.lit(k)) for k, t in enumerate(tiles)])
    first = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_rank"))).alias(v) for v in values]
    return ranked.groupBy(*keys).agg(*first)


def concat(parts: list[DataFrame]) -> DataFrame:
    """Classes, times or towers one below the other; absent columns are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def smear(grid: DataFrame, value: str, size: int = 3, keys: list[str] = PIXEL, kernel: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """Kernel mean over an integer grid. Missing pixels are left out of the mean, a missing
    centre stays missing, and what lies outside of the raster counts as 0. Without a kernel all pixels
    of a square count alike, and a large square costs what a small one does."""
    if kernel is None:
        return _box_mean(grid, value, size // 2, keys)
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in kernel.items()]))
    x, y = keys
    spread = grid.select(x, y, value, offsets.alias("o"))
    spread = spread.select((F.col(x) + F.col("o.i")).alias(x), (F.col(y) + F.col("o.j")).alias(y), (F.col(value) * F.col("o.w")).alias("s"), F.when(F.col(value).isNull(), F.col("o.w")).otherwise(0.0).alias("lost"))
    sums = spread.groupBy(x, y).agg(F.sum("s").alias("_s"), F.sum("lost").alias("_lost"))
    return _mean(grid.join(sums, keys, "left"), value, float(sum(kernel.values())))


def _mean(joined: DataFrame, value: str, total: float) -> DataFrame:
    return joined.withColumn(value, F.when(col(value).isNotNull(), F.try_divide("_s", F.lit(total) - F.col("_lost")))).drop("_s", "_lost")


def _box_mean(grid: DataFrame, value: str, half: int, keys: list[str]) -> DataFrame:
    """The mean of a square by sums along one axis, then the other: each is the difference of two
    running sums. The raster is filled up first, column by column, as sums at absent pixels count too."""
    x, y = keys
    rows = grid.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.coalesce(F.col(value), F.lit(0.0)).alias("_s"), F.col(value).isNull().cast("double").alias("_lost"))
    edges = F.broadcast(rows.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1")))  # one row
    lines = rows.select("_y").distinct().crossJoin(edges).select(F.explode(F.sequence("_x0", "_x1")).alias("_x"), "_y")
    dense = lines.join(rows.groupBy("_x", "_y").agg(F.sum("_s").alias("_s"), F.sum("_lost").alias("_lost")), ["_x", "_y"], "left").na.fill(0.0, ["_s", "_lost"])
    across = _moving_sums(dense, ["_y"], "_x", half)
    # Absent lines of the raster hold nothing, so distance along a column is by y, not by rows.
    gaps = across.groupBy("_x").agg(F.min("_y").alias("_y0"), F.max("_y").alias("_y1")).select("_x", F.explode(F.sequence("_y0", "_y1")).alias("_y"))
    down = _moving_sums(gaps.join(across, ["_x", "_y"], "left").na.fill(0.0, ["_s", "_lost"]), ["_x"], "_y", half)
    sums = down.select(F.col("_x").alias(x), F.col("_y").alias(y), "_s", "_lost")
    return _mean(grid.join(sums, keys, "left"), value, float((2 * half + 1) ** 2))


def _moving_sums(dense: DataFrame, keys: list[str], along: str, half: int) -> DataFrame:
    """Sums of _s and _lost over 2 half + 1 neighbours along a line without gaps."""
    line = Window.partitionBy(*keys).orderBy(along)
    so_far, whole = line.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    held = dense.select(*keys, along, *[F.sum(c).over(so_far).alias(c) for c in ("_s", "_lost")])
    moved = lambda c: F.coalesce(F.lead(c, half).over(line), F.max_by(c, along).over(whole)) - F.coalesce(F.lag(c, half + 1).over(line), F.lit(0.0))
    return held.select(*keys, along, *[moved(c).alias(c) for c in ("_s", "_lost")])
