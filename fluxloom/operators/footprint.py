"""Flux footprints in closed form for each (site, time) and grid cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_divide, sentinel

#: Von Karman constant, and coefficients of the scaled footprint.
K = 0.4
A, B, C, D = 1.452, -1.991, 1.462, 0.136
AY, BY, CY = 2.17, 1.66, 20.0
#: Lanczos coefficients (g = 7, 9 terms) of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(z: Column) -> Column:
    """Gamma function for positive arguments."""
    x = z - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (x + k)
    t = x + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, x + 0.5) * F.exp(-t) * series


def inputs(obs: DataFrame) -> DataFrame:
    """Columns u, ustar, wd, zl, z with defaults: boundary layer of 1000 m, sigma_v = 2 u*."""
    clean = {c: sentinel(c) for c in ("u", "ustar", "wd", "zl", "z", "pblh", "sigma_v") if c in obs.columns}
    obs = obs.withColumns(clean)
    h = F.coalesce("pblh", F.lit(1000.0)) if "pblh" in obs.columns else F.lit(1000.0)
    s = F.coalesce("sigma_v", 2 * F.col("ustar")) if "sigma_v" in obs.columns else 2 * F.col("ustar")
    return obs.withColumns({"pblh": h, "sigma_v": s})


def grid(spark: SparkSession, length: float, n: int) -> DataFrame:
    """Cell centres of an n x n grid over `length` metres around the tower."""
    dx = length / n
    line = F.sequence(F.lit(0), F.lit(n - 1))
    cells = spark.range(1).select(F.explode(line).alias("i")).withColumn("j", F.explode(line))
    centre = lambda c: -(length - dx) / 2 + F.col(c) * dx
    return cells.select("i", "j", centre("i").alias("gx"), centre("j").alias("gy"))


def rotated(x, y, wd) -> tuple[Column, Column]:
    """Along and across the wind, which comes from wd degrees."""
    theta = F.radians(90 - F.col(wd))
    return F.cos(theta) * F.col(x) + F.sin(theta) * F.col(y), -F.sin(theta) * F.col(x) + F.cos(theta) * F.col(y)


def _ffp_scale() -> Column:
    return F.col("z") / (1 - F.col("z") / F.col("pblh")) * (F.col("u") / F.col("ustar") * K)


def _ffp_line(x: Column) -> tuple[Column, Column, Column]:
    """Scaled distance, cross-wind integrated footprint per metre, and lateral spread."""
    scale = _ffp_scale()
    xs = x / scale
    fy = F.when(xs > D, A * F.pow(xs - D, B) * F.exp(-C / (xs - D)) / scale)
    ps = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1e-5), F.abs("zl")), F.lit(1.0)) + F.when(F.col("zl") <= 0, 0.8).otherwise(0.55))
    sy = F.when(xs > D, AY * F.sqrt(BY * xs * xs / (1 + CY * xs)) / ps * F.col("z") * F.col("sigma_v") / F.col("ustar"))
    return xs, fy, sy


def ffp(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """Footprint of each cell for rows of inputs(); zero up the wind and too near."""
    x, y = rotated("gx", "gy", "wd")
    wide = obs.crossJoin(F.broadcast(cells)).withColumns({"_x": x, "_y": y})
    _, fy, sy = _ffp_line(F.col("_x"))
    value = fy / (math.sqrt(2 * math.pi) * sy) * F.exp(-F.col("_y") * F.col("_y") / (2 * sy * sy))
    return wide.withColumn("footprint", F.coalesce(value, F.lit(0.0))).drop("_x", "_y")


def ffp_peak() -> Column:
    return 0.87 * _ffp_scale()


def ffp_fetch(share: float) -> Column:
    return (-C / math.log(share) + D) * _ffp_scale()


def ffp_crosswind_integrated(obs: DataFrame, distances: list[float]) -> DataFrame:
    line = obs.withColumn("r", F.explode(F.array(*[F.lit(float(d)) for d in distances])))
    return line.withColumn("f", F.coalesce(_ffp_line(F.col("r"))[1], F.lit(0.0)))


def km_scalars(obs: DataFrame) -> DataFrame:
    """Profile constants of each time, before any cell is joined."""
    zl, z = F.col("zl"), F.col("z")
    stable = zl > 0
    fc = F.when(stable, 1 + 5 * zl).otherwise(F.pow(1 - 16 * zl, -0.5))
    fm = F.when(stable, 1 + 5 * zl).otherwise(F.pow(1 - 16 * zl, -0.25))
    n = F.when(stable, 1 / (1 + 5 * zl)).otherwise((1 - 24 * zl) / (1 - 16 * zl))
    obs = obs.withColumns({"_n": n, "_m": F.col("ustar") * fm / (K * F.col("u")), "_fc": fc, "_fm": fm})
    obs = obs.withColumns({"_kappa": K * F.col("ustar") * z / (F.col("_fc") * F.pow(z, F.col("_n"))), "_r": 2 + F.col("_m") - F.col("_n")})
    obs = obs.withColumns({"_mu": (1 + F.col("_m")) / F.col("_r"), "_U": F.col("ustar") * F.col("_fm") / (K * F.col("_m") * F.pow(z, F.col("_m")))})
    obs = obs.withColumn("_xi", F.col("_U") * F.pow(z, F.col("_r")) / (F.col("_r") * F.col("_r") * F.col("_kappa")))
    obs = obs.withColumn("_gmu", gamma(F.col("_mu")))
    mean = F.col("_gmu") / gamma(1 / F.col("_r")) * F.pow(F.col("_r") * F.col("_r") * F.col("_kappa") / F.col("_U"), F.col("_m") / F.col("_r")) * F.col("_U")
    return obs.withColumn("_ubar", mean).drop("_fc", "_fm")


def _km_line(x: Column) -> Column:
    return F.when(x > 0, F.pow("_xi", F.col("_mu")) / F.col("_gmu") * F.pow(x, -1 - F.col("_mu")) * F.exp(-F.col("_xi") / x))


def km(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """Analytic footprint of power-law profiles; zero up the wind."""
    x, y = rotated("gx", "gy", "wd")
    wide = km_scalars(obs).crossJoin(F.broadcast(cells)).withColumns({"_x": x, "_y": y})
    sy = F.col("_x") * F.col("sigma_v") / (F.col("_ubar") * F.pow(F.when(F.col("_x") > 0, F.col("_x")), F.col("_m") / F.col("_r")))
    value = _km_line(F.col("_x")) / (math.sqrt(2 * math.pi) * sy) * F.exp(-F.col("_y") * F.col("_y") / (2 * sy * sy))
    return wide.withColumn("footprint", F.coalesce(value, F.lit(0.0))).select(*obs.columns, "i", "j", "gx", "gy", "footprint")


def km_peak(obs: DataFrame) -> DataFrame:
    return km_scalars(obs).select(*obs.columns, (F.col("_xi") / (1 + F.col("_mu"))).alias("x_peak"))


def km_crosswind_integrated(obs: DataFrame, distances: list[float]) -> DataFrame:
    line = km_scalars(obs).withColumn("r", F.explode(F.array(*[F.lit(float(d)) for d in distances])))
    return line.select(*obs.columns, "r", F.coalesce(_km_line(F.col("r")), F.lit(0.0)).alias("f"))


def integrated(fp: DataFrame, keys: list[str], area: float) -> DataFrame:
    return fp.groupBy(*keys).agg((F.sum("footprint") * area).alias("integrated"))


def normalise(fp: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of each time's sum; missing where that is 0."""
    total = F.sum("footprint").over(Window.partitionBy(*keys))
    return fp.withColumn("footprint", safe_divide("footprint", F.nullif(total, F.lit(0.0))))


def valid(fp: DataFrame, keys: list[str], least: float = 1e-5) -> DataFrame:
    """Times whose footprint has a sum, above a least one."""
    return fp.groupBy(*keys).agg(F.sum("footprint").alias("total")).where((F.col("total") != 0) & (F.col("total") > least))


def to_grid(fp: DataFrame, weights: DataFrame, keys: list[str], src: list[str], dst: list[str]) -> DataFrame:
    """Footprint on another grid by weights computed once, as shares."""
    moved = fp.join(weights, src).groupBy(*keys, *dst).agg(F.sum(F.col("w") * F.col("footprint")).alias("footprint"))
    return normalise(moved, keys)


def weighted_flux(fp: DataFrame, fluxes: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """What a tower sees: sum of footprint * (reco - gpp)."""
    return fp.join(fluxes, on).groupBy(*keys).agg(F.sum(F.col("footprint") * (F.col("reco") - F.col("gpp"))).alias("nee"))


def over_map(fp: DataFrame, shares: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Footprint-weighted class fractions."""
    return fp.join(shares, on).groupBy(*keys, "veg_class").agg(F.sum(F.col("footprint") * F.col("frac")).alias("frac"))


def cumulative_radius(line: DataFrame, keys: list[str], share: float, dx: float) -> DataFrame:
    """The first distance at which the summed cross-wind integrated footprint reaches a share."""
    total = F.sum(F.col("f") * dx).over(Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("_sum", total).groupBy(*keys).agg(F.min(F.when(F.col("_sum") >= share, F.col("r"))).alias("radius"))


def peak_radius(line: DataFrame, keys: list[str]) -> DataFrame:
    return line.groupBy(*keys).agg(F.max_by("r", F.struct(F.col("f"), -F.col("r"))).alias("peak"))


def contour_level(fp: DataFrame, keys: list[str], share: float, area: float) -> DataFrame:
    """Footprint value whose superlevel set holds a share of the whole."""
    w = Window.partitionBy(*keys).orderBy(F.desc("footprint"), "i", "j").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("footprint").over(Window.partitionBy(*keys))
    reached = F.sum("footprint").over(w) >= share * whole
    return fp.withColumn("_in", reached).groupBy(*keys).agg(F.max(F.when(F.col("_in"), F.col("footprint"))).alias("level"))


def crop_to_mass(fp: DataFrame, keys: list[str], least_share: float = 1e-6) -> DataFrame:
    """Cells in the bounding box of those that hold more than a share of the summed footprint."""
    cells = fp.groupBy(*keys, "i", "j").agg(F.sum("footprint").alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy(*keys))
    box = cells.withColumn("share", share).where(F.col("share") > least_share).groupBy(*keys).agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    return fp.join(box, keys).where("i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1").drop("i0", "i1", "j0", "j1")
