"""Queries over weather, towers, the flux model, footprints and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import physics as P
from ..operators import footprint as K
from ..operators import model as V
from ..operators import spatial as G
from ..operators import stack as S
from ..operators import towers as T
from ..operators import training as L
from ..sources import readers as R
from ..sources.scratch import written
from .registry import BINDINGS, bind, query
from .scenes import stack

r6, up = X.r6, X.half_up

# Scales of pixels and classes at the hours with weather, by the nearest scene.
BINDINGS["nearest"] = """
SELECT m.x, m.y, m.hour, m.ok, m.day, m.t2m - 273.15e0 AS t2m, m.ssrd / 0.505e0 / 3600 AS par, CASE WHEN a.day IS NULL OR m.day - b.day <= a.day - m.day THEN b.day ELSE a.day END AS scene_day,
       CASE WHEN a.day IS NULL OR m.day - b.day <= a.day - m.day THEN b.evi ELSE a.evi END AS evi, CASE WHEN a.day IS NULL OR m.day - b.day <= a.day - m.day THEN b.lswi ELSE a.lswi END AS lswi
FROM {met_obs} m ASOF LEFT JOIN {stack} b ON m.x = b.x AND m.y = b.y AND m.day >= b.day ASOF LEFT JOIN {stack} a ON m.x = a.x AND m.y = a.y AND m.day <= a.day
WHERE m.day >= 0 AND m.day <= (SELECT max(day) FROM {stack}) AND (a.day IS NOT NULL OR b.day IS NOT NULL)"""

BINDINGS["features"] = """
SELECT *, CASE WHEN t2m < tlow THEN tlow ELSE t2m END AS tcorr,
  CASE WHEN t2m < tmin OR s < 0 THEN 0e0 ELSE s END AS ts,
  CASE WHEN veg_class = 1 THEN 1e0 WHEN veg_class IN (5, 7) THEN (1 + lswi) / 2 WHEN evi > th THEN 1e0 ELSE (1 + lswi) / 2 END AS ps,
  CASE WHEN veg_class IN (4, 7) THEN (lswi - min_lswi) / nullif(max_lswi - min_lswi, 0) ELSE (1 + lswi) / nullif(1 + max_lswi, 0) END AS ws,
  (lswi - min_lswi) / nullif(max_lswi - min_lswi, 0) AS w2
FROM (SELECT n.*, f.veg_class, f.frac, t.min_lswi, t.max_lswi, t.th, c.tmin, c.topt, c.tmax, c.tlow, (t2m - tmin) * (t2m - tmax) / nullif((t2m - tmin) * (t2m - tmax) - (t2m - topt) * (t2m - topt), 0) AS s
      FROM {nearest} n JOIN {stats} t ON n.x = t.x AND n.y = t.y JOIN {fractions} f ON n.x = f.x AND n.y = f.y JOIN {coefficients} c ON f.veg_class = c.veg_class) q"""

BINDINGS["predicted"] = """
SELECT f.x, f.y, f.hour, f.ok, f.day, f.veg_class, frac * lamb * ps * ws * ts * evi * (par / (1 + par / par0)) AS gpp, greatest(frac * (alpha * tcorr + beta), 0e0) AS reco
FROM {features} f JOIN {params} p ON f.veg_class = p.veg_class WHERE f.veg_class NOT IN (0, 8)"""


def met(spark: SparkSession, d: str) -> DataFrame:
    m = bind(spark, d, "met_obs")
    return m.select("x", "y", "hour", "ok", "day", (F.col("t2m") - 273.15).alias("t2m"), P.par("ssrd", reanalysis=True).alias("par"))


def features(spark: SparkSession, d: str, xeric: bool = True) -> DataFrame:
    s = stack(spark, d)
    given = S.growing_season_stats(s), bind(spark, d, "coefficients"), ["x", "y"]
    return V.features_at_towers(met(spark, d), s.drop("is_snow"), *given, fractions=bind(spark, d, "fractions"), grid=True, xeric=xeric)


@query("nearest", sql="SELECT x, y, hour, ok, scene_day, round(evi, 6) AS evi, round(lswi, 6)+0e0 AS lswi FROM nearest")
def j01_nearest_scene(spark: SparkSession, d: str) -> DataFrame:
    near = G.nearest_in_time(met(spark, d), stack(spark, d).drop("is_snow"), ["x", "y"])
    return near.select("x", "y", "hour", "ok", "scene_day", r6("evi").alias("evi"), r6("lswi").alias("lswi"))


@query("met_obs", "stack", sql="""
, h AS (SELECT CASE WHEN ok % 3 > 0 THEN 7 ELSE x END AS x, CASE WHEN ok % 3 > 0 THEN 3 ELSE y END AS y, hour, ok, day FROM met_obs)
SELECT m.x, m.y, m.hour, m.ok, CASE WHEN a.day IS NULL OR m.day - b.day <= a.day - m.day THEN b.day ELSE a.day END AS scene_day,
       round(CASE WHEN a.day IS NULL OR m.day - b.day <= a.day - m.day THEN b.evi ELSE a.evi END, 6) AS evi
FROM h m ASOF LEFT JOIN stack b ON m.x = b.x AND m.y = b.y AND m.day >= b.day ASOF LEFT JOIN stack a ON m.x = a.x AND m.y = a.y AND m.day <= a.day
WHERE m.day >= 0 AND m.day <= (SELECT max(day) FROM stack) AND (a.day IS NOT NULL OR b.day IS NOT NULL)""")
def j01_nearest_scene_hot_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the weather's rows are those of one pixel, whose time is cut in parts."""
    hot = lambda c, v: F.when(F.col("ok") % 3 > 0, v).otherwise(F.col(c))
    rows = bind(spark, d, "met_obs").select(hot("x", 7).alias("x"), hot("y", 3).alias("y"), "hour", "ok", "day")
    near = G.nearest_in_time(rows, written(stack(spark, d).select("x", "y", "day", "evi")), ["x", "y"], buckets=64)
    return near.select("x", "y", "hour", "ok", "scene_day", r6("evi").alias("evi"))


@query("features", sql="""
SELECT x, y, hour, ok, veg_class::BIGINT AS veg_class, floor(tcorr * 1e6 + 0.5e0) / 1e6 AS tcorr, floor(ts * 1e6 + 0.5e0) / 1e6 AS ts, floor(ps * 1e6 + 0.5e0) / 1e6 AS ps, floor(ws * 1e6 + 0.5e0) / 1e6 AS ws, floor(w2 * 1e6 + 0.5e0) / 1e6 AS w2,
       floor((CASE WHEN t2m < 5 THEN 5e0 - 0.5e0 * (5e0 - t2m) ELSE t2m END) * 1e6 + 0.5e0) / 1e6 AS td, floor(par * 1e6 + 0.5e0) / 1e6 AS par FROM features""")
def v01_v07_j13_features(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    return f.select("x", "y", "hour", "ok", F.col("veg_class").cast("long").alias("veg_class"), up("tcorr").alias("tcorr"), up("Ts").alias("ts"), up("Ps").alias("ps"), up("Ws").alias("ws"), up("W2").alias("w2"), up(V.t_dash("t2m", F.lit(5.0), F.lit(0.5))).alias("td"), up("par").alias("par"))


@query("features", sql="""
SELECT x, y, hour, ok, veg_class::BIGINT AS veg_class, floor((CASE WHEN t2m < tmin THEN tmin ELSE t2m END) * 1e6 + 0.5e0) / 1e6 AS tcorr, floor((CASE WHEN veg_class = 1 OR evi > th THEN 1e0 ELSE (1 + lswi) / 2 END) * 1e6 + 0.5e0) / 1e6 AS ps,
       floor(((1 + lswi) / nullif(1 + max_lswi, 0)) * 1e6 + 0.5e0) / 1e6 AS ws FROM features""")
def v01_v03_without_xeric(spark: SparkSession, d: str) -> DataFrame:
    """The forms of a model that knows no xeric and no ramped classes."""
    f = features(spark, d, xeric=False)
    return f.select("x", "y", "hour", "ok", F.col("veg_class").cast("long").alias("veg_class"), up("tcorr").alias("tcorr"), up("Ps").alias("ps"), up("Ws").alias("ws"))


BINDINGS["same_day"] = """
SELECT m.x, m.y, m.hour, m.ok, m.day, m.t2m - 273.15e0 AS t2m, m.ssrd / 0.505e0 / 3600 AS par, s.evi, s.lswi FROM {met_obs} m JOIN {stack} s ON m.x = s.x AND m.y = s.y AND m.day = s.day"""
BINDINGS["grid_features"] = BINDINGS["features"].replace("{nearest}", "{same_day}")


@query("grid_features", sql="""
SELECT x, y, hour, ok, veg_class::BIGINT AS veg_class, floor(tcorr * 1e6 + 0.5e0) / 1e6 AS tcorr, floor(ts * 1e6 + 0.5e0) / 1e6 AS ts, floor(ps * 1e6 + 0.5e0) / 1e6 AS ps, floor(ws * 1e6 + 0.5e0) / 1e6 AS ws, floor(w2 * 1e6 + 0.5e0) / 1e6 AS w2 FROM grid_features""")
def v07_features_on_grid(spark: SparkSession, d: str) -> DataFrame:
    s = stack(spark, d)
    f = V.features_on_grid(met(spark, d), s.drop("is_snow"), S.growing_season_stats(s), bind(spark, d, "fractions"), bind(spark, d, "coefficients"), ["x", "y"])
    return f.select("x", "y", "hour", "ok", F.col("veg_class").cast("long").alias("veg_class"), up("tcorr").alias("tcorr"), up("Ts").alias("ts"), up("Ps").alias("ps"), up("Ws").alias("ws"), up("W2").alias("w2"))


@query("predicted", sql="SELECT x, y, hour, ok, round(coalesce(sum(gpp),0),7)+0e0 AS gpp, round(coalesce(sum(reco),0),7)+0e0 AS reco, round(coalesce(sum(reco),0) - coalesce(sum(gpp),0),7)+0e0 AS nee FROM predicted GROUP BY x, y, hour, ok")
def v08_a16_fluxes(spark: SparkSession, d: str) -> DataFrame:
    out = V.predict(features(spark, d), bind(spark, d, "params"), ["x", "y", "hour", "ok"])
    return out.select("x", "y", "hour", "ok", *[r6(c, 7).alias(c) for c in ("gpp", "reco", "nee")])


@query("predicted", sql="""
SELECT x, y, day, round(sum(nee), 7)+0e0 AS nee, count(*) AS hours FROM (SELECT x, y, day, hour, ok, coalesce(sum(reco),0) - coalesce(sum(gpp),0) AS nee FROM predicted GROUP BY ALL) GROUP BY x, y, day""")
def e01_daily_nee(spark: SparkSession, d: str) -> DataFrame:
    """Scenes to daily net exchange per pixel: masks, indices, same-day merge, nearest scene,
    scales, fluxes over classes, daily sums."""
    hourly = V.predict(features(spark, d), bind(spark, d, "params"), ["x", "y", "day", "hour", "ok"])
    return hourly.groupBy("x", "y", "day").agg(r6(F.sum("nee"), 7).alias("nee"), F.count("*").alias("hours"))


@query("features", sql="""
SELECT x, y, hour, ok, f.veg_class::BIGINT AS veg_class, round(coalesce(greatest(frac * (b + 0.1e0*d + 0.002e0*d*d + 2e0*evi + 0.5e0*w2 + 0.03e0*w2*d + 0.001e0*w2*d*d), 0e0),0),5) AS reco
FROM (SELECT *, veg_class * 0.2e0 AS b, CASE WHEN t2m < 4 THEN 4e0 - 0.3e0 * (4e0 - t2m) ELSE t2m END AS d FROM features) f WHERE f.veg_class BETWEEN 1 AND 7 AND evi IS NOT NULL AND w2 IS NOT NULL""")
def v09_modified_fluxes(spark: SparkSession, d: str) -> DataFrame:
    extra = {"beta": F.col("veg_class") * 0.2, "alpha1": F.lit(0.1), "alpha2": F.lit(0.002), "gamma": F.lit(2.0), "theta1": F.lit(0.5), "theta2": F.lit(0.03), "theta3": F.lit(0.001), "tcrit": F.lit(4.0), "tmult": F.lit(0.3)}
    params = bind(spark, d, "params").select("veg_class", "lamb", "par0").withColumns(extra)
    rows = features(spark, d).where("evi IS NOT NULL AND W2 IS NOT NULL")
    out = V.predict(rows, params, ["x", "y", "hour", "ok"], modified=True, per_class=True)
    return out.select("x", "y", "hour", "ok", F.col("veg_class").cast("long").alias("veg_class"), r6("reco", 5).alias("reco"))


# Rows with a planted flux: known parameters plus a small deterministic miss.
BINDINGS["planted"] = """
SELECT f.*, greatest(alpha * tcorr + beta, 0e0) - CASE WHEN par > 0 THEN lamb * ps * ws * ts * evi * (par / (1 + par / par0)) ELSE 0e0 END + (CAST(f.ok % 21 AS DOUBLE) - 10) / 100e0 AS nee
FROM {features} f JOIN {params} p ON f.veg_class = p.veg_class WHERE evi IS NOT NULL AND ws IS NOT NULL"""


def planted(spark: SparkSession, d: str) -> DataFrame:
    rows = features(spark, d).where("evi IS NOT NULL AND Ws IS NOT NULL").join(F.broadcast(bind(spark, d, "params")), "veg_class")
    whole = F.greatest(F.col("alpha") * F.col("tcorr") + F.col("beta"), F.lit(0.0)) - F.when(F.col("par") > 0, V.gpp(F.lit(1.0))).otherwise(0.0)
    return rows.withColumn("nee", whole + (F.col("ok") % 21 - 10) / 100).drop("lamb", "par0", "alpha", "beta")


def _respiration_sql(steps: int = 4) -> str:
    """Tables s0, s1, ...: the line through all dark rows of a class, then each time through those
    that the line before puts above zero; r: the best of them."""
    fit = "regr_slope(nee, tcorr) AS alpha, regr_intercept(nee, tcorr) AS beta"
    text = f", dark AS (SELECT veg_class AS c, tcorr, nee FROM planted WHERE par = 0 AND nee IS NOT NULL AND tcorr IS NOT NULL), s0 AS (SELECT c, {fit} FROM dark GROUP BY c)"
    for k in range(1, steps + 1):
        text += f", s{k} AS (SELECT d.c, {fit} FROM dark d JOIN s{k - 1} s ON d.c = s.c WHERE alpha * tcorr + beta > 0 GROUP BY d.c)"
    tried = " UNION ".join(f"SELECT * FROM s{k}" for k in range(steps + 1))
    return text + f""", t AS (SELECT * FROM ({tried}) WHERE alpha IS NOT NULL AND beta IS NOT NULL),
m AS (SELECT d.c, alpha, beta, avg((greatest(alpha * tcorr + beta, 0) - nee) ^ 2) AS mse FROM dark d JOIN t ON d.c = t.c GROUP BY ALL),
r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY mse, alpha, beta) = 1)
"""


@query("planted", sql=_respiration_sql() + "SELECT c::BIGINT AS veg_class, round(alpha, 5)+0e0 AS alpha, round(beta, 5)+0e0 AS beta, round(mse, 6) AS mse, round(mse, 6) AS reported FROM r")
def v10_v14_respiration(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d)
    fitted = V.fit_respiration(rows)
    dark = V.partition_nee(rows.where("par = 0"), fitted)
    fitted = fitted.join(V.fit_report(dark, "reco", "nee").withColumnRenamed("mse", "reported"), "veg_class")
    return fitted.select(F.col("veg_class").cast("long").alias("veg_class"), r6("alpha", 5).alias("alpha"), r6("beta", 5).alias("beta"), r6("mse").alias("mse"), r6("reported").alias("reported"))


LIGHT = [50.0, 100.0, 200.0, 400.0, 800.0, 1600.0]


def _light_sql(rounds: int = 2) -> str:
    """Tables b0, b1, ...: the best lamb and par0 of each class over a grid, then around the best."""
    text = ", q AS (SELECT p.veg_class AS c, par, ps * ws * ts * evi * par AS b, q.alpha * tcorr + q.beta - nee AS t FROM planted p JOIN params q ON p.veg_class = q.veg_class)"
    for k in range(rounds + 1):
        tries = f"SELECT c, unnest({LIGHT}) AS par0 FROM (SELECT DISTINCT c FROM q)" if not k else f"SELECT c, par0 * unnest({[float(2 ** (2.0 / 4 ** (k - 1) * s / 8)) for s in range(-8, 9)]}) AS par0 FROM b{k - 1}"
        text += f""", g{k} AS ({tries}), s{k} AS (SELECT q.c, g.par0, sum(b / (1 + par / g.par0) * t) AS fg, sum((b / (1 + par / g.par0)) ^ 2) AS ff, sum(t * t) AS gg, count(t) AS n FROM q JOIN g{k} g ON q.c = g.c GROUP BY 1, 2),
b{k} AS (SELECT c, par0, fg / ff AS lamb, (gg - fg * fg / ff) / n AS mse FROM s{k} QUALIFY row_number() OVER (PARTITION BY c ORDER BY (gg - fg * fg / ff) / n, par0) = 1)
"""
    return text + f"SELECT c::BIGINT AS veg_class, round(lamb, 5) AS lamb, round(par0, 4) AS par0, round(mse, 5) AS mse FROM b{rounds}"


@query("planted", "params", sql=_light_sql())
def v11_fit_nee(spark: SparkSession, d: str) -> DataFrame:
    fitted = V.fit_nee(planted(spark, d), bind(spark, d, "params"), LIGHT)
    return fitted.select(F.col("veg_class").cast("long").alias("veg_class"), r6("lamb", 5).alias("lamb"), r6("par0", 4).alias("par0"), r6("mse", 5).alias("mse"))


@query()
def v12_fit_combined(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d).select("veg_class", "par", "tcorr", "Ps", "Ws", "Ts", "evi", "nee").persist()
    dark = V.fit_respiration(rows)
    start = V.fit_nee(rows, dark, [50, 100, 200, 400, 800, 1600]).select("veg_class", "lamb", "par0").join(dark.select("veg_class", "alpha", "beta"), "veg_class")
    fitted = V.fit_combined(rows, start)
    rows.unpersist()
    return fitted.select(F.col("veg_class").cast("long").alias("veg_class"), "lamb", "par0", "alpha", "beta", "mse")


@query()
def v13_fit_modified(spark: SparkSession, d: str) -> DataFrame:
    """The respiration of dark rows, then light and respiration together over all rows."""
    rows = written(planted(spark, d).select("veg_class", "t2m", "evi", "W2", "par", "Ps", "Ws", "Ts", "nee"))
    dark = V.fit_modified_respiration(rows, [float(t) for t in range(0, 20, 2)], [k / 10 for k in range(1, 11)])
    whole = V.fit_modified_nee(rows, dark, LIGHT)
    return whole.join(dark.select("veg_class", F.col("mse").alias("dark_mse")), "veg_class")


@query("planted", sql=_respiration_sql() + """
SELECT x, y, hour, ok, veg_class::BIGINT AS veg_class, round(greatest(alpha * tcorr + beta, 0e0), 4) AS reco, round(CASE WHEN par = 0 THEN 0 ELSE greatest(alpha * tcorr + beta, 0e0) - nee END, 4)+0e0 AS gpp FROM planted JOIN r ON veg_class = c""")
def v19_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = planted(spark, d)
    out = V.partition_nee(rows, V.fit_respiration(rows))
    return out.select("x", "y", "hour", "ok", F.col("veg_class").cast("long").alias("veg_class"), r6("reco", 4).alias("reco"), r6("gpp", 4).alias("gpp"))


@query()
def v19_partition_flexible(spark: SparkSession, d: str) -> DataFrame:
    out = V.partition_nee_flexible(planted(spark, d).withColumn("weight", 1 / F.col("frac")), ["tcorr", "lswi", "evi"], weight="weight")
    return out.select("x", "y", "hour", "ok", F.col("veg_class").cast("long").alias("veg_class"), "reco", "gpp")


@query("tower_obs", sql="""
SELECT site, step, round(es - ea, 6)+0e0 AS vpd, round((es - ea) / es, 6)+0e0 AS rel, round(ln(greatest(es - ea, 0.01e0)) - ln(es), 6)+0e0 AS logged, round(least(greatest(100 * (e2 - k / 40e0) / e2, 0e0), 100e0), 6) AS rh,
       round(ssrd / 0.505e0, 6) AS par, round(ssrd / 0.505e0 / 3600, 6) AS par_era, round(ssrd / 1000, 6) AS scaled, ssrd > 0 AS is_day, CASE WHEN qc > 1 THEN qc END AS known
FROM (SELECT *, 0.61078e0 * exp(17.27e0 * t2m / (t2m + 237.3e0)) AS es, 0.61078e0 * exp(17.27e0 * (t2m - k / 20e0) / (t2m - k / 20e0 + 237.3e0)) AS ea, 0.6108e0 * exp(17.27e0 * t2m / (t2m + 237.3e0)) AS e2 FROM tower_obs)""")
def p15_p19_m25_humidity(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").withColumn("td", F.col("t2m") - F.col("k") / 20)
    cols = {"vpd": P.vpd("t2m", "td"), "rel": P.vpd_decorrelated("t2m", "td"), "logged": P.vpd_decorrelated_log("t2m", "td"), "rh": P.vpd_to_rh(F.col("k") / 4, "t2m"), "par": P.par("ssrd"), "par_era": P.par("ssrd", True), "scaled": P.met_scaling("ssrd", "ssrd")}
    known = X.sentinel(F.when(F.col("qc") > 1, F.col("qc")).otherwise(-9999), -9999)
    return t.select("site", "step", *[r6(c).alias(n) for n, c in cols.items()], L.day_mask("ssrd").alias("is_day"), known.cast("long").alias("known"))


@query("tower_obs", sql="""
, a AS (SELECT site, step, -(1000 * 98e0 / (287.05e0 * (t2m + 273.15e0))) * 1004 * (t2m + 273.15e0) * power(0.1e0 + k / 100e0, 3) / nullif(0.4e0 * 9.81e0 * (nee * 5), 0) AS l, k FROM tower_obs),
b AS (SELECT *, CASE WHEN l > -1000 AND l < 1000 THEN l END AS mo FROM a)
SELECT site, step, round(mo, 4)+0e0 AS mo, round(10e0 / nullif(mo, 0), 4)+0e0 AS zl, coalesce(10e0 / nullif(mo, 0) > -1000 AND 10e0 / nullif(mo, 0) < 1000, false) AS ok, CASE k % 3 WHEN 0 THEN 0.68e0 * 20 WHEN 1 THEN 0.3e0 * 20 ELSE 10e0 END AS disp FROM b""")
def p20_p21_m22_stability(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").withColumn("mo", P.obukhov_length(F.lit(98.0), F.col("t2m") + 273.15, 0.1 + F.col("k") / 100, F.col("nee") * 5)).withColumn("zl", P.stability(F.lit(10.0), "mo"))
    cls = F.when(F.col("k") % 3 == 0, "ENF").when(F.col("k") % 3 == 1, "SAV").otherwise("CRO")
    return t.select("site", "step", r6("mo", 4).alias("mo"), r6("zl", 4).alias("zl"), F.coalesce(P.valid_stability("zl"), F.lit(False)).alias("ok"), P.displacement_height(cls, F.lit(20.0), F.lit(10.0)).alias("disp"))


@query("tower_obs", sql="SELECT site, step, (epoch_us(t) - (site - 5) * 3600000000)::BIGINT AS utc FROM tower_obs")
def p24_local_to_utc(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").withColumn("stamp", F.date_format("t", "yyyyMMddHHmm"))
    return t.select("site", "step", F.unix_micros(P.local_to_utc("stamp", F.col("site") - 5)).alias("utc"))


PARTS = {
    "window": "t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'",
    "half_open": "t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-10'",
    "one_bound": "true",
    "qc": "qc IN (0, 1)",
    "train": "qc = 0 AND NOT (nee < 0 AND ssrd = 0)",
    "common": "qc IN (0, 1) AND (site, step) IN (SELECT (site, step) FROM tower_obs WHERE p_mm > 0)",
}


@query("tower_obs", sql=" UNION ALL ".join(f"SELECT '{k}' AS part, site, step FROM tower_obs WHERE {w}" for k, w in PARTS.items()))
def m20_m23_m24_j18_filters(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs")
    a, b = (F.to_timestamp(F.lit(x)) for x in ("2024-01-05", "2024-01-10"))
    parts = {"window": T.fluxnet_window(t, a, b, ts="t"), "half_open": T.fluxnet_window(t, a, b, half_open=True, ts="t"), "one_bound": T.fluxnet_window(t, a, None, ts="t"), "qc": T.qc_filter(t, [0, 1], "qc"), "train": T.train_rows(t)}
    parts["common"] = T.common_times(T.qc_filter(t, [0, 1], "qc"), t.where("p_mm > 0"), keys=["site", "step"])
    return S.concat([p.select(F.lit(k).alias("part"), "site", "step") for k, p in parts.items()])


@query("tower_obs", sql="""
SELECT a.site, a.step, round(a.nee, 6)+0e0 AS nee, round(b.p_mm, 6) AS p_mm FROM tower_obs b LEFT JOIN (SELECT * FROM tower_obs WHERE qc = 0) a ON a.site = b.site AND a.step = b.step WHERE a.site IS NOT NULL""")
def j07_tower_fluxes(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs")
    out = T.with_fluxes(t.where("qc = 0").select("site", "step", "nee"), t.select("site", "step", "p_mm"), ["site", "step"])
    return out.select("site", "step", r6("nee").alias("nee"), r6("p_mm").alias("p_mm"))


@query("tower_obs", sql="SELECT b.site, b.step, round(a.t2m, 6) AS t2m FROM (SELECT * FROM tower_obs WHERE p_mm > 0) b LEFT JOIN (SELECT * FROM tower_obs WHERE qc = 0) a ON a.site = b.site AND a.step = b.step")
def j08_footprint_times(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs")
    out = T.footprint_times(t.where("qc = 0").select("site", "step", "t2m"), t.where("p_mm > 0").select("site", "step"), ["site", "step"])
    return out.select("site", "step", r6("t2m").alias("t2m"))


# Three measurement heights for each site.
BINDINGS["heights"] = """
SELECT s.site, CAST((19723 + 8 * v.k + s.site % 3) * 48 AS BIGINT) AS since, 10e0 + 5 * v.k + s.site AS height FROM (SELECT DISTINCT site FROM {tower_obs}) s, (VALUES (0), (1), (2)) v(k)"""

HEIGHTS = """
, p AS (SELECT site, height, since AS since0, CASE WHEN row_number() OVER w > 1 THEN since END AS since, lead(since) OVER w AS until FROM heights WINDOW w AS (PARTITION BY site ORDER BY since)),
r AS (SELECT t.*, p.height, CASE WHEN t.k % 11 <> 0 THEN t.nee / 10 * (t.k - 20) END AS zll FROM tower_obs t LEFT JOIN p ON t.site = p.site AND (p.since IS NULL OR t.hh >= p.since) AND (p.until IS NULL OR t.hh < p.until))
"""


def _heights(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "heights").withColumn("date", F.timestamp_seconds(F.col("since") * 1800)).drop("since")


@query("heights", sql=HEIGHTS + "SELECT site, step, height FROM r")
def j09_w14_heights(spark: SparkSession, d: str) -> DataFrame:
    return T.with_height(bind(spark, d, "tower_obs"), _heights(spark, d)).select("site", "step", "height")


@query("heights", sql=HEIGHTS + "SELECT r.site, step, r.height, round(z, 6)+0e0 AS z_footprint FROM r JOIN (SELECT site, height, greatest(avg(zll), 0e0) AS z FROM r GROUP BY 1, 2) m ON r.site = m.site AND r.height = m.height")
def j10_displacement(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").withColumns({"zl": F.when(F.col("k") % 11 != 0, F.col("nee") / 10).otherwise(-9999.0), "mo_length": (F.col("k") - 20).cast("double")})
    out = T.displacement_by_period(t, _heights(spark, d))
    return out.select("site", "step", "height", r6("z_footprint").alias("z_footprint"))


BINDINGS["bif"] = """
SELECT concat('S', CAST(o_custkey % 40 AS VARCHAR(4))) AS site, CAST(o_orderkey % 6 AS BIGINT) AS grp, min(CASE o_orderkey % 4 WHEN 0 THEN 'IGBP' WHEN 1 THEN 'LOCATION_LAT' WHEN 2 THEN 'VAR_INFO_HEIGHT' ELSE 'VAR_INFO_VARNAME' END) AS variable,
       min(CASE WHEN o_orderkey % 4 = 3 THEN 'NEE_VUT_REF' ELSE CAST(o_orderkey AS VARCHAR(20)) END) AS value FROM {orders} GROUP BY 1, 2, o_orderkey % 4"""


def _bif(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "bif").withColumnsRenamed({"grp": "GROUP_ID", "variable": "VARIABLE", "value": "DATAVALUE"})


@query("bif", sql="""
SELECT site, arg_min(value, grp) FILTER (variable = 'IGBP') AS "IGBP", arg_min(value, grp) FILTER (variable = 'LOCATION_LAT') AS "LOCATION_LAT" FROM bif GROUP BY site""")
def a21_bif_pivot(spark: SparkSession, d: str) -> DataFrame:
    return T.bif_pivot(_bif(spark, d), ["IGBP", "LOCATION_LAT"])


@query("bif", sql="""
SELECT site, grp AS "GROUP_ID", max(value) FILTER (variable = 'VAR_INFO_HEIGHT') AS "VAR_INFO_HEIGHT" FROM bif WHERE (site, grp) IN (SELECT (site, grp) FROM bif WHERE value = 'NEE_VUT_REF') GROUP BY 1, 2""")
def a21_bif_group(spark: SparkSession, d: str) -> DataFrame:
    return T.bif_group(_bif(spark, d), "NEE_VUT_REF", ["VAR_INFO_HEIGHT"])


@query("tower_obs", sql="""
SELECT site, round(quantile_cont(CASE WHEN nee > 0 THEN nee END, 0.9), 6) AS fetch_50_p90, round(quantile_cont(CASE WHEN t2m > 0 THEN t2m END, 0.5), 6) AS fetch_90_p50 FROM tower_obs GROUP BY site""")
def a14_fetch(spark: SparkSession, d: str) -> DataFrame:
    out = T.fetch_percentiles(bind(spark, d, "tower_obs").select("site", F.col("nee").alias("fetch_50"), F.col("t2m").alias("fetch_90")))
    return out.select("site", r6("fetch_50_p90").alias("fetch_50_p90"), r6("fetch_90_p50").alias("fetch_90_p50"))


@query("tower_obs", sql="SELECT year(t)::BIGINT AS year, count(*) AS n FROM tower_obs GROUP BY 1")
def a20_times_per_year(spark: SparkSession, d: str) -> DataFrame:
    return T.times_per_year(bind(spark, d, "tower_obs"))


@query("tower_obs", sql="""
, r AS (SELECT site, step, site % 3 AS cls, row_number() OVER (PARTITION BY site ORDER BY md5(concat(step, '42')), step) AS rn, count(*) OVER (PARTITION BY site) AS n FROM tower_obs)
SELECT site, step, cls FROM (SELECT *, min(n) OVER (PARTITION BY cls) AS least FROM r) WHERE rn <= least""")
def o03_equalise(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").select("site", "step", (F.col("site") % 3).alias("cls"))
    return T.equalise_sites(t, "step").select("site", "step", "cls")


@query("tower_obs", sql="SELECT site, step FROM tower_obs ORDER BY md5(concat(site, step, '42')), site, step LIMIT 100")
def o04_subsample(spark: SparkSession, d: str) -> DataFrame:
    return L.random_subsample(bind(spark, d, "tower_obs").select("site", "step"), 100, "site", "step")


@query("tower_obs", sql="""
, m AS (SELECT site AS c, hh // 2 AS hour, avg(t2m) AS t, avg(nee) AS blh FROM tower_obs GROUP BY 1, 2)
SELECT site, step, round(m.t, 6) AS met_t FROM tower_obs o LEFT JOIN m ON o.site = m.c AND CAST(ceil(o.hh / 2e0 - 0.5e0) AS BIGINT) = m.hour""")
def j06_s05_met_at_towers(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs")
    m = t.groupBy("site", F.timestamp_seconds(F.floor(F.col("hh") / 2) * 3600).alias("valid_time")).agg(F.avg("t2m").alias("met_t"))
    return T.met_at_towers(t, m, ["site"]).select("site", "step", r6("met_t").alias("met_t"))


# The towers' places on the weather's grid.
BINDINGS["sites"] = "SELECT CAST(site AS BIGINT) AS site, site * 1.63e0 AS px, site * 0.71e0 AS py FROM (SELECT DISTINCT site FROM {tower_obs}) t"


@query("met_obs", "sites", sql="""
, g AS (SELECT x, y, day // 200 AS part, avg(t2m) AS v FROM met_obs GROUP BY 1, 2, 3),
n AS (SELECT s.site, g.part, g.v AS nearest FROM sites s JOIN g ON g.x = round(s.px) AND g.y = round(s.py)),
l AS (SELECT s.site, g.part, sum(g.v * (1 - abs(s.px - g.x)) * (1 - abs(s.py - g.y))) AS linear, sum((1 - abs(s.px - g.x)) * (1 - abs(s.py - g.y))) AS w FROM sites s JOIN g ON abs(s.px - g.x) < 1 AND abs(s.py - g.y) < 1 GROUP BY 1, 2)
SELECT site::BIGINT AS site, part, round(nearest, 6) AS nearest, round(CASE WHEN abs(w - 1) < 1e-9 THEN linear END, 6) AS linear FROM n JOIN l USING (site, part)""")
def j02_j03_j05_points(spark: SparkSession, d: str) -> DataFrame:
    """Means of 200 days at each site: the time axis is kept."""
    g = bind(spark, d, "met_obs").groupBy("x", "y", F.floor(F.col("day") / 200).alias("part")).agg(F.avg("t2m").alias("v"))
    near, linear = (G.extract_points(g, bind(spark, d, "sites"), ["v"], m, more=("part",)) for m in ("nearest", "linear"))
    return near.join(linear.withColumnRenamed("v", "l"), ["site", "part"]).select("site", "part", r6("v").alias("nearest"), r6("l").alias("linear"))


@query("met_obs", "sites", sql="""
, g AS (SELECT x, y, avg(CASE WHEN (x + y) % 3 = 0 THEN t2m END) AS v FROM met_obs GROUP BY 1, 2)
SELECT site::BIGINT AS site, x, y, round(v, 6) AS v FROM (SELECT s.site, g.*, row_number() OVER (PARTITION BY s.site ORDER BY (x - px) * (x - px) + (y - py) * (y - py), x, y) AS rn FROM sites s, g WHERE v IS NOT NULL) WHERE rn = 1""")
def j04_nearest_valid(spark: SparkSession, d: str) -> DataFrame:
    g = bind(spark, d, "met_obs").groupBy("x", "y").agg(F.avg(F.when((F.col("x") + F.col("y")) % 3 == 0, F.col("t2m"))).alias("v"))
    return G.nearest_valid_cell(g, bind(spark, d, "sites"), ["v"]).withColumn("v", r6("v"))


@query("land_cover", sql="""
, g AS (SELECT fx AS x, fy AS y, min(code) AS code FROM land_cover GROUP BY 1, 2),
n AS (SELECT a.x, a.y, arg_min(b.code, ((a.x-b.x)^2 + (a.y-b.y)^2) * 1e8 + b.x * 1e4 + b.y) AS new FROM g a, g b WHERE a.code = 7 AND b.code IN (1, 2, 3) GROUP BY 1, 2)
SELECT g.x, g.y, coalesce(n.new, g.code) AS code FROM g LEFT JOIN n ON g.x = n.x AND g.y = n.y""")
def j12_nearest_class(spark: SparkSession, d: str) -> DataFrame:
    g = bind(spark, d, "land_cover").groupBy(F.col("fx").alias("x"), F.col("fy").alias("y")).agg(F.min("code").alias("code"))
    return G.nearest_of_class(g, 7, [1, 2, 3])


BINDINGS["lc_class"] = "SELECT fx AS sx, fy AS sy, min(1 + (code - 1) % 9) AS veg_class, avg(height) AS height FROM {land_cover} GROUP BY 1, 2"
# Coarse cells of two and a half fine cells.
BINDINGS["weights"] = """
SELECT sx, sy, dx, dy, wx * wy AS w FROM
 (SELECT s.i AS sx, t.i AS dx, (least(s.i + 0.5e0, t.i * 2.5e0 + 2e0) - greatest(s.i - 0.5e0, t.i * 2.5e0 - 0.5e0)) / 2.5e0 AS wx FROM (SELECT DISTINCT fx AS i FROM {land_cover}) s, (SELECT DISTINCT CAST(floor(fx / 2.5e0) AS BIGINT) AS i FROM {land_cover}) t WHERE least(s.i + 0.5e0, t.i * 2.5e0 + 2e0) > greatest(s.i - 0.5e0, t.i * 2.5e0 - 0.5e0)) a,
 (SELECT s.i AS sy, t.i AS dy, (least(s.i + 0.5e0, t.i * 2.5e0 + 2e0) - greatest(s.i - 0.5e0, t.i * 2.5e0 - 0.5e0)) / 2.5e0 AS wy FROM (SELECT DISTINCT fy AS i FROM {land_cover}) s, (SELECT DISTINCT CAST(floor(fy / 2.5e0) AS BIGINT) AS i FROM {land_cover}) t WHERE least(s.i + 0.5e0, t.i * 2.5e0 + 2e0) > greatest(s.i - 0.5e0, t.i * 2.5e0 - 0.5e0)) b"""


def weights(spark: SparkSession, d: str) -> DataFrame:
    lc = bind(spark, d, "land_cover")
    fine = lambda c: lc.select(F.col(c).alias("i")).distinct().select("i", (F.col("i") - 0.5).alias("lo"), (F.col("i") + 0.5).alias("hi"))
    coarse = lambda c: lc.select(F.floor(F.col(c) / 2.5).alias("i")).distinct().select("i", (F.col("i") * 2.5 - 0.5).alias("lo"), (F.col("i") * 2.5 + 2.0).alias("hi"))
    return G.conservative_weights(fine("fx"), fine("fy"), coarse("fx"), coarse("fy"))


@query("weights", sql="SELECT sx, sy, dx, dy, round(w, 6) AS w FROM weights")
def a05_weights(spark: SparkSession, d: str) -> DataFrame:
    return weights(spark, d).withColumn("w", r6("w"))


@query("weights", sql="SELECT dx, dy, round(sum(w), 6) AS coverage, sum(w) > 0.99e0 AS is_fully_covered FROM weights GROUP BY 1, 2")
def a07_coverage(spark: SparkSession, d: str) -> DataFrame:
    return G.coverage(weights(spark, d), ["dx", "dy"]).withColumn("coverage", r6("coverage"))


@query("weights", "lc_class", sql="""
SELECT w.dx, w.dy, round(sum(w.w * h) / sum(CASE WHEN h IS NOT NULL THEN w.w END), 6) AS skipped, CASE WHEN count(h) = count(*) THEN round(sum(w.w * h), 6) END AS whole
FROM weights w JOIN (SELECT sx, sy, CASE WHEN veg_class <> 3 THEN height END AS h FROM lc_class) c ON w.sx = c.sx AND w.sy = c.sy GROUP BY 1, 2""")
def j16_regrid(spark: SparkSession, d: str) -> DataFrame:
    v = bind(spark, d, "lc_class").select("sx", "sy", F.when(F.col("veg_class") != 3, F.col("height")).alias("h"))
    w = weights(spark, d)
    a, b = (G.regrid(v, w, "h", ["sx", "sy"], ["dx", "dy"], skip_missing=m) for m in (True, False))
    return a.join(b.withColumnRenamed("h", "whole"), ["dx", "dy"]).select("dx", "dy", r6("h").alias("skipped"), r6("whole").alias("whole"))


@query("weights", "lc_class", sql="""
SELECT c.dx, c.dy, c.veg_class, round(coalesce(s, 0), 6) AS frac FROM (SELECT * FROM (SELECT DISTINCT dx, dy FROM weights), (SELECT DISTINCT veg_class FROM lc_class)) c
LEFT JOIN (SELECT dx, dy, veg_class, sum(w) AS s FROM weights w JOIN lc_class l ON w.sx = l.sx AND w.sy = l.sy GROUP BY 1, 2, 3) f ON c.dx = f.dx AND c.dy = f.dy AND c.veg_class = f.veg_class""")
def a04_fractions(spark: SparkSession, d: str) -> DataFrame:
    lc = bind(spark, d, "lc_class")
    return G.land_cover_fractions(lc, weights(spark, d), lc, ["sx", "sy"], ["dx", "dy"]).withColumn("frac", r6("frac"))


@query("met_obs", sql="""
, p AS (SELECT k AS dst, least(greatest(px, 0), 19) AS px, least(greatest(py, 0), 9) AS py, px < 0 OR px > 19 OR py < 0 OR py > 9 AS o FROM (SELECT hour AS k, (hour * 7 % 230) / 10e0 - 1.5e0 AS px, (hour * 3 % 110) / 10e0 - 0.5e0 AS py FROM (SELECT DISTINCT hour FROM met_obs))),
q AS (SELECT dst, CASE WHEN o THEN round(px) ELSE px END AS px, CASE WHEN o THEN round(py) ELSE py END AS py FROM p)
SELECT dst, CAST(floor(px) + i AS BIGINT) AS sx, CAST(floor(py) + j AS BIGINT) AS sy, round(wx * wy, 6) AS w FROM (SELECT *, CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END AS wx, CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS wy FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) WHERE wx * wy > 0""")
def a06_bilinear(spark: SparkSession, d: str) -> DataFrame:
    h = bind(spark, d, "met_obs").select(F.col("hour").alias("dst")).distinct()
    points = h.select("dst", ((F.col("dst") * 7 % 230) / 10 - 1.5).alias("px"), ((F.col("dst") * 3 % 110) / 10 - 0.5).alias("py"))
    return G.bilinear_weights(points, 20, 10).withColumn("w", r6("w"))


@query("stack", "fractions", sql="""
, v AS (SELECT s.x // 4 AS dx, s.y // 5 AS dy, veg_class::BIGINT AS veg_class, s.day + 1 AS day, avg(evi) AS evi, avg(lswi) AS lswi FROM stack s JOIN fractions f ON s.x = f.x AND s.y = f.y GROUP BY ALL),
r AS (SELECT dx, dy, veg_class, min(evi) AS evi_min, max(evi) AS evi_max, min(lswi) AS lswi_min, max(lswi) AS lswi_max FROM v GROUP BY ALL), t AS (
SELECT 'evi' AS field, dx, dy, veg_class, day, evi AS v FROM v UNION ALL SELECT 'lswi', dx, dy, veg_class, day, lswi FROM v
UNION ALL SELECT 'evi_min', dx, dy, veg_class, NULL, evi_min FROM r UNION ALL SELECT 'evi_max', dx, dy, veg_class, NULL, evi_max FROM r
UNION ALL SELECT 'lswi_min', dx, dy, veg_class, NULL, lswi_min FROM r UNION ALL SELECT 'lswi_max', dx, dy, veg_class, NULL, lswi_max FROM r
UNION ALL SELECT 'veg_fraction', x // 4, y // 5, veg_class, NULL, sum(frac * 0.05e0) FROM fractions GROUP BY ALL
UNION ALL SELECT 'legend ' || (SELECT string_agg(c::VARCHAR, ',' ORDER BY c) FROM (SELECT DISTINCT veg_class AS c FROM fractions)), NULL, NULL, NULL, NULL, NULL)
SELECT field, dx, dy, veg_class, day, round(v, 5)+0e0 AS v FROM t""")
def a08_weather_model_export(spark: SparkSession, d: str) -> DataFrame:
    """All seven fields and the legend, one below the other."""
    px = bind(spark, d, "fractions").select("x", "y").distinct()
    w = px.select("x", "y", F.floor(F.col("x") / 4).alias("dx"), F.floor(F.col("y") / 5).alias("dy"), F.lit(0.05).alias("w"))
    out = V.export_weather_model(stack(spark, d), bind(spark, d, "fractions"), w, ["x", "y"], ["dx", "dy"], ["evi", "lswi"])
    day = lambda t: F.col("day") if "day" in t.columns else F.lit(None).cast("long")
    fields = [t.select(F.lit(k).alias("field"), "dx", "dy", F.col("veg_class").cast("long").alias("veg_class"), day(t).alias("day"), r6(k, 5).alias("v")) for k, t in out.items() if k != "legend"]
    return S.concat([*fields, out["legend"].select(F.concat(F.lit("legend "), "legend").alias("field"))])


@query("land_cover", sql="""
, s AS (SELECT k AS site, 10.0005e0 + k * 0.004e0 AS slon, 50.0005e0 + k * 0.002e0 AS slat FROM (VALUES (0), (1), (2), (3)) v(k)), c AS (SELECT 10 + fx / 1000e0 AS lon, 50 + fy / 1000e0 AS lat, height FROM land_cover)
SELECT site::BIGINT AS site, round(avg(height), 6) AS height FROM s JOIN c ON abs(lat - slat) <= 500 / 111000e0 AND abs(lon - slon) <= 500 / 111000e0 / cos(radians(slat)) GROUP BY site""")
def a12_canopy_height(spark: SparkSession, d: str) -> DataFrame:
    cells = bind(spark, d, "land_cover").select((10 + F.col("fx") / 1000).alias("lon"), (50 + F.col("fy") / 1000).alias("lat"), "height")
    sites = spark.range(4).select(F.col("id").alias("site"), (10.0005 + F.col("id") * 0.004).alias("slon"), (50.0005 + F.col("id") * 0.002).alias("slat"))
    return G.box_mean(cells, sites, "height", 500).withColumn("height", r6("height"))


@query("land_cover", "tower_obs", sql="""
, s AS (SELECT site, 10.0005e0 + site * 0.0041e0 AS lon, 50.0003e0 + site * 0.0021e0 AS lat FROM tower_obs GROUP BY site), g AS (SELECT fx, fy, min(height) * 100 AS e FROM land_cover GROUP BY 1, 2)
SELECT site, round(e, 6) AS elevation FROM s JOIN g ON fx = round((lon - 10) / 0.001e0) AND fy = round((lat - 50) / 0.001e0)""")
def a13_elevation(spark: SparkSession, d: str) -> DataFrame:
    dem = bind(spark, d, "land_cover").groupBy(F.col("fx").alias("x"), F.col("fy").alias("y")).agg((F.min("height") * 100).alias("elevation"))
    sites = bind(spark, d, "tower_obs").select("site").distinct().select("site", (10.0005 + F.col("site") * 0.0041).alias("px"), (50.0003 + F.col("site") * 0.0021).alias("py"))
    return G.elevation_at(dem, sites, 10.0, 0.001, 50.0, 0.001).withColumn("elevation", r6("elevation"))


@query("met_obs", sql="""
, g AS (SELECT x, y, hour, sum(ssrd) AS v FROM met_obs GROUP BY 1, 2, 3), w AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY x, y, floor((hour - 1) / 24e0) ORDER BY hour) IS NULL THEN v ELSE v - lag(v) OVER (PARTITION BY x, y, floor((hour - 1) / 24e0) ORDER BY hour) END AS i FROM g)
SELECT x, y, hour, round(i, 4)+0e0 AS v FROM w WHERE hour > (SELECT min(hour) FROM g)""")
def w06_accumulated(spark: SparkSession, d: str) -> DataFrame:
    g = bind(spark, d, "met_obs").groupBy("x", "y", "hour").agg(F.sum("ssrd").alias("v")).withColumn("valid_time", F.timestamp_seconds((F.col("hour") + 9131 * 24) * 3600))
    return G.instant_from_accumulated(g, "v", ["x", "y"]).select("x", "y", "hour", r6("v", 4).alias("v"))


CHOSEN = {"box": "y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 9", "wrap": "x >= 15 OR x <= 4", "time": "hour BETWEEN 2000 AND 3000"}


@query("met_obs", sql=" UNION ALL ".join(f"SELECT '{k}' AS part, x, y, count(*) AS n, sum(hour)::BIGINT AS hours FROM met_obs WHERE {w} GROUP BY x, y" for k, w in CHOSEN.items()))
def m18_m19_o06_met_select(spark: SparkSession, d: str) -> DataFrame:
    m = bind(spark, d, "met_obs").select(F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("hour").alias("valid_time"))
    parts = {"box": G.met_select(m, (2, 6), (3, 9)), "wrap": G.met_select(m, None, (15, 4)), "time": G.reduce_time(m, (2000, 9000), (100, 3000))}
    return S.concat([p.groupBy(F.col("lon").alias("x"), F.col("lat").alias("y")).agg(F.count("*").alias("n"), F.sum("valid_time").alias("hours")).withColumn("part", F.lit(k)) for k, p in parts.items()])


# One row per site and half hour with what footprints need.
BINDINGS["fp_in"] = """
SELECT site, step, 1.5e0 + k % 6 AS u, (nee * 40 + 400) - 360 * floor((nee * 40 + 400) / 360) AS wd, 0.2e0 + (k % 40) / 100e0 AS ustar, (k - 50.5e0) / 50e0 AS zl, 10e0 AS z FROM {tower_obs}"""
BINDINGS["cells"] = """
SELECT i, j, -(900e0 - 60e0) / 2 + i * 60e0 AS gx, -(900e0 - 60e0) / 2 + j * 60e0 AS gy FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14)) a(i), (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14)) b(j)"""
FFP = """
, r AS (SELECT *, cos(radians(90 - wd)) * gx + sin(radians(90 - wd)) * gy AS rx, -sin(radians(90 - wd)) * gx + cos(radians(90 - wd)) * gy AS ry, z / (1 - z / 1000e0) * (u / ustar * 0.4e0) AS sc FROM fp_in, cells),
f AS (SELECT site, step, i, j, gx, gy, CASE WHEN rx / sc > 0.136e0 THEN 1.452e0 * power(rx / sc - 0.136e0, -1.991e0) * exp(-1.462e0 / (rx / sc - 0.136e0)) / sc / (sqrt(2 * pi()) * sy) * exp(-ry * ry / (2 * sy * sy)) ELSE 0e0 END AS footprint
 FROM (SELECT *, CASE WHEN rx / sc > 0.136e0 THEN 2.17e0 * sqrt(1.66e0 * power(rx / sc, 2) / (1 + 20 * rx / sc)) / least(1e0, 1e-5 / abs(zl) + CASE WHEN zl <= 0 THEN 0.8e0 ELSE 0.55e0 END) * z * (2 * ustar) / ustar END AS sy FROM r))
"""


def fp(spark: SparkSession, d: str) -> DataFrame:
    return K.ffp(K.inputs(bind(spark, d, "fp_in")), K.grid(spark, 900.0, 15))


AT = ["site", "step"]


@query("fp_in", "cells", sql=FFP + "SELECT site, step, i::BIGINT AS i, j::BIGINT AS j, round(footprint * 1e6, 4) AS f FROM f")
def f01_f04_ffp(spark: SparkSession, d: str) -> DataFrame:
    return fp(spark, d).select(*AT, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("footprint") * 1e6, 4).alias("f"))


@query("fp_in", sql="""
SELECT site, step, round(0.87e0 * sc, 6) AS x_peak, round((-1.462e0 / ln(0.7e0) + 0.136e0) * sc, 6) AS x_70, round((-1.462e0 / ln(0.9e0) + 0.136e0) * sc, 6) AS x_90 FROM (SELECT *, z / (1 - z / 1000e0) * (u / ustar * 0.4e0) AS sc FROM fp_in)""")
def f05_ffp_scalars(spark: SparkSession, d: str) -> DataFrame:
    i = K.inputs(bind(spark, d, "fp_in"))
    return i.select(*AT, r6(K.ffp_peak()).alias("x_peak"), r6(K.ffp_fetch(0.7)).alias("x_70"), r6(K.ffp_fetch(0.9)).alias("x_90"))


LINE = """
, l AS (SELECT site, step, r, CASE WHEN r / sc > 0.136e0 THEN 1.452e0 * power(r / sc - 0.136e0, -1.991e0) * exp(-1.462e0 / (r / sc - 0.136e0)) / sc ELSE 0e0 END AS f FROM (SELECT *, z / (1 - z / 1000e0) * (u / ustar * 0.4e0) AS sc FROM fp_in), (SELECT unnest([20e0, 40e0, 60e0, 80e0, 100e0, 120e0, 140e0, 160e0, 180e0, 200e0]) AS r))
"""
DISTANCES = [20.0 * k for k in range(1, 11)]


@query("fp_in", sql=LINE + "SELECT site, step, r, round(f * 1e3, 6) AS f FROM l")
def f06_ffp_line(spark: SparkSession, d: str) -> DataFrame:
    line = K.ffp_crosswind_integrated(K.inputs(bind(spark, d, "fp_in")), DISTANCES)
    return line.select(*AT, "r", r6(F.col("f") * 1e3).alias("f"))


@query("fp_in", sql=LINE + """, c AS (SELECT *, sum(f * 20) OVER (PARTITION BY site, step ORDER BY r) AS s FROM l)
SELECT site, step, min(r) FILTER (s >= 0.2e0) AS radius, arg_max(r, f * 1e9 - r * 1e-6) AS peak FROM c GROUP BY 1, 2""")
def w11_w12_radii(spark: SparkSession, d: str) -> DataFrame:
    line = K.ffp_crosswind_integrated(K.inputs(bind(spark, d, "fp_in")), DISTANCES)
    return K.cumulative_radius(line, AT, 0.2, 20.0).join(K.peak_radius(line, AT), AT)


KM = """
, a AS (SELECT *, CASE WHEN zl > 0 THEN 1 + 5 * zl ELSE power(1 - 16 * zl, -0.5e0) END AS fc, CASE WHEN zl > 0 THEN 1 + 5 * zl ELSE power(1 - 16 * zl, -0.25e0) END AS fm, CASE WHEN zl > 0 THEN 1 / (1 + 5 * zl) ELSE (1 - 24 * zl) / (1 - 16 * zl) END AS n FROM fp_in),
b AS (SELECT *, ustar * fm / (0.4e0 * u) AS m, 0.4e0 * ustar * z / (fc * power(z, n)) AS kappa FROM a), c AS (SELECT *, 2 + m - n AS rr, ustar * fm / (0.4e0 * m * power(z, m)) AS uu FROM b),
e AS (SELECT *, (1 + m) / rr AS mu, uu * power(z, rr) / (rr * rr * kappa) AS xi FROM c)
"""


@query("fp_in", sql=KM + "SELECT site, step, round(xi / (1 + mu), 4) AS x_peak FROM e")
def f08_km_peak(spark: SparkSession, d: str) -> DataFrame:
    return K.km_peak(K.inputs(bind(spark, d, "fp_in"))).select(*AT, r6("x_peak", 4).alias("x_peak"))


@query("fp_in", "cells", sql=KM + """
, g AS (SELECT *, cos(radians(90 - wd)) * gx + sin(radians(90 - wd)) * gy AS rx, -sin(radians(90 - wd)) * gx + cos(radians(90 - wd)) * gy AS ry, gamma(mu) / gamma(1 / rr) * power(rr * rr * kappa / uu, m / rr) * uu AS ubar FROM e, cells),
h AS (SELECT *, CASE WHEN rx > 0 THEN rx * 2 * ustar / (ubar * power(rx, m / rr)) END AS sy FROM g)
SELECT site, step, i::BIGINT AS i, j::BIGINT AS j, round(CASE WHEN rx > 0 THEN power(xi, mu) / gamma(mu) * power(rx, -1 - mu) * exp(-xi / rx) / (sqrt(2 * pi()) * sy) * exp(-ry * ry / (2 * sy * sy)) ELSE 0 END * 1e6, 4) AS f FROM h""")
def f07_km(spark: SparkSession, d: str) -> DataFrame:
    out = K.km(K.inputs(bind(spark, d, "fp_in")), K.grid(spark, 900.0, 15))
    return out.select(*AT, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6(F.col("footprint") * 1e6, 4).alias("f"))


@query("fp_in", "cells", sql=FFP + "SELECT site, step, round(sum(footprint) * 3600, 6) AS integrated FROM f GROUP BY 1, 2 HAVING sum(footprint) > 1e-5")
def a17_m29_integrated(spark: SparkSession, d: str) -> DataFrame:
    f = fp(spark, d)
    return K.integrated(f, AT, 3600.0).join(K.valid(f, AT), AT, "left_semi").withColumn("integrated", r6("integrated"))


@query("fp_in", "cells", sql=FFP + """
, m AS (SELECT site, step, i // 3 AS di, j // 3 AS dj, sum(footprint) AS s FROM f GROUP BY 1, 2, 3, 4)
SELECT site, step, di::BIGINT AS di, dj::BIGINT AS dj, round(s / nullif(sum(s) OVER (PARTITION BY site, step), 0), 6) AS share FROM m""")
def f09_a18_to_grid(spark: SparkSession, d: str) -> DataFrame:
    w = K.grid(spark, 900.0, 15).select("i", "j", F.floor(F.col("i") / 3).alias("di"), F.floor(F.col("j") / 3).alias("dj"), F.lit(1.0).alias("w"))
    return K.to_grid(fp(spark, d), w, AT, ["i", "j"], ["di", "dj"]).withColumnRenamed("footprint", "share").withColumn("share", r6("share"))


@query("fp_in", "cells", sql=FFP + """
SELECT site, step, round(sum(footprint * ((i + j) % 5 - i % 3)) * 1e3, 6)+0e0 AS nee, round(sum(footprint * (i % 4) / 4e0) * 1e3, 6) AS frac FROM f GROUP BY 1, 2""")
def a19_j17_weighted(spark: SparkSession, d: str) -> DataFrame:
    f = fp(spark, d).select(*AT, "i", "j", (F.col("footprint") * 1e3).alias("footprint"))
    cells = K.grid(spark, 900.0, 15).select("i", "j", ((F.col("i") + F.col("j")) % 5).alias("reco"), (F.col("i") % 3).alias("gpp"), F.lit(1).alias("veg_class"), (F.col("i") % 4 / 4).alias("frac"))
    flux = K.weighted_flux(f, cells, ["i", "j"], AT)
    return flux.join(K.over_map(f, cells, ["i", "j"], AT), AT).select(*AT, r6("nee").alias("nee"), r6("frac").alias("frac"))


@query("fp_in", "cells", sql=FFP + """
, q AS (SELECT *, sum(footprint) OVER (PARTITION BY site, step ORDER BY footprint DESC, i, j) >= 0.68e0 * sum(footprint) OVER (PARTITION BY site, step) AS inside FROM f)
SELECT site, step, round(max(footprint) FILTER (inside) * 1e6, 4) AS level FROM q GROUP BY 1, 2""")
def w13_contour(spark: SparkSession, d: str) -> DataFrame:
    return K.contour_level(fp(spark, d), AT, 0.68, 3600.0).select(*AT, r6(F.col("level") * 1e6, 4).alias("level"))


@query("fp_in", "cells", sql=FFP + """
, c AS (SELECT site, i, j, sum(footprint) AS s FROM f GROUP BY 1, 2, 3), b AS (SELECT site, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM (SELECT *, s / sum(s) OVER (PARTITION BY site) AS share FROM c) WHERE share > 0.004e0 GROUP BY 1)
SELECT f.site, count(*) AS n FROM f JOIN b ON f.site = b.site WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 GROUP BY 1""")
def m26_crop_to_mass(spark: SparkSession, d: str) -> DataFrame:
    return K.crop_to_mass(fp(spark, d), ["site"], 0.004).groupBy("site").agg(F.count("*").alias("n"))


@query("tower_obs", sql="""
, r AS (SELECT *, row_number() OVER w AS rn FROM tower_obs WINDOW w AS (PARTITION BY site ORDER BY step))
SELECT site, step, (rn - max(CASE WHEN p_mm > 0.1e0 THEN rn END) OVER (PARTITION BY site ORDER BY step)) * 0.5e0 AS hours_since_rain, round(sum(p_mm) OVER (PARTITION BY site ORDER BY step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling FROM r""")
def w07_w08_rain(spark: SparkSession, d: str) -> DataFrame:
    t = L.rolling_sum(L.hours_since_rain(bind(spark, d, "tower_obs"), ["site"], "p_mm", ts="step"), ["site"], "p_mm", 6, ts="step")
    return t.select("site", "step", "hours_since_rain", r6("rolling").alias("rolling"))


@query("tower_obs", sql="""
SELECT site, step, round(t2m + 10 * l1 + 100 * l3, 5)+0e0 AS lags FROM (SELECT *, lag(t2m, 1) OVER w AS l1, lag(t2m, 3) OVER w AS l3, row_number() OVER w AS rn FROM tower_obs WINDOW w AS (PARTITION BY site ORDER BY step)) WHERE l3 IS NOT NULL AND rn > 5""")
def w09_w10_lags(spark: SparkSession, d: str) -> DataFrame:
    t = L.lag_matrix(bind(spark, d, "tower_obs"), ["site"], ["t2m"], [1, 3], ts="step")
    t = L.skip_first(t, ["site"], 2, ts="step")
    c = F.col("t2m_lags")
    return t.select("site", "step", r6(c[0] + 10 * c[1] + 100 * c[2], 5).alias("lags"))


@query("tower_obs", sql="""
, e AS (SELECT site, nee - t2m / 10 AS miss, greatest(k / 60e0, 0.4e0) AS s, t2m FROM tower_obs)
SELECT site, round(avg(miss * miss / (2 * s * s) + 0.5e0 * ln(2 * pi() * s * s)), 5)+0e0 AS gaussian_nll, round(avg(abs(miss) / (s / sqrt(2)) + ln(2 * s / sqrt(2))), 5)+0e0 AS laplace_nll, round(avg(miss * miss), 5) AS mse, round(0.1e0 * avg(greatest(t2m * 4 - 40, 0)), 5) AS ceiling FROM e GROUP BY 1""")
def a22_a23_losses(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").withColumns({"pred": F.col("t2m") / 10, "sigma": F.col("k") / 60, "gpp": F.col("t2m") * 4})
    out = t.groupBy("site").agg(*L.losses("nee", "sigma", "pred"), L.gpp_ceiling("gpp", 0.1).alias("ceiling"))
    return out.select("site", *[r6(c, 5).alias(c) for c in out.columns[1:]])


@query("tower_obs", sql="""
SELECT round(coalesce(avg(e), 0), 6) AS penalty FROM (SELECT site, sum(t2m) FILTER (ssrd > 0) / greatest(sum(nee + 8) FILTER (ssrd > 0), 1) - 1.1e0 AS e FROM tower_obs GROUP BY 1) WHERE e > 0""")
def a24_ratio_penalty(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").select("site", F.col("t2m").alias("reco"), (F.col("nee") + 8).alias("gpp"), L.day_mask("ssrd").alias("is_day"))
    return L.ratio_penalty(t, ["site"], 1.1).withColumn("penalty", r6("penalty"))


@query("tower_obs", sql="""
, t AS (SELECT site, step, nee, t2m, step % 4 <> 0 AS train FROM tower_obs), e AS (SELECT min(nee) FILTER (train) AS n0, max(nee) FILTER (train) AS n1, min(t2m) FILTER (train) AS t0, max(t2m) FILTER (train) AS t1 FROM t),
b AS (SELECT t.*, CAST(floor((nee - n0) / ((n1 - n0) / 20)) AS INT) AS b0, CAST(floor((t2m - t0) / ((t1 - t0) / 20)) AS INT) AS b1 FROM t, e), c AS (SELECT b0, b1, count(*) AS n FROM b WHERE train GROUP BY 1, 2),
w AS (SELECT b.*, coalesce(1 / power(n, 0.5e0), 1e0) AS raw FROM b LEFT JOIN c ON b.b0 = c.b0 AND b.b1 = c.b1)
SELECT site, step, round(least(raw / (SELECT avg(raw) FROM w WHERE train), 5e0), 5) AS weight FROM w""")
def a25_sample_weights(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs").select("site", "step", "nee", "t2m", F.when(F.col("step") % 4 != 0, "train").otherwise("test").alias("role"))
    return L.sample_weights(t, "nee", "t2m").select("site", "step", r6("weight", 5).alias("weight"))


@query("tower_obs", sql="""
, t AS (SELECT site, step, CAST(ceil((t2m + 2) / 4) AS INT) AS bin FROM tower_obs WHERE t2m > -2 AND t2m <= 30), n AS (SELECT bin, count(*) AS n FROM t GROUP BY 1),
d AS (SELECT bin, n, unnest(generate_series(1, least(n * 2, (SELECT max(n) FROM n)))) AS draw FROM n),
p AS (SELECT bin, ('0x' || substr(md5(concat_ws(':', bin, draw, '42')), 1, 12))::BIGINT % n + 1 AS rn FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat(site, step, '42')), site, step) AS rn FROM t)
SELECT r.bin::BIGINT AS bin, r.site, r.step FROM p JOIN r ON p.bin = r.bin AND p.rn = r.rn""")
def a26_temperature_balance(spark: SparkSession, d: str) -> DataFrame:
    out = L.temperature_balance(bind(spark, d, "tower_obs").select("site", "step", "t2m"), "t2m", ["site", "step"])
    return out.select(F.col("bin").cast("long").alias("bin"), "site", "step")


@query("tower_obs", sql="""
, r AS (SELECT step, row_number() OVER (ORDER BY md5(concat(step, '42')), step) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT step FROM tower_obs)),
o AS (SELECT *, CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1) ELSE n % 5 + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM r),
f AS (SELECT o.*, k AS fold FROM o, (VALUES (0), (1), (2), (3), (4)) v(k)),
q AS (SELECT *, row_number() OVER (PARTITION BY fold, own <> fold ORDER BY md5(concat(step, 'val')), step) AS od, count(*) OVER (PARTITION BY fold, own <> fold) AS lf FROM f)
SELECT step, fold::BIGINT AS fold, CASE WHEN own = fold THEN 'test' WHEN od <= floor(lf * 0.15e0) THEN 'val' ELSE 'train' END AS role FROM q""")
def x01_split_random(spark: SparkSession, d: str) -> DataFrame:
    return L.split_random(bind(spark, d, "tower_obs"), ["step"], 5, 0.15).withColumn("fold", F.col("fold").cast("long"))


@query("tower_obs", sql="""
, dd AS (SELECT day, (dense_rank() OVER (ORDER BY day) - 1) // 3 AS block FROM (SELECT DISTINCT day FROM tower_obs)), b AS (SELECT block, row_number() OVER (ORDER BY md5(concat(block, '42')), block) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM dd)),
r AS (SELECT block, CASE WHEN o < tests THEN 'test' WHEN o < tests + greatest(1, floor((n - tests) * 0.15e0)) THEN 'val' ELSE 'train' END AS role FROM (SELECT *, greatest(1, floor(n * 0.2e0)) AS tests FROM b))
SELECT t.site, t.step, dd.block, 0::BIGINT AS fold, role FROM tower_obs t JOIN dd ON t.day = dd.day JOIN r ON dd.block = r.block""")
def x02_split_daywise(spark: SparkSession, d: str) -> DataFrame:
    return L.split_daywise(bind(spark, d, "tower_obs"), ["site", "step"], 1, 0.15, 3).withColumn("fold", F.col("fold").cast("long"))


@query("met_obs", sql="""
, o AS (SELECT ok, CAST(DATE '1995-01-01' + CAST(day AS INT) AS DATE) AS dt FROM met_obs), y AS (SELECT dt, dense_rank() OVER (ORDER BY year(dt) DESC) <= 2 AS test FROM (SELECT DISTINCT dt FROM o)),
r AS (SELECT dt, test, row_number() OVER (PARTITION BY test ORDER BY md5(concat(strftime(dt, '%Y-%m-%d'), '42')), dt) AS od, count(*) OVER (PARTITION BY test) AS n FROM y)
SELECT ok, CASE WHEN test THEN 'test' WHEN od <= floor(n * 0.15e0) THEN 'val' ELSE 'train' END AS role FROM o JOIN r ON o.dt = r.dt""")
def x03_split_years(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "met_obs").select("ok", F.date_add(F.lit("1995-01-01").cast("date"), F.col("day").cast("int")).alias("t"))
    return L.split_years(t, ["ok"], 2)


ICE = """
, s AS (SELECT site, step, nee, t2m, ssrd FROM tower_obs ORDER BY md5(concat(site, step, '42')), site, step LIMIT 200), g AS (SELECT quantile_cont(t2m, 0.03) AS lo, max(t2m) AS hi FROM s), p AS (SELECT k AS step_, lo + (hi - lo) * k / 9 AS t FROM g, (SELECT unnest(generate_series(0, 9)) AS k)),
c AS (SELECT p.step_, p.t, s.site, s.step, s.nee * 0.1e0 + p.t * p.t * 0.01e0 + s.ssrd * 0.001e0 * p.t AS r FROM s, p)
"""


@query("tower_obs", sql=ICE + "SELECT step_::BIGINT AS k, round(t, 6) AS t2m, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.05), 6)+0e0 AS p05, round(quantile_cont(r, 0.95), 6) AS p95 FROM c GROUP BY 1, 2")
def x04_x05_response(spark: SparkSession, d: str) -> DataFrame:
    s = L.random_subsample(bind(spark, d, "tower_obs").select("site", "step", "nee", "t2m", "ssrd"), 200, "site", "step").withColumnRenamed("step", "at")
    t = F.col("t2m")
    curves = L.ice(s, "t2m", 10, lambda: F.col("nee") * 0.1 + t * t * 0.01 + F.col("ssrd") * 0.001 * t)
    out = L.pdp(curves, "t2m")
    return out.select(F.col("step").cast("long").alias("k"), *[r6(c).alias(c) for c in ("t2m", "median", "p05", "p95")])


@query("tower_obs", sql="SELECT site, step, round(ssrd / 0.505e0, 6) AS par, round(t2m, 6) AS t2m FROM tower_obs")
def x06_feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    t = bind(spark, d, "tower_obs").select("site", "step", P.par("ssrd").alias("par"), "t2m")
    v = vector_to_array("features")
    return L.feature_matrix(t, "gpp").select("site", "step", r6(v[0]).alias("par"), r6(v[1]).alias("t2m"))


@query("tower_obs", "stack", sql="""
, s AS (SELECT x AS site, day, avg(evi) AS evi FROM stack WHERE x < 12 GROUP BY 1, 2)
SELECT t.site, t.step, round(coalesce(s.evi, 0), 6) AS evi FROM tower_obs t LEFT JOIN s ON t.site = s.site AND t.day * 10 = s.day""")
def v15_v17_j15_training(spark: SparkSession, d: str) -> DataFrame:
    s = stack(spark, d).where("x < 12").groupBy(F.col("x").alias("site"), "day").agg(F.avg("evi").alias("evi"))
    t = bind(spark, d, "tower_obs").withColumn("day", F.col("day") * 10).select("site", "step", "day", "t")
    return L.upscaling_table(t, s, ["site"]).select("site", "step", r6("evi").alias("evi"))


@query("tower_obs", sql="""
, m AS (SELECT site AS c, hh // 2 AS hour, avg(t2m) AS t FROM tower_obs GROUP BY 1, 2), s AS (SELECT site AS c, day, avg(nee) AS evi FROM tower_obs WHERE qc = 0 GROUP BY 1, 2)
SELECT t.site, t.step, round(coalesce(m.t, 0), 6) AS met_t, round(coalesce(s.evi, 0), 6)+0e0 AS evi FROM tower_obs t LEFT JOIN m ON t.site = m.c AND CAST(ceil(t.hh / 2e0 - 0.5e0) AS BIGINT) = m.hour LEFT JOIN s ON t.site = s.c AND t.day = s.day""")
def v16_training_table(spark: SparkSession, d: str) -> DataFrame:
    t = bind(spark, d, "tower_obs")
    m = t.groupBy("site", F.timestamp_seconds(F.floor(F.col("hh") / 2) * 3600).alias("valid_time")).agg(F.avg("t2m").alias("met_t"))
    s = t.where("qc = 0").groupBy("site", "day").agg(F.avg("nee").alias("evi"))
    out = L.training_table(t.select("site", "step", "day", "t"), s, m, ["site"])
    return out.select("site", "step", r6("met_t").alias("met_t"), r6("evi").alias("evi"))


@query("stack", "fractions", sql="""
, p AS (SELECT x, y, quantile_cont(evi * 0.3e0, 0.9) AS a, quantile_cont(evi * 0.3e0, 0.1) AS b FROM stack GROUP BY 1, 2)
SELECT p.x, p.y, round(a, 6) AS p90, round(b, 6) AS p10, sum(frac) FILTER (veg_class = 1) AS c1, sum(frac) FILTER (veg_class = 7) AS c7, coalesce(sum(frac) FILTER (veg_class = 7), 0) < 0.5e0 AS flux_mask FROM p JOIN fractions f ON p.x = f.x AND p.y = f.y GROUP BY ALL""")
def j14_m27_static(spark: SparkSession, d: str) -> DataFrame:
    f = bind(spark, d, "fractions")
    s = V.static_features(stack(spark, d).withColumn("nirv", F.col("evi") * 0.3), f, ["x", "y"], [1, 7])
    s = s.join(L.flux_mask(f, ["x", "y"], most=0.5), ["x", "y"])
    return s.select("x", "y", r6("nirv_p90").alias("p90"), r6("nirv_p10").alias("p10"), F.col("1").alias("c1"), F.col("7").alias("c7"), "flux_mask")


# A site's pixels are cells of its footprint; the stack's first days stand for January.
CUBE = FFP + """
, c AS (SELECT f.site, f.step, f.i, f.j, f.footprint, o.qc, o.nee, coalesce(s.evi, 0) AS evi, coalesce(l.water, 0) AS water
 FROM f JOIN tower_obs o ON f.site = o.site AND f.step = o.step LEFT JOIN stack s ON f.i = s.x AND f.j = s.y AND o.day * 40 = s.day
 LEFT JOIN (SELECT x, y, sum(frac) FILTER (veg_class > 5) AS water FROM fractions GROUP BY 1, 2) l ON f.i = l.x AND f.j = l.y)
"""


def cube(spark: SparkSession, d: str) -> DataFrame:
    samples = bind(spark, d, "tower_obs").select("site", "step", (F.col("day") * 40).alias("day"), "qc", "nee")
    pixels = stack(spark, d).select(F.col("x").alias("i"), F.col("y").alias("j"), "day", "evi")
    share = F.sum(F.when(F.col("veg_class") > 5, F.col("frac"))).alias("water")
    classes = bind(spark, d, "fractions").groupBy(F.col("x").alias("i"), F.col("y").alias("j")).agg(share)
    return L.training_cube(samples, fp(spark, d).select(*AT, "i", "j", "footprint"), pixels, classes, AT, ["i", "j"])


WEIGHED = "count(*) AS n, round(sum(footprint) * 1e3, 6) AS footprint, round(sum(footprint * evi) * 1e3, 6)+0e0 AS evi, round(sum(footprint * water) * 1e3, 6) AS water"


def _weighed(c: DataFrame) -> DataFrame:
    total = lambda v: r6(F.sum(F.col("footprint") * v) * 1e3)
    return c.groupBy(*AT).agg(F.count("*").alias("n"), total(F.lit(1.0)).alias("footprint"), total(F.col("evi")).alias("evi"), total(F.col("water")).alias("water"))


@query("fp_in", "cells", "tower_obs", "stack", "fractions", sql=CUBE + f"SELECT site, step, {WEIGHED} FROM c GROUP BY 1, 2")
def v16_training_cube(spark: SparkSession, d: str) -> DataFrame:
    """Footprint, land cover and stack at each cell and time, summed up over the cells."""
    return _weighed(cube(spark, d))


@query("fp_in", "cells", "tower_obs", "stack", "fractions", sql=CUBE + f"""
, b AS (SELECT site, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM (SELECT *, s / sum(s) OVER (PARTITION BY site) AS share FROM (SELECT site, i, j, sum(footprint) AS s FROM c GROUP BY 1, 2, 3)) WHERE share > 0.002e0 GROUP BY 1),
k AS (SELECT c.* FROM c JOIN b ON c.site = b.site WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1),
t AS (SELECT site, step, sum(footprint) AS total FROM k WHERE qc = 0 GROUP BY 1, 2 HAVING sum(footprint) > 1e-5), u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY site ORDER BY step) > 4),
n AS (SELECT k.site, k.step, k.footprint / u.total AS footprint, evi, water FROM k JOIN u ON k.site = u.site AND k.step = u.step)
SELECT site, step, {WEIGHED} FROM n GROUP BY 1, 2""")
def v17_base_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _weighed(L.base_dataset(cube(spark, d), ["site"], least_share=0.002, lag=4))
