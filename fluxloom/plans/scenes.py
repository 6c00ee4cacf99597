"""Queries over satellite scenes: indices, masks, catalogue, stacks, smoothing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import indices as I
from ..functions import masks as M
from ..functions import physics as P
from ..operators import grids as Z
from ..operators import polygons as L
from ..operators import smoothing as H
from ..operators import spatial as G
from ..operators import stack as S
from ..operators.quantiles import exact_quantiles
from ..sources import config as C
from ..sources import readers as R
from ..sources.scratch import written
from .registry import BINDINGS, bind, query

r6 = X.r6
KEYS = ["ok", "ln"]


@query("px_obs", sql="""
SELECT ok, ln, round((nir-red)/nullif(nir+red,0),6)+0e0 AS ndvi, round((nir-red)/nullif(nir+red,0)*nir,6)+0e0 AS nirv, round((nir-red_edge)/nullif(nir+red_edge,0),6)+0e0 AS ndre,
       round((nir-red)/nullif(nir+red,0),6)+0e0 AS ndwi, round((nir-swir)/nullif(nir+swir,0),6)+0e0 AS lswi,
       CASE WHEN 2.5e0*(nir-red)/nullif(nir+6*red-7.5e0*blue+1,0) BETWEEN 0 AND 1 THEN round(2.5e0*(nir-red)/nullif(nir+6*red-7.5e0*blue+1,0),6)+0e0 END AS evi,
       round(2.5e0*(nir-red)/nullif(nir+2.4e0*red+1,0),6)+0e0 AS evi2 FROM px_obs""")
def p01_p12_indices(spark: SparkSession, d: str) -> DataFrame:
    out = I.add_indices(bind(spark, d, "px_obs"), ["ndvi", "nirv", "ndre", "lswi", "evi", "evi2"]).withColumn("ndwi", I.ndwi("nir", "red"))
    return I.drop_bands(out).select(*KEYS, *[r6(c).alias(c) for c in ("ndvi", "nirv", "ndre", "ndwi", "lswi", "evi", "evi2")])


@query("px_obs", sql="""
SELECT ok, ln, round(least(greatest(nir, 0.3e0), 0.5e0), 6) AS held, CASE WHEN nir BETWEEN 0.3e0 AND 0.5e0 THEN round(nir, 6) ELSE -1e0 END AS filled,
       CASE WHEN nir BETWEEN 0.3e0 AND 0.5e0 THEN round(nir, 6) WHEN ln < 4 THEN -2e0 END AS chosen FROM px_obs""")
def p09_p10_clip(spark: SparkSession, d: str) -> DataFrame:
    inside = X.clip("nir", 0.3, 0.5, to_null=True)
    cols = {"held": X.clip("nir", 0.3, 0.5), "filled": X.fill_missing(inside, -1), "chosen": X.fill_missing(inside, -2, F.col("ln") < 4)}
    return bind(spark, d, "px_obs").select(*KEYS, *[r6(c).alias(n) for n, c in cols.items()])


@query("px_obs", sql="""
SELECT ok, ln, date_diff('day', min(CAST(scene_ts AS DATE)) OVER (), CAST(scene_ts AS DATE))::BIGINT AS obs_day,
       date_diff('day', DATE '1970-01-01', CASE WHEN abs(obs_doy - s) < abs(obs_doy - e) THEN d + CAST(obs_doy - s AS INT) ELSE d + 8 + CAST(obs_doy - e AS INT) END)::BIGINT AS own_day,
       date_diff('day', min(CAST(scene_ts AS DATE)) OVER (), CAST(scene_ts AS DATE))::BIGINT AS since
FROM (SELECT *, CAST(scene_ts AS DATE) AS d, dayofyear(scene_ts) AS s, dayofyear(CAST(scene_ts AS DATE) + 8) AS e FROM px_obs)""")
def p13_p14_p25_days(spark: SparkSession, d: str) -> DataFrame:
    px = bind(spark, d, "px_obs").withColumn("midday", F.to_timestamp(F.to_date("scene_ts")))
    px = S.add_observation_day(px, "midday", "midday").crossJoin(F.broadcast(px.agg(F.min("midday").alias("t0"))))
    own = P.observation_day("obs_doy", "scene_ts", F.date_add(F.to_date("scene_ts"), 8))
    return px.select(*KEYS, "obs_day", F.datediff(own, F.lit("1970-01-01").cast("date")).cast("long").alias("own_day"), P.days_between("midday", "t0").alias("since"))


@query("px_obs", sql="""
SELECT ok, ln, (qc_500m >> 2) & 15 <> 0 AS bad1, (qc_500m >> 6) & 15 <> 0 AS bad2, (qc_500m >> 22) & 15 <> 0 AS bad6,
       state_qa & 3 <> 0 OR (state_qa >> 2) & 1 = 1 OR (state_qa >> 8) & 3 <> 0 OR (state_qa >> 13) & 1 = 1 AS clouds, (state_qa >> 12) & 1 = 1 OR (state_qa >> 15) & 1 = 1 AS snow, (state_qa >> 3) & 7 <> 1 AS water,
       (qc_500m >> 4) & 15 <> 0 AS vbad1, (qc_500m >> 8) & 15 <> 0 AS vbad2, state_qa & 3 <> 0 OR (state_qa >> 2) & 1 = 1 OR (state_qa >> 8) & 3 <> 0 AS vclouds, (state_qa >> 12) & 1 = 1 AS vsnow,
       (qf6 >> 3) & 7 <> 0 AS dbad, (qf1 >> 2) & 3 <> 0 OR (qf2 >> 3) & 1 = 1 AS dclouds, (qf2 >> 5) & 1 = 1 AS dsnow FROM px_obs""")
def m01_m07_bit_masks(spark: SparkSession, d: str) -> DataFrame:
    cols = {"bad1": M.modis_bad(1), "bad2": M.modis_bad(2), "bad6": M.modis_bad(6), "clouds": M.modis_clouds(), "snow": M.modis_snow(), "water": M.modis_water(), "vbad1": M.viirs_bad(1), "vbad2": M.viirs_bad(2)}
    cols |= {"vclouds": M.viirs_clouds(), "vsnow": M.viirs_snow(), "dbad": M.viirs_daily_bad(), "dclouds": M.viirs_daily_clouds(), "dsnow": M.viirs_daily_snow()}
    return bind(spark, d, "px_obs").select(*KEYS, *[c.alias(n) for n, c in cols.items()])


@query("px_obs", sql="""
SELECT p.ok, p.ln, q.qf1 AS qf1, q.qf2 AS qf2 FROM px_obs p JOIN (SELECT CAST(floor(x / 2e0) AS BIGINT) AS cx, CAST(floor(y / 2e0) AS BIGINT) AS cy, max(qf1) AS qf1, max(qf2) AS qf2 FROM px_obs GROUP BY 1, 2) q
ON CAST(floor(p.x / 2e0) AS BIGINT) = q.cx AND CAST(floor(p.y / 2e0) AS BIGINT) = q.cy""")
def m08_flags_to_fine_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a grid twice as coarse, at centres 0.5, 2.5, ..., for the pixels nearest to them."""
    px = bind(spark, d, "px_obs").withColumns({"cx": F.floor(F.col("x") / 2), "cy": F.floor(F.col("y") / 2)})
    coarse = px.groupBy("cx", "cy").agg(F.max("qf1").alias("c1"), F.max("qf2").alias("c2"))
    return px.join(coarse, ["cx", "cy"]).select(*KEYS, F.col("c1").alias("qf1"), F.col("c2").alias("qf2"))


@query("px_obs", sql="""
SELECT ok, ln, fmask & 30 <> 0 AS bad, fmask & 15 <> 0 OR (fmask >> 6) & 3 = 3 AS clouds, (fmask >> 4) & 1 = 1 AS snow, (fmask >> 5) & 1 = 1 AS water, (fmask >> 6) & 3 = 3 AS aerosol, fmask & 10 <> 0 AS chosen,
       scl IN (0,1,2,3,7) AS sbad, scl = 6 AS swater, scl = 5 AS bare, scl IN (8,9,10) AS sclouds, scl = 11 AS ssnow FROM px_obs""")
def m09_m10_class_masks(spark: SparkSession, d: str) -> DataFrame:
    cols = {"bad": M.hls_bad(), "clouds": M.hls_clouds(), "snow": M.hls_snow(), "water": M.hls_water(), "aerosol": M.hls_aerosol(), "chosen": M.hls_mask([1, 3])}
    cols |= {"sbad": M.scl("bad"), "swater": M.scl("water"), "bare": M.scl("non_vegetated"), "sclouds": M.scl("clouds"), "ssnow": M.scl("snow")}
    return bind(spark, d, "px_obs").select(*KEYS, *[c.alias(n) for n, c in cols.items()])


def masked_indices(spark: SparkSession, d: str) -> DataFrame:
    px = I.add_indices(bind(spark, d, "px_obs"), ["evi", "lswi"])
    return M.apply_masks(px, M.PRODUCTS["modis"], ["evi", "lswi"])


def stack(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_same_day(masked_indices(spark, d).select("x", "y", "scene_ts", "is_snow", "evi", "lswi"), ["evi", "lswi"])


@query("px_obs", sql="""
SELECT ok, ln, s AND NOT h AS is_snow, CASE WHEN NOT h AND NOT s AND n BETWEEN 0.2e0 AND 0.5e0 THEN round(n, 6) END AS nir FROM (
 SELECT ok, ln, CASE WHEN NOT (scl IN (0,1,2,3,7)) THEN nir END AS n, scl = 11 AS s, scl = 6 OR scl = 5 OR scl IN (8,9,10) AS h FROM px_obs)""")
def m11_masks_in_order(spark: SparkSession, d: str) -> DataFrame:
    p = M.PRODUCTS["sentinel2"]
    px = M.mask_bad(bind(spark, d, "px_obs"), p).withColumn("nir", X.clip("nir", 0.2, 0.5, to_null=True))
    return M.apply_masks(px, p, ["nir"]).select(*KEYS, "is_snow", r6("nir").alias("nir"))


@query("px_obs", sql="SELECT x, y, avg(CAST((fmask >> 5) & 1 = 1 AS INT)) > 0.5e0 AS is_water FROM px_obs GROUP BY x, y")
def m12_dominant_water(spark: SparkSession, d: str) -> DataFrame:
    return M.dominant_water(bind(spark, d, "px_obs"), M.hls_water(), ["x", "y"])


@query("px_obs", sql="""
SELECT epoch_us(scene_ts)::BIGINT AS ts, avg(CAST(scl IN (8,9,10) AS INT)) AS cover FROM px_obs GROUP BY 1 HAVING avg(CAST(scl IN (8,9,10) AS INT)) < 0.25e0""")
def m13_scene_cloud_cover(spark: SparkSession, d: str) -> DataFrame:
    cover = bind(spark, d, "px_obs").groupBy("scene_ts").agg(F.avg(M.scl("clouds").cast("int")).alias("cover"))
    return cover.where("cover < 0.25").select(F.unix_micros("scene_ts").alias("ts"), "cover")


CROP = "SELECT '{}' AS crop, x, y, count(*) AS n, round(avg(nir), 6) AS nir FROM px_obs WHERE {} GROUP BY x, y"


@query("px_obs", sql=" UNION ALL ".join(CROP.format(*c) for c in (
    ("box", "x BETWEEN 3 AND 9 AND y BETWEEN 2 AND 5"),
    ("other", "x BETWEEN 4 AND 7 AND y BETWEEN 1 AND 3"),
    ("pixels", "abs(x - 7) <= 2 AND abs(y - 4) <= 2"),
    ("circle", "x BETWEEN 10 - degrees(asin(sin(300e3/6371000e0)/cos(radians(5e0)))) AND 10 + degrees(asin(sin(300e3/6371000e0)/cos(radians(5e0)))) AND y BETWEEN 5 - degrees(300e3/6371000e0) AND 5 + degrees(300e3/6371000e0)"),
    ("polygon", "x BETWEEN 2 AND 8 AND y BETWEEN 1 AND 6"),
    ("central", "x BETWEEN 4 AND 6 AND y BETWEEN 4 AND 6"))))
def m14_m17_crops(spark: SparkSession, d: str) -> DataFrame:
    px = bind(spark, d, "px_obs").select("x", "y", "nir")
    other = px.where("x BETWEEN 4 AND 7 AND y BETWEEN 1 AND 3")
    square = [(2.4, 1.4), (7.6, 1.4), (7.6, 5.6), (2.4, 5.6)]
    parts = {"box": G.crop_box(px, 3, 2, 9, 5), "other": G.clip_to(px, other), "pixels": G.crop_pixels(px, 7.2, 3.9, 5), "circle": G.crop_circle_box(px, 10, 5, 300, "x", "y"), "polygon": G.crop_polygon(px, square)}
    parts["central"] = G.crop_box(px, 4, 4, 6, 6)
    return S.concat([p.groupBy("x", "y").agg(F.count("*").alias("n"), r6(F.avg("nir")).alias("nir")).select(F.lit(k).alias("crop"), "x", "y", "n", "nir") for k, p in parts.items()])


# Polygons around sites of the weather's grid: one with a notch and a hole, one thinner than a pixel, and one for
# each column of pixels, of another size each.
BINDINGS["polygons"] = """
SELECT * FROM (VALUES ('notched', 0, 0, 1.7e0, 0.9e0), ('notched', 0, 1, 15.3e0, 1.3e0), ('notched', 0, 2, 17.1e0, 8.2e0), ('notched', 0, 3, 9.9e0, 3.1e0), ('notched', 0, 4, 3.2e0, 8.7e0),
 ('notched', 1, 0, 12.1e0, 2.2e0), ('notched', 1, 1, 14.4e0, 2.3e0), ('notched', 1, 2, 13.9e0, 4.6e0),
 ('thin', 0, 0, 0.2e0, 7.81e0), ('thin', 0, 1, 19.1e0, 0.33e0), ('thin', 0, 2, 19.1e0, 0.34e0)) v(poly, ring, seq, px, py)
UNION ALL SELECT concat('column', CAST(x AS VARCHAR(9))), 0, k, x + dx * (0.3e0 + x % 3), 4.2e0 + dy * (0.4e0 + x % 4)
FROM (SELECT DISTINCT x FROM {px_obs}) p, (VALUES (0, -1e0, -1e0), (1, 1.1e0, -0.9e0), (2, 0.1e0, 1.2e0)) t(k, dx, dy)"""


@query("px_obs", "polygons", sql="""
, e AS (SELECT poly, px AS x1, py AS y1, coalesce(lead(px) OVER r, first_value(px) OVER r) AS x2, coalesce(lead(py) OVER r, first_value(py) OVER r) AS y2 FROM polygons WINDOW r AS (PARTITION BY poly, ring ORDER BY seq)),
c AS (SELECT x, y, count(*) AS n, round(avg(nir), 6) AS nir FROM px_obs GROUP BY x, y),
t AS (SELECT poly, x, y, n, nir,
   least(x1, x2) <= x + 0.5e0 AND greatest(x1, x2) >= x - 0.5e0 AND least(y1, y2) <= y + 0.5e0 AND greatest(y1, y2) >= y - 0.5e0
   AND abs(sign((x2-x1)*(y-0.5e0-y1)-(y2-y1)*(x-0.5e0-x1)) + sign((x2-x1)*(y-0.5e0-y1)-(y2-y1)*(x+0.5e0-x1)) + sign((x2-x1)*(y+0.5e0-y1)-(y2-y1)*(x-0.5e0-x1)) + sign((x2-x1)*(y+0.5e0-y1)-(y2-y1)*(x+0.5e0-x1))) < 4 AS hit,
   (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) < x AS crossed FROM c, e)
SELECT poly, x, y, any_value(n) AS n, any_value(nir) AS nir FROM t GROUP BY poly, x, y HAVING bool_or(hit) OR sum(CASE WHEN crossed THEN 1 ELSE 0 END) % 2 = 1""")
def m16_polygon_table(spark: SparkSession, d: str) -> DataFrame:
    px = bind(spark, d, "px_obs").groupBy("x", "y").agg(F.count("*").alias("n"), r6(F.avg("nir")).alias("nir"))
    return L.crop_polygons(px, bind(spark, d, "polygons"), sizes=(4, 1))


APART = "(SELECT a.x1 < b.x0 OR b.x1 < a.x0 OR a.y1 < b.y0 OR b.y1 < a.y0 FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px_obs WHERE {}) a, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px_obs WHERE {}) b)"


@query("px_obs", sql="SELECT " + ", ".join(f"{APART.format(*w)} AS {n}" for n, w in {"near": ("x < 9", "x > 5"), "far": ("x < 5", "x > 5"), "bright": ("nir > 0.5e0", "nir < 0.3e0")}.items()))
def m21_disjoint(spark: SparkSession, d: str) -> DataFrame:
    px = bind(spark, d, "px_obs").select("x", "y", "nir")
    pairs = {"near": ("x < 9", "x > 5"), "far": ("x < 5", "x > 5"), "bright": ("nir > 0.5", "nir < 0.3")}
    found = [G.is_disjoint(px.where(a), px.where(b)).withColumnRenamed("disjoint", n) for n, (a, b) in pairs.items()]
    return found[0].crossJoin(found[1]).crossJoin(found[2])  # one row each


@query("stack", sql="SELECT x, y, day, is_snow, round(evi, 6) AS evi, round(lswi, 6)+0e0 AS lswi FROM stack")
def a01_same_day_merge(spark: SparkSession, d: str) -> DataFrame:
    return stack(spark, d).select("x", "y", "day", "is_snow", r6("evi").alias("evi"), r6("lswi").alias("lswi"))


@query("stats", sql="SELECT x, y, round(min_evi,6) AS min_evi, round(max_evi,6) AS max_evi, round(th,6) AS th, round(min_lswi,6)+0e0 AS min_lswi, round(max_lswi,6)+0e0 AS max_lswi FROM stats")
def a02_a03_growing_season(spark: SparkSession, d: str) -> DataFrame:
    s = S.growing_season_stats(stack(spark, d))
    return s.select("x", "y", *[r6(c).alias(c) for c in s.columns[2:]])


@query("stack", sql="""
, t AS (SELECT *, count(evi) OVER (PARTITION BY x, y ORDER BY day) AS island, quantile_cont(evi, 0.05) OVER (PARTITION BY x, y) AS low FROM stack),
r AS (SELECT *, sum(CASE WHEN is_snow AND evi IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY x, y, island) AS snow FROM t),
k AS (SELECT greatest(1, CAST(trunc({days} / ((max(day) - min(day)) / greatest(count(*) - 1, 1)::DOUBLE)) AS BIGINT)) AS least FROM (SELECT DISTINCT day FROM stack))
SELECT x, y, day, round(CASE WHEN evi IS NOT NULL THEN evi WHEN is_snow AND snow >= least THEN low END, 6) AS evi FROM r, k""".replace("{days}", "2.5e0"))
def w01_snow_runs(spark: SparkSession, d: str) -> DataFrame:
    """The length of a run follows the stack's mean step."""
    own = stack(spark, d)
    out = S.replace_snow_runs(own, "evi", S.snow_run_length(own, 2.5))
    return out.select("x", "y", "day", r6("evi").alias("evi"))


@query()
def w02_w04_w05_lowess(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed onto every 30th day of the record and its last."""
    own = written(stack(spark, d).select("x", "y", "day", "evi"))
    last = own.agg(F.max("day")).first()[0] or 0
    days = [r["day"] for r in S.target_days(spark, last, [*range(0, last, 30), last], own).collect()]
    return H.lowess(own, "evi", days, S.smoothing_keys(own))


@query()
def w02_lowess_own_days(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed onto the days of the stack's own scenes, the default."""
    own = written(stack(spark, d).select("x", "y", "day", "evi"))
    days = [r["day"] for r in S.target_days(spark, 0, None, own).collect()]
    return H.lowess(own, "evi", days, S.smoothing_keys(own))


@query()
def w03_kalman(spark: SparkSession, d: str) -> DataFrame:
    own = written(stack(spark, d).select("x", "y", "day", "evi"))
    return H.kalman(own, "evi", own.agg(F.max("day")).first()[0] or 0)


@query("masked", sql="SELECT x, y, date_diff('day', DATE '1970-01-01', CAST(scene_ts AS DATE))::BIGINT AS day, round(avg(evi), 6) AS evi FROM masked GROUP BY 1, 2, 3")
def a09_mean_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Scenes before their days are merged, so that many days have several."""
    px = masked_indices(spark, d).withColumn("day", F.datediff(F.to_date("scene_ts"), F.lit("1970-01-01").cast("date")).cast("long"))
    return S.mean_of_duplicates(px, "evi", ["x", "y"]).withColumn("evi", r6("evi"))


SMEAR = """
, g AS (SELECT x, y, avg(CASE WHEN (x * 7 + y) % 5 <> 0 THEN evi END) AS v FROM stack GROUP BY x, y),
o AS (SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
s AS (SELECT g.x + i AS x, g.y + j AS y, sum(v) AS s, sum(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END) AS lost FROM g, o GROUP BY 1, 2)
SELECT g.x, g.y, CASE WHEN g.v IS NOT NULL THEN round(s.s / (9 - s.lost), 6) END AS v FROM g LEFT JOIN s ON g.x = s.x AND g.y = s.y"""


@query("stack", sql=SMEAR)
def a10_smear(spark: SparkSession, d: str) -> DataFrame:
    grid = stack(spark, d).groupBy("x", "y").agg(F.avg(F.when((F.col("x") * 7 + F.col("y")) % 5 != 0, F.col("evi"))).alias("v"))
    return S.smear(grid, "v").withColumn("v", r6("v"))


@query("stack", sql=SMEAR.replace("VALUES (-1), (0), (1)", "SELECT unnest(range(-7, 8))").replace("9 - s.lost", "225 - s.lost"))
def a10_smear_wide(spark: SparkSession, d: str) -> DataFrame:
    """Squares of 15 x 15 pixels, at the edges wider than the raster."""
    grid = stack(spark, d).groupBy("x", "y").agg(F.avg(F.when((F.col("x") * 7 + F.col("y")) % 5 != 0, F.col("evi"))).alias("v"))
    return S.smear(grid, "v", 15).withColumn("v", r6("v"))


@query("stack", sql="""SELECT round(avg(v), 6) AS v FROM (SELECT x, y, avg(evi) AS v FROM stack GROUP BY x, y) WHERE x BETWEEN 4 AND 6 AND y BETWEEN 4 AND 6""")
def a11_central_mean(spark: SparkSession, d: str) -> DataFrame:
    grid = stack(spark, d).groupBy("x", "y").agg(F.avg("evi").alias("v"))
    return G.central_mean(grid, "v", 3, 10).withColumn("v", r6("v"))


@query("px_obs", sql="""
, n AS (SELECT x, y, (nir-red)/nullif(nir+red,0)*nir AS nirv FROM px_obs)
SELECT x, y, round(quantile_cont(nirv, 0.9), 6) AS nirv_p90, round(quantile_cont(nirv, 0.1), 6) AS nirv_p10 FROM n GROUP BY x, y""")
def a15_nirv_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of more than a thousand values go the way of large groups."""
    n = bind(spark, d, "px_obs").select("x", "y", I.nirv().alias("nirv"))
    found = exact_quantiles(n, ["x", "y"], "nirv", {"nirv_p90": 0.9, "nirv_p10": 0.1}, small=1000)
    return found.select("x", "y", r6("nirv_p90").alias("nirv_p90"), r6("nirv_p10").alias("nirv_p10"))


@query("px_obs", sql="SELECT epoch_us(scene_ts)::BIGINT AS ts, count(*) AS pixels FROM px_obs GROUP BY scene_ts ORDER BY 2 DESC, scene_ts LIMIT 1")
def o01_o02_prototype(spark: SparkSession, d: str) -> DataFrame:
    return S.prototype_scene(bind(spark, d, "px_obs")).select(F.unix_micros("scene_ts").alias("ts"), "pixels")


@query("stack", sql="""
, a AS (SELECT x, y, avg(evi) AS v FROM stack WHERE x <= 12 AND day < 300 GROUP BY x, y), b AS (SELECT x, y, avg(lswi) AS v FROM stack WHERE x >= 8 GROUP BY x, y)
SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, round(coalesce(a.v, b.v), 6) AS v FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y""")
def o05_o07_tiles(spark: SparkSession, d: str) -> DataFrame:
    s = stack(spark, d)
    a = s.where("x <= 12 AND day < 300").groupBy("x", "y").agg(F.avg("evi").alias("v"))
    b = s.where("x >= 8").groupBy("x", "y").agg(F.avg("lswi").alias("v"))
    return S.add_tiles([a, b], ["v"], ["x", "y"]).withColumn("v", r6("v"))


#: A raster in degrees, and two tiles that lie over its edges: in metres, and in other degrees.
OWN = Z.Grid("lonlat", 10.0, 50.0, 0.01, 0.01, 20, 10)
TILES = {"a": Z.Grid("sinusoidal", 722137.0, 5558211.0, 905.0, 905.0, 20, 10), "b": Z.Grid("lonlat", 9.9432, 50.0373, 0.0071, 0.0083, 20, 10)}


@query("px_obs", "stack", sql="""
, src AS (SELECT CASE WHEN scl < 6 THEN 'a' ELSE 'b' END AS tile, x, y, avg(nir) AS v, avg(CASE WHEN (x + y) % 4 <> 0 THEN red END) AS w FROM px_obs GROUP BY 1, 2, 3),
own AS (SELECT x, y, avg(evi) AS v, avg(lswi) AS w FROM stack GROUP BY x, y),
t AS (SELECT c, r, 10 + (c + 0.5e0) * 0.01e0 AS lon, 50 - (r + 0.5e0) * 0.01e0 AS lat FROM range(-99, 150) a(c), range(-99, 150) b(r)),
m AS (SELECT c, r, floor((6371007.181e0 * radians(lon) * cos(radians(lat)) - 722137) / 905) AS ax, floor((5558211 - 6371007.181e0 * radians(lat)) / 905) AS ay,
             floor((lon - 9.9432e0) / 0.0071e0) AS bx, floor((50.0373e0 - lat) / 0.0083e0) AS by FROM t)
SELECT c AS col, r AS row, round(coalesce(a.v, b.v, o.v), 6) AS v, round(coalesce(a.w, b.w, o.w), 6)+0e0 AS w
FROM m LEFT JOIN src a ON a.tile = 'a' AND a.x = ax AND a.y = ay LEFT JOIN src b ON b.tile = 'b' AND b.x = bx AND b.y = m.by LEFT JOIN own o ON o.x = c AND o.y = r
WHERE a.x IS NOT NULL OR b.x IS NOT NULL OR o.x IS NOT NULL""")
def o05_reprojected_tiles(spark: SparkSession, d: str) -> DataFrame:
    own = stack(spark, d).groupBy(F.col("x").alias("col"), F.col("y").alias("row")).agg(F.avg("evi").alias("v"), F.avg("lswi").alias("w"))
    red = F.when((F.col("x") + F.col("y")) % 4 != 0, F.col("red"))
    px = bind(spark, d, "px_obs").withColumn("tile", F.when(F.col("scl") < 6, "a").otherwise("b"))
    new = px.groupBy("tile", F.col("x").alias("sx"), F.col("y").alias("sy")).agg(F.avg("nir").alias("v"), F.avg(red).alias("w"))
    out, wide = Z.add_tiles_reprojected(own, OWN, new, Z.as_tiles(spark, TILES), ["v", "w"], block=16)
    left, top = round((wide.x0 - OWN.x0) / OWN.dx), round((OWN.y0 - wide.y0) / OWN.dy)
    return out.select((F.col("col") + left).alias("col"), (F.col("row") + top).alias("row"), r6("v").alias("v"), r6("w").alias("w"))


@query("fractions", sql="SELECT DISTINCT veg_class::BIGINT AS veg_class FROM fractions")
def o08_distinct_classes(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "fractions").select(F.col("veg_class").cast("long").alias("veg_class")).distinct()


@query("px_obs", sql="""
SELECT ok, ln, round(nir * 1e-4, 9) AS nir, (epoch_us(scene_ts) + 4 * 86400000000)::BIGINT AS mid, (epoch_us(date_trunc('day', scene_ts)) + 43200000000)::BIGINT AS noon FROM px_obs""")
def s09_scenes(spark: SparkSession, d: str) -> DataFrame:
    px = bind(spark, d, "px_obs").withColumns({"start": F.col("scene_ts"), "stop": F.timestamp_micros(F.unix_micros("scene_ts") + 8 * 86_400_000_000)})
    px = R.scaled_scenes(px, "modis", ["nir"])
    return px.select(*KEYS, F.round("nir", 9).alias("nir"), F.unix_micros("scene_ts").alias("mid"), F.unix_micros(R.scene_time("viirs_daily")).alias("noon"))


@query("land_cover", sql="SELECT fx, fy, coalesce(CASE WHEN code % 10 <> 0 THEN code END, 8)::BIGINT AS code, 30e0 AS resolution FROM land_cover")
def s10_land_cover(spark: SparkSession, d: str) -> DataFrame:
    lc = bind(spark, d, "land_cover").withColumn("code", F.when(F.col("code") % 10 != 0, F.col("code")))
    return R.land_cover_codes(lc, "mapbiomas").select("fx", "fy", F.col("code").cast("long").alias("code"), "resolution")


CONFIG = {f"class {c}": {"veg_class": c, "class_numbers": [k for k in range(20, 51) if k % 7 + 1 == c], "tmin": -c, "topt": 15 + c, "tmax": 40} for c in range(1, 8)}


@query("land_cover", sql="""
SELECT fx, fy, (CASE WHEN code BETWEEN 20 AND 50 THEN code % 7 + 1 ELSE code END)::BIGINT AS veg_class, CASE WHEN code BETWEEN 20 AND 50 THEN -(code % 7 + 1)::DOUBLE END AS tlow FROM land_cover""")
def s11_j11_recode(spark: SparkSession, d: str) -> DataFrame:
    lc_map, coefficients = C.load_class_config(spark, CONFIG)
    out = G.recode(bind(spark, d, "land_cover"), lc_map)
    inside = F.col("code").between(20, 50)
    out = out.join(F.broadcast(coefficients.select(F.col("veg_class").alias("_c"), "tlow")), F.col("veg_class") == F.col("_c"), "left")
    return out.select("fx", "fy", F.col("veg_class").cast("long").alias("veg_class"), F.when(inside, F.col("tlow")).alias("tlow"))


@query("granules", sql="""
SELECT string_split(name, '.')[1] AS product, string_split(name, '.')[2] AS day, string_split(name, '.')[3] AS tile, max(name) AS name FROM granules GROUP BY 1, 2, 3""")
def c05_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_version(bind(spark, d, "granules"))


@query("granules", sql="SELECT name FROM granules WHERE ok % 3 <> 0")
def c04_missing_granules(spark: SparkSession, d: str) -> DataFrame:
    g = bind(spark, d, "granules")
    return C.missing_granules(g.select("name"), g.where("ok % 3 = 0").select("name"))


@query("granules", sql="""
SELECT name, (2 * row_number() OVER (PARTITION BY ok % 7 ORDER BY ok) - 1)::BIGINT AS pos FROM granules WHERE name ILIKE 'MOD09A1.A2021150.h12%'""")
def c03_extract_granules(spark: SparkSession, d: str) -> DataFrame:
    """Seven listings with a link for each granule, whose name stands in it twice."""
    link = F.concat(F.lit("<a href='"), F.lower("name"), F.lit("'>"), F.col("name"), F.lit("</a>"))
    g = bind(spark, d, "granules").groupBy(F.col("ok") % 7).agg(F.array_sort(F.collect_list(F.struct("ok", link.alias("link")))).alias("links"))
    found = C.extract_granules(g.select(F.array_join("links.link", "\n").alias("html")), "MOD09A1", dt.date(2021, 5, 30), r"h12v\d\d")
    return found.where("name LIKE 'MOD%'").select("name", F.col("pos").cast("long").alias("pos"))


DATES = """
, p AS (SELECT * FROM (VALUES ('MOD09GA', 'daily'), ('MOD09A1', '8day'), ('MOD13A1', '16day'), ('MCD12Q1', 'yearly'), ('MOD99', '8day')) v(product, cadence)),
s AS (SELECT CAST(min(scene_ts) AS DATE) AS a, CAST(min(scene_ts) AS DATE) + 500 AS b FROM px_obs),
e AS (SELECT product, cadence, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM p, s),
k AS (SELECT product, day FROM e WHERE CASE cadence WHEN '8day' THEN (dayofyear(day) - 1) % 8 WHEN '16day' THEN (dayofyear(day) - 1) % 16 WHEN 'yearly' THEN dayofyear(day) - 1 ELSE 0 END = 0)
"""


def _dates(spark: SparkSession, d: str) -> DataFrame:
    first = bind(spark, d, "px_obs").agg(F.min(F.to_date("scene_ts"))).first()[0]
    asked = C.product_info(spark.createDataFrame([(p,) for p in ("MOD09GA", "MOD09A1", "MOD13A1", "MCD12Q1", "MOD99")], "product string"))
    return C.expected_dates(spark, asked, str(first), str(first + dt.timedelta(days=500)))


@query("px_obs", sql=DATES + "SELECT product, epoch(day)::BIGINT // 86400 AS day FROM k")
def c01_c07_expected_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d).select("product", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"))


@query("px_obs", sql=DATES + "SELECT DISTINCT product, year(day)::BIGINT AS year, t.x AS tile FROM k, (SELECT DISTINCT x FROM px_obs) t")
def c02_tile_years(spark: SparkSession, d: str) -> DataFrame:
    return C.tile_year_tasks(_dates(spark, d), bind(spark, d, "px_obs").select(F.col("x").alias("tile")).distinct())


@query("px_obs", sql="""
SELECT date_diff('day', DATE '1970-01-01', d)::BIGINT AS day FROM (SELECT DISTINCT CAST(scene_ts AS DATE) AS d FROM px_obs WHERE scene_ts < TIMESTAMP '1997-01-02' ORDER BY 1 DESC LIMIT 40) WHERE d >= DATE '1996-12-01'""")
def c06_select_days(spark: SparkSession, d: str) -> DataFrame:
    days = bind(spark, d, "px_obs").select(F.to_date("scene_ts").alias("date")).distinct()
    out = C.select_days(days, dt.date(1997, 1, 1), dt.date(1996, 12, 1), 40)
    return out.select(F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"))


@query("px_obs", sql="""
, p AS (SELECT ok, ln, (ok % 3600) / 10e0 - 180 AS lon, (ok % 1600) / 10e0 - 80 AS lat FROM px_obs),
q AS (SELECT *, 6371007.181e0 * radians(lon) * cos(radians(lat)) AS sx, 6371007.181e0 * radians(lat) AS sy, 2 * pi() * 6371007.181e0 / 36 AS t, CAST(floor(lat / 3) * 3 AS INT) AS a, CAST(floor(lon / 3) * 3 AS INT) AS o FROM p)
SELECT ok, ln, trunc(18 + sx / t)::BIGINT AS h, trunc(9 - sy / t)::BIGINT AS v, round(sx, 3) AS sx, round(sy, 3)+0e0 AS sy, round(lon, 6) AS lon, round(lat, 6)+0e0 AS lat,
       (CASE WHEN a >= 0 THEN 'N' ELSE 'S' END) || lpad(abs(a)::VARCHAR, 2, '0') || (CASE WHEN o >= 0 THEN 'E' ELSE 'W' END) || lpad(abs(o)::VARCHAR, 3, '0') AS tile,
       round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS lon360, round(CASE WHEN lon * 2 > 180 THEN lon * 2 - 360 ELSE lon * 2 END, 6)+0e0 AS lon180 FROM q""")
def c08_c09_p22_p23_geometry(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "px_obs").select(*KEYS, ((F.col("ok") % 3600) / 10 - 180).alias("lon"), ((F.col("ok") % 1600) / 10 - 80).alias("lat"))
    (h, v), (sx, sy) = P.lonlat_to_tile("lon", "lat"), P.sinusoidal("lon", "lat")
    p = p.withColumns({"h": h.cast("long"), "v": v.cast("long"), "sx": sx, "sy": sy, "tile": P.tile3deg_name("lat", "lon"), "lon360": r6(P.lon360("lon")), "lon180": r6(P.lon180(F.col("lon") * 2))})
    lon, lat = P.sinusoidal_inverse("sx", "sy")
    return p.select(*KEYS, "h", "v", r6("sx", 3).alias("sx"), r6("sy", 3).alias("sy"), r6(lon).alias("lon"), r6(lat).alias("lat"), "tile", "lon360", "lon180")


KEYS_SQL = ", ".join(str(k) for k in C.MET_KEYS)
LAYOUTS = {"1H": ("%Y-%m-%d", "1H"), "1D": ("%Y-%m", "1D"), "1M": ("%Y", "1M")}


@query("granules", sql=f", k AS (SELECT * FROM (VALUES {KEYS_SQL}) v(key, param, stream)) " + " UNION ALL ".join(
    f"SELECT key, stamp, printf('%03d/E5%s_{step}_%s_%03d.grb', param, stream, stamp, param) AS file FROM k, (SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '{f}') AS stamp FROM orders)" for f, step in LAYOUTS.values()))
def s08_met_files(spark: SparkSession, d: str) -> DataFrame:
    """All keys in the layouts of days, months and years."""
    dates = bind(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return S.concat([C.met_files(dates, [k for k, _, _ in C.MET_KEYS], step) for step in LAYOUTS])


@query("land_cover", sql="""
SELECT CASE WHEN fx < 15 THEN 0 WHEN fx < 30 THEN 1 WHEN fx < 45 THEN 2 ELSE 3 END::BIGINT AS chunk, count(*) AS n FROM land_cover GROUP BY 1
UNION ALL SELECT 100, count(*) FROM land_cover WHERE fx >= 20 AND fx < 40 AND fy < 10""")
def w15_s15_chunks(spark: SparkSession, d: str) -> DataFrame:
    lc = bind(spark, d, "land_cover")
    counts = lc.groupBy(G.chunk_id("fx", 60, 4).cast("long").alias("chunk")).agg(F.count("*").alias("n"))
    one = G.grid_chunk(lc, 3, 1, 0, 60, 30, "fx", "fy").agg(F.count("*").alias("n")).select(F.lit(100).cast("long").alias("chunk"), "n")
    return counts.unionByName(one)
