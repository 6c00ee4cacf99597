"""Queries over readers and writers: the given tables are written in a source's format to the
shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import masks as M
from ..sources import archive as A
from ..sources import readers as R
from ..sources.scratch import scratch
from .registry import bind, query

r6 = X.r6


SITES = range(12)


def _tower_csv(spark: SparkSession, d: str, name: str, ssrd: str, t2m: str) -> str:
    """Half-hourly CSV files with sentinels, stamps an hour east of UTC, in a folder for each site
    (SITE in the name); returns the glob of all."""
    t = bind(spark, d, "tower_obs")
    start, end = (F.date_format(F.timestamp_seconds(F.col("hh") * 1800 + s), "yyyyMMddHHmm") for s in (3600, 5400))
    nee = F.when(F.col("qc") == 3, -9999.0).otherwise(F.round("nee", 4))
    t = t.select("site", start.alias("TIMESTAMP_START"), end.alias("TIMESTAMP_END"), nee.alias("NEE_VUT_REF"), F.round("ssrd", 4).alias(ssrd), F.round("t2m", 4).alias(t2m), F.col("qc").alias("NEE_VUT_REF_QC")).persist()
    path = scratch(spark, name)
    for k in SITES:
        t.where(F.col("site") == k).drop("site").coalesce(1).write.option("header", True).csv(path.replace("SITE", f"S{k:02d}"))
    t.unpersist()
    return path.replace("SITE", "*")


def _tower(df: DataFrame) -> DataFrame:
    return df.select("site", F.unix_micros("datetime_utc").alias("utc"), r6("NEE_VUT_REF").alias("nee"), r6("ssrd").alias("ssrd"), r6("t2m").alias("t2m"))


TOWER = """
SELECT '{site}' || lpad(site::VARCHAR, 2, '0') AS site, (hh * 1800000000 + 1800000000)::BIGINT AS utc, CASE WHEN qc <> 3 THEN round(nee, 4)+0e0 END AS nee, round(ssrd, 4) AS ssrd, round(t2m, 4)+0e0 AS t2m FROM tower_obs"""


@query("tower_obs", sql=TOWER.format(site="DE-S") + " WHERE hh * 1800 + 1800 BETWEEN epoch(TIMESTAMP '2024-01-03') AND epoch(TIMESTAMP '2024-01-09')")
def s01_fluxnet(spark: SparkSession, d: str) -> DataFrame:
    path = _tower_csv(spark, d, "FLX_DE-SITE_FULLSET", "SW_IN_F", "TA_F")
    a, b = (F.to_timestamp(F.lit(x)) for x in ("2024-01-03", "2024-01-09"))
    return _tower(R.read_tower_fluxnet(spark, path, 1.0, t_start=a, t_stop=b))


@query("tower_obs", sql=TOWER.format(site="DE-S"))
def s02_icos(spark: SparkSession, d: str) -> DataFrame:
    return _tower(R.read_tower_icos(spark, _tower_csv(spark, d, "ICOSETC_DE-SITE_FLUXNET", "SW_IN_F", "TA_F"), 1.0))


@query("tower_obs", sql=TOWER.format(site="US-S"))
def s03_ameriflux(spark: SparkSession, d: str) -> DataFrame:
    """The two lines before each file's header are written, too; every other site has its columns
    in another order."""
    path = _tower_csv(spark, d, "plain_US-SITE_x", "SW_IN", "TA")
    out = scratch(spark, "AMF_US-SITE_BASE")
    for k in SITES:
        lines = spark.read.text(path.replace("*", f"S{k:02d}"), wholetext=True)
        if k % 2:  # the last column goes first
            turned = F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, "^(.*),([^,]*)$", "$2,$1"))
            lines = lines.select(F.array_join(turned, "\n").alias("value"))
        lines.select(F.concat(F.lit("# Site\n# Version: 1\n"), "value").alias("value")).write.option("lineSep", "\n").text(out.replace("SITE", f"S{k:02d}"))
    return _tower(R.read_tower_ameriflux(spark, out.replace("SITE", "*"), 1.0))


BRAZIL = [*R.BRAZIL, "X09", "X10", "X11"]


@query("tower_obs", sql=f"""
SELECT {BRAZIL}[site + 1] AS site, (hh * 1800000000 + 4 * 3600000000)::BIGINT AS utc, round(round(t2m + 273.15e0, 5) - 273.15e0, 3)+0e0 AS t2m, {[R.BRAZIL[k][0] if k in R.BRAZIL else None for k in BRAZIL]}[site + 1]::DOUBLE AS lat FROM tower_obs""".replace("None", "NULL"))
def s04_brazil(spark: SparkSession, d: str) -> DataFrame:
    """A file for each site; three of them are not in the table of known places."""
    t = bind(spark, d, "tower_obs")
    hour = (F.col("hh") % 48) / 2
    row = F.concat_ws("  ", F.lit("2024"), (F.col("day") + 1).cast("string"), hour.cast("string"), F.round(F.col("t2m") + 273.15, 5).cast("string"))
    head = spark.createDataFrame([("Year_LBAMIP DoY_LBAMIP Hour_LBAMIP Tair_LBAMIP",), ("- - h K",)], "value string")
    path, out = scratch(spark, "SITE"), None
    for k, site in enumerate(BRAZIL):
        head.unionByName(t.where(F.col("site") == k).select(row.alias("value"))).write.text(path.replace("SITE", site))
        read = R.read_tower_brazil(spark, path.replace("SITE", site), site, offset_hours=-4.0)
        out = read if out is None else out.unionByName(read)
    return out.select("site", F.unix_micros("datetime_utc").alias("utc"), r6("t2m", 3).alias("t2m"), "lat")


@query("tower_obs", sql=TOWER.format(site="DE-S") + " WHERE hh * 1800 + 1800 >= epoch(TIMESTAMP '2024-01-03') AND hh * 1800 + 1800 < epoch(TIMESTAMP '2024-01-09')")
def s05_shuttle(spark: SparkSession, d: str) -> DataFrame:
    path = _tower_csv(spark, d, "ABC_DE-SITE_SHUTTLE", "SW_IN_F", "TA_F")
    a, b = (F.to_timestamp(F.lit(x)) for x in ("2024-01-03", "2024-01-09"))
    return _tower(R.read_tower_shuttle(spark, path, 1.0, t_start=a, t_stop=b))


@query("tower_obs", sql="""
SELECT 'S-' || site AS site, (count(*) / 10e0) AS height, min(step // 48 + 2000)::BIGINT AS first_year, max(step // 48 + 2000)::BIGINT AS last_year FROM tower_obs GROUP BY site""")
def s12_site_survey(spark: SparkSession, d: str) -> DataFrame:
    year = F.floor(F.col("step") / 48) + 2000
    t = bind(spark, d, "tower_obs").groupBy("site").agg(F.concat_ws("~", F.min(year), F.max(year)).alias("years"), (F.count("*") / 10).alias("h"))
    row = F.concat_ws(" ", F.concat(F.lit("S-"), "site"), F.lit("ENF 50.1 10.2"), "years", F.col("h").cast("string"), F.lit("12"), *[F.lit(str(k)) for k in range(10)])
    path = scratch(spark, "site_infos")
    t.select(row.alias("value")).write.text(path)
    s = R.read_site_survey(spark, path)
    return s.select("site", F.col("measurement_height").alias("height"), F.col("first_year").cast("long").alias("first_year"), F.col("last_year").cast("long").alias("last_year"))


@query("tower_obs", sql="SELECT site, step, round(t2m, 6)+0e0 AS t2m FROM tower_obs")
def s13_s14_save_and_merge(spark: SparkSession, d: str) -> DataFrame:
    t, root = bind(spark, d, "tower_obs").select("site", "step", "t2m"), scratch(spark, "chunks")
    for k in SITES:
        R.save(t.where(F.col("site") == k), f"{root}-{k}")
    return R.merge_chunks(spark, [f"{root}-{k}" for k in SITES]).withColumn("t2m", r6("t2m"))


@query("tower_obs", sql="SELECT site, (hh * 1800)::BIGINT AS utc, round(round(t2m, 4) + 273.15e0, 6) AS t2m, round(round(ssrd, 4) * 3600, 6) AS ssrd FROM tower_obs")
def s06_local_met(spark: SparkSession, d: str) -> DataFrame:
    """Station files of all sites, read with their own column names."""
    path, out = scratch(spark, "station"), None
    t = bind(spark, d, "tower_obs")
    t.select("site", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("when"), F.round("t2m", 4).alias("T_air"), F.round("ssrd", 4).alias("Rad")).write.option("header", True).partitionBy("site").csv(path)
    for k in SITES:
        read = R.read_local_met(spark, f"{path}/site={k}", {"when": "datetime_utc", "T_air": "t2m", "Rad": "ssrd"}).withColumn("site", F.lit(k).cast("long"))
        out = read if out is None else out.unionByName(read)
    return out.select("site", F.unix_seconds("datetime_utc").alias("utc"), r6("t2m").alias("t2m"), r6("ssrd").alias("ssrd"))


@query("met_obs", sql="SELECT x, y, hour, round(t2m, 6) AS t2m FROM met_obs WHERE y BETWEEN 2 AND 6 AND (x >= 15 OR x <= 4) AND hour BETWEEN 2000 AND 30000")
def s07_met_grid(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "met_grid")
    m = bind(spark, d, "met_obs")
    m.select(F.col("hour").alias("valid_time"), F.col("y").alias("lat"), F.col("x").alias("lon"), "t2m", "ssrd").write.parquet(path)
    out = R.read_met_grid(spark, path, ["t2m"], (2, 6), (15, 4), 2000, 30000)
    return out.select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("valid_time").alias("hour"), r6("t2m").alias("t2m"))


@query("px_obs", sql="""
SELECT ok, ln, round((0.2e0 * 1e4 + l) * 1e-4, 9) AS nir, (epoch_us(scene_ts) + 4 * 86400000000)::BIGINT AS mid FROM (SELECT *, CAST(floor(nir * 100) AS INT) AS l FROM px_obs)""")
def s09_scene_files(spark: SparkSession, d: str) -> DataFrame:
    """Stored integers of a scene file, scaled while reading."""
    path = scratch(spark, "scenes")
    px = bind(spark, d, "px_obs")
    stored = (2000 + F.floor(F.col("nir") * 100)).cast("int")
    px.select("ok", "ln", "x", "y", F.col("scene_ts").alias("start"), F.timestamp_micros(F.unix_micros("scene_ts") + 8 * 86_400_000_000).alias("stop"), *[stored.alias(b) for b in M.PRODUCTS["modis"].bands]).write.parquet(path)
    out = R.read_scenes(spark, path, "modis")
    return out.select("ok", "ln", F.round("nir", 9).alias("nir"), F.unix_micros("scene_ts").alias("mid"))


@query("land_cover", sql=" UNION ALL ".join(
    f"SELECT '{p}' AS product, fx, fy, {'coalesce(CASE WHEN code % 10 <> 0 THEN code END, 8)' if p == 'mapbiomas' else 'CASE WHEN code % 10 <> 0 THEN code END'}::BIGINT AS code, {r}e0 AS resolution FROM land_cover" for p, r in R.LAND_COVER.items()))
def s10_land_cover_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of each product, read by the product's own rules."""
    path, out = scratch(spark, "land_cover"), None
    bind(spark, d, "land_cover").select("fx", "fy", F.when(F.col("code") % 10 != 0, F.col("code")).alias("code")).write.parquet(path)
    for product in R.LAND_COVER:
        read = R.read_land_cover(spark, path, product).select(F.lit(product).alias("product"), "fx", "fy", F.col("code").cast("long").alias("code"), "resolution")
        out = read if out is None else out.unionByName(read)
    return out


def _scene_archive(spark: SparkSession, d: str) -> DataFrame:
    """Stored integers in a file for each tile and month."""
    path = scratch(spark, "archive")
    px = bind(spark, d, "px_obs")
    tile = F.format_string("h%02dv%02d", F.floor(F.col("x") / 10), F.floor(F.col("y") / 5))
    px = px.select(tile.alias("tile"), F.date_format("scene_ts", "yyyyMM").alias("month"), F.col("scene_ts").alias("start"), F.timestamp_micros(F.unix_micros("scene_ts") + 8 * 86_400_000_000).alias("stop"), "x", "y", (2000 + F.floor(F.col("nir") * 100)).cast("int").alias("nir"))
    px.repartition("tile", "month").write.partitionBy("tile", "month").parquet(path)
    return A.read_scene_archive(spark, path, ["nir", "red"])


ARCHIVE = """
SELECT 'h' || lpad((x // 10)::VARCHAR, 2, '0') || 'v' || lpad((y // 5)::VARCHAR, 2, '0') AS tile, strftime(scene_ts, '%Y%m')::BIGINT AS month, count(*) AS n, sum(2000 + floor(nir * 100))::BIGINT AS nir, 0::BIGINT AS red
FROM px_obs {} GROUP BY 1, 2"""


def _by_month(px: DataFrame) -> DataFrame:
    return px.groupBy("tile", F.col("month").cast("long").alias("month")).agg(F.count("*").alias("n"), F.sum("nir").alias("nir"), F.count("red").alias("red"))


@query("px_obs", sql=ARCHIVE.format(""))
def s09_scene_archive(spark: SparkSession, d: str) -> DataFrame:
    """All files; none of them has the second band."""
    return _by_month(_scene_archive(spark, d))


@query("px_obs", sql=ARCHIVE.format("WHERE x >= 10 AND y < 5 AND year(scene_ts) = 1996 AND month(scene_ts) BETWEEN 4 AND 9"))
def s09_scene_archive_season(spark: SparkSession, d: str) -> DataFrame:
    """One tile and season: six of the archive's files are opened."""
    return _by_month(_scene_archive(spark, d).where("tile = 'h01v00' AND month BETWEEN 199604 AND 199609"))


@query("tower_obs", sql="""
SELECT 'DE-S' || lpad(site::VARCHAR, 2, '0') AS site, strftime(make_timestamp(hh * 1800000000), '%Y')::BIGINT AS year, strftime(make_timestamp(hh * 1800000000), '%Y%m%d%H%M')::BIGINT AS stamp, round(nee, 4)+0e0 AS nee FROM tower_obs""")
def s01_tower_archive(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file for each site and year."""
    t = bind(spark, d, "tower_obs")
    path = scratch(spark, "towers")
    name = F.concat(F.lit("FLX_DE-S"), F.lpad(F.col("site").cast("string"), 2, "0"), F.lit("_"), F.date_format("t", "yyyy"))
    t.select(name.alias("file"), F.date_format("t", "yyyyMMddHHmm").alias("TIMESTAMP_START"), F.round("nee", 4).alias("NEE_VUT_REF")).repartition("file").write.option("header", True).partitionBy("file").csv(path)
    read = A.read_tower_archive(spark, path, ["TIMESTAMP_START", "NEE_VUT_REF"])
    return read.select("site", F.col("year").cast("long").alias("year"), F.col("TIMESTAMP_START").alias("stamp"), (F.col("NEE_VUT_REF") + F.lit(0.0)).alias("nee"))
