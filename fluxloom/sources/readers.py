"""Readers and writers. Schemas are explicit; paths may be globs over many sites or dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import sentinel
from ..functions.physics import local_to_utc, midpoint

#: The columns of a half-hourly tower file that are read by default.
TOWER_COLUMNS = [
    "TIMESTAMP_START", "TIMESTAMP_END",
    "NEE_VUT_REF", "NEE_CUT_REF", "NEE_VUT_REF_QC", "NEE_CUT_REF_QC",
    "GPP_NT_VUT_REF", "GPP_NT_CUT_REF", "GPP_DT_VUT_REF", "GPP_DT_CUT_REF",
    "RECO_NT_VUT_REF", "RECO_DT_VUT_REF",
    "TA_F", "TA_F_QC", "SW_IN_F", "SW_IN_F_QC", "VPD_F", "WS", "P_F",
]
STAMPS = ("TIMESTAMP_START", "TIMESTAMP_END")

#: Sites of the Brazilian network (latitude, longitude, class).
BRAZIL = {
    "K67": (-2.857, -54.959, "EF"),
    "K77": (-3.0202, -54.8885, "CRO"),
    "K83": (-3.017, -54.9707, "EF"),
    "K34": (-2.6091, -60.2093, "EF"),
    "CAX": (-1.7483, -51.4536, "EF"),
    "FNS": (-10.7618, -62.3572, "GRA"),
    "RJA": (-10.078, -61.9331, "EF"),
    "BAN": (-9.824416667, -50.1591111, "EF"),
    "PDG": (-21.61947222, -47.6498889, "SH"),
}


def _csv(spark: SparkSession, path: str, columns: list[str] | str, skip: int = 0, mode: str = "PERMISSIVE") -> DataFrame:
    """CSV files with a header; the columns asked for, or all, as numbers, and the file's path. Files
    with lines before their header may each have columns of their own, found by name; others must
    agree in their header."""
    if skip:
        lines = spark.read.text(path, wholetext=False).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
        lines = lines.select(F.split("value", r"\s*,\s*").alias("parts"), F.col("_metadata.file_path").alias("_file"))
        is_header = F.array_contains(F.col("parts"), STAMPS[0])
        headers = lines.where(is_header).select("_file", F.col("parts").alias("header")).distinct()  # a row for each file
        names = sorted({c for r in headers.select("header").distinct().collect() for c in r["header"]})
        names = names if columns == "all" else [c for c in columns if c in names]
        rows = lines.where(~is_header).join(headers, "_file")
        at = lambda c: F.nullif(F.array_position("header", c), F.lit(0).cast("long"))
        raw = rows.select("_file", *[F.get("parts", (at(c) - 1).cast("int")).alias(c) for c in names])
    else:
        raw = spark.read.option("header", True).option("enforceSchema", False).option("mode", mode).csv(path)
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"))
        names = [c for c in raw.columns if c != "_file"] if columns == "all" else [c for c in columns if c in raw.columns]
    return raw.select("_file", *[F.col(c).cast("long" if c in STAMPS else "double").alias(c) for c in names])


def _finish(df: DataFrame, offset_hours: float, ssrd: str, t2m: str, site: str) -> DataFrame:
    numbers = [c for c, kind in df.dtypes if kind == "double"]
    df = df.withColumns({c: sentinel(c) for c in numbers}).withColumn("site", F.regexp_extract("_file", site, 1)).drop("_file")
    renames = {k: v for k, v in ((ssrd, "ssrd"), (t2m, "t2m")) if k in df.columns}
    return df.withColumnsRenamed(renames).withColumn("datetime_utc", local_to_utc("TIMESTAMP_END", F.lit(offset_hours)))


def read_tower_fluxnet(spark: SparkSession, path: str, offset_hours: float = 0.0, use_vars: list[str] | str = TOWER_COLUMNS, ssrd_key: str = "SW_IN_F", t2m_key: str = "TA_F", t_start=None, t_stop=None) -> DataFrame:
    """Half-hourly files FLX_<site>_...; both bounds given: inclusive window."""
    from ..operators.towers import fluxnet_window

    df = _finish(_csv(spark, path, use_vars), offset_hours, ssrd_key, t2m_key, r"FLX_([A-Za-z0-9-]+)_")
    return fluxnet_window(df, t_start, t_stop)


def read_tower_icos(spark: SparkSession, path: str, offset_hours: float = 0.0, use_vars: list[str] | str = TOWER_COLUMNS, ssrd_key: str = "SW_IN_F", t2m_key: str = "TA_F") -> DataFrame:
    """Files ICOSETC_<site>_...; malformed lines are skipped."""
    return _finish(_csv(spark, path, use_vars, mode="DROPMALFORMED"), offset_hours, ssrd_key, t2m_key, r"ICOSETC_([A-Za-z0-9-]+)_")


def read_tower_ameriflux(spark: SparkSession, path: str, offset_hours: float = 0.0, use_vars: list[str] | str = "all", ssrd_key: str = "SW_IN", t2m_key: str = "TA") -> DataFrame:
    """Files AMF_<site>_... with two lines before the header."""
    return _finish(_csv(spark, path, use_vars, skip=2), offset_hours, ssrd_key, t2m_key, r"AMF_([A-Za-z0-9-]+)_")


def read_tower_brazil(spark: SparkSession, path: str, site: str, offset_hours: float = 0.0) -> DataFrame:
    """White-space text with a header and a row of units; time from year, day of year and hour."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = lines.where(F.col("value").contains("Year")).first()["value"].split()
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("value").rlike(r"^\s*\d")).select(*[sentinel(parts[k].try_cast("double")).alias(c) for k, c in enumerate(header)])
    year, doy, hour = (F.col(next(c for c in header if c.startswith(p))) for p in ("Year", "DoY", "Hour"))
    start = F.unix_micros(F.make_timestamp(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    at = F.timestamp_micros((start + ((doy - 1) * 86400e6 + (hour - offset_hours) * 3600e6).cast("long")).cast("long"))
    lat, lon, cls = BRAZIL.get(site, (None, None, None))
    rows = rows.withColumns({"datetime_utc": at, "site": F.lit(site), "lat": F.lit(lat).cast("double"), "lon": F.lit(lon).cast("double"), "veg_class": F.lit(cls).cast("string")})
    celsius = next((c for c in header if c.startswith("Tair")), None)
    return rows.withColumn("t2m", F.col(celsius) - 273.15) if celsius else rows


def read_tower_shuttle(spark: SparkSession, path: str, offset_hours: float = 0.0, met: DataFrame | None = None, t_start=None, t_stop=None) -> DataFrame:
    """Half-open window, each bound by itself; weather joined on the nearest hour, blh as PBLH."""
    from ..operators.towers import fluxnet_window, met_at_towers

    df = _finish(_csv(spark, path, "all"), offset_hours, "SW_IN_F", "TA_F", r"_([A-Z]{2}-[A-Za-z0-9]+)_")
    df = fluxnet_window(df, t_start, t_stop, half_open=True)
    if met is not None:
        df = met_at_towers(df, met, ["site"], ts="datetime_utc").withColumnRenamed("blh", "PBLH")
    return df


def local_met_units(df: DataFrame) -> DataFrame:
    """Station weather in the units of a reanalysis: kelvin, and J/m2 over an hour."""
    return df.withColumns({"t2m": F.col("t2m") + 273.15, "ssrd": F.col("ssrd") * 3600})


def read_local_met(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A station CSV (columns renamed by `names` to datetime_utc, t2m, ssrd)."""
    df = spark.read.option("header", True).csv(path).withColumnsRenamed(names)
    return local_met_units(df.select(F.to_timestamp("datetime_utc").alias("datetime_utc"), *[F.col(c).cast("double") for c in ("t2m", "ssrd")]))


def read_met_grid(spark: SparkSession, path: str, keys: list[str], lat=None, lon=None, t0=None, t1=None) -> DataFrame:
    """Weather on a grid from Parquet: the keys asked for, narrowed while reading."""
    from ..operators.spatial import met_select

    return met_select(spark.read.parquet(path).select("valid_time", "lat", "lon", *keys), lat, lon, t0, t1)


#: Factors that turn stored integers into reflectance.
SCALE = {"modis": 1e-4, "viirs": 1e-4, "viirs_daily": 1e-4, "hls": 1.0, "sentinel2": 1e-4}


def scene_time(product: str, start="start", stop="stop"):
    """Midpoint of a scene's range; noon for daily scenes."""
    if product == "viirs_daily":
        return F.timestamp_micros(F.unix_micros(F.to_timestamp(F.to_date(start))) + 12 * 3_600_000_000)
    return midpoint(start, stop)


def read_scenes(spark: SparkSession, path: str, product: str) -> DataFrame:
    """Long-format pixels of a product (Parquet with start, stop, x, y, bands and flags)."""
    from ..functions.masks import PRODUCTS

    return scaled_scenes(spark.read.parquet(path), product, [b for b in PRODUCTS[product].bands])


def scaled_scenes(df: DataFrame, product: str, bands: list[str]) -> DataFrame:
    return df.withColumns({b: F.col(b) * SCALE[product] for b in bands if b in df.columns} | {"scene_ts": scene_time(product)})


#: Land-cover products and their resolution in metres.
LAND_COVER = {"copernicus": 92.2, "esa_world_cover": 10.0, "mapbiomas": 30.0, "city": 10.0, "synmap": 1000.0}


def land_cover_codes(df: DataFrame, product: str) -> DataFrame:
    """Codes of a product with its resolution; a missing code is class 8 where the product says so."""
    code = F.coalesce("code", F.lit(8)) if product == "mapbiomas" else F.col("code")
    return df.withColumns({"code": code.cast("int"), "resolution": F.lit(LAND_COVER[product])})


def read_land_cover(spark: SparkSession, path: str, product: str) -> DataFrame:
    return land_cover_codes(spark.read.parquet(path), product)


def read_site_survey(spark: SparkSession, path: str) -> DataFrame:
    """217 sites of a space-separated table; the header does not fit the rows and is ignored."""
    names = "site igbp lat lon years measurement_height canopy_height".split()
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("Site_name")).select(*[parts[k].alias(n) for k, n in enumerate(names)], *[parts[k].try_cast("double").alias(f"m{k}") for k in range(7, 17)])
    rows = rows.withColumns({n: F.col(n).try_cast("double") for n in names if n not in ("site", "igbp", "years")})
    return rows.withColumns({"first_year": F.split("years", "~")[0].try_cast("int"), "last_year": F.element_at(F.split("years", "~"), -1).try_cast("int")})


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chunk outputs as one table."""
    return spark.read.parquet(*paths)
