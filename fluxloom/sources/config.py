"""Class configuration and fixed product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_class_config(spark: SparkSession, config: str | dict) -> tuple[DataFrame, DataFrame]:
    """lc_map (code, veg_class) and temp_coef (veg_class, tmin, topt, tmax, tlow) of a YAML file or
    mapping name -> {veg_class, class_numbers, tmin, topt, tmax, tlow}. A code listed twice
    keeps its last class; entries without tmin give no coefficients; tlow defaults to tmin."""
    if isinstance(config, str):
        import yaml

        with open(config) as f:
            config = yaml.safe_load(f)
    codes, coefficients = {}, {}
    for entry in config.values():
        cls = int(entry["veg_class"])
        codes.update((int(c), cls) for c in entry["class_numbers"])
        if "tmin" in entry:
            coefficients[cls] = tuple(float(entry.get(k, entry["tmin"])) for k in ("tmin", "topt", "tmax", "tlow"))
    if chained := [c for c in codes if c in codes.values() and codes[c] != c]:
        raise ValueError(f"codes that are classes too: {chained}")
    lc_map = spark.createDataFrame(list(codes.items()), "code int, veg_class int")
    return lc_map, spark.createDataFrame([(c, *v) for c, v in coefficients.items()], "veg_class int, tmin double, topt double, tmax double, tlow double")


#: Products, their cadence, file extension, and what they hold.
PRODUCTS = [
    ("MCD19A1", "daily", ".hdf", "MAIAC surface BRF"),
    ("MCD19A2", "daily", ".hdf", "MAIAC aerosol"),
    ("MOD09GA", "daily", ".hdf", "Terra surface reflectance"),
    ("MYD09GA", "daily", ".hdf", "Aqua surface reflectance"),
    ("MOD04_L2", "daily", ".hdf", "Terra aerosol"),
    ("MYD04_L2", "daily", ".hdf", "Aqua aerosol"),
    ("MCD43A4", "daily", ".hdf", "BRDF-adjusted reflectance"),
    ("MCD43C4", "daily", ".hdf", "BRDF-adjusted reflectance, climate grid"),
    ("MOD09A1", "8day", ".hdf", "Terra surface reflectance"),
    ("MYD09A1", "8day", ".hdf", "Aqua surface reflectance"),
    ("MOD13A1", "16day", ".hdf", "Terra vegetation indices"),
    ("MYD13A1", "16day", ".hdf", "Aqua vegetation indices"),
    ("MOD13A2", "16day", ".hdf", "Terra vegetation indices, 1 km"),
    ("MCD12Q1", "yearly", ".hdf", "land cover"),
]

#: Weather keys, their parameter number and stream.
MET_KEYS = [
    ("ssrd", 169, "sf12"),
    ("t2m", 167, "sf00"),
    ("sp", 134, "sf00"),
    ("tcc", 164, "sf00"),
    ("stl1", 139, "sf00"),
    ("stl2", 170, "sf00"),
    ("stl3", 183, "sf00"),
    ("swvl1", 39, "sf00"),
    ("swvl2", 40, "sf00"),
    ("swvl3", 41, "sf00"),
    ("swvl4", 42, "sf00"),
    ("2d", 168, "sf00"),
    ("tp", 228, "sf12"),
    ("src", 198, "sf00"),
    ("q", 133, "ml00"),
    ("e", 182, "sf12"),
    ("sst", 34, "sf00"),
]


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, "product string, cadence string, file_ext string, notes string")


def product_info(asked: DataFrame) -> DataFrame:
    """Cadence and extension of products (column product); 8-day .hdf where unknown."""
    known = products(asked.sparkSession).drop("notes")
    joined = asked.join(F.broadcast(known), "product", "left")
    return joined.withColumns({"cadence": F.coalesce("cadence", F.lit("8day")), "file_ext": F.coalesce("file_ext", F.lit(".hdf"))})


def met_key_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MET_KEYS, "key string, param int, stream string")


def met_files(times: DataFrame, keys: list[str], step: str = "1H") -> DataFrame:
    """File names that hold the keys at the dates of times (column date): a file for each day
    (1H), month (1D) or year (1M)."""
    catalog = met_key_catalog(times.sparkSession).where(F.col("key").isin(keys))
    fmt = {"1H": "yyyy-MM-dd", "1D": "yyyy-MM", "1M": "yyyy"}[step]
    stamps = times.select(F.date_format("date", fmt).alias("stamp")).distinct()
    name = F.format_string("%03d/E5%s_%s_%s_%03d.grb", "param", "stream", F.lit(step), "stamp", "param")
    return stamps.crossJoin(F.broadcast(catalog)).select("key", "stamp", name.alias("file"))


def expected_dates(spark: SparkSession, asked: DataFrame, start: str, end: str) -> DataFrame:
    """Dates on which products (columns product, cadence) have files; each cadence begins anew on
    the first of January."""
    days = asked.withColumn("date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    doy = F.dayofyear("date") - 1
    step = F.when(F.col("cadence") == "8day", doy % 8).when(F.col("cadence") == "16day", doy % 16).when(F.col("cadence") == "yearly", doy).otherwise(0)
    return days.where(step == 0)


def tile_year_tasks(dates: DataFrame, tiles: DataFrame) -> DataFrame:
    """Distinct years and products for each tile."""
    return dates.select("product", F.year("date").cast("long").alias("year")).distinct().crossJoin(F.broadcast(tiles))


def extract_granules(listing: DataFrame, product: str, date, tile: str, html: str = "html") -> DataFrame:
    """Granule names of a listing in order of first appearance: name, pos."""
    stamp = date.strftime("%Y%j")
    pattern = rf"(?i){product}\.A{stamp}\.{tile}\.[\w.]*?\.hdf"
    names = listing.select(F.posexplode(F.regexp_extract_all(html, F.lit(pattern), 0)).alias("pos", "name"))
    return names.groupBy("name").agg(F.min("pos").alias("pos"))


def missing_granules(expected: DataFrame, have: DataFrame) -> DataFrame:
    return expected.join(have, "name", "left_anti")


def latest_version(granules: DataFrame) -> DataFrame:
    """Of the files of a product, day and tile that with the greatest processing stamp."""
    part = lambda k: F.split("name", r"\.")[k]
    return granules.groupBy(part(0).alias("product"), part(1).alias("day"), part(2).alias("tile")).agg(F.max_by("name", F.struct(part(4), F.col("name"))).alias("name"))


def select_days(days: DataFrame, today, enddate, delta: int) -> DataFrame:
    """The newest `delta` days not after today, without those before enddate."""
    return days.where(F.col("date") <= F.lit(today)).orderBy(F.desc("date")).limit(delta).where(F.col("date") >= F.lit(enddate))

