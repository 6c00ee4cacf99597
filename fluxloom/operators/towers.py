"""Eddy-covariance tower tables: metadata, measurement heights, joins with fluxes and weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import at_least, sentinel


def clean_sentinels(df: DataFrame, missing: float = -9999.0) -> DataFrame:
    """The sentinel is missing in every numeric column."""
    numeric = {f.name: f.dataType for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long")}
    return df.withColumns({c: sentinel(c, missing).cast(t) for c, t in numeric.items()})


def cut_window(df: DataFrame, t0, t1, ts: str = "datetime_utc") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(t0), F.lit(t1)))


def qc_filter(df: DataFrame, flags: list[int], qc: str = "NEE_QC") -> DataFrame:
    return df.where(F.col(qc).isin(flags))


def train_rows(df: DataFrame, qc: str = "qc", nee: str = "nee", ssrd: str = "ssrd") -> DataFrame:
    """Best quality, without uptake in the dark."""
    return df.where((F.col(qc) == 0) & ~((F.col(nee) < 0) & (F.col(ssrd) == 0)))


def bif_pivot(bif: DataFrame, variables: list[str]) -> DataFrame:
    """Site metadata from rows (site, GROUP_ID, VARIABLE, DATAVALUE): one column a variable, the
    value of the lowest group."""
    one = lambda v: F.min_by("DATAVALUE", F.when(F.col("VARIABLE") == v, F.col("GROUP_ID"))).alias(v)
    return bif.groupBy("site").agg(*[one(v) for v in variables])


def bif_group(bif: DataFrame, value: str, variables: list[str]) -> DataFrame:
    """Variables of those groups that hold a value, such as the heights of one flux."""
    groups = bif.where(F.col("DATAVALUE") == value).select("site", "GROUP_ID").distinct()
    members = bif.join(groups, ["site", "GROUP_ID"], "left_semi")
    return members.groupBy("site", "GROUP_ID").agg(*[F.max(F.when(F.col("VARIABLE") == v, F.col("DATAVALUE"))).alias(v) for v in variables])


def height_periods(heights: DataFrame) -> DataFrame:
    """Periods (site, height, since, until) of heights (site, date, height); the first one holds
    for all times before, too."""
    w = Window.partitionBy("site").orderBy("date")
    since = F.when(F.row_number().over(w) > 1, F.col("date"))
    return heights.select("site", "height", since.alias("since"), F.lead("date").over(w).alias("until"))


def with_height(obs: DataFrame, heights: DataFrame, ts: str = "t") -> DataFrame:
    """As-of join: the last height whose date is not after the row."""
    periods = height_periods(heights)
    holds = (F.col("since").isNull() | (F.col(ts) >= F.col("since"))) & (F.col("until").isNull() | (F.col(ts) < F.col("until")))
    periods = periods.withColumnRenamed("site", "_site")
    return obs.join(periods, (F.col("site") == F.col("_site")) & holds, "left").drop("_site", "since", "until")


def displacement_by_period(obs: DataFrame, heights: DataFrame, zl: str = "zl", length: str = "mo_length", ts: str = "t") -> DataFrame:
    """Measurement height over ground per height period: max(0, mean(ZL * L)). Periods are closed
    on both ends, a row on a common end belongs to the later."""
    rows = with_height(obs, heights, ts)
    valid = sentinel(zl) * sentinel(length)
    means = rows.groupBy("site", "height").agg(at_least(F.avg(valid), 0).alias("z_footprint"))
    return rows.join(means, ["site", "height"], "left")


def with_fluxes(obs: DataFrame, fluxes: DataFrame, keys: list[str]) -> DataFrame:
    return obs.join(fluxes, keys, "inner")


def footprint_times(obs: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """All footprint times; missing weather stays missing."""
    return obs.join(times, keys, "right")


def nearest_hour(ts: str) -> Column:
    """The full hour nearest to a time, the earlier of equals: the key of an hourly grid."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / 3_600_000_000 - 0.5) * 3600)


def met_at_towers(obs: DataFrame, met: DataFrame, keys: list[str], ts: str = "t", met_ts: str = "valid_time") -> DataFrame:
    return obs.withColumn(met_ts, nearest_hour(ts)).join(met, [*keys, met_ts], "left")


def common_times(base: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are valid in all other sets."""
    for other in others:
        base = base.join(other, keys, "left_semi")
    return base


def fetch_percentiles(fluxes: DataFrame) -> DataFrame:
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return fluxes.groupBy("site").agg(F.percentile(positive("fetch_50"), 0.9).alias("fetch_50_p90"), F.percentile(positive("fetch_90"), 0.5).alias("fetch_90_p50"))


def times_per_year(df: DataFrame, ts: str = "t") -> DataFrame:
    return df.groupBy(F.year(ts).cast("long").alias("year")).agg(F.count("*").alias("n"))


def equalise_sites(df: DataFrame, key: str = "t", seed: str = "42") -> DataFrame:
    """A hash-random subsample of each site as long as the shortest site of its class."""
    rank = F.row_number().over(Window.partitionBy("cls", "site").orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key))
    sizes = df.groupBy("cls", "site").agg(F.count("*").alias("_n")).groupBy("cls").agg(F.min("_n").alias("_least"))
    return df.withColumn("_rank", rank).join(F.broadcast(sizes), "cls").where("_rank <= _least").drop("_rank", "_least")


def fluxnet_window(df: DataFrame, t0=None, t1=None, half_open: bool = False, ts: str = "datetime_utc") -> DataFrame:
    """Inclusive if both bounds are given, else everything; half-open: each bound by itself."""
    if half_open:
        df = df if t0 is None else df.where(F.col(ts) >= F.lit(t0))
        return df if t1 is None else df.where(F.col(ts) < F.lit(t1))
    return df if t0 is None or t1 is None else cut_window(df, t0, t1, ts)
