"""Quality masks of satellite products as boolean columns, true where a pixel is affected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import any_bit, bits, col


def modis_bad(band: int, qc="qc_500m") -> Column:
    """Four quality bits for each band, any of them set."""
    return bits(qc, 4 * (band - 1) + 2, 4) != 0


def modis_clouds(state="state_qa") -> Column:
    """Cloudy, mixed or assumed clear; cloud shadow; cirrus; next to a cloud."""
    return (bits(state, 0, 2) != 0) | any_bit(state, 2) | (bits(state, 8, 2) != 0) | any_bit(state, 13)


def modis_snow(state="state_qa") -> Column:
    return any_bit(state, 12, 15)


def modis_water(state="state_qa") -> Column:
    """Everything but land."""
    return bits(state, 3, 3) != 1


def viirs_bad(band: int, qc="qc_500m") -> Column:
    """Of bands I1 and I2 only."""
    return bits(qc, 4 * band, 4) != 0 if band in (1, 2) else F.lit(False)


def viirs_clouds(state="state_qa") -> Column:
    return (bits(state, 0, 2) != 0) | any_bit(state, 2) | (bits(state, 8, 2) != 0)


def viirs_snow(state="state_qa") -> Column:
    return any_bit(state, 12)


def viirs_daily_bad(qf6="qf6") -> Column:
    return any_bit(qf6, 3, 4, 5)


def viirs_daily_clouds(qf1="qf1", qf2="qf2") -> Column:
    return (bits(qf1, 2, 2) != 0) | any_bit(qf2, 3)


def viirs_daily_snow(qf2="qf2") -> Column:
    return any_bit(qf2, 5)


def hls_mask(numbers: list[int], fmask="fmask") -> Column:
    return any_bit(fmask, *numbers)


def hls_aerosol(fmask="fmask") -> Column:
    return bits(fmask, 6, 2) == 3


def hls_bad(fmask="fmask") -> Column:
    return hls_mask([1, 2, 3, 4], fmask)


def hls_clouds(fmask="fmask") -> Column:
    return hls_mask([0, 1, 2, 3], fmask) | hls_aerosol(fmask)


def hls_snow(fmask="fmask") -> Column:
    return hls_mask([4], fmask)


def hls_water(fmask="fmask") -> Column:
    return hls_mask([5], fmask)


#: Scene classes of the ten-metre product.
SCL = {"bad": (0, 1, 2, 3, 7), "water": (6,), "non_vegetated": (5,), "clouds": (8, 9, 10), "snow": (11,)}


def scl(kind: str, c="scl") -> Column:
    return col(c).isin(*SCL[kind])


NEVER = lambda: F.lit(False)


@dataclass(frozen=True)
class Product:
    """What a product's masks are; bad is given a band's number, for bands with one."""

    bands: dict[str, int]
    bad: Callable[[int], Column]
    clouds: Callable[[], Column] = NEVER
    snow: Callable[[], Column] = NEVER
    water: Callable[[], Column] = NEVER
    non_vegetated: Callable[[], Column] = NEVER


PRODUCTS = {
    "modis": Product({"red": 1, "nir": 2, "blue": 3, "swir": 6}, modis_bad, modis_clouds, modis_snow, modis_water),
    "viirs": Product({"red": 1, "nir": 2, "swir": 3}, viirs_bad, viirs_clouds, viirs_snow),
    "viirs_daily": Product({"red": 1, "nir": 2, "swir": 3}, lambda _: viirs_daily_bad(), viirs_daily_clouds, viirs_daily_snow),
    "hls": Product({"red": 4, "nir": 5, "blue": 2, "swir": 6}, lambda _: hls_bad(), hls_clouds, hls_snow, hls_water),
    "sentinel2": Product({"red": 4, "nir": 8, "blue": 2, "swir": 11}, lambda _: scl("bad"), lambda: scl("clouds"), lambda: scl("snow"), lambda: scl("water"), lambda: scl("non_vegetated")),
}


def mask_bad(df: DataFrame, product: Product) -> DataFrame:
    """Bands with bad pixels missing; comes before index math."""
    return df.withColumns({b: F.when(~product.bad(k), F.col(b)) for b, k in product.bands.items() if b in df.columns})


def apply_masks(df: DataFrame, product: Product, values: list[str]) -> DataFrame:
    """Values missing under cloud, water or bare ground, and is_snow where only snow covers."""
    hidden = product.water() | product.non_vegetated() | product.clouds()
    return df.withColumn("is_snow", product.snow() & ~hidden).withColumns({v: F.when(~(hidden | product.snow()), F.col(v)) for v in values})


def dominant_water(df: DataFrame, water: Column, keys: list[str]) -> DataFrame:
    """Pixels that are water in most of their scenes."""
    return df.groupBy(*keys).agg((F.avg(water.cast("double")) > 0.5).alias("is_water"))
