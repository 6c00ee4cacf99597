"""Vegetation indices of reflectance columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import clip, col, safe_divide


def _normalised(a, b) -> Column:
    return safe_divide(col(a) - col(b), col(a) + col(b))


def ndvi(nir="nir", red="red") -> Column:
    return _normalised(nir, red)


def nirv(nir="nir", red="red") -> Column:
    return ndvi(nir, red) * col(nir)


def ndre(nir="nir", red_edge="red_edge") -> Column:
    return _normalised(nir, red_edge)


def ndwi(nir="nir", swir="swir") -> Column:
    """The band is an argument: pass the red band for the variant computed with it."""
    return _normalised(nir, swir)


def lswi(nir="nir", swir="swir") -> Column:
    return _normalised(nir, swir)


def evi(nir="nir", red="red", blue="blue") -> Column:
    """Enhanced vegetation index; values outside [0, 1] are missing."""
    n, r, b = col(nir), col(red), col(blue)
    return clip(safe_divide(2.5 * (n - r), n + 6 * r - 7.5 * b + 1), 0, 1, to_null=True)


def evi2(nir="nir", red="red") -> Column:
    n, r = col(nir), col(red)
    return safe_divide(2.5 * (n - r), n + 2.4 * r + 1)


INDICES = {
    "ndvi": lambda b: ndvi(b["nir"], b["red"]),
    "nirv": lambda b: nirv(b["nir"], b["red"]),
    "ndre": lambda b: ndre(b["nir"], b["red_edge"]),
    "ndwi": lambda b: ndwi(b["nir"], b["swir"]),
    "lswi": lambda b: lswi(b["nir"], b["swir"]),
    "evi": lambda b: evi(b["nir"], b["red"], b["blue"]),
    "evi2": lambda b: evi2(b["nir"], b["red"]),
}
BANDS = {b: b for b in ("nir", "red", "blue", "swir", "red_edge")}


def add_indices(df: DataFrame, names: list[str], bands: dict[str, str] = BANDS) -> DataFrame:
    """Add indices in one projection; an unknown name is an error."""
    if unknown := set(names) - INDICES.keys():
        raise ValueError(f"unknown indices: {sorted(unknown)}")
    return df.withColumns({n: INDICES[n](bands) for n in names})


def drop_bands(df: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Without the reflectance bands, or those named."""
    return df.drop(*(bands or BANDS.values()))


def with_kept_snow(value: Column, snow: Column) -> Column:
    return F.when(~F.coalesce(snow, F.lit(False)), value)
