"""Meteorology, radiation, geometry and time expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import at_least, clip, col, safe_divide

#: Radius of the sinusoidal grid's sphere and width of one of its 36 tiles in metres.
RADIUS = 6371007.181
TILE = 2 * math.pi * RADIUS / 36
#: Displacement height as a share of the canopy height by land-cover class.
DISPLACEMENT = {"ENF": 0.68, "EBF": 0.68, "DBF": 0.68, "DNF": 0.68, "MF": 0.68, "WSA": 0.5, "SAV": 0.3, "CSH": 0.4, "OSH": 0.15}


def saturation_pressure(t) -> Column:
    """kPa over water at t degrees Celsius."""
    t = col(t)
    return 6.1078 * F.exp(17.27 * t / (t + 237.3)) / 10


def vapour_pressure(dew_point) -> Column:
    return saturation_pressure(dew_point)


def vpd(t, dew_point) -> Column:
    return saturation_pressure(t) - vapour_pressure(dew_point)


def vpd_decorrelated(t, dew_point) -> Column:
    return safe_divide(vpd(t, dew_point), saturation_pressure(t))


def vpd_decorrelated_log(t, dew_point) -> Column:
    return F.ln(at_least(vpd(t, dew_point), 0.01)) - F.ln(saturation_pressure(t))


def vpd_to_rh(vpd_hpa, t) -> Column:
    """Relative humidity in percent from the deficit in hPa."""
    t = col(t)
    es = 0.6108 * F.exp(17.27 * t / (t + 237.3))
    return clip(100 * safe_divide(es - col(vpd_hpa) / 10, es), 0, 100)


def par(ssrd, reanalysis: bool = False) -> Column:
    """Photosynthetic radiation from W/m2, or from J/m2 accumulated over an hour."""
    return col(ssrd) / 0.505 / 3600 if reanalysis else col(ssrd) / 0.505


def met_scaling(name: str, v) -> Column:
    return col(v) / {"ssrd": 1000.0, "SWC": 10.0}.get(name, 1.0)


def obukhov_length(pressure, t_kelvin, ustar, heat_flux) -> Column:
    """Obukhov length in metres; only within (-1000, 1000)."""
    density = 1000 * col(pressure) / (287.05 * col(t_kelvin))
    length = safe_divide(-density * 1004 * col(t_kelvin) * F.pow(col(ustar), 3), 0.4 * 9.81 * col(heat_flux))
    return F.when((length > -1000) & (length < 1000), length)


def stability(z, length) -> Column:
    return safe_divide(z, length)


def valid_stability(zl, strict: bool = False) -> Column:
    return col(zl) > 0 if strict else (col(zl) > -1000) & (col(zl) < 1000)


def displacement_height(igbp, canopy, z) -> Column:
    """Share of the canopy height by class; z for classes without one."""
    share = F.create_map(*[F.lit(x) for pair in DISPLACEMENT.items() for x in pair])
    return F.coalesce(F.try_element_at(share, col(igbp)) * col(canopy), col(z))


def lon180(lon) -> Column:
    return F.when(col(lon) > 180, col(lon) - 360).otherwise(col(lon))


def lon360(lon) -> Column:
    return F.when(col(lon) < 0, col(lon) + 360).otherwise(col(lon))


def sinusoidal(lon, lat) -> tuple[Column, Column]:
    phi = F.radians(col(lat))
    return RADIUS * F.radians(col(lon)) * F.cos(phi), RADIUS * phi


def sinusoidal_inverse(x, y) -> tuple[Column, Column]:
    lat = F.degrees(col(y) / RADIUS)
    return F.degrees(safe_divide(col(x), RADIUS * F.cos(F.radians(lat)))), lat


def lonlat_to_tile(lon, lat) -> tuple[Column, Column]:
    x, y = sinusoidal(lon, lat)
    return (18 + x / TILE).cast("int"), (9 - y / TILE).cast("int")


def tile3deg_name(lat, lon) -> Column:
    """Name of the three-degree tile by its south-west corner, such as N48E009."""
    a, o = ((F.floor(col(c) / 3) * 3).cast("int") for c in (lat, lon))
    return F.format_string("%s%02d%s%03d", F.when(a >= 0, "N").otherwise("S"), F.abs(a), F.when(o >= 0, "E").otherwise("W"), F.abs(o))


def local_to_utc(stamp, offset_hours) -> Column:
    """yyyyMMddHHmm in local standard time to UTC; the offset never follows summer time."""
    local = F.try_to_timestamp(col(stamp).cast("string"), F.lit("yyyyMMddHHmm"))
    return F.timestamp_micros(F.unix_micros(local) - (col(offset_hours) * 3600e6).cast("long"))


def midpoint(a, b) -> Column:
    return F.timestamp_micros(F.floor((F.unix_micros(col(a)) + F.unix_micros(col(b))) / 2))


def days_between(a, b, rounded: bool = False) -> Column:
    """Days from b to a: whole ones, or rounded."""
    days = (F.unix_micros(col(a)) - F.unix_micros(col(b))) / 86400e6
    return (F.round(days) if rounded else F.floor(days)).cast("long")


def observation_day(doy, start, stop) -> Column:
    """Date of a pixel's observation from its day of year: counted from the nearer of the
    scene's start and stop, the stop in a tie; the start if it is missing."""
    d, s, e = col(doy), F.dayofyear(col(start)), F.dayofyear(col(stop))
    near = F.abs(d - s) < F.abs(d - e)
    return F.when(d.isNull(), F.to_date(col(start))).when(near, F.date_add(F.to_date(col(start)), (d - s).cast("int"))).otherwise(F.date_add(F.to_date(col(stop)), (d - e).cast("int")))
