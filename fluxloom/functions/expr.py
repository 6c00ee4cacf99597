"""Null-aware helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def safe_divide(a, b, fill=None) -> Column:
    """a / b, and fill where that is no finite number."""
    q = F.try_divide(col(a), col(b))
    return q if fill is None else F.coalesce(q, num(fill))


def at_least(v, low) -> Column:
    """max(v, low), missing where v is missing."""
    v = col(v)
    return F.when(v.isNotNull(), F.greatest(v, num(low)))


def clip(v, low, high, to_null: bool = False) -> Column:
    """v held within [low, high], or missing outside of it."""
    v = col(v)
    if to_null:
        return F.when(v.between(num(low), num(high)), v)
    return F.when(v.isNotNull(), F.least(F.greatest(v, num(low)), num(high)))


def fill_missing(v, value: float, where: Column | None = None) -> Column:
    """Missing values, snow included, by a constant, in a selection."""
    v, hole = col(v), col(v).isNull()
    return F.when(hole if where is None else hole & where, num(value)).otherwise(v)


def sentinel(v, missing: float = -9999.0) -> Column:
    return F.nullif(col(v), F.lit(missing))


def bits(c, start: int, n: int = 1) -> Column:
    """The number in n bits of c from bit start on."""
    return F.shiftright(col(c).cast("long"), start).bitwiseAND(F.lit((1 << n) - 1))


def any_bit(c, *numbers: int) -> Column:
    return reduce(Column.__or__, [bits(c, b) == 1 for b in numbers])


def r6(c, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def half_up(c, digits: int = 6) -> Column:
    """Rounded, a half upwards, by arithmetic that every engine does alike."""
    scale = 10.0**digits
    return F.floor(col(c) * scale + 0.5) / scale


def exact_mean(v, unit: float = 2.0**-50) -> Column:
    """Mean in a group that doesn't depend on the order of its rows: values are counted in units, and
    sums of whole numbers are exact. A group with a value of 2**62 units or more has the plain mean."""
    v = col(v)
    whole = F.when(F.abs(v) < 2.0**62 * unit, F.floor(v / unit + 0.5).cast("decimal(20,0)"))
    return F.when(F.count(whole) == F.count(v), safe_divide(F.sum(whole).cast("double"), F.count(v)) * unit).otherwise(F.avg(v))
