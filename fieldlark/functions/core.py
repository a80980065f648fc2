"""Null-safe helpers. A missing value is NULL throughout; NaN is made NULL on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def finite(c) -> Column:
    """NaN and infinities as NULL."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(c, lo=None, hi=None) -> Column:
    """Bounds that leave NULL alone (``least`` and ``greatest`` would not)."""
    x = col(c)
    out = None
    if lo is not None:
        out = F.when(x < lo, F.lit(float(lo)))
    if hi is not None:
        out = F.when(x > hi, F.lit(float(hi))) if out is None else out.when(x > hi, F.lit(float(hi)))
    return out.otherwise(x)


def at_least(c, lo) -> Column:
    return F.when(col(c) < lo, F.lit(float(lo))).otherwise(col(c))


def safe_divide(num, den, eps: float = EPS) -> Column:
    """NULL where the denominator is within ``eps`` of zero."""
    return F.when(F.abs(col(den)) >= eps, col(num) / col(den))


def normalised(num, den, bounded: bool = True) -> Column:
    """A safe ratio, clipped to [0, 1]."""
    r = safe_divide(num, den)
    return clip(r, 0.0, 1.0) if bounded else r


def lookup(table: dict, key: Column) -> Column:
    """A small fixed table as a map expression; NULL for an unknown key."""
    from itertools import chain

    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def required(value: Column, message: str) -> Column:
    """Raises at run time where ``value`` is NULL."""
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)
