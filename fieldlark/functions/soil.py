"""Soil water: capacity, stress, effective rain, and one step of the soil water index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import at_least, clip, col


def total_available(fc, wp, zr) -> Column:
    return 1000.0 * (col(fc) - col(wp)) * col(zr)


def readily_available(taw, p) -> Column:
    return col(p) * col(taw)


def total_evaporable(fc, wp, ze: float = 0.10) -> Column:
    return 1000.0 * (col(fc) - 0.5 * col(wp)) * ze


def stress_coefficient(dr, taw, p) -> Column:
    share = clip(p, 0.0, 0.999999)
    room = (1.0 - share) * col(taw)
    return F.when(col(taw) <= 0, 1.0).when(col(dr) <= share * col(taw), 1.0).otherwise(clip((col(taw) - col(dr)) / F.when(col(taw) > 0, room), 0.0, 1.0))


def rain_usda_monthly(p) -> Column:
    x = col(p)
    return at_least(F.when(x <= 250, x * (125.0 - 0.2 * x) / 125.0).otherwise(125.0 + 0.1 * x), 0.0)


def runoff_cn(p, number=75.0) -> Column:
    s = 25400.0 / clip(number, 1.0, 100.0) - 254.0
    start = 0.2 * s
    x = col(p)
    return F.when(x > start, (x - start) * (x - start) / (x - start + s)).otherwise(F.lit(0.0))


def rain_cn(p, number=75.0) -> Column:
    return at_least(col(p) - runoff_cn(p, number), 0.0)


def swi_step(ssm, days, previous, t_char: float = 5.0) -> Column:
    """The first value as it is; then a gain that takes the one before as 1."""
    gain = 1.0 / (1.0 + F.exp(-at_least(days, 0.0) / t_char))
    return F.when(col(previous).isNull(), col(ssm)).otherwise(col(previous) + gain * (col(ssm) - col(previous)))
