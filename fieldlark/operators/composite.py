"""Eight-day composites, aligned to a start date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_of(ts: str, start: date, days: int = 8) -> Column:
    """The window's first date; windows are counted from ``start``."""
    n = F.floor(F.datediff(F.col(ts).cast("date"), F.lit(start)) / days).cast("int")
    return F.date_add(F.lit(start), n * days)


def composite(df: DataFrame, keys: list[str], bands: list[str], start: date, end: date, ts: str = "date", how: str = "median", days: int = 8) -> DataFrame:
    """Per key and window each band's median (or mean, sum, ...) and the number of images; ``end`` is exclusive."""
    day = F.col(ts).cast("date")
    held = df.where((day >= F.lit(start)) & (day < F.lit(end))).withColumn("window_start", window_of(ts, start, days))
    agg = {"mean": "avg"}.get(how, how)
    return held.groupBy(*keys, "window_start").agg(*[getattr(F, agg)(b).alias(b) for b in bands], F.count(F.lit(1)).alias("n_images"))


def by_pass(df: DataFrame, keys: list[str], bands: list[str], start: date, end: date, orbit: str = "pass", **kw) -> DataFrame:
    """Ascending and descending passes composited apart: the pass is one more key."""
    return composite(df, [*keys, orbit], bands, start, end, **kw)


def mosaic(df: DataFrame, keys: list[str], value: str, year: int, ts: str = "date") -> DataFrame:
    """The last value that isn't missing of a calendar year."""
    held = df.where((F.year(ts) == year) & F.col(value).isNotNull())
    return held.groupBy(*keys).agg(F.max_by(value, ts).alias(value))
