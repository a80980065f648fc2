"""Crop coefficients and growth stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import clip, col, lookup

#: Stage lengths in days, Kc of the initial, middle and end stage, root depth (m), depletion share, ponded.
CROPS = {
    "rice": ([30, 30, 60, 30], 1.05, 1.20, 0.90, 0.50, 0.20, True),
    "wheat": ([30, 40, 40, 30], 0.30, 1.15, 0.30, 1.50, 0.55, False),
    "maize": ([30, 40, 50, 30], 0.30, 1.20, 0.50, 1.00, 0.55, False),
    "cotton": ([30, 50, 60, 55], 0.35, 1.18, 0.60, 1.35, 0.65, False),
    "sugarcane": ([35, 60, 190, 120], 0.40, 1.25, 0.75, 1.50, 0.65, False),
    "pulses": ([20, 30, 35, 20], 0.40, 1.15, 0.35, 0.70, 0.45, False),
}
#: Other names of stages.
STAGE_NAMES = {
    "initial": "ini", "ini": "ini", "development": "dev", "dev": "dev", "crop_development": "dev",
    "mid": "mid", "mid-season": "mid", "mid_season": "mid", "midseason": "mid", "flowering": "mid", "reproductive": "mid",
    "late": "late", "late-season": "late", "late_season": "late", "maturity": "late", "senescence": "late",
}
#: Base temperature and degree-day sums at the end of the first four stages.
DEGREE_DAYS = {
    "wheat": (4.5, [200.0, 700.0, 1400.0, 1900.0]),
    "rice": (10.0, [250.0, 750.0, 1500.0, 2000.0]),
    "maize": (10.0, [250.0, 800.0, 1500.0, 2100.0]),
    "cotton": (15.0, [300.0, 1000.0, 1900.0, 2600.0]),
    "sugarcane": (12.0, [400.0, 1500.0, 3500.0, 4500.0]),
    "soybean": (10.0, [200.0, 650.0, 1300.0, 1700.0]),
    "mustard": (5.0, [180.0, 550.0, 1100.0, 1500.0]),
    "default": (10.0, [250.0, 800.0, 1500.0, 2000.0]),
}
STAGES = ("initial", "development", "mid-season", "late-season", "mature")
CROP_SCHEMA = "crop string, stage_lengths array<int>, kc_ini double, kc_mid double, kc_end double, zr_m double, depletion_p double, ponded boolean"


def crops(spark: SparkSession, table: dict | None = None) -> DataFrame:
    """The crop table (a handful of rows); four stage lengths each are required."""
    rows = CROPS if table is None else table
    for name, r in rows.items():
        if len(r[0]) != 4:
            raise ValueError(f"{name}: four stage lengths are needed")
    return spark.createDataFrame([(k, *v) for k, v in sorted(rows.items())], CROP_SCHEMA)


def with_crop(df: DataFrame, crop: str = "crop", table: DataFrame | None = None) -> DataFrame:
    """Adds the crop table's columns by a case-insensitive name; the fixed table is broadcast."""
    dim = (crops(df.sparkSession) if table is None else table).withColumnRenamed("crop", "__crop")
    return df.join(F.broadcast(dim), F.lower(F.col(crop)) == F.col("__crop"), "left").drop("__crop")


def stage_name(stage) -> Column:
    return lookup(STAGE_NAMES, F.lower(F.trim(col(stage))))


def kc_for_stage(stage) -> Column:
    s = stage_name(stage)
    return F.when(s == "ini", F.col("kc_ini")).when(s == "dev", (F.col("kc_ini") + F.col("kc_mid")) / 2.0).when(s == "mid", F.col("kc_mid")).when(s == "late", F.col("kc_end"))


def _ends() -> list[Column]:
    """Last day of each stage."""
    n = [F.element_at("stage_lengths", i + 1) for i in range(4)]
    return [n[0], n[0] + n[1], n[0] + n[1] + n[2], n[0] + n[1] + n[2] + n[3]]


def stage_for_day(das) -> Column:
    """A stage's last day belongs to it."""
    d, e = col(das), _ends()
    return F.when(d <= e[0], "ini").when(d <= e[1], "dev").when(d <= e[2], "mid").when(d.isNotNull(), "late")


def kc_curve(das) -> Column:
    """Flat, rising, flat, falling, then the end value."""
    d, (a, b, c, e) = col(das).cast("double"), _ends()
    along = lambda lo, hi: F.when(hi > lo, (d - lo) / F.when(hi > lo, hi - lo)).otherwise(F.lit(0.0))
    ini, mid, end = F.col("kc_ini"), F.col("kc_mid"), F.col("kc_end")
    return F.when(d <= a, ini).when(d <= b, ini + (mid - ini) * along(a, b)).when(d <= c, mid).when(d <= e, mid + (end - mid) * along(c, e)).when(d.isNotNull(), end)


def kc_from_ndvi(ndvi, a: float = 1.457, b: float = -0.1725, lo: float = 0.0, hi: float = 1.3) -> Column:
    return clip(a * col(ndvi) + b, lo, hi)


def kc_from_ndvi_server(ndvi) -> Column:
    return kc_from_ndvi(ndvi, 1.45, -0.10, 0.15, 1.20)


def kc_climate(kc_mid, u2, rh_min, height_m) -> Column:
    h = clip(height_m, 0.1, 10.0)
    return col(kc_mid) + (0.04 * (col(u2) - 2.0) - 0.004 * (clip(rh_min, 20.0, 80.0) - 45.0)) * F.pow(h / 3.0, F.lit(0.3))


def degree_day_stage(gdd, crop) -> Column:
    """A bound belongs to the next stage; an unknown crop takes the default bounds."""
    key = F.lower(col(crop))
    bounds = F.coalesce(
        F.try_element_at(F.create_map(*[x for k, v in DEGREE_DAYS.items() for x in (F.lit(k), F.array(*map(F.lit, v[1])))]), key),
        F.array(*map(F.lit, DEGREE_DAYS["default"][1])),
    )
    passed = F.size(F.filter(bounds, lambda b: b <= col(gdd)))
    return F.when(col(gdd).isNotNull(), F.element_at(F.array(*map(F.lit, STAGES)), passed + 1))


def stage_intervals(spark: SparkSession) -> DataFrame:
    """(crop, stage, lo, hi) of each stage in degree days; the last is open."""
    rows = [(c, s, lo, hi) for c, (_, b) in DEGREE_DAYS.items() for s, lo, hi in zip(STAGES, [0.0, *b], [*b, float("inf")])]
    return spark.createDataFrame(rows, "crop string, stage string, lo double, hi double")
