"""The serving view: seeded records of cells and dates, keyed lookups, keys, colours."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.advisory import serving_status
from ..functions.core import at_least, clip, col
from ..functions.geo import unit_hash
from ..session import scratch

#: Labels of classes, and first days of seasons.
CROP_LABELS = ["fallow", "rice", "wheat", "maize", "cotton", "sugarcane"]
STRESS_LABELS = ["none", "mild", "moderate", "severe"]
STAGES = ["sowing", "vegetative", "reproductive", "maturity"]
SEASONS = {"kharif": (2025, 6, 1), "rabi": (2025, 11, 1), "zaid": (2025, 3, 1)}
GREEN_RED = [(26, 152, 80), (255, 255, 191), (215, 48, 39)]


def season_dates(season: str = "kharif", count: int = 8, step: int = 8) -> list[date]:
    """Dates of a season's composites; an unknown season is the first."""
    first = date(*SEASONS.get(season, SEASONS["kharif"]))
    return [first + timedelta(days=step * i) for i in range(count)]


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)


def seeded(cells: DataFrame, dates: list[date], digits: int = 3, cell: str = "cell") -> DataFrame:
    """One row per cell and date with crop, stress and advisory records, all from hashes of their keys."""
    rows = cells.select(F.col(cell).alias("cell")).select("cell", F.posexplode(F.array(*map(F.lit, dates))).alias("t", "date"))
    c, day = F.col("cell"), F.date_format("date", "yyyy-MM-dd")
    r = lambda x: F.round(x, digits)
    kind = F.conv(F.substring(F.sha2(F.concat_ws("/", c, F.lit("crop")), 256), 1, 12), 16, 10).cast("long") % len(CROP_LABELS)
    phase = F.sin(math.pi * (F.col("t") + 1) / 9.0)
    base = 0.25 + 0.5 * phase * (0.6 + 0.4 * unit_hash(c, "stressbias"))
    rows = rows.withColumns({"crop_class": kind.cast("int"), "confidence": r(0.7 + 0.29 * unit_hash(c, "cropconf")), "stress_index": r(clip(base + 0.1 * (unit_hash(c, day) - 0.5), 0.0, 1.0))})
    s = F.col("stress_index")
    level = F.least((s * len(STRESS_LABELS)).cast("int"), F.lit(len(STRESS_LABELS) - 1))
    rows = rows.withColumns({"crop_label": _pick(CROP_LABELS, F.col("crop_class")), "stress_level": level, "stage": _pick(STAGES, F.least(F.floor(F.col("t") / 2), F.lit(len(STAGES) - 1)))})
    rows = rows.withColumns({"stress_label": _pick(STRESS_LABELS, F.col("stress_level")), "vci": r(at_least(1.0 - s + 0.05 * (unit_hash(c, day, "vci") - 0.5), 0.0)), "smi": r(at_least(0.8 - 0.6 * s, 0.0))})
    money = lambda x: F.round(x, max(2, digits - 1))
    rows = rows.withColumns({"etc_mm": money(3.0 + 4.0 * (0.5 + 0.5 * s)), "rainfall_mm": money(6.0 * unit_hash(c, day, "rain"))})
    rows = rows.withColumn("eta_mm", money(F.col("etc_mm") * (1.0 - 0.6 * s)))
    rows = rows.withColumn("deficit_mm", money(at_least((F.col("etc_mm") - F.col("eta_mm")) * 8.0 - F.col("rainfall_mm"), 0.0)))
    told = serving_status("deficit_mm")
    return rows.withColumns({"status": told["status"], "action": told["action"], "irrigation_mm": F.when(F.col("deficit_mm") > 2, F.col("deficit_mm")).otherwise(0.0)})


def lookup(store: DataFrame, cell: str, day: date | None = None, columns: list[str] | None = None) -> DataFrame:
    """A cell's record of a day, of its latest one if none is given; no row if there is none."""
    held = store.where(F.col("cell") == cell)
    if day is not None:
        held = held.where(F.col("date") == F.lit(day))
    held = held.orderBy(F.desc("date")).limit(1)
    return held.select(*columns) if columns else held


def counts(store: DataFrame) -> DataFrame:
    return store.agg(F.count_distinct("cell").alias("cells"), F.count(F.lit(1)).alias("records"), F.max("date").alias("latest"))


def cache_key(layer, cell=None, day=None, **extra) -> Column:
    """The key of a cached layer: parts in a fixed order, extras by name; NULL parts are left out."""
    parts = [col(layer) if isinstance(layer, Column) else F.lit(layer)]
    named = ([("h3", cell)] if cell is not None else []) + ([("date", day)] if day is not None else []) + sorted(extra.items())
    parts += [F.concat(F.lit(f"{k}="), (v if isinstance(v, Column) else F.lit(v)).cast("string")) for k, v in named]
    return F.concat_ws(":", *parts)


def ramp(value, stops=GREEN_RED) -> dict[str, Column]:
    """Red, green and blue between colour stops, cut to whole numbers."""
    n = len(stops) - 1
    x = clip(value, 0.0, 1.0) * float(n)
    i = F.least(F.floor(x), F.lit(n - 1)).cast("int")
    f = x - i
    at = lambda k, j: F.element_at(F.array(*[F.lit(float(s[k])) for s in stops]), j + 1)
    return {c: (at(k, i) * (1.0 - f) + at(k, i + 1) * f).cast("int") for k, c in enumerate(("r", "g", "b"))}


def field_grid(areas: DataFrame, rows: int, cols: int, radius: float = 0.105, inset: float = 0.012, gap: float = 0.06) -> DataFrame:
    """Adds (r, c, cx, cy) to areas (min_lng, max_lng, min_lat, max_lat, lng, lat): cells of a grid over each box, without those far from its centre."""
    g = areas.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("__i"))
    g = g.withColumns({"r": F.floor(F.col("__i") / cols).cast("int"), "c": (F.col("__i") % cols).cast("int"), "__x0": F.col("min_lng") + inset, "__y0": F.col("min_lat") + inset})
    g = g.withColumns({"__dx": ((F.col("max_lng") - inset) - F.col("__x0")) / cols, "__dy": ((F.col("max_lat") - inset) - F.col("__y0")) / rows})
    mid = lambda o, i, d: ((F.col(o) + F.col(i) * F.col(d) + F.col(d) * gap) + (F.col(o) + (F.col(i) + 1) * F.col(d) - F.col(d) * gap)) / 2.0
    g = g.withColumns({"cx": mid("__x0", "c", "__dx"), "cy": mid("__y0", "r", "__dy")})
    far = F.hypot(F.col("cx") - F.col("lng"), (F.col("cy") - F.col("lat")) * 1.05)
    return g.where(far <= radius).drop("__i", "__x0", "__y0", "__dx", "__dy")


def iso_day(value) -> Column:
    """A date or timestamp as YYYY-MM-DD; of any other text its first ten characters."""
    x = col(value)
    return F.substring(x.cast("string"), 1, 10)


def version(spark: SparkSession, *paths: str) -> tuple:
    """What tells that files under the paths (of any file system Spark knows) have changed: their number, sizes and times."""
    out = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        n = size = last = mixed = 0
        while files.hasNext():
            f = files.next()
            n, size, last = n + 1, size + f.getLen(), max(last, f.getModificationTime())
            mixed = (mixed + hash((f.getPath().toString(), f.getLen(), f.getModificationTime()))) % (1 << 61)
        out.append((p, n, size, last, mixed))
    return tuple(out)


_PREPARED: dict[tuple, tuple[tuple, str, StructType]] = {}


def prepared(spark: SparkSession, key: tuple[str, ...], build, order: list[str], sources: tuple[str, ...] = ()) -> DataFrame:
    """A table to serve from: ``build`` makes it once for ``key`` while the application runs, later calls read what is stored.

    It is made anew when the files under ``sources``, which it is made of, have
    changed. It is sorted by ``order``, so that a lookup by these columns reads few
    row groups.
    """
    at, now = (spark.sparkContext.applicationId, *key), version(spark, *sources)
    if at not in _PREPARED or _PREPARED[at][0] != now:
        path, df = scratch(spark, "served"), build()
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        _PREPARED[at] = now, path, df.schema
    _, path, schema = _PREPARED[at]
    return spark.read.schema(schema).parquet(path)
