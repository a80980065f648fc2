"""Sources and sinks: field tables in Parquet, registries, GeoJSON, synthetic observations."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import unit_hash
from ..operators.series import gradient, phenophase
from ..session import spread
from .features import read_features

REGISTRY = "id string, name string, operator string, country string, sensor_type string, bands array<string>, native_resolution_m double, revisit_days double, swath_km double, status string, gee_asset_id string, stac_collection string, portal string, cost string, tier int, roles array<string>, fills_gaps array<string>"
#: Sensor kinds each loader family takes.
FAMILIES = {"optical_sr": ["optical"], "sar_grd": ["sar"], "soil_moisture": ["passive_microwave", "sar"], "precip": ["precip"], "thermal_et": ["thermal"], "dem": ["dem"], "embeddings": ["embedding"]}
#: Ranges of synthetic values by family.
RANGES = {"optical_sr": (0.0, 1.0), "sar_grd": (-30.0, 0.0), "soil_moisture": (0.0, 0.6), "precip": (0.0, 120.0), "thermal_et": (270.0, 330.0), "dem": (0.0, 3000.0), "embeddings": (-1.0, 1.0)}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A sensor registry in JSON lines. An id that is missing or not unique, and a tier out of 1..3, are errors at once."""
    df = spark.read.schema(REGISTRY).json(path)
    twice = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1").select(F.coalesce("id", F.lit("a missing id")).alias("id"))
    tiers = df.where("tier is null or not tier between 1 and 3").select(F.concat(F.col("id"), F.lit(" by its tier")).alias("id"))
    wrong = [r["id"] for r in twice.unionByName(tiers).limit(5).collect()]
    if wrong:
        raise ValueError(f"registry {path}: {', '.join(map(str, wrong))}")
    return df


def scan(spark: SparkSession, path: str, bands: list[str], start: date, end: date, bbox=None, ts: str = "date") -> DataFrame:
    """Pixels of a date range (``end`` exclusive) and box; columns and predicates reach the Parquet scan."""
    df = spark.read.parquet(path).where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    if bbox:
        df = df.where(F.col("lng").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return df.select(ts, "lat", "lng", *bands)


def write_partitioned(df: DataFrame, path: str, by: str = "date", within=("cell",), mode: str = "overwrite") -> None:
    """Parquet partitioned by date, sorted within, so that row groups can be skipped.

    Tasks take ranges of date and ``within``: a date of many rows is written by
    several, each with cells of its own, and small dates share one.
    """
    df.repartitionByRange(by, *within).sortWithinPartitions(by, *within).write.partitionBy(by).mode(mode).parquet(path)


def read_geojson(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """One row per feature and step: field_id and the value of each ``*_series`` property; files are read by ranges of bytes."""
    kinds = ", ".join(["field_id: string", *[f"{s}: array<double>" for s in series]])
    f = read_features(spark, path, f"properties struct<{kinds}>").select(F.col("properties").alias("p"))
    zipped = F.arrays_zip(*[F.col(f"p.{s}").alias(s.removesuffix("_series")) for s in series])
    return f.select(F.col("p.field_id").alias("field_id"), F.posexplode(zipped).alias("step", "z")).select("field_id", "step", "z.*")


def write_rollup(df: DataFrame, path: str, by: str = "date") -> None:
    """A report as JSON lines in a folder per date, and ``index``: the dates in order, the last of which is the default."""
    df.withColumn("__day", F.col(by).cast("string")).repartitionByRange(by, *[c for c, t in df.dtypes if c != by and "map<" not in t]).write.partitionBy("__day").mode("overwrite").json(f"{path}/rows")
    days = df.select(F.col(by).cast("string").alias("day")).distinct()
    # as many as there are dates
    days.agg(F.array_sort(F.collect_list("day")).alias("dates")).select("dates", F.try_element_at("dates", F.lit(-1)).alias("default")).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def time_axis(start: date, end: date, n: int) -> list[date]:
    """n dates, both ends included, evenly spaced (halves to even); swapped ends are put right."""
    if end < start:
        start, end = end, start
    if n == 1:
        return [start]
    gap = (end - start).days / (n - 1)
    return [date.fromordinal(start.toordinal() + round(gap * i)) for i in range(n)]


def axis_of(start, end, n: int) -> Column:
    """``time_axis`` of two date columns: an array of n dates from the first."""
    a, b = F.least(start, end), F.greatest(start, end)
    gap = F.datediff(b, a).cast("double") / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(a, F.bround(gap * i).cast("int")))


def validate_family(family: str, kind: str) -> None:
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    if kind not in FAMILIES[family]:
        raise ValueError(f"{family} does not take {kind!r} sensors")


def chance(seed, *parts) -> Column:
    """A number in [0, 1) for a seed and any columns, the same in any partitioning (and in any SQL with SHA-256)."""
    return unit_hash(F.concat_ws("/", F.lit(str(seed)), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def synthetic(spark: SparkSession, sensor: str | DataFrame, family: str, start: date, end: date, n: int = 6, size: int = 32, bands=("b1",), seed: int = 0) -> DataFrame:
    """Deterministic observations (sensor, date, y, x, band, value): a season's swell and hash noise within the family's range.

    Of one sensor, or of each in a table's column ``sensor``.
    """
    lo, hi = RANGES[family]
    if family == "dem":
        n = 1
    dates = time_axis(start, end, n)
    sensors = spread(sensor.select("sensor"), "sensor") if isinstance(sensor, DataFrame) else spark.range(1).select(F.lit(sensor).alias("sensor"))
    rows = sensors.select("sensor", F.explode(F.sequence(F.lit(0), F.lit(n * size * size - 1))).alias("id"))
    rows = rows.select("sensor", F.floor(F.col("id") / (size * size)).cast("int").alias("t"), (F.floor(F.col("id") / size) % size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    swell = F.sin(math.pi * F.col("t") / max(1, n - 1))
    value = lo + (hi - lo) * (0.25 + 0.45 * swell + 0.2 * chance(seed, F.col("sensor"), F.col("t"), F.col("y"), F.col("x"), F.col("band")))
    day = F.element_at(F.array(*map(F.lit, dates)), F.col("t") + 1)
    return rows.select("sensor", day.alias("date"), "y", "x", "band", F.least(F.greatest(value, F.lit(lo)), F.lit(hi)).cast("float").alias("value"))


def demo_cube(spark: SparkSession, start: date, end: date, n: int = 12, height: int = 64, width: int = 64, seed: int = 0, cloud: float = 0.25, pixels: DataFrame | None = None) -> DataFrame:
    """A made cube (date, y, x, field_id, bands, indices, soil_moisture, lst_et, phenophase, qa, sigma).

    Greenness is a Gaussian in time, with its own peak and height for each of
    five kinds of field block. Clouds (qa 0, more of them in the rains) leave ndvi
    NULL and nothing else. The noise is of hashes, so the cube is the same on any
    cluster. ``pixels`` (y, x) says which pixels of the grid there are; all by default.
    """
    dates = time_axis(start, end, n)
    if pixels is None:
        pixels = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    rows = pixels.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"), "y", "x")
    rows = rows.withColumn("date", F.element_at(F.array(*map(F.lit, dates)), F.col("t") + 1)).withColumns({"doy": F.dayofyear("date").cast("double"), "field_id": pixel_block("y", "x", height, width)})
    c = F.col
    noise = lambda name, sd: (chance(seed, name, c("t"), c("y"), c("x")) - 0.5) * (sd * math.sqrt(12.0))
    bell = lambda x, at, width: F.exp(-0.5 * F.pow((x - at) / width, F.lit(2.0)))
    unit = lambda x, lo=0.0, hi=1.0: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    k = c("field_id").cast("double")
    rows = rows.withColumn("green_up", unit(0.18 + 0.02 * k + (0.45 + 0.08 * (k - 2.0)) * bell(c("doy"), 150.0 + 25.0 * (k - 2.0), 45.0) + noise("ndvi", 0.015), 0.0, 0.95))
    rows = gradient(rows, ["y", "x"], "green_up", "t")
    g = c("green_up")
    rows = rows.withColumns({"qa": F.when(chance(seed, "cloud", c("t"), c("y"), c("x")) < cloud * (0.6 + 0.8 * bell(c("doy"), 200.0, 40.0)), 0).otherwise(1), "nir": unit(0.20 + 0.45 * g), "swir1": unit(0.18 + 0.10 * (1.0 - g)), "swir2": unit(0.12 + 0.08 * (1.0 - g))})
    rows = rows.withColumn("red", unit(c("nir") * (1.0 - g) / (1.0 + g + 1e-6)))
    rows = rows.withColumns({"green": unit(c("red") * 1.15 + 0.02), "blue": unit(c("red") * 0.95 + 0.01), "soil_moisture": unit(0.15 + 0.12 * bell(c("doy"), 210.0, 35.0) + 0.05 * (1.0 - g) + noise("sm", 0.01), 0.02, 0.55)})
    evi = 2.5 * (c("nir") - c("red")) / (c("nir") + 6.0 * c("red") - 7.5 * c("blue") + 1.0 + 1e-6)
    return rows.select(
        "date", "y", "x", "field_id", "blue", "green", "red", "nir", "swir1", "swir2", F.when(c("qa") == 1, g).alias("ndvi"), unit(evi, -0.2, 1.0).alias("evi"),
        ((c("green") - c("nir")) / (c("green") + c("nir") + 1e-6)).alias("ndwi"), "soil_moisture", unit(28.0 + 8.0 * (1.0 - g) - 20.0 * c("soil_moisture") + noise("lst", 0.5), 15.0, 50.0).alias("lst_et"),
        phenophase(g, c("gradient")).alias("phenophase"), "qa", (0.01 + F.when(c("qa") == 0, 0.04).otherwise(0.0) + 0.02 * (1.0 - g)).alias("sigma"),
    )


def pixel_block(y, x, height: int, width: int) -> Column:
    """The kind of field (0 to 4) of a pixel: blocks of a quarter of the grid's sides."""
    return ((F.floor(F.col(y) / max(height // 4, 1)) * 3 + F.floor(F.col(x) / max(width // 4, 1))) % 5).cast("int")


def load_sensor(spark: SparkSession, sensor: dict, start: date, end: date, bands: list[str], stored: dict[str, str] | None = None, prefer_stac: bool = False, family: str = "optical_sr", n: int = 6, size: int = 32) -> DataFrame:
    """Observations of a registered sensor with how they were got (``route``, ``asset``).

    ``stored`` maps an asset's name to its table of pixels. A sensor goes to its
    catalogue collection where that is preferred or it has no native asset, else
    to the asset, and is made up (route "demo") without a stored table of either.
    """
    route, asset = route_of(sensor, prefer_stac)
    path = (stored or {}).get(asset)
    if path is None:
        return synthetic(spark, sensor["id"], family, start, end, n, size, tuple(bands)).withColumns({"route": F.lit("demo"), "asset": F.lit(asset)})
    return scan(spark, path, bands, start, end).withColumns({"sensor": F.lit(sensor["id"]), "route": F.lit(route), "asset": F.lit(asset)})


def route_of(sensor: dict, prefer_stac: bool = False) -> tuple[str, str | None]:
    """Where a sensor's observations come from, and its asset there."""
    native, collection = sensor.get("gee_asset_id"), sensor.get("stac_collection")
    if collection and (prefer_stac or not native):
        return "stac", collection
    return ("gee", native) if native else ("demo", None)


def load_family(spark: SparkSession, family: str, sensor: dict, start: date, end: date, bands: list[str], **options) -> DataFrame:
    """``load_sensor`` of a sensor that the family takes; elevation is one date."""
    validate_family(family, sensor["sensor_type"])
    return load_sensor(spark, sensor, start, end, bands, family=family, **options)


#: Archetypes of synthetic crops: base, amplitude, start, rise, end, fall (shares of the season).
ARCHETYPES = {"crop0": (0.15, 0.65, 0.20, 25.0, 0.75, 22.0), "crop1": (0.18, 0.50, 0.35, 30.0, 0.90, 30.0), "crop2": (0.22, 0.60, 0.10, 18.0, 0.55, 20.0), "crop3": (0.12, 0.35, 0.45, 22.0, 0.80, 18.0)}


def synthetic_crops(ids: DataFrame, steps: int = 12, noise: float = 0.04, seed: int = 11) -> DataFrame:
    """(id, label, px, py, t00..): seeded NDVI curves of the archetypes with hash noise, one for each ``id``."""
    rows = ids.select("id").withColumn("k", (F.col("id") % len(ARCHETYPES)).cast("int"))
    names = sorted(ARCHETYPES)
    pick = lambda i: F.element_at(F.array(*[F.lit(ARCHETYPES[n][i]) for n in names]), F.col("k") + 1)
    unit = lambda *p: chance(seed, F.col("id"), *p)
    sig = lambda z: 1.0 / (1.0 + F.exp(-z))
    cols = {}
    for t in range(steps):
        at = t / (steps - 1)
        shift = (unit("s") - 0.5) * 0.06
        curve = pick(0) + pick(1) * (sig(pick(3) * (at - pick(2) - shift)) - sig(pick(5) * (at - pick(4) - shift)))
        cols[f"t{t:02d}"] = curve + (unit("n", t) + unit("m", t) - 1.0) * noise * 2.0
    return rows.select("id", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("label"), (unit("x") * 100).alias("px"), (unit("y") * 100).alias("py"), *[c.alias(n) for n, c in cols.items()])
