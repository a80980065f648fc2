"""Queries over a sensor registry and its assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COST = {"free": 0, "open": 1, "commercial": 2}
VOCABULARY = {"cloud", "revisit", "resolution", "moisture", "thermal"}


def by_tier(registry: DataFrame, tier: int) -> DataFrame:
    return registry.where(F.col("tier") == tier).orderBy("id")


def by_type(registry: DataFrame, kind: str) -> DataFrame:
    return registry.where(F.lower("sensor_type") == kind.lower()).orderBy("id")


def native(registry: DataFrame, column: str) -> DataFrame:
    """Rows with an asset in ``column``."""
    return registry.where(F.col(column).isNotNull() & (F.col(column) != "")).orderBy("id")


def gap_fillers(registry: DataFrame, mode: str, vocabulary=VOCABULARY) -> DataFrame:
    """Sensors that fill a gap, by tier, cost and id; an unknown gap is an error."""
    if mode not in vocabulary:
        raise ValueError(f"unknown gap {mode!r}; known: {sorted(vocabulary)}")
    cost = F.when(F.col("cost") == "free", 0).when(F.col("cost") == "open", 1).otherwise(2)
    return registry.where(F.array_contains("fills_gaps", mode)).orderBy("tier", cost, "id")


def resolve(registry: DataFrame, endpoints: DataFrame, prefer: str = "gee") -> DataFrame:
    """The asset of each sensor: the preferred catalogue, else the other, else its portal."""
    e = registry.join(F.broadcast(endpoints), "stac_collection", "left")
    gee, stac = F.col("gee_asset_id").isNotNull(), F.col("stac_collection").isNotNull()
    first, second = (gee, stac) if prefer == "gee" else (stac, gee)
    names = ("gee", "stac") if prefer == "gee" else ("stac", "gee")
    method = F.when(first, names[0]).when(second, names[1]).otherwise("portal")
    ref = F.when(method == "gee", F.col("gee_asset_id")).when(method == "stac", F.col("stac_collection")).otherwise(F.col("portal"))
    return e.select("id", method.alias("method"), ref.alias("asset"), F.when(method == "stac", F.coalesce("endpoint", F.lit("planetary_computer"))).alias("endpoint"))


def summary(registry: DataFrame) -> DataFrame:
    """(facet, value, n): sensors by tier, by type and by gap filled, in one pass."""
    facets = F.concat(
        F.array(F.struct(F.lit("tier").alias("facet"), F.col("tier").cast("string").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("sensor_type").alias("value"))),
        F.transform("fills_gaps", lambda g: F.struct(F.lit("gap").alias("facet"), g.alias("value"))),
    )
    return registry.select(F.inline(facets)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def unknown_gaps(registry: DataFrame, vocabulary=VOCABULARY) -> DataFrame:
    return registry.select("id", F.array_except("fills_gaps", F.array(*map(F.lit, sorted(vocabulary)))).alias("unknown")).where(F.size("unknown") > 0)


def search(items: DataFrame, collection: str, bbox, start, end, limit: int = 100) -> DataFrame:
    """Items of a collection that meet a box and a date range (both ends included), newest last."""
    w, s, e, n = bbox
    met = (F.col("max_lng") >= w) & (F.col("min_lng") <= e) & (F.col("max_lat") >= s) & (F.col("min_lat") <= n)
    return items.where((F.col("collection") == collection) & F.col("date").between(start, end) & met).orderBy("date", "id").limit(limit)


def sensor(registry: DataFrame, name: str) -> dict:
    """The registry's row of one id; unknown ids are errors."""
    found = registry.where(F.col("id") == name).limit(1).collect()
    if not found:
        raise KeyError(f"no sensor {name!r}")
    return found[0].asDict()


def search_sensor(items: DataFrame, registry: DataFrame, name: str, bbox, start, end, limit: int = 100) -> DataFrame:
    """``search`` by a sensor's own collection; one without a collection is an error."""
    collection = sensor(registry, name)["stac_collection"]
    if not collection:
        raise ValueError(f"sensor {name!r} has no collection to search")
    return search(items, collection, bbox, start, end, limit)


def routes(registry: DataFrame, prefer_stac: bool = False) -> DataFrame:
    """(id, route, asset): where each sensor's observations come from."""
    stac = F.col("stac_collection").isNotNull() & (F.lit(prefer_stac) | F.col("gee_asset_id").isNull())
    route = F.when(stac, "stac").when(F.col("gee_asset_id").isNotNull(), "gee").otherwise("demo")
    return registry.select("id", route.alias("route"), F.when(stac, F.col("stac_collection")).otherwise(F.col("gee_asset_id")).alias("asset"))
