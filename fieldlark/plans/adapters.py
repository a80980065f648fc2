"""The driver's tables as observations: deterministic arithmetic, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = 6) -> Column:
    """Doubles at so many digits, half away from zero as SQL does it; no negative zero."""
    return F.round(c, digits) + 0.0


def pixels(spark, d) -> DataFrame:
    c = F.col
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", c("l_shipdate").cast("date").alias("date"),
        (c("l_tax") + 0.02).alias("red"), (c("l_quantity") / 100.0 + 0.2).alias("nir"), (c("l_discount") / 2.0 + 0.01).alias("blue"),
        (c("l_discount") + 0.05).alias("green"), (c("l_tax") * 2.0 + 0.1).alias("swir1"), (c("l_tax") + 0.05).alias("swir2"),
        (c("l_discount") + 0.1).alias("red_edge"), (c("l_quantity") / 125.0 + 0.2).alias("nir_n"),
        (c("l_quantity") * 200.0).alias("dn"), (c("l_partkey") % 12).cast("int").alias("scl"), (c("l_partkey") % 32).cast("int").alias("qa"),
        F.when(c("l_linenumber") != 3, c("l_discount") * 10.0).alias("cs"), (c("l_tax") + 0.05).alias("vv"), (c("l_discount") / 4.0 + 0.01).alias("vh"),
        (c("l_quantity") / 5.0 + 290.0).alias("lst"),
    )


PIXELS = """pix AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS date,
  l_tax + 0.02::DOUBLE AS red, l_quantity / 100::DOUBLE + 0.2::DOUBLE AS nir, l_discount / 2::DOUBLE + 0.01::DOUBLE AS blue,
  l_discount + 0.05::DOUBLE AS green, l_tax * 2::DOUBLE + 0.1::DOUBLE AS swir1, l_tax + 0.05::DOUBLE AS swir2,
  l_discount + 0.1::DOUBLE AS red_edge, l_quantity / 125::DOUBLE + 0.2::DOUBLE AS nir_n, l_quantity * 200::DOUBLE AS dn,
  (l_partkey % 12)::INT AS scl, (l_partkey % 32)::INT AS qa, CASE WHEN l_linenumber <> 3 THEN l_discount * 10::DOUBLE END AS cs,
  l_tax + 0.05::DOUBLE AS vv, l_discount / 4::DOUBLE + 0.01::DOUBLE AS vh, l_quantity / 5::DOUBLE + 290::DOUBLE AS lst FROM lineitem)"""


def points(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", ((k * 37 % 1600) / 10.0 - 80.0).alias("lat"), ((k * 91 % 3600) / 10.0 - 180.0).alias("lng"))


POINTS = "pts AS (SELECT c_custkey, (c_custkey * 37 % 1600) / 10::DOUBLE - 80::DOUBLE AS lat, (c_custkey * 91 % 3600) / 10::DOUBLE - 180::DOUBLE AS lng FROM customer)"


def weather(spark, d) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    dbl = lambda x: x.cast("double")
    return read(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), F.dayofyear("o_orderdate").alias("doy"), dbl(o % 15 + 5).alias("tmin"), dbl(o % 15 + 10 + c % 12).alias("tmax"),
        dbl(o % 40 + 20).alias("rh_min"), dbl(o % 40 + 50).alias("rh_max"), (dbl(c % 5) / 2.0 + 1.0).alias("u2"), dbl(o % 18 + 8).alias("rs"), dbl(c % 30 * 50).alias("elevation"),
        dbl(c % 60 - 10).alias("lat"), dbl(o % 70 * 7).alias("rain"),
    )


WEATHER = """wx AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, dayofyear(o_orderdate)::INT AS doy, (o_orderkey % 15 + 5)::DOUBLE AS tmin, (o_orderkey % 15 + 10 + o_custkey % 12)::DOUBLE AS tmax,
  (o_orderkey % 40 + 20)::DOUBLE AS rh_min, (o_orderkey % 40 + 50)::DOUBLE AS rh_max, (o_custkey % 5)::DOUBLE / 2::DOUBLE + 1::DOUBLE AS u2, (o_orderkey % 18 + 8)::DOUBLE AS rs,
  (o_custkey % 30 * 50)::DOUBLE AS elevation, (o_custkey % 60 - 10)::DOUBLE AS lat, (o_orderkey % 70 * 7)::DOUBLE AS rain FROM orders)"""

CROP_OF = ["rice", "wheat", "maize", "cotton", "sugarcane", "pulses"]
STAGE_OF = ["ini", "dev", "mid", "flowering", "late", "maturity", "other"]


def nth(names, k):
    return F.element_at(F.array(*map(F.lit, names)), k.cast("int") + 1)


def sql_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def fields(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    dbl = lambda x: x.cast("double")
    nation = read(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("command_id"))
    return read(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("field_id"), "command_id", nth(CROP_OF, k % 6).alias("crop"), nth(STAGE_OF, k % 7).alias("stage"),
        (dbl(k % 5) / 100.0 + 0.22).alias("theta_fc"), (dbl(k % 3) / 100.0 + 0.08).alias("theta_wp"), (dbl(k % 4) / 4.0 + 0.5).alias("zr"), (dbl(k % 3) / 10.0 + 0.4).alias("p"),
        (dbl(k % 17) / 2.0 + 1.0).alias("area_ha"), (k % 3 == 0).alias("is_tail_end"), dbl(k * 37 % 1000).alias("distance_from_head_m"), dbl(k * 13 % 160).alias("dr"), dbl(k % 5 + 3).alias("etc"),
    )


FIELDS = f"""fld AS (SELECT s_suppkey AS field_id, n_regionkey::BIGINT AS command_id, {sql_list(CROP_OF)}[(s_suppkey % 6 + 1)::INT] AS crop, {sql_list(STAGE_OF)}[(s_suppkey % 7 + 1)::INT] AS stage,
  (s_suppkey % 5)::DOUBLE / 100::DOUBLE + 0.22::DOUBLE AS theta_fc, (s_suppkey % 3)::DOUBLE / 100::DOUBLE + 0.08::DOUBLE AS theta_wp, (s_suppkey % 4)::DOUBLE / 4::DOUBLE + 0.5::DOUBLE AS zr,
  (s_suppkey % 3)::DOUBLE / 10::DOUBLE + 0.4::DOUBLE AS p, (s_suppkey % 17)::DOUBLE / 2::DOUBLE + 1::DOUBLE AS area_ha, s_suppkey % 3 = 0 AS is_tail_end, (s_suppkey * 37 % 1000)::DOUBLE AS distance_from_head_m,
  (s_suppkey * 13 % 160)::DOUBLE AS dr, (s_suppkey % 5 + 3)::DOUBLE AS etc FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def daily(spark, d) -> DataFrame:
    """A row per user and day: what depends on no order of the events."""
    e = read(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("ts").cast("date").alias("date"), "event_type", "value")
    return e.groupBy("cell", "date").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("value").alias("low"), F.max(F.when(F.col("event_type") != "error", F.col("value") / 500.0)).alias("vi")
    )


DAILY = """day AS (SELECT user_id AS cell, CAST(ts AS DATE) AS date, count(*) AS n, max(value) AS top, min(value) AS low, max(CASE WHEN event_type <> 'error' THEN value / 500::DOUBLE END) AS vi FROM events GROUP BY 1, 2)"""


def grid(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(F.lit(0).alias("patch"), F.floor(k / 50).cast("int").alias("y"), (k % 50).cast("int").alias("x"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("size"))


GRID = "grd AS (SELECT 0 AS patch, (p_partkey // 50)::INT AS y, (p_partkey % 50)::INT AS x, p_retailprice AS value, p_size::DOUBLE AS size FROM part)"


def registry(spark, d) -> DataFrame:
    """A sensor registry made from the supplier table."""
    k = F.col("s_suppkey")
    gaps = ["cloud", "revisit", "resolution", "moisture", "thermal"]
    return read(spark, d, "supplier").select(
        F.lower("s_name").alias("id"), nth(["optical", "sar", "thermal", "passive_microwave"], k % 4).alias("sensor_type"), (k % 3 + 1).cast("int").alias("tier"), nth(["free", "open", "commercial"], k % 3).alias("cost"),
        F.when(k % 2 == 0, F.concat(F.lit("asset/"), k.cast("string"))).alias("gee_asset_id"), F.when(k % 3 == 0, F.concat(F.lit("coll-"), (k % 5).cast("string"))).alias("stac_collection"),
        F.concat(F.lit("portal/"), k.cast("string")).alias("portal"), F.array_distinct(F.array(nth(gaps, k % 5), nth(gaps, k * 7 % 5))).alias("fills_gaps"),
    )


REGISTRY = """reg AS (SELECT lower(s_name) AS id, ['optical', 'sar', 'thermal', 'passive_microwave'][(s_suppkey % 4 + 1)::INT] AS sensor_type, (s_suppkey % 3 + 1)::INT AS tier, ['free', 'open', 'commercial'][(s_suppkey % 3 + 1)::INT] AS cost,
  CASE WHEN s_suppkey % 2 = 0 THEN 'asset/' || s_suppkey END AS gee_asset_id, CASE WHEN s_suppkey % 3 = 0 THEN 'coll-' || (s_suppkey % 5) END AS stac_collection, 'portal/' || s_suppkey AS portal,
  s_suppkey AS k, ['cloud', 'revisit', 'resolution', 'moisture', 'thermal'] AS g FROM supplier)"""


def endpoints(spark) -> DataFrame:
    return spark.createDataFrame([("coll-0", "earth_search"), ("coll-1", "usgs")], "stac_collection string, endpoint string")
