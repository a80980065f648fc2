"""Queries of operators on tables, series, rasters and models, each with its SQL where SQL can say it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import advisory, crop, geo, soil, stress
from ..operators import accuracy, balance, boosting, catalog, cells, classify, command, composite, forest, raster, series, serving, smoothing, spells, stats
from ..session import scratch
from ..sources import chunks, exports, features, items, tables
from ..streaming import runs, windows
from . import adapters as A
from .scalar import _ADV, _CROPS, _TAW, cl, nd, r6, sd

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


R = lambda c, n=None, k=6: A.rounded(c, k).alias(n or c)
START, END = date(2024, 1, 1), date(2024, 2, 1)

_EV = "ev AS (SELECT user_id, CAST(ts AS DATE) AS date, event_type, value, (user_id * 37 % 1600) / 10::DOUBLE - 80::DOUBLE AS lat, (user_id * 91 % 3600) / 10::DOUBLE - 180::DOUBLE AS lng FROM events)"
_C9 = "printf('f%02d%08x%08x', 9, floor((lat + 90) / (60E0 / 512E0))::BIGINT, floor((lng + 180) / (60E0 / 512E0))::BIGINT)"


def _events(spark, d):
    e = A.read(spark, d, "events")
    k = F.col("user_id")
    return e.select("user_id", F.col("ts").cast("date").alias("date"), "event_type", "value", ((k * 37 % 1600) / 10.0 - 80.0).alias("lat"), ((k * 91 % 3600) / 10.0 - 180.0).alias("lng"))


@query(f"""WITH {_EV}, p AS (SELECT {_C9} AS cell, date, value AS a, CASE WHEN event_type <> 'error' THEN value * 2 END AS b FROM ev)
    SELECT cell, date, variable, round(avg(value), 6) AS value FROM (SELECT cell, date, 'a' AS variable, a AS value FROM p UNION ALL SELECT cell, date, 'b', b FROM p) WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def cell_feature_table(spark, d):
    e = _events(spark, d).select("lat", "lng", "date", F.col("value").alias("a"), F.when(F.col("event_type") != "error", F.col("value") * 2.0).alias("b"))
    return cells.cell_table(e, 9, ["a", "b"]).select("cell", "date", "variable", R("value"))


@query(f"""WITH {_EV} SELECT printf('f%02d%08x%08x', 4, floor((lat + 90) / (60E0 / 16E0))::BIGINT, floor((lng + 180) / (60E0 / 16E0))::BIGINT) AS cell, max(value) AS top, count(*) AS n FROM ev GROUP BY 1""")
def cell_parent_rollup(spark, d):
    e = _events(spark, d).withColumn("fine", geo.cell("lat", "lng", 9))
    return e.groupBy(geo.parent("fine", 4).alias("cell")).agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.DAILY} SELECT cell, date, top, low, n::DOUBLE AS n FROM day")
def store_pivot(spark, d):
    long = cells.melt(A.daily(spark, d), ["cell", "date"], ["top", "low", "n"])
    return cells.pivot(long, ["top", "low", "n"])


@query(f"WITH {A.DAILY} SELECT cell, date, round(top, 6) AS top, round(low, 6) AS low FROM day")
def store_json_roundtrip(spark, d):
    long = cells.melt(A.daily(spark, d), ["cell", "date"], ["top", "low"])
    back = cells.from_json(cells.to_json(cells.to_features(long)))
    return back.select("cell", "date", R(F.try_element_at("features", F.lit("top")), "top"), R(F.try_element_at("features", F.lit("low")), "low"))


@query("""WITH a AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id, value FROM a JOIN events USING (user_id, event_type, event_id)""")
def store_upsert_latest(spark, d):
    e = A.read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return cells.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_record(spark, d):
    e = A.read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return cells.latest(e, ["user_id"], "event_id")


@query(f"WITH {A.DAILY} SELECT date, top AS value FROM day WHERE cell = 7 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def timeseries_range(spark, d):
    return cells.timeseries(_records(spark, d), 7, "top", date(2024, 1, 5), date(2024, 1, 20))


def _records(spark, d):
    return A.daily(spark, d).select("cell", "date", F.create_map(F.lit("low"), F.col("low")).alias("stress"), F.create_map(F.lit("top"), F.col("top")).alias("advisory"), F.create_map(F.lit("n"), F.col("n")).alias("crop"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_properties(spark, d):
    return A.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(f"WITH {A.DAILY}, a AS (SELECT date, (cell // 10)::INT AS y, (cell % 10)::INT AS x, top FROM day), b AS (SELECT date, (cell // 10)::INT AS y, (cell % 10)::INT AS x, low FROM day WHERE cell % 3 > 0), s AS (SELECT DISTINCT (cell // 10)::INT AS y, (cell % 10)::INT AS x, (cell * 5)::DOUBLE AS dem FROM day WHERE cell % 4 > 0) SELECT date AS time, y, x, top AS ndvi, low AS lst, dem, 1::SMALLINT AS qa, 0.02::FLOAT AS sigma FROM a FULL JOIN b USING (date, y, x) LEFT JOIN s USING (y, x)")
def cube_layers(spark, d):
    day = A.daily(spark, d).select(F.col("date").alias("time"), F.floor(F.col("cell") / 10).cast("int").alias("y"), (F.col("cell") % 10).cast("int").alias("x"), "cell", "top", "low")
    layer = lambda df, v: df.select("time", "y", "x", F.col(v).alias("value"))
    dem = day.where("cell % 4 > 0").select("y", "x", (F.col("cell") * 5).cast("double").alias("value")).distinct()
    return cells.align({"ndvi": layer(day, "top"), "lst": layer(day.where("cell % 3 > 0"), "low")}, {"dem": dem})


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN l ON l_orderkey = o_orderkey WHERE k = 1""")
def scene_quality_join(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    li = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_quantity")
    return cells.first_match(o, li, "key", ["l_linenumber", "l_partkey", "l_quantity"]).select(F.col("key").alias("o_orderkey"), "l_partkey", "l_quantity")


_W = "(DATE '2024-01-01' + ((CAST(ts AS DATE) - DATE '2024-01-01') // 8)::INT * 8)::DATE"
_HELD = "CAST(ts AS DATE) >= DATE '2024-01-01' AND CAST(ts AS DATE) < DATE '2024-02-01'"


@query(f"SELECT user_id, {_W} AS window_start, round(median(value), 6) AS value, count(*) AS n_images FROM events WHERE {_HELD} GROUP BY 1, 2")
def composite_8day_median(spark, d):
    return composite.composite(A.read(spark, d, "events"), ["user_id"], ["value"], START, END, "ts").select("user_id", "window_start", R("value"), "n_images")


@query(f"SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'ASC' ELSE 'DESC' END AS pass, {_W} AS window_start, round(median(value), 6) AS value, count(*) AS n_images FROM events WHERE {_HELD} GROUP BY 1, 2, 3")
def composite_by_pass(spark, d):
    e = A.read(spark, d, "events").withColumn("pass", F.when(F.col("event_id") % 2 == 0, "ASC").otherwise("DESC"))
    return composite.by_pass(e, ["user_id"], ["value"], START, END, ts="ts").select("user_id", "pass", "window_start", R("value"), "n_images")


@query(f"SELECT event_type, {_W} AS window_start, round(avg(value), 6) AS mean, round(sum(value) * 0.5, 4) AS total FROM events WHERE {_HELD} GROUP BY 1, 2")
def reduce_8day(spark, d):
    e = A.read(spark, d, "events")
    m = composite.composite(e, ["event_type"], ["value"], START, END, "ts", "mean").select("event_type", "window_start", R("value", "mean"))
    s = composite.composite(e, ["event_type"], ["value"], START, END, "ts", "sum").select("event_type", "window_start", R(F.col("value") * 0.5, "total", 4))
    return m.join(s, ["event_type", "window_start"])


@query("SELECT user_id, arg_max(value, ts) AS value FROM events WHERE event_type <> 'error' AND year(ts) = 2024 GROUP BY 1")
def annual_mosaic(spark, d):
    e = A.read(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return composite.mosaic(e, ["user_id"], "value", 2024, "ts")


@query("""SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, l_quantity AS value, 'a' AS sensor FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE), l_quantity, 'b' FROM lineitem WHERE l_linenumber = 3""")
def union_collections(spark, d):
    li = A.read(spark, d, "lineitem")
    one = lambda c, s: li.where(c).select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("value"), F.lit(s).alias("sensor"))
    return one("l_linenumber <= 2", "a").unionByName(one("l_linenumber = 3", "b"))


_S = f"s AS (SELECT cell, date, (date - DATE '2024-01-01')::DOUBLE AS t, vi, top, low, n FROM day)"


def _series(spark, d):
    return A.daily(spark, d).withColumn("t", F.datediff("date", F.lit(START)).cast("double"))


_RUN = "OVER (PARTITION BY cell ORDER BY t ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH {A.DAILY}, {_S}, x AS (SELECT *, CASE WHEN n % 7 > 0 THEN (n % 13)::DOUBLE + 4 END AS tmin, (n % 31)::DOUBLE + 8 AS tmax FROM s), y AS (SELECT *, coalesce(greatest((greatest(least(tmin, 30), 10) + greatest(least(tmax, 30), 10)) / 2 - 10, 0), 0) * (CASE WHEN tmin IS NULL THEN 0 ELSE 1 END) AS g FROM x)
    SELECT cell, date, g + 0 AS gdd, sum(g) {_RUN} AS gdd_sum FROM y""")
def gdd_cumulative(spark, d):
    df = _series(spark, d).withColumns({"tmin": F.when(F.col("n") % 7 > 0, (F.col("n") % 13).cast("double") + 4.0), "tmax": (F.col("n") % 31).cast("double") + 8.0})
    return series.growing_degree_days(df, ["cell"], "t").select("cell", "date", "gdd", "gdd_sum")


@query(f"WITH {A.DAILY}, {_S}, w AS (SELECT *, CASE WHEN vi IS NOT NULL THEN exp((t - min(t) OVER (PARTITION BY cell)) / 10) END AS w FROM s) SELECT cell, date, round(sum(w * vi) {_RUN} / sum(w) {_RUN}, 6) AS swi FROM w")
def swi_filter(spark, d):
    return series.soil_water_index(_series(spark, d), ["cell"], "t", "vi").select("cell", "date", R("swi"))


@query(f"""WITH {A.DAILY}, {_S}, g AS (SELECT *, lag(top) OVER w AS b, lead(top) OVER w AS a FROM s WINDOW w AS (PARTITION BY cell ORDER BY t)), h AS (SELECT cell, date, top / 500 AS v, (CASE WHEN b IS NULL THEN a / 500 - top / 500 WHEN a IS NULL THEN top / 500 - b / 500 ELSE (a / 500 - b / 500) / 2 END) AS g FROM g)
    SELECT cell, date, round(g, 6) + 0 AS gradient, CASE WHEN v >= 0.25 AND v < 0.5 AND g < 0 THEN 5 WHEN v >= 0.5 AND g < 0 THEN 4 WHEN v >= 0.6::DOUBLE AND abs(g) < 0.01::DOUBLE THEN 3 WHEN v >= 0.5 AND g >= 0 THEN 2 WHEN v >= 0.25 AND v < 0.5 AND g >= 0 THEN 1 ELSE 0 END AS phase FROM h""")
def gradient_phenophase(spark, d):
    df = series.gradient(_series(spark, d).withColumn("v", F.col("top") / 500.0), ["cell"], "v", "t")
    return df.select("cell", "date", R("gradient"), series.phenophase(F.col("v"), F.col("gradient")).alias("phase"))


@query(f"""WITH {A.DAILY}, {_S}, x AS (SELECT cell, t, top AS v, lag(top) OVER w AS v0, lag(t) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY cell ORDER BY t)) SELECT cell, round(min(CASE WHEN v0 < 400 AND v >= 400 THEN t0 + (400 - v0) * (t - t0) / (v - v0) END), 6) AS crossing FROM x GROUP BY 1""")
def threshold_crossing(spark, d):
    return series.crossings(_series(spark, d), ["cell"], F.lit(400.0), "top").select("cell", R("crossing"))


_FILL = """i AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cell) AS m FROM s WINDOW w AS (PARTITION BY cell ORDER BY t)),
  f AS (SELECT *, last_value(vi IGNORE NULLS) OVER b AS x0, first_value(vi IGNORE NULLS) OVER a AS x1, last_value(CASE WHEN vi IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN vi IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM i
    WINDOW b AS (PARTITION BY cell ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cell ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  y AS (SELECT *, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 WHEN i0 = i1 THEN x0 ELSE x0 + (x1 - x0) * (i - i0) / (i1 - i0) END AS y FROM f)"""


@query(f"WITH {A.DAILY}, {_S}, {_FILL} SELECT cell, date, round(y, 6) AS filled FROM y")
def linear_gap_fill(spark, d):
    return series.interpolated(_series(spark, d), ["cell"], "vi").select("cell", "date", R("filled"))


@query(f"""WITH {A.DAILY}, {_S}, {_FILL}, j AS (SELECT a.cell, a.date, a.i, a.m, a.y AS own, b.i AS k, b.y AS v, least(greatest(a.i, 4), a.m - 3) AS c FROM y a JOIN y b ON a.cell = b.cell AND abs(b.i - least(greatest(a.i, 4), a.m - 3)) <= 3),
    q AS (SELECT cell, date, i, m, c, any_value(own) AS own, sum(v * ((7 - (k - c) * (k - c)) / 21::DOUBLE)) AS b0, sum(v * (k - c) / 28::DOUBLE) AS b1, sum(v * ((k - c) * (k - c) - 4) / 84::DOUBLE) AS b2 FROM j GROUP BY 1, 2, 3, 4, 5)
    SELECT cell, date, round(CASE WHEN m < 7 THEN own ELSE b0 + b1 * (i - c) + b2 * (i - c) * (i - c) END, 6) + 0 AS smooth FROM q""")
def savgol_7_2(spark, d):
    return series.savitzky_golay(_series(spark, d), ["cell"], "vi").select("cell", "date", R("smooth"))


@query(f"""WITH {A.DAILY}, {_S}, o AS (SELECT cell, t, top AS x, max(top) OVER c AS peak, min(top) OVER c AS base, lag(top) OVER w AS x0, lag(t) OVER w AS t0 FROM s WINDOW c AS (PARTITION BY cell), w AS (PARTITION BY cell ORDER BY t)),
    p AS (SELECT *, min(CASE WHEN x = peak THEN t END) OVER (PARTITION BY cell) AS pos, base + 0.5 * (peak - base) AS thr FROM o), q AS (SELECT *, CASE WHEN x <> x0 THEN t0 + (thr - x0) * (t - t0) / (x - x0) END AS cut FROM p),
    r AS (SELECT cell, coalesce(min(CASE WHEN t <= pos AND x0 < thr AND x >= thr THEN cut END), min(t)) AS sos, any_value(pos) AS pos, coalesce(min(CASE WHEN t0 >= pos AND x0 >= thr AND x < thr THEN cut END), max(t)) AS eos, any_value(peak) AS peak_value, any_value(base) AS base_value, coalesce(sum((t - t0) * ((x - base) + (x0 - base)) / 2), 0) AS integral FROM q GROUP BY 1)
    SELECT cell, {r6(sos="sos", pos="pos", eos="eos", lgp="greatest(eos - sos, 0)", amplitude="peak_value - base_value", peak_value="peak_value", base_value="base_value", integral="integral")} FROM r""")
def phenometrics_direct(spark, d):
    names = ("sos", "pos", "eos", "lgp", "amplitude", "peak_value", "base_value", "integral")
    return series.phenometrics(_series(spark, d), ["cell"], "top", "t").select("cell", *[R(n) for n in names])


@query(f"WITH {A.DAILY}, a AS (SELECT cell, dayofyear(date)::INT AS doy, top, min(top) OVER w + (max(top) OVER w - min(top) OVER w) * 0.2::DOUBLE AS thr FROM day WINDOW w AS (PARTITION BY cell)) SELECT cell, min(doy) AS sos_doy, max(doy) AS eos_doy, max(doy) - min(doy) AS lgp FROM a WHERE top >= thr GROUP BY 1")
def sos_eos_threshold(spark, d):
    return series.season_by_threshold(A.daily(spark, d).withColumn("doy", F.dayofyear("date")), ["cell"], "top")


@query(f"WITH {A.WEATHER} SELECT o_orderkey, round(0.15::DOUBLE + 0.6::DOUBLE * (1 / (1 + exp(-(0.1::DOUBLE * (doy - 90)))) - 1 / (1 + exp(-(0.08::DOUBLE * (doy - 250))))), 6) AS vi FROM wx")
def double_logistic_curve(spark, d):
    c = lambda v: F.lit(float(v))
    return A.weather(spark, d).select("o_orderkey", R(series.double_logistic(F.col("doy").cast("double"), c(0.15), c(0.6), c(90), c(0.1), c(250), c(0.08)), "vi"))


def _wb(spark, d):
    """Field-days: crop and soil by cell, demand and rain by the day's events."""
    day = A.daily(spark, d)
    df = day.select(F.col("cell").alias("field_id"), "date", (F.col("n") % 5 + 5).cast("double").alias("et0"), F.lit(1.15).alias("kc"), (F.floor("top") % 4).cast("double").alias("rain"), F.when(F.col("n") % 11 == 0, 6.0).otherwise(0.0).alias("irrigation"))
    k = F.col("field_id")
    return df.withColumns({"taw": 1000.0 * ((k % 5).cast("double") / 100.0 + 0.12) * 0.5, "p": (k % 3).cast("double") / 10.0 + 0.4})


_WBIN = f"""inp AS (SELECT cell AS field_id, date, (n % 5 + 5)::DOUBLE AS et0, 1.15::DOUBLE AS kc, (floor(top)::BIGINT % 4)::DOUBLE AS rain, CASE WHEN n % 11 = 0 THEN 6 ELSE 0 END::DOUBLE AS irr, 1000 * ((cell % 5)::DOUBLE / 100 + 0.12::DOUBLE) * 0.5 AS taw, (cell % 3)::DOUBLE / 10 + 0.4::DOUBLE AS p,
  row_number() OVER (PARTITION BY cell ORDER BY date) AS i FROM day)"""


@query(f"""WITH RECURSIVE {A.DAILY}, {_WBIN}, rec AS (
    SELECT field_id, i, date, 0::DOUBLE AS before_dr, et0, kc, rain, irr, taw, p, (1 * 1::DOUBLE) AS ks, least(greatest(-(0 - rain - irr - 0 + 1 * (kc * et0)), 0) + (0 - rain - irr - 0 + 1 * (kc * et0)), taw) AS dr FROM inp WHERE i = 1
    UNION ALL
    SELECT n.field_id, n.i, n.date, r.dr, n.et0, n.kc, n.rain, n.irr, n.taw, n.p, k.ks, least((r.dr - n.rain - n.irr - 0 + k.ks * (n.kc * n.et0)) + greatest(-(r.dr - n.rain - n.irr - 0 + k.ks * (n.kc * n.et0)), 0), n.taw)
    FROM rec r JOIN inp n ON n.field_id = r.field_id AND n.i = r.i + 1, LATERAL (SELECT CASE WHEN n.taw <= 0 OR r.dr <= n.p * n.taw THEN 1 ELSE greatest(least((n.taw - r.dr) / ((1 - n.p) * n.taw), 1), 0) END AS ks) k)
    SELECT field_id, date, {r6(dr="dr", ks="ks", etc="kc * et0", etc_adj="ks * (kc * et0)", peff="rain", irrigation="irr", deep_perc="greatest(-(before_dr - rain - irr - 0 + ks * (kc * et0)), 0)", runoff="0::DOUBLE")} FROM rec""")
def water_balance_daily(spark, d):
    out = balance.run(_wb(spark, d))
    return out.select("field_id", "date", *[R(c) for c in out.columns if c not in ("field_id", "date")])


@query(f"""WITH RECURSIVE {A.DAILY}, {_WBIN}, pad AS (SELECT DISTINCT field_id, g AS i FROM inp, range(1, 9) t(g)), mx AS (SELECT field_id, max(i) AS m FROM inp GROUP BY 1),
    q AS (SELECT p.field_id, p.i, n.et0, n.kc, n.rain, n.irr, n.taw, n.p FROM pad p JOIN mx USING (field_id) JOIN inp n ON n.field_id = p.field_id AND n.i = least(p.i, mx.m)),
    rec AS (SELECT field_id, i, 1::DOUBLE AS ks, least((0 - rain - irr - 0 + 1 * (kc * et0)) + greatest(-(0 - rain - irr - 0 + 1 * (kc * et0)), 0), taw) AS dr FROM q WHERE i = 1
    UNION ALL SELECT n.field_id, n.i, k.ks, least((r.dr - n.rain - n.irr - 0 + k.ks * (n.kc * n.et0)) + greatest(-(r.dr - n.rain - n.irr - 0 + k.ks * (n.kc * n.et0)), 0), n.taw) FROM rec r JOIN q n ON n.field_id = r.field_id AND n.i = r.i + 1, LATERAL (SELECT CASE WHEN n.taw <= 0 OR r.dr <= n.p * n.taw THEN 1 ELSE greatest(least((n.taw - r.dr) / ((1 - n.p) * n.taw), 1), 0) END AS ks) k)
    SELECT field_id, {r6(dnet="dr", dgross="dr / 0.6::DOUBLE", ks_end="ks")} FROM rec WHERE i = 8""")
def deficit_8day(spark, d):
    out = balance.eight_day_deficit(_wb(spark, d))
    return out.select("field_id", R("dnet"), R("dgross"), R("ks_end"))


@query(f"""WITH RECURSIVE {A.DAILY}, {_WBIN}, {_CROPS}, cn AS (SELECT i.*, c.*, i.i - 1 AS das, 25400 / 75::DOUBLE - 254 AS s FROM inp i JOIN crops c ON c.crop = {A.sql_list(A.CROP_OF)}[(i.field_id % 6 + 1)::INT]),
    q AS (SELECT field_id, date, i, taw, p, et0, irr, CASE WHEN das <= l1 THEN ki WHEN das <= l1 + l2 THEN ki + (km - ki) * ((das - l1)::DOUBLE / l2) ELSE km END AS kc, CASE WHEN das <= l1 THEN 'ini' WHEN das <= l1 + l2 THEN 'dev' ELSE 'mid' END AS stage, greatest(rain - CASE WHEN rain > 0.2::DOUBLE * s THEN (rain - 0.2::DOUBLE * s) * (rain - 0.2::DOUBLE * s) / (rain - 0.2::DOUBLE * s + s) ELSE 0 END, 0) AS rain FROM cn),
    rec AS (SELECT field_id, i, stage, taw, p, kc * et0 AS etc, 1::DOUBLE AS ks, least((0 - rain - irr - 0 + 1 * (kc * et0)) + greatest(-(0 - rain - irr - 0 + 1 * (kc * et0)), 0), taw) AS dr FROM q WHERE i = 1
    UNION ALL SELECT n.field_id, n.i, n.stage, n.taw, n.p, n.kc * n.et0, k.ks, least((r.dr - n.rain - n.irr - 0 + k.ks * (n.kc * n.et0)) + greatest(-(r.dr - n.rain - n.irr - 0 + k.ks * (n.kc * n.et0)), 0), n.taw) FROM rec r JOIN q n ON n.field_id = r.field_id AND n.i = r.i + 1, LATERAL (SELECT CASE WHEN n.taw <= 0 OR r.dr <= n.p * n.taw THEN 1 ELSE greatest(least((n.taw - r.dr) / ((1 - n.p) * n.taw), 1), 0) END AS ks) k),
    e AS (SELECT *, {cl("p * (CASE stage WHEN 'ini' THEN 1.1::DOUBLE WHEN 'dev' THEN 1.0 ELSE 0.85::DOUBLE END)", "0.05", "0.95")} AS pe FROM rec), f AS (SELECT *, pe * taw AS raw, CASE WHEN taw <= 0 OR dr <= pe * taw THEN 1 ELSE {cl("(taw - dr) / ((1 - pe) * taw)", "0.0", "1.0")} END AS k2 FROM e)
    SELECT field_id, i AS day, {r6(dr="dr", raw="raw", dgross="greatest(dr, 0) / 0.6::DOUBLE")}, (CASE WHEN k2 <= 0.4::DOUBLE OR dr / taw >= 0.9::DOUBLE THEN 4 WHEN dr >= raw THEN 3 WHEN dr >= 0.75::DOUBLE * raw THEN 2 WHEN dr >= 0.4::DOUBLE * raw THEN 1 ELSE 0 END)::TINYINT AS status FROM f""")
def advisory_end_to_end(spark, d):
    """Demand and rain, crop curve, daily root-zone balance with runoff, and the advisory of each day."""
    from pyspark.sql import Window

    w = Window.partitionBy("field_id").orderBy("date")
    df = _wb(spark, d).withColumns({"day": F.row_number().over(w), "crop": A.nth(A.CROP_OF, F.col("field_id") % 6)})
    df = crop.with_crop(df).withColumn("das", F.col("day") - 1)
    df = df.withColumns({"kc": crop.kc_curve("das"), "stage": crop.stage_for_day("das")})
    bal = balance.run(df, curve_number=75.0).select("field_id", "date", "dr", "etc")
    j = df.select("field_id", "date", F.col("day").cast("long").alias("day"), "taw", "p", "stage").join(bal, ["field_id", "date"])
    e = advisory.evaluate("dr", "taw", "p", "stage", "etc")
    return j.select("field_id", "day", R("dr"), R(e["raw"], "raw"), R(e["dgross"], "dgross"), e["status"].alias("status"))


@query(f"""WITH {A.PIXELS}, b AS (SELECT l_suppkey, avg(nir) AS m, stddev_pop(nir) AS s, median(nir) AS md, 1.4826::DOUBLE * mad(nir) AS r FROM pix GROUP BY 1)
    SELECT l_orderkey, l_linenumber, {r6(z=sd("nir - m", "s"), z_robust=sd("nir - md", "r"))} FROM pix JOIN b USING (l_suppkey)""")
def anomaly_zscore(spark, d):
    p = A.pixels(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "nir")
    z = stats.anomaly(p, p, ["l_suppkey"], "nir")
    z = stats.anomaly(z.withColumnRenamed("z", "z0"), p, ["l_suppkey"], "nir", True)
    return z.select("l_orderkey", "l_linenumber", R("z0", "z"), R("z", "z_robust"))


@query(f"""WITH {A.PIXELS}, v AS (SELECT l_suppkey, l_linenumber, max(nir) AS value, (l_linenumber)::DOUBLE AS w FROM pix GROUP BY 1, 2), m AS (SELECT l_suppkey, median(value) AS med, mad(value) AS md FROM v GROUP BY 1), k AS (SELECT *, (md <= 1e-9 OR 0.6745::DOUBLE * abs(value - med) / md <= 3.5) AS ok FROM v JOIN m USING (l_suppkey))
    SELECT l_suppkey, {r6(median="any_value(med)", mad="any_value(md)", consensus="coalesce(sum(CASE WHEN ok THEN w * value END) / sum(CASE WHEN ok THEN w END), any_value(med))")}, count(CASE WHEN ok THEN 1 END)::INT AS n_kept FROM k GROUP BY 1""")
def consensus_mad(spark, d):
    v = A.pixels(spark, d).groupBy("l_suppkey", "l_linenumber").agg(F.max("nir").alias("value")).withColumn("w", F.col("l_linenumber").cast("double"))
    out = stats.consensus(v, ["l_suppkey"], "value", "w")
    return out.select("l_suppkey", R("median"), R("mad"), R("consensus"), "n_kept")


@query(f"""WITH {A.PIXELS}, t AS (SELECT l_suppkey, nir AS x, nir_n * 1.1::DOUBLE + red * 0.05::DOUBLE AS y, nir + blue * 0.5 AS z FROM pix), s AS (SELECT l_suppkey, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, var_samp(z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM t GROUP BY 1 HAVING count(*) >= 3)
    SELECT l_suppkey, n, round(greatest(xx - xy * xz / yz, 0), 5) + 0 AS var_err_x, round(greatest(yy - xy * yz / xz, 0), 5) + 0 AS var_err_y, round(greatest(zz - xz * yz / xy, 0), 5) + 0 AS var_err_z, round(sqrt(least(greatest(xy * xz / yz / xx, 0), 1)), 5) AS rho_x FROM s""")
def triple_collocation(spark, d):
    p = A.pixels(spark, d).select("l_suppkey", F.col("nir").alias("x"), (F.col("nir_n") * 1.1 + F.col("red") * 0.05).alias("y"), (F.col("nir") + F.col("blue") * 0.5).alias("z"))
    return stats.triple_collocation(p, ["l_suppkey"]).select("l_suppkey", "n", *[R(c, None, 5) for c in ("var_err_x", "var_err_y", "var_err_z", "rho_x")])


@query(f"WITH {A.PIXELS} SELECT l_suppkey, round(regr_slope(y, nir), 5) AS gain, round(regr_intercept(y, nir), 5) AS bias, count(*) AS n FROM (SELECT l_suppkey, nir, nir * 0.9::DOUBLE + red AS y FROM pix) GROUP BY 1 HAVING count(*) >= 2")
def ols_calibration(spark, d):
    p = A.pixels(spark, d).withColumn("y", F.col("nir") * 0.9 + F.col("red"))
    return stats.fitted_calibration(p, ["l_suppkey"], "nir", "y").select("l_suppkey", R("gain", None, 5), R("bias", None, 5), "n")


@query(f"""WITH {A.FIELDS}, f AS (SELECT field_id, area_ha / 30 AS smap, dr AS s1, etc + distance_from_head_m / 200 AS optical FROM fld), a AS (SELECT median(s1) AS m1, median(optical) AS m2, stddev_pop(smap) AS sd, mad(s1) AS d1, mad(optical) AS d2 FROM f)
    SELECT field_id, round({cl("smap + 0.10::DOUBLE * ((s1 - m1) / (1.4826::DOUBLE * (d1 + 1e-12))) * sd - 0.05::DOUBLE * ((optical - m2) / (1.4826::DOUBLE * (d2 + 1e-12))) * sd", "0.0", "0.6")}, 6) AS downscaled FROM f, a""")
def downscale_sm(spark, d):
    f = A.fields(spark, d).select("field_id", (F.col("area_ha") / 30.0).alias("smap"), F.col("dr").alias("s1"), (F.col("etc") + F.col("distance_from_head_m") / 200.0).alias("optical"))
    return stats.downscaled(f).select("field_id", R("downscaled"))


@query(f"WITH {A.PIXELS} SELECT l_orderkey, l_linenumber, round(coalesce(cs, (SELECT median(cs) FROM pix)), 6) AS cs, round(nir, 6) AS nir FROM pix")
def impute_median(spark, d):
    return stats.impute_median(A.pixels(spark, d).select("l_orderkey", "l_linenumber", "cs", "nir"), ["cs", "nir"]).select("l_orderkey", "l_linenumber", R("cs"), R("nir"))


@query("WITH c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY 1), t AS (SELECT sum(c) AS n, count(*) AS k FROM c) SELECT vec_id, label, round(n::DOUBLE / (k * c), 6) AS weight FROM embeddings JOIN c USING (label), t")
def balanced_weights(spark, d):
    return stats.balanced_weights(A.read(spark, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", "label", R("weight"))


@query(f"WITH {A.POINTS}, e AS (SELECT min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pts) SELECT c_custkey, (least(floor((lat - y0) / (y1 - y0) * 8), 7) * 8 + least(floor((lng - x0) / (x1 - x0) * 8), 7))::INT AS block FROM pts, e")
def block_split_ids(spark, d):
    return stats.block_id(A.points(spark, d), "lng", "lat", 8).select("c_custkey", "block")


@query("WITH ids AS (" + SQL["block_split_ids"] + """), b AS (SELECT DISTINCT block FROM ids), k AS (SELECT block, row_number() OVER (ORDER BY (('0x' || substr(sha256('42/' || block), 1, 12))::BIGINT % 10000), block) AS r, count(*) OVER () AS n FROM b)
    SELECT c_custkey, block, r <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) AS is_test FROM ids JOIN k USING (block)""")
def block_split(spark, d):
    return stats.block_split(A.points(spark, d), "lng", "lat", 8).select("c_custkey", "block", "is_test")


@query("SELECT c_custkey, (('0x' || substr(sha256('42/' || c_custkey), 1, 12))::BIGINT % 10000) / 10000::DOUBLE < 0.7::DOUBLE AS is_train FROM customer")
def random_split(spark, d):
    return classify.hash_split(A.read(spark, d, "customer").select("c_custkey"), "c_custkey")


_CM = "g AS (SELECT DISTINCT unnest([quality, toxic]) AS l FROM labels), c AS (SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2), cm AS (SELECT a.l AS truth, b.l AS pred, coalesce(c.n, 0)::BIGINT AS n FROM g a, g b LEFT JOIN c ON c.truth = a.l AND c.pred = b.l)"


def _cm(spark, d):
    return accuracy.confusion(A.read(spark, d, "labels"), "quality", "toxic")


@query(f"WITH {_CM} SELECT * FROM cm")
def confusion_matrix(spark, d):
    return _cm(spark, d)


@query(f"""WITH {_CM}, t AS (SELECT sum(n)::DOUBLE AS t, sum(CASE WHEN truth = pred THEN n ELSE 0 END)::DOUBLE AS h FROM cm), r AS (SELECT truth AS l, sum(n)::DOUBLE AS r FROM cm GROUP BY 1), s AS (SELECT pred AS l, sum(n)::DOUBLE AS s FROM cm GROUP BY 1), e AS (SELECT sum(r * s) AS rc FROM r JOIN s USING (l))
    SELECT round(h / t, 6) AS overall_accuracy, round(CASE WHEN abs(1 - rc / (t * t)) < 1e-12 THEN CASE WHEN h = t THEN 1 ELSE 0 END ELSE (h / t - rc / (t * t)) / (1 - rc / (t * t)) END, 6) AS kappa FROM t, e""")
def overall_accuracy_kappa(spark, d):
    return accuracy.overall(_cm(spark, d)).select(R("overall_accuracy"), R("kappa"))


@query(f"""WITH {_CM}, r AS (SELECT truth AS l, sum(n)::BIGINT AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END)::DOUBLE AS hit FROM cm GROUP BY 1), s AS (SELECT pred AS l, sum(n) AS said FROM cm GROUP BY 1),
    e AS (SELECT l::VARCHAR AS label, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS q, support FROM r JOIN s USING (l)), f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM e),
    u AS (SELECT label, p, q, f1, support FROM f UNION ALL SELECT 'macro', avg(p), avg(q), avg(f1), sum(support)::BIGINT FROM f UNION ALL SELECT 'weighted', sum(p * support) / sum(support), sum(q * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)
    SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def per_class_metrics(spark, d):
    return accuracy.per_class(_cm(spark, d)).select("label", R("precision"), R("recall"), R("f1"), "support")


@query(f"""WITH k AS (SELECT vec_id, label, ((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10)::INT AS ref FROM embeddings), lab AS (SELECT DISTINCT label AS l FROM k), c AS (SELECT label AS map, ref, count(*)::DOUBLE AS n FROM k GROUP BY 1, 2), ni AS (SELECT map, sum(n) AS ni FROM c GROUP BY 1), w AS (SELECT l AS map, (l + 1)::DOUBLE / (SELECT sum(l + 1) FROM lab) AS w FROM lab),
    p AS (SELECT c.map, c.ref, n, ni, w, n / ni AS u, w * (n / ni) AS p FROM c JOIN ni USING (map) JOIN w USING (map)), dg AS (SELECT map AS l, w, ni, p AS pd, u FROM p WHERE map = ref), rf AS (SELECT ref AS l, sum(p) AS area, sum(CASE WHEN ni > 1 THEN (w * p - p * p) / (ni - 1) ELSE 0 END) AS va, sum(CASE WHEN ni > 1 AND map <> ref THEN w * w * u * (1 - u) / (ni - 1) ELSE 0 END) AS t2 FROM p GROUP BY 1),
    e AS (SELECT *, pd / area AS pr, u * (1 - u) / (ni - 1) AS sp FROM dg JOIN rf USING (l)), t AS (SELECT sum(pd) AS oa, sqrt(sum(w * w * sp)) AS so FROM e)
    SELECT l AS label, {r6(users="u", producers="pr", area_proportion="area", se_users="sqrt(sp)", se_producers="sqrt(greatest((w * w * (1 - pr) * (1 - pr) * sp + pr * pr * t2) / (area * area), 0))", se_area="sqrt(greatest(va, 0))", oa="oa", se_oa="so", oa_low="oa - 1.96::DOUBLE * so", oa_high="oa + 1.96::DOUBLE * so")} FROM e, t""")
def area_weighted_accuracy(spark, d):
    k = A.read(spark, d, "embeddings").select("label", ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10).cast("int").alias("ref"))
    cm = k.groupBy(F.col("label").alias("map"), "ref").agg(F.count(F.lit(1)).cast("double").alias("n"))
    areas = k.select("label").distinct().withColumn("fraction", (F.col("label") + 1).cast("double"))
    out = accuracy.area_weighted(cm, areas)
    return out.select("label", *[R(c) for c in out.columns if c != "label"])


@query(f"WITH {A.FIELDS}, {_ADV} SELECT command_id, round(sum(CASE WHEN status >= 2 THEN greatest(dr, 0) / 0.6::DOUBLE * area_ha * 10 ELSE 0 END), 4) AS volume_m3, round(sum(CASE WHEN status >= 2 THEN greatest(dr, 0) / 0.6::DOUBLE * area_ha * 10 ELSE 0 END) / 0.03::DOUBLE / 3600, 4) AS hours, count(*) FILTER (status >= 2) AS n_need, count(*) AS n_fields FROM adv GROUP BY 1")
def command_plan(spark, d):
    return command.plan(_advised(spark, d), 0.03).select("command_id", R("volume_m3", None, 4), R("hours", None, 4), "n_need", "n_fields")


def _advised(spark, d):
    df = A.fields(spark, d).withColumns({"taw": soil.total_available("theta_fc", "theta_wp", "zr"), "is_rice": F.col("crop") == "rice"})
    e = advisory.evaluate("dr", "taw", "p", "stage", "etc", is_ponded="is_rice")
    return df.withColumns({k: e[k] for k in ("raw", "status", "dgross")})


@query(f"WITH {A.FIELDS}, {_ADV} SELECT command_id, field_id, round(greatest(dr, 0) / 0.6::DOUBLE * area_ha * 10, 4) AS volume_m3, row_number() OVER (PARTITION BY command_id ORDER BY is_tail_end DESC, distance_from_head_m DESC, status DESC, greatest(dr, 0) / 0.6::DOUBLE DESC, field_id)::INT AS rank FROM adv WHERE status >= 2")
def command_delivery_order(spark, d):
    return command.delivery(_advised(spark, d)).select("command_id", "field_id", R("volume_m3", None, 4), "rank")


@query(f"""WITH {A.FIELDS}, f AS (SELECT *, field_id::VARCHAR AS cell, round(dr / 160, 4) AS stress_index, ['monitor', 'irrigate_soon', 'irrigate_now'][(field_id % 3 + 1)::INT] AS action FROM fld WHERE field_id % 7 > 0), h AS (SELECT command_id, action, count(*) AS n, min(field_id) AS pos FROM f GROUP BY 1, 2)
    SELECT command_id, count(*) AS n_cells, round(avg(stress_index), 4) AS mean_stress, round(avg(dr), 2) AS mean_deficit, round(avg(dr) * 12500 * 10, 1) AS demand_m3, (SELECT arg_max(action, n * 1000000 - pos) FROM h WHERE h.command_id = f.command_id) AS dominant FROM f GROUP BY 1""")
def command_rollup(spark, d):
    f = A.fields(spark, d)
    area = f.select("command_id", F.col("field_id").cast("string").alias("cell"), F.col("field_id").alias("pos"), F.lit(12500.0).alias("command_area_ha"))
    s = f.where("field_id % 7 > 0").select(F.col("field_id").cast("string").alias("cell"), A.rounded(F.col("dr") / 160.0, 4).alias("stress_index"))
    a = f.select(F.col("field_id").cast("string").alias("cell"), F.col("dr").alias("deficit_mm"), A.nth(["monitor", "irrigate_soon", "irrigate_now"], F.col("field_id") % 3).alias("action"))
    return command.rollup(area, s, a).drop("actions")


@query(f"""WITH {A.FIELDS}, f AS (SELECT *, dr * 0.7::DOUBLE AS raw, ['no_irrigation', 'watch', 'irrigate_soon', 'irrigate_now', 'critical'][(field_id % 5 + 1)::INT] AS a FROM fld), g AS (SELECT *, (CASE WHEN a IN ('irrigate_now', 'critical') THEN greatest(dr, 0) WHEN a = 'irrigate_soon' THEN greatest(dr - raw * 0.6::DOUBLE, 0) ELSE 0 END) / 0.65::DOUBLE * 1e-3 * area_ha * 1e4 AS m3 FROM f)
    SELECT command_id, count(*) AS n_fields, round(sum(area_ha), 1) AS total_area_ha, """ + ", ".join(f"count(*) FILTER (a = '{x}') AS n_{x}, round(100 * count(*) FILTER (a = '{x}') / count(*)::DOUBLE, 1) AS pct_{x}" for x in ("no_irrigation", "watch", "irrigate_soon", "irrigate_now", "critical")) + ", round(sum(m3), 0) AS gross_demand_m3, round(sum(m3) / 1e4, 1) AS gross_demand_ham FROM g GROUP BY 1")
def dashboard_rollup(spark, d):
    f = A.fields(spark, d).withColumns({"raw": F.col("dr") * 0.7, "advisory": A.nth(["no_irrigation", "watch", "irrigate_soon", "irrigate_now", "critical"], F.col("field_id") % 5)})
    return command.dashboard(f, ["command_id"])


_REG = f"{A.REGISTRY}, rg AS (SELECT *, list_distinct([g[(k % 5 + 1)::INT], g[(k * 7 % 5 + 1)::INT]]) AS fills FROM reg)"


@query(f"WITH {_REG} SELECT id, tier, sensor_type FROM rg WHERE tier = 1 OR sensor_type = 'sar'")
def catalog_by_tier_or_type(spark, d):
    r = A.registry(spark, d)
    return catalog.by_tier(r, 1).unionByName(catalog.by_type(r, "SAR")).select("id", "tier", "sensor_type").distinct()


@query(f"WITH {_REG} SELECT id, gee_asset_id IS NOT NULL AS gee, stac_collection IS NOT NULL AS stac FROM rg WHERE gee_asset_id IS NOT NULL OR stac_collection IS NOT NULL")
def catalog_native(spark, d):
    r = A.registry(spark, d)
    both = catalog.native(r, "gee_asset_id").unionByName(catalog.native(r, "stac_collection")).select("id", "gee_asset_id", "stac_collection").distinct()
    return both.select("id", F.col("gee_asset_id").isNotNull().alias("gee"), F.col("stac_collection").isNotNull().alias("stac"))


@query(f"WITH {_REG} SELECT id, tier, cost FROM rg WHERE list_contains(fills, 'moisture')")
def gap_fillers(spark, d):
    return catalog.gap_fillers(A.registry(spark, d), "moisture").select("id", "tier", "cost")


@query(f"WITH {_REG} SELECT id, CASE WHEN gee_asset_id IS NOT NULL THEN 'gee' WHEN stac_collection IS NOT NULL THEN 'stac' ELSE 'portal' END AS method, coalesce(gee_asset_id, stac_collection, portal) AS asset, CASE WHEN gee_asset_id IS NULL AND stac_collection IS NOT NULL THEN CASE stac_collection WHEN 'coll-0' THEN 'earth_search' WHEN 'coll-1' THEN 'usgs' ELSE 'planetary_computer' END END AS endpoint FROM rg")
def resolve_asset(spark, d):
    return catalog.resolve(A.registry(spark, d), A.endpoints(spark))


@query(f"WITH {_REG} SELECT 'tier' AS facet, tier::VARCHAR AS value, count(*) AS n FROM rg GROUP BY 2 UNION ALL SELECT 'type', sensor_type, count(*) FROM rg GROUP BY 2 UNION ALL SELECT 'gap', g, count(*) FROM (SELECT unnest(fills) AS g FROM rg) GROUP BY 2")
def registry_summary(spark, d):
    return catalog.summary(A.registry(spark, d))


@query(f"WITH {_REG} SELECT id, list_sort(list_filter(list_distinct([g[(k % 5 + 1)::INT], g[(k * 7 % 5 + 1)::INT]]), lambda x: x NOT IN ('cloud', 'thermal'))) AS unknown FROM rg WHERE len(list_filter(fills, lambda x: x NOT IN ('cloud', 'thermal'))) > 0")
def registry_unknown_gaps(spark, d):
    return catalog.unknown_gaps(A.registry(spark, d), {"cloud", "thermal"}).select("id", F.array_sort("unknown").alias("unknown"))


@query(f"WITH {A.POINTS} SELECT c_custkey AS id, DATE '2024-01-01' + (c_custkey % 60)::INT AS date FROM pts WHERE c_custkey % 2 = 0 AND c_custkey % 60 BETWEEN 10 AND 40 AND lng + 1 >= -60 AND lng <= 60 AND lat + 1 >= -30 AND lat <= 40 ORDER BY 2, 1 LIMIT 50")
def item_search(spark, d):
    p = A.points(spark, d).select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "s2").otherwise("l8").alias("collection"), F.date_add(F.lit(START), (F.col("c_custkey") % 60).cast("int")).alias("date"), F.col("lng").alias("min_lng"), F.col("lat").alias("min_lat"), (F.col("lng") + 1.0).alias("max_lng"), (F.col("lat") + 1.0).alias("max_lat"))
    return catalog.search(p, "s2", (-60, -30, 60, 40), date(2024, 1, 11), date(2024, 2, 10), 50).select("id", "date")


def _near(radius: int, mode: str) -> str:
    ix = {"clamp": ("least(greatest(a.y + dy, 0), h - 1)", "least(greatest(a.x + dx, 0), w - 1)"), "reflect": tuple(f"(h - 1 - abs(h - 1 - abs(a.{c} + d{c}) % greatest(2 * (h - 1), 1)))".replace("h", n) for c, n in (("y", "h"), ("x", "w"))), "drop": ("a.y + dy", "a.x + dx")}[mode]
    return f"dim AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM grd), off AS (SELECT i AS dy, j AS dx FROM range(-{radius}, {radius + 1}) p(i), range(-{radius}, {radius + 1}) q(j)), nb AS (SELECT a.patch, a.y, a.x, dy, dx, {ix[0]} AS ny, {ix[1]} AS nx FROM grd a, off, dim)"


@query(f"WITH {A.GRID}, {_near(2, 'clamp')} SELECT n.patch, n.y, n.x, round(avg(g.value), 6) AS mean FROM nb n JOIN grd g ON g.y = n.ny AND g.x = n.nx GROUP BY 1, 2, 3")
def boxcar(spark, d):
    return raster.box_mean(A.grid(spark, d), 5).select("patch", "y", "x", R("mean"))


@query(SQL["boxcar"])
def boxcar_wide(spark, d):
    return raster.box_mean_wide(A.grid(spark, d), 5).select("patch", "y", "x", R("mean"))


@query(f"WITH {A.GRID}, {_near(1, 'drop')} SELECT n.patch, n.y, n.x, round(avg(g.value), 6) AS mean FROM nb n JOIN grd g ON g.y = n.ny AND g.x = n.nx GROUP BY 1, 2, 3")
def focal_mean(spark, d):
    return raster.box_mean(A.grid(spark, d), 3, edge="drop").select("patch", "y", "x", R("mean"))


@query(f"WITH {A.GRID}, {_near(1, 'drop')}, f AS (SELECT n.y, n.x, avg(g.size) AS m FROM nb n JOIN grd g ON g.y = n.ny AND g.x = n.nx GROUP BY 1, 2) SELECT patch, y, x, round({cl('value / 5000 + 0.02::DOUBLE * (size - m)', '0', '0.6')}, 6) AS sm FROM grd JOIN f USING (y, x)")
def sharpened_moisture(spark, d):
    g = A.grid(spark, d).withColumn("sm", F.col("value") / 5000.0)
    return raster.sharpened_moisture(g, 3, "patch", "sm", "size").select("patch", "y", "x", R("sm"))


@query(f"WITH {A.GRID}, {_near(2, 'clamp')}, s AS (SELECT n.patch, n.y, n.x, avg(g.value) AS m, avg(g.value * g.value) AS m2 FROM nb n JOIN grd g ON g.y = n.ny AND g.x = n.nx GROUP BY 1, 2, 3), v AS (SELECT s.*, g.value AS v, greatest(m2 - m * m, 0) AS vl, m * m * 1.0 AS nz FROM s JOIN grd g USING (patch, y, x)), q AS (SELECT *, greatest((vl - nz) / 2, 0) AS sg FROM v) SELECT patch, y, x, round(m + (CASE WHEN sg + nz > 1e-12 THEN sg / (sg + nz) ELSE 0 END) * (v - m), 5) AS filtered FROM q")
def refined_lee(spark, d):
    return raster.refined_lee(A.grid(spark, d), 5).select("patch", "y", "x", R("filtered", None, 5))


@query(SQL["refined_lee"].replace(_near(2, "clamp"), _near(3, "clamp")))
def refined_lee_7(spark, d):
    """The default window of 7."""
    return raster.refined_lee(A.grid(spark, d)).select("patch", "y", "x", R("filtered", None, 5))


@query(SQL["boxcar"].replace(_near(2, "clamp"), _near(12, "clamp")))
def boxcar_25(spark, d):
    return raster.box_mean(A.grid(spark, d), 25).select("patch", "y", "x", R("mean"))


_Q = "qz AS (SELECT patch, y, x, CASE WHEN hi > lo THEN round_even((size - lo) / (hi - lo) * 15, 0)::INT ELSE 0 END AS q FROM (SELECT *, min(size) OVER () AS lo, max(size) OVER () AS hi FROM grd))"


@query(f"WITH {A.GRID}, {_Q} SELECT * FROM qz")
def quantise(spark, d):
    return raster.quantise(A.grid(spark, d), 16, value="size").select("patch", "y", "x", "q")


_GL = "off(angle, dy, dx) AS (VALUES (0, 0, 1), (45, -1, 1), (90, -1, 0), (135, -1, -1)), pr AS (SELECT a.patch, angle, a.q AS i, b.q AS j FROM qz a, off JOIN qz b ON b.y = a.y + dy AND b.x = a.x + dx), sy AS (SELECT * FROM pr UNION ALL SELECT patch, angle, j, i FROM pr), n AS (SELECT patch, angle, i, j, count(*) AS n FROM sy GROUP BY 1, 2, 3, 4), gl AS (SELECT patch, angle, i, j, n / sum(n) OVER (PARTITION BY angle)::DOUBLE AS p FROM n)"


@query(f"WITH {A.GRID}, {_Q}, {_GL} SELECT patch, angle, i, j, round(p, 9) AS p FROM gl")
def glcm(spark, d):
    return raster.cooccurrence(raster.quantise(A.grid(spark, d), 16, value="size")).select("patch", "angle", "i", "j", R("p", None, 9))


@query(f"""WITH {A.GRID}, {_Q}, {_GL}, m AS (SELECT *, sum(i * p) OVER (PARTITION BY angle) AS mi, sum(j * p) OVER (PARTITION BY angle) AS mj FROM gl), e AS (SELECT patch, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm, -sum(p * ln(p)) AS entropy, sum((i - mi) * (i - mi) * p) AS vi, sum((j - mj) * (j - mj) * p) AS vj, sum((i - mi) * (j - mj) * p) AS cv FROM m GROUP BY 1, 2)
    SELECT patch, {r6(contrast="avg(contrast)", dissimilarity="avg(dissimilarity)", homogeneity="avg(homogeneity)", energy="avg(sqrt(asm))", asm="avg(asm)", correlation="avg(CASE WHEN sqrt(vi * vj) < 1e-12 THEN 1 ELSE cv / sqrt(vi * vj) END)", entropy="avg(entropy)")} FROM e GROUP BY 1""")
def glcm_props(spark, d):
    out = raster.haralick(raster.cooccurrence(raster.quantise(A.grid(spark, d), 16, value="size")))
    return out.select("patch", *[R(c) for c in out.columns if c != "patch"])


def _fusion(spark, d):
    g = A.grid(spark, d)
    return g.select("patch", "y", "x", (F.col("value") / 2000.0).alias("f0"), (F.col("value") / 2100.0).alias("c0"), (F.col("value") / 2100.0 + F.col("size") / 500.0).alias("c1"), (F.col("value") / 1900.0).alias("f2"), (F.col("value") / 2050.0 + F.col("size") / 300.0).alias("c2"))


_FG = "grd AS (SELECT patch, y, x, value / 2000 AS f0, value / 2100 AS c0, value / 2100 + size / 500 AS c1, value / 1900 AS f2, value / 2050 + size / 300 AS c2 FROM raw)"


def _starfm(f: str, c: str, out: str) -> str:
    return f"""{out}t AS (SELECT stddev_pop({f}) * 2 / 4 + 1e-6 AS tol FROM grd), {out}w AS (SELECT n.patch, n.y, n.x, n.dy, n.dx, g.{f} AS f, g.{c} AS a, g.c1 AS b, s.{f} AS own, s.c1 - s.{c} AS ch FROM nb n JOIN grd g ON g.y = n.ny AND g.x = n.nx JOIN grd s ON s.y = n.y AND s.x = n.x),
      {out}v AS (SELECT patch, y, x, own, ch, CASE WHEN abs(f - own) <= tol THEN 1 / ((abs(f - own) + 1e-6) * (abs(b - a) + 1e-6) * (1 + sqrt((dy * dy + dx * dx)::DOUBLE))) ELSE 0 END AS w, f + (b - a) AS cand FROM {out}w, {out}t), {out} AS (SELECT patch, y, x, CASE WHEN sum(w) > 0 THEN sum(w * cand) / sum(w) ELSE any_value(own + ch) END AS pred FROM {out}v GROUP BY 1, 2, 3)"""


_RAW = A.GRID.replace("grd AS", "raw AS", 1)


@query(f"WITH {_RAW}, {_FG}, {_near(1, 'reflect')}, {_starfm('f0', 'c0', 'p')} SELECT patch, y, x, round(pred, 6) AS pred FROM p")
def starfm_w3(spark, d):
    return raster.starfm(_fusion(spark, d), win=3).select("patch", "y", "x", R("pred"))


@query(f"WITH {_RAW}, {_FG}, {_near(12, 'reflect')}, {_starfm('f0', 'c0', 'p')} SELECT patch, y, x, round(pred, 6) AS pred FROM p")
def starfm(spark, d):
    """The default window of 25."""
    return raster.starfm(_fusion(spark, d)).select("patch", "y", "x", R("pred"))


@query(f"WITH {_RAW}, {_FG}, {_near(1, 'reflect')}, {_starfm('f0', 'c0', 'p')}, {_starfm('f2', 'c2', 'q')}, ds AS (SELECT avg(abs(c1 - c0)) + 1e-6 AS d0, avg(abs(c1 - c2)) + 1e-6 AS d2 FROM grd), wt AS (SELECT (1 / d0) / (1 / d0 + 1 / d2) AS w FROM ds) SELECT p.patch, p.y, p.x, round(w * p.pred + (1 - w) * q.pred, 6) AS pred FROM p JOIN q USING (patch, y, x), wt")
def estarfm_w3(spark, d):
    return raster.estarfm(_fusion(spark, d), win=3).select("patch", "y", "x", R("pred"))


@query(SQL["estarfm_w3"].replace(_near(1, "reflect"), _near(12, "reflect")))
def estarfm(spark, d):
    """The default window of 25."""
    return raster.estarfm(_fusion(spark, d)).select("patch", "y", "x", R("pred"))


@query(f"WITH {A.GRID}, m AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM grd), t AS (SELECT i AS ty, j AS tx, round_even(i * ((h - 1) / 16::DOUBLE), 0)::INT AS y, round_even(j * ((w - 1) / 22::DOUBLE), 0)::INT AS x FROM range(17) a(i), range(23) b(j), m) SELECT patch, ty::INT AS y, tx::INT AS x, value FROM t JOIN grd USING (y, x)")
def resample_nearest(spark, d):
    return raster.resample_nearest(A.grid(spark, d), 17, 23)


@query(f"""WITH {A.GRID}, m AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM grd), t AS (SELECT i, j, h, w, i * ((h - 1) / 16::DOUBLE) AS sy, j * ((w - 1) / 22::DOUBLE) AS sx FROM range(17) a(i), range(23) b(j), m), c AS (SELECT i, j, least(floor(sy)::INT + a, h - 1) AS y, least(floor(sx)::INT + b, w - 1) AS x, (CASE WHEN a = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN b = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS k FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
    SELECT patch, i::INT AS y, j::INT AS x, round(sum(k * value), 5) AS value FROM c JOIN grd USING (y, x) GROUP BY 1, 2, 3""")
def resample_bilinear(spark, d):
    return raster.resample_bilinear(A.grid(spark, d), 17, 23).select("patch", "y", "x", R("value", None, 5))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (CASE WHEN sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) < 1e-12 THEN 1 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END)) AS v FROM embeddings)"
_CENT = "ce AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u) GROUP BY 1, 2), cv AS (SELECT label, list(x ORDER BY i) AS c FROM ce GROUP BY 1), cn AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM cv)"


@query(f"WITH {_UNIT}, {_CENT}, s AS (SELECT vec_id, cn.label, round(list_dot_product(v, c), 9) AS score FROM u, cn) SELECT vec_id, arg_max(label, score - label * 1e-13)::INT AS predicted, round(max(score), 6) AS score FROM s GROUP BY 1")
def embedding_centroid_classify(spark, d):
    e = A.read(spark, d, "embeddings")
    return classify.by_centroid(e, classify.centroids(e)).select("vec_id", "predicted", R("score"))


@query(f"WITH {_UNIT}, {_CENT}, s AS (SELECT vec_id, cn.label, exp(list_dot_product(v, c)) AS e FROM u, cn) SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM s")
def embedding_probabilities(spark, d):
    e = A.read(spark, d, "embeddings")
    return classify.probabilities(e, classify.centroids(e)).select("vec_id", "label", R("probability"))


@query(f"WITH {_UNIT}, s AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(-list_dot_product(q.v, t.v), 9), t.vec_id) AS r FROM u q JOIN u t ON q.vec_id <> t.vec_id), v AS (SELECT vec_id, label, count(*) AS n FROM s WHERE r <= 5 GROUP BY 1, 2) SELECT vec_id, arg_max(label, n * 1000 - label)::INT AS predicted FROM v GROUP BY 1")
def embedding_knn(spark, d):
    e = A.read(spark, d, "embeddings")
    return classify.by_neighbours(e, e)


@query(f"WITH {A.DAILY}, s AS (SELECT cell, ((date - DATE '2024-01-01') // 8)::INT AS w, max(top) AS v FROM day GROUP BY 1, 2) SELECT cell, " + ", ".join(f"max(CASE WHEN w = {i} THEN v END) AS v_t{i}" for i in range(4)) + ", round(avg(v), 6) AS v_mean, max(v) AS v_max, round(stddev_pop(v), 5) + 0 AS v_std FROM s GROUP BY 1")
def feature_stack(spark, d):
    s = _series(spark, d).groupBy("cell", F.floor(F.col("t") / 8).cast("int").alias("w")).agg(F.max("top").alias("v"))
    out = classify.feature_stack(s, ["cell"], "w", ["v"], [0, 1, 2, 3])
    return out.select("cell", *[f"v_t{i}" for i in range(4)], R("v_mean"), "v_max", R("v_std", None, 5))


@query(f"WITH {A.DAILY}, s AS (SELECT cell, ((date - DATE '2024-01-01') // 8)::INT AS w, max(top) AS v FROM day GROUP BY 1, 2) SELECT cell, " + ", ".join(f"max(CASE WHEN w = {i} THEN v END) AS s1_t{i:02d}_v" for i in range(4)) + " FROM s GROUP BY 1")
def time_stack(spark, d):
    s = _series(spark, d).groupBy("cell", F.floor(F.col("t") / 8).cast("int").alias("w")).agg(F.max("top").alias("v"))
    return classify.stacked(s, ["cell"], "w", ["v"], [0, 1, 2, 3], "s1")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, g""")
def event_sessions(spark, d):
    out = windows.sessions(A.read(spark, d, "events"), ["user_id"], "6 hours")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query()
def whittaker(spark, d):
    return smoothing.whittaker_series(_series(spark, d), "cell", "t", "vi")


@query()
def double_logistic_fit(spark, d):
    return smoothing.season_series(_series(spark, d), "cell", "t", "vi")


@query()
def harmonic(spark, d):
    return smoothing.harmonic_series(_series(spark, d), "cell", "t", "vi")


@query()
def phenometrics(spark, d):
    return smoothing.phenometric_series(_series(spark, d), "cell", "t", "vi")


@query(f"""WITH {A.REGISTRY} SELECT id AS sensor, DATE '2024-01-01' + (t * 12)::INT AS date, y::INT AS y, x::INT AS x, band, round(least(greatest(0.25::DOUBLE + 0.45::DOUBLE * sin(pi() * t / 5) + 0.2::DOUBLE * ((('0x' || substr(sha256('0/' || id || '/' || t || '/' || y || '/' || x || '/' || band), 1, 12))::BIGINT % 10000) / 10000::DOUBLE), 0), 1), 5) AS value
    FROM reg, range(6) a(t), range(16) b(y), range(16) c(x), (VALUES ('red'), ('nir')) v(band) WHERE sensor_type = 'optical'""")
def synthetic_stack(spark, d):
    """A stack for each optical sensor of the registry."""
    sensors = A.registry(spark, d).where("sensor_type = 'optical'").select(F.col("id").alias("sensor"))
    out = tables.synthetic(spark, sensors, "optical_sr", START, date(2024, 3, 1), 6, 16, ("red", "nir"))
    return out.select("sensor", "date", "y", "x", "band", R(F.col("value").cast("double"), "value", 5))


_CUBE = "WITH " + A.GRID + """, h AS (SELECT t, y, x, DATE '2024-01-01' + (t * 30)::INT AS date, dayofyear(DATE '2024-01-01' + (t * 30)::INT)::DOUBLE AS doy, ((y // 10 * 3 + x // 12) % 5)::INT AS field_id FROM range(12) a(t), grd),
    r AS (SELECT *, HASH(ndvi) AS u1, HASH(cloud) AS u2, HASH(sm) AS u3, HASH(lst) AS u4 FROM h),
    g AS (SELECT *, greatest(0, least(0.95::DOUBLE, 0.18::DOUBLE + 0.02::DOUBLE * field_id + (0.45::DOUBLE + 0.08::DOUBLE * (field_id - 2)) * exp(-0.5 * ((doy - (150 + 25 * (field_id - 2))) / 45) ** 2) + (u1 - 0.5) * (0.015::DOUBLE * sqrt(12)))) AS g FROM r),
    l AS (SELECT *, lag(g) OVER w AS b, lead(g) OVER w AS a FROM g WINDOW w AS (PARTITION BY y, x ORDER BY t)),
    s AS (SELECT *, CASE WHEN b IS NULL THEN a - g WHEN a IS NULL THEN g - b ELSE (a - b) / 2 END AS d, CASE WHEN u2 < 0.25 * (0.6::DOUBLE + 0.8::DOUBLE * exp(-0.5 * ((doy - 200) / 40) ** 2)) THEN 0 ELSE 1 END AS qa, greatest(0, least(1, 0.2::DOUBLE + 0.45::DOUBLE * g)) AS nir FROM l),
    e AS (SELECT *, greatest(0, least(1, nir * (1 - g) / (1 + g + 1e-6))) AS red, greatest(0.02::DOUBLE, least(0.55::DOUBLE, 0.15::DOUBLE + 0.12::DOUBLE * exp(-0.5 * ((doy - 210) / 35) ** 2) + 0.05::DOUBLE * (1 - g) + (u3 - 0.5) * (0.01::DOUBLE * sqrt(12)))) AS sm FROM s),
    f AS (SELECT *, greatest(0, least(1, red * 1.15::DOUBLE + 0.02::DOUBLE)) AS green, greatest(0, least(1, red * 0.95::DOUBLE + 0.01::DOUBLE)) AS blue FROM e)
    SELECT date, y::INT AS y, x::INT AS x, field_id, round(blue, 6) AS blue, round(green, 6) AS green, round(red, 6) AS red, round(nir, 6) AS nir, round(greatest(0, least(1, 0.18::DOUBLE + 0.1::DOUBLE * (1 - g))), 6) AS swir1, round(greatest(0, least(1, 0.12::DOUBLE + 0.08::DOUBLE * (1 - g))), 6) AS swir2,
    round(CASE WHEN qa = 1 THEN g END, 6) AS ndvi, round(greatest(-0.2::DOUBLE, least(1, 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-6))), 6) AS evi, round((green - nir) / (green + nir + 1e-6), 6) AS ndwi, round(sm, 6) AS soil_moisture, round(greatest(15, least(50, 28 + 8 * (1 - g) - 20 * sm + (u4 - 0.5) * (0.5 * sqrt(12)))), 6) AS lst_et,
    CASE WHEN g >= 0.25 AND g < 0.5 AND d < 0 THEN 5 WHEN g >= 0.5 AND d < 0 THEN 4 WHEN g >= 0.6::DOUBLE AND abs(d) < 0.01::DOUBLE THEN 3 WHEN g >= 0.5 AND d >= 0 THEN 2 WHEN g >= 0.25 AND g < 0.5 AND d >= 0 THEN 1 ELSE 0 END AS phenophase, qa, round(0.01::DOUBLE + CASE WHEN qa = 0 THEN 0.04::DOUBLE ELSE 0 END + 0.02::DOUBLE * (1 - g), 6) AS sigma FROM f"""
for _n in ("ndvi", "cloud", "sm", "lst"):
    _CUBE = _CUBE.replace(f"HASH({_n})", f"(('0x' || substr(sha256('0/{_n}/' || t || '/' || y || '/' || x), 1, 12))::BIGINT % 10000) / 10000::DOUBLE")


@query(_CUBE)
def demo_cube(spark, d):
    """A cube over the pixels of the grid."""
    out = tables.demo_cube(spark, START, date(2024, 11, 26), 12, 40, 50, pixels=A.grid(spark, d).select("y", "x"))
    return out.select("date", "y", "x", "field_id", *[R(c) for c in out.columns if c not in ("date", "y", "x", "field_id", "phenophase", "qa")], "phenophase", "qa")


_ROLL = lambda *p: "((('0x' || substr(sha256('11/' || id || " + " || ".join(f"'/{x}'" for x in p) + "), 1, 12))::BIGINT % 10000) / 10000::DOUBLE)"
_SIG = lambda z: f"(1 / (1 + exp(-({z}))))"


@query("WITH r AS (SELECT c_custkey AS id, (c_custkey % 4)::INT AS k FROM customer), a AS (SELECT id, " + ", ".join(f"[{', '.join(f'{tables.ARCHETYPES[n][i]}::DOUBLE' for n in sorted(tables.ARCHETYPES))}][k + 1] AS a{i}" for i in range(6)) + f", 'crop' || k AS label, ({_ROLL('s')} - 0.5) * 0.06::DOUBLE AS shift FROM r) SELECT id, label, round({_ROLL('x')} * 100, 6) AS px, round({_ROLL('y')} * 100, 6) AS py, "
    + ", ".join("round(a0 + a1 * (" + _SIG(f"a3 * ({t} / 11::DOUBLE - a2 - shift)") + " - " + _SIG(f"a5 * ({t} / 11::DOUBLE - a4 - shift)") + f") + ({_ROLL('n', t)} + {_ROLL('m', t)} - 1) * 0.04::DOUBLE * 2, 6) AS t{t:02d}" for t in range(12)) + " FROM a")
def synthetic_crops(spark, d):
    out = tables.synthetic_crops(A.read(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    return out.select("id", "label", *[R(c) for c in out.columns if c not in ("id", "label")])


def _labelled(spark, d):
    """Embeddings with labels, on blocks of ground for training and testing."""
    e = A.read(spark, d, "embeddings").where("embedding is not null and label is not null")
    e = e.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") * 37 % 100).cast("double").alias("px"), (F.col("vec_id") * 91 % 97).cast("double").alias("py"))
    return stats.block_split(e, "px", "py", 4, 0.3)


def _trained(spark, d, kind: str, **kw):
    """Overall accuracy of a model of the embeddings' labels, on blocks of ground it hasn't seen."""
    from pyspark.ml.functions import array_to_vector

    split = _labelled(spark, d).withColumn("v", array_to_vector("x"))
    model = classify.fit(split.where("not is_test"), ["v"], "label", kind, **kw)
    return accuracy.overall(accuracy.confusion(model.transform(split.where("is_test")), "label", "predicted"))


@query()
def rf_classifier(spark, d):
    """300 trees of depth 12."""
    split = _labelled(spark, d)
    model = forest.fit(split.where("not is_test"), "x", "label")
    path = scratch(spark, "rf-classifier")
    forest.predict(split.where("is_test"), model, "x", ["label"]).write.parquet(path)  # read several times
    told = spark.read.schema("label string, predicted string").parquet(path)
    return accuracy.overall(accuracy.confusion(told, "label", "predicted"))


@query()
def lr_head(spark, d):
    return _trained(spark, d, "logistic")


def _streamed(spark, d, name: str, build, mode: str):
    """What a stream over a table's files gives once all of them are read."""
    path, schema = scratch(spark, name), A.read(spark, d, "events").schema
    out = build(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"))

    def put(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    q = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query("SELECT user_id, " + _W + " AS window_start, round(median(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def stream_8day(spark, d):
    out = _streamed(spark, d, "stream-8day", lambda s: windows.eight_day(s, ["user_id"], "value", START), "complete")
    return out.select("user_id", "window_start", R("value"), "n")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark, d):
    """Latest record of each key, kept by a foreachBatch sink over six batches of the events."""
    path = scratch(spark, "stream-upsert")
    e = A.read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    e.repartition(6, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sink = runs.upsert_into(spark, f"{path}/rows", ["user_id", "event_type"], "event_id")
    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return runs.upserted(spark, f"{path}/rows", s.schema, ["user_id", "event_type"], "event_id")


@query(SQL["water_balance_daily"].replace(SQL["water_balance_daily"][SQL["water_balance_daily"].rindex("SELECT field_id, date,"):], f"SELECT field_id, date, {r6(dr='dr', ks='ks')} FROM rec"))
def stream_balance(spark, d):
    """The daily balance of field-days that come in any order, in three batches: the last revision of each day."""
    path = scratch(spark, "stream-balance")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    days = _wb(spark, d)
    days.repartition(3, F.xxhash64("date", "field_id")).write.parquet(f"{path}/in")
    s = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = windows.water_balance(s, 400)
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    held = cells.latest(spark.read.schema(out.schema).parquet(f"{path}/out"), ["field_id", "date"], "revision")
    return held.select("field_id", "date", R("dr"), R("ks"))


_U = lambda *p: "(('0x' || substr(sha256(" + " || '/' || ".join(p) + "), 1, 12))::BIGINT % 10000) / 10000::DOUBLE"


@query(f"""WITH k AS (SELECT 'cell' || c_custkey AS cell FROM customer), d AS (SELECT t, DATE '2025-06-01' + (t * 8)::INT AS date FROM range(8) r(t)), a AS (SELECT *, strftime(date, '%Y-%m-%d') AS s, (('0x' || substr(sha256(cell || '/crop'), 1, 12))::BIGINT % 6)::INT AS crop_class FROM k, d),
    b AS (SELECT *, round(0.7::DOUBLE + 0.29::DOUBLE * {_U("cell", "'cropconf'")}, 6) AS confidence, round({cl(f"0.25::DOUBLE + 0.5 * sin(pi() * (t + 1) / 9) * (0.6::DOUBLE + 0.4::DOUBLE * {_U('cell', chr(39) + 'stressbias' + chr(39))}) + 0.1::DOUBLE * ({_U('cell', 's')} - 0.5)", "0.0", "1.0")}, 6) AS si FROM a),
    e AS (SELECT *, round(3 + 4 * (0.5 + 0.5 * si), 5) AS etc, round(6 * {_U("cell", "s", "'rain'")}, 5) AS rain FROM b), f AS (SELECT *, round(etc * (1 - 0.6::DOUBLE * si), 5) AS eta FROM e), g AS (SELECT *, round(greatest((etc - eta) * 8 - rain, 0), 5) AS df FROM f)
    SELECT cell, date, crop_class, ['fallow', 'rice', 'wheat', 'maize', 'cotton', 'sugarcane'][crop_class + 1] AS crop_label, confidence, si AS stress_index, least(trunc(si * 4), 3)::INT AS stress_level, ['sowing', 'vegetative', 'reproductive', 'maturity'][(least(t // 2, 3) + 1)::INT] AS stage, df AS deficit_mm,
    CASE WHEN df <= 2 THEN 'adequate' WHEN df <= 10 THEN 'mild_deficit' WHEN df <= 25 THEN 'moderate_deficit' ELSE 'severe_deficit' END AS status, CASE WHEN df > 2 THEN df ELSE 0 END AS irrigation_mm FROM g""")
def serving_seed(spark, d):
    return serving.seeded(_cells(spark, d), serving.season_dates(), 6).select("cell", "date", "crop_class", "crop_label", "confidence", "stress_index", "stress_level", "stage", "deficit_mm", "status", "irrigation_mm")


def _cells(spark, d):
    return A.read(spark, d, "customer").select(F.concat(F.lit("cell"), F.col("c_custkey").cast("string")).alias("cell"))


@query("SELECT 'cell6' AS cell, DATE '2025-07-27' AS date")
def serving_latest(spark, d):
    return serving.lookup(serving.seeded(_cells(spark, d), serving.season_dates()), "cell6", None, ["cell", "date"])


@query("SELECT count(*) AS cells, count(*) * 8 AS records, DATE '2025-07-27' AS latest FROM customer")
def serving_counts(spark, d):
    return serving.counts(serving.seeded(_cells(spark, d), serving.season_dates()))


@query("SELECT event_id, 'stress:h3=' || user_id || ':date=' || strftime(ts, '%Y-%m-%d') || ':a=' || event_type || ':z=1' AS key, strftime(ts, '%Y-%m-%d') AS day FROM events")
def serving_cache_key(spark, d):
    e = A.read(spark, d, "events")
    day = serving.iso_day("ts")
    return e.select("event_id", serving.cache_key("stress", F.col("user_id"), day, z=1, a=F.col("event_type")).alias("key"), day.alias("day"))


@query(f"WITH {A.PIXELS}, a AS (SELECT l_orderkey, l_linenumber, {cl('nir * 1.3::DOUBLE', '0.0', '1.0')} * 2 AS x FROM pix), b AS (SELECT *, least(floor(x), 1)::INT AS i FROM a), c AS (SELECT *, x - i AS f FROM b) SELECT l_orderkey, l_linenumber, " + ", ".join(f"trunc([{s[0]}::DOUBLE, {s[1]}, {s[2]}][i + 1] * (1 - f) + [{s[0]}::DOUBLE, {s[1]}, {s[2]}][i + 2] * f)::INT AS {n}" for n, s in zip("rgb", zip(*[(26, 152, 80), (255, 255, 191), (215, 48, 39)]))) + " FROM c")
def colour_ramp(spark, d):
    p = A.pixels(spark, d)
    return p.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in serving.ramp(F.col("nir") * 1.3).items()])


@query(f"WITH {A.FIELDS} SELECT field_id, (CASE WHEN field_id % 2 = 0 THEN DATE '2025-06-01' ELSE DATE '2025-11-01' END + (i * 8)::INT)::DATE AS date FROM fld, range(5) t(i)")
def season_axis(spark, d):
    """The dates of each field's season."""
    first, second = (F.array(*map(F.lit, serving.season_dates(s, 5))) for s in ("kharif", "rabi"))
    return A.fields(spark, d).select("field_id", F.explode(F.when(F.col("field_id") % 2 == 0, first).otherwise(second)).alias("date"))


@query("WITH a AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1) SELECT o_custkey, (a + round_even((b - a) / 6::DOUBLE * i, 0)::INT)::DATE AS date FROM a, range(7) t(i)")
def even_time_axis(spark, d):
    """Seven dates over each customer's orders."""
    a = A.read(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    return a.select("o_custkey", F.explode(tables.axis_of(F.col("a"), F.col("b"), 7)).alias("date"))


@query("""WITH k AS (SELECT s_suppkey AS k, 74.48::DOUBLE + s_suppkey % 20 AS w, 74.80::DOUBLE + s_suppkey % 20 AS e, 18.90::DOUBLE + s_suppkey % 7 AS s, 19.20::DOUBLE + s_suppkey % 7 AS n, 74.64::DOUBLE + s_suppkey % 20 AS lng, 19.05::DOUBLE + s_suppkey % 7 AS lat FROM supplier),
    p AS (SELECT *, w + 0.012::DOUBLE AS x0, e - 0.012::DOUBLE AS x1, s + 0.012::DOUBLE AS y0, n - 0.012::DOUBLE AS y1 FROM k), g AS (SELECT *, (x1 - x0) / 12 AS dx, (y1 - y0) / 9 AS dy FROM p, range(9) a(r), range(12) b(c)),
    m AS (SELECT k, lng, lat, r::INT AS r, c::INT AS c, ((x0 + c * dx + dx * 0.06::DOUBLE) + (x0 + (c + 1) * dx - dx * 0.06::DOUBLE)) / 2 AS cx, ((y0 + r * dy + dy * 0.06::DOUBLE) + (y0 + (r + 1) * dy - dy * 0.06::DOUBLE)) / 2 AS cy FROM g) SELECT k AS s_suppkey, r, c, round(cx, 6) AS cx, round(cy, 6) AS cy FROM m WHERE sqrt((cx - lng) ** 2 + ((cy - lat) * 1.05::DOUBLE) ** 2) <= 0.105::DOUBLE""")
def field_grid(spark, d):
    """A grid of fields over an area for each supplier."""
    k = F.col("s_suppkey")
    at = lambda v, m: (v + (k % m))
    areas = A.read(spark, d, "supplier").select(k, at(F.lit(74.48), 20).alias("min_lng"), at(F.lit(74.80), 20).alias("max_lng"), at(F.lit(18.90), 7).alias("min_lat"), at(F.lit(19.20), 7).alias("max_lat"), at(F.lit(74.64), 20).alias("lng"), at(F.lit(19.05), 7).alias("lat"))
    return serving.field_grid(areas, 9, 12).select("s_suppkey", "r", "c", R("cx"), R("cy"))


@query()
def harmonic_trend(spark, d):
    """The scene-server twin: a trend column, periods of one unit of time."""
    s = _series(spark, d).withColumn("t", F.col("t") / 365.25)
    return smoothing.harmonic_series(s, "cell", "t", "vi", 2, None, True)


@query()
def gbm_classifier(spark, d):
    """Boosted trees of all classes at once, 40 rounds of depth 4."""
    split = _labelled(spark, d)
    model = boosting.fit(split.where("not is_test"), "x", "label", 40, 4)
    return accuracy.overall(accuracy.confusion(boosting.predict(split.where("is_test"), model, "x", ["label"]), "label", "predicted"))


@query()
def embedding_forest(spark, d):
    """A forest over embedding vectors: in-sample accuracy."""
    from pyspark.ml.functions import array_to_vector

    e = A.read(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = classify.fit(e, ["v"], "label", "rf", trees=20, depth=8)
    return accuracy.overall(accuracy.confusion(model.transform(e).withColumn("label", F.col("label").cast("string")), "label", "predicted"))


_BK = "(r.dr0 + n.etc - n.rain)"
_EFF = "z.d / greatest(n.raw, 1e-6) * (0.85::DOUBLE + 0.25::DOUBLE * ((CASE n.stage WHEN 'initial' THEN 0.4::DOUBLE WHEN 'development' THEN 0.8::DOUBLE WHEN 'mid' THEN 1.2::DOUBLE ELSE 0.7::DOUBLE END) - 0.4::DOUBLE))"


@query(f"""WITH RECURSIVE {A.DAILY}, n AS (SELECT cell AS field_id, row_number() OVER (PARTITION BY cell ORDER BY date)::INT AS step, (n % 5 + 20)::DOUBLE AS etc, (floor(top)::BIGINT % 20)::DOUBLE AS rain, ['initial', 'development', 'mid', 'late'][(cell % 4 + 1)::INT] AS stage, (cell % 5 * 10 + 100)::DOUBLE AS taw, (cell % 5 * 10 + 100)::DOUBLE * 0.5 AS raw, 0.85::DOUBLE - 0.45::DOUBLE * ((cell % 3)::DOUBLE / 2) AS refill FROM day),
    rec AS (SELECT field_id, 0 AS step, taw * 0.3::DOUBLE AS dr0, NULL::VARCHAR AS advisory FROM n WHERE step = 1
    UNION ALL SELECT n.field_id, n.step, CASE WHEN y.e >= 1 THEN greatest(z.d - n.raw * n.refill, 0) ELSE z.d END, CASE WHEN y.e < 0.5 THEN 'no_irrigation' WHEN y.e < 0.85::DOUBLE THEN 'watch' WHEN y.e < 1 THEN 'irrigate_soon' WHEN y.e < 1.25 THEN 'irrigate_now' ELSE 'critical' END
      FROM rec r JOIN n ON n.field_id = r.field_id AND n.step = r.step + 1, LATERAL (SELECT least(greatest({_BK}, 0), n.taw) AS d) z, LATERAL (SELECT {_EFF} AS e) y)
    SELECT field_id, step, round(dr0, 6) AS dr, advisory FROM rec WHERE step > 0""")
def bucket_recursion(spark, d):
    from pyspark.sql import Window

    k = F.col("cell")
    df = A.daily(spark, d).withColumn("step", F.row_number().over(Window.partitionBy("cell").orderBy("date")))
    df = df.select(k.alias("field_id"), "step", (F.col("n") % 5 + 20).cast("double").alias("etc"), (F.floor("top") % 20).cast("double").alias("rain"), A.nth(["initial", "development", "mid", "late"], k % 4).alias("stage"), (k % 5 * 10 + 100).cast("double").alias("taw"), ((k % 5 * 10 + 100).cast("double") * 0.5).alias("raw"), (0.85 - 0.45 * ((k % 3).cast("double") / 2.0)).alias("refill"))
    return balance.bucket(df.withColumn("dr0", F.col("taw") * 0.3)).select("field_id", "step", R("dr"), "advisory")


@query(f"WITH {A.PIXELS} SELECT l_suppkey, count(cs) AS n, " + r6(low="min(cs)", high="max(cs)", mean="avg(cs)", std="stddev_pop(cs)", median="median(cs)", spread="max(cs) - min(cs)") + " FROM pix GROUP BY 1")
def zonal_stats(spark, d):
    out = stats.zonal(A.pixels(spark, d), ["l_suppkey"], "cs")
    return out.select("l_suppkey", "n", *[R(c) for c in ("low", "high", "mean", "std", "median", "spread")])


@query(f"WITH {A.GRID} SELECT patch, y, x, ((y // 10 * 3 + x // 12) % 5)::INT AS field_id FROM grd")
def pixel_blocks(spark, d):
    return A.grid(spark, d).select("patch", "y", "x", tables.pixel_block("y", "x", 40, 50).alias("field_id"))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT event_id, value AS last_error FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def as_of_layer(spark, d):
    e = A.read(spark, d, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("value").alias("last_error"))
    return cells.as_of(e.where("event_type <> 'error'").select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", ["last_error"]).select("event_id", "last_error")


@query("SELECT user_id, list_sort(list_distinct(list(CAST(ts AS DATE)))) AS days, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def distinct_sets(spark, d):
    e = A.read(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("ts").cast("date"))).alias("days"), F.count_distinct("event_type").alias("kinds"))


@query("""SELECT 'both' AS side, c AS custkey FROM (SELECT c_custkey AS c FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'idle', c FROM (SELECT c_custkey AS c FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark, d):
    c, o = A.read(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), A.read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    named = lambda side, df: df.select(F.lit(side).alias("side"), "custkey")
    return named("both", c.intersect(o)).unionByName(named("idle", c.subtract(o)))


@query(f"WITH {A.FIELDS} SELECT command_id, crop, grouping(command_id) AS all_commands, grouping(crop) AS all_crops, count(*) AS fields, round(sum(area_ha), 6) AS area_ha FROM fld GROUP BY ROLLUP (command_id, crop)")
def command_hierarchy(spark, d):
    f = A.fields(spark, d)
    return f.rollup("command_id", "crop").agg(F.grouping("command_id").cast("long").alias("all_commands"), F.grouping("crop").cast("long").alias("all_crops"), F.count(F.lit(1)).alias("fields"), R(F.sum("area_ha"), "area_ha"))


@query(f"WITH {A.FIELDS} SELECT stage, is_tail_end, grouping(stage) AS all_stages, grouping(is_tail_end) AS all_ends, count(*) AS fields, round(avg(dr), 6) AS dr FROM fld GROUP BY CUBE (stage, is_tail_end)")
def stage_cube(spark, d):
    f = A.fields(spark, d)
    return f.cube("stage", "is_tail_end").agg(F.grouping("stage").cast("long").alias("all_stages"), F.grouping("is_tail_end").cast("long").alias("all_ends"), F.count(F.lit(1)).alias("fields"), R(F.avg("dr"), "dr"))


@query(f"WITH {_EV} SELECT DISTINCT {_C9} AS cell FROM ev ORDER BY 1 LIMIT 16")
def first_cells(spark, d):
    """A report's first cells, in order."""
    return _events(spark, d).select(geo.cell("lat", "lng", 9).alias("cell")).distinct().orderBy("cell").limit(16)


@query(f"WITH {A.REGISTRY} SELECT id, CASE WHEN stac_collection IS NOT NULL AND gee_asset_id IS NULL THEN 'stac' WHEN gee_asset_id IS NOT NULL THEN 'gee' ELSE 'demo' END AS route, CASE WHEN stac_collection IS NOT NULL AND gee_asset_id IS NULL THEN stac_collection ELSE gee_asset_id END AS asset FROM reg")
def sensor_routes(spark, d):
    return catalog.routes(A.registry(spark, d))


@query(f"WITH {A.REGISTRY}, {A.POINTS}, i AS (SELECT c_custkey AS id, 'coll-' || (c_custkey % 5) AS collection, DATE '2024-01-01' + (c_custkey % 60)::INT AS date, lng, lat FROM pts) SELECT i.id, i.date FROM i JOIN reg ON reg.id = 'supplier#000000003' AND i.collection = reg.stac_collection WHERE date BETWEEN DATE '2024-01-11' AND DATE '2024-02-10' AND lng + 1 >= -60 AND lng <= 60 AND lat + 1 >= -30 AND lat <= 40 ORDER BY i.date, i.id LIMIT 50")
def sensor_search(spark, d):
    p = A.points(spark, d).select(F.col("c_custkey").alias("id"), F.concat(F.lit("coll-"), (F.col("c_custkey") % 5).cast("string")).alias("collection"), F.date_add(F.lit(START), (F.col("c_custkey") % 60).cast("int")).alias("date"), F.col("lng").alias("min_lng"), F.col("lat").alias("min_lat"), (F.col("lng") + 1.0).alias("max_lng"), (F.col("lat") + 1.0).alias("max_lat"))
    return catalog.search_sensor(p, A.registry(spark, d), "supplier#000000003", (-60, -30, 60, 40), date(2024, 1, 11), date(2024, 2, 10), 50).select("id", "date")


@query(f"WITH {A.PIXELS} SELECT date, l_suppkey, l_partkey, round(red, 6) AS red, round(nir, 6) AS nir FROM pix WHERE date >= DATE '1995-01-01' AND date < DATE '1996-01-01' AND l_suppkey BETWEEN 10 AND 60 AND l_partkey BETWEEN 20 AND 150")
def pixel_scan(spark, d):
    """Pixels written partitioned by year, and a date range and box read back: both reach the scan."""
    path = scratch(spark, "pixel-scan")
    p = A.pixels(spark, d).select("date", F.year("date").alias("year"), F.col("l_suppkey").alias("lat"), F.col("l_partkey").alias("lng"), "red", "nir")
    tables.write_partitioned(p, path, "year", ("lat", "lng"))
    out = tables.scan(spark, path, ["red", "nir"], date(1995, 1, 1), date(1996, 1, 1), (20, 10, 150, 60))
    return out.select("date", F.col("lat").alias("l_suppkey"), F.col("lng").alias("l_partkey"), R("red"), R("nir"))


@query(SQL["command_plan"].replace(" FROM adv GROUP BY 1", " FROM adv WHERE command_id = 2 GROUP BY 1"))
def command_plan_served(spark, d):
    """One command's plan, from the plans stored by the first call."""
    return serving.prepared(spark, ("command_plan", d), lambda: command_plan(spark, d), ["command_id"], (f"{d}/supplier.parquet", f"{d}/nation.parquet")).where("command_id = 2")


@query(SQL["timeseries_range"])
def timeseries_served(spark, d):
    """One cell's series, from the records stored by the first call."""
    held = serving.prepared(spark, ("timeseries", d), lambda: _records(spark, d), ["cell", "date"], (f"{d}/events.parquet",))
    return cells.timeseries(held, 7, "top", date(2024, 1, 5), date(2024, 1, 20))


@query(f"WITH {_EV} SELECT event_type, date, round(lat, 6) AS lat, round(lng, 6) AS lng, value FROM ev WHERE event_type IN ('click', 'view') AND date >= DATE '2024-01-05' AND date < DATE '2024-01-12' AND lat BETWEEN -40 AND 40")
def scene_scan(spark, d):
    """Scenes by kind, day and latitude, of which kind, dates and box open few."""
    path = scratch(spark, "scenes")
    items.write_items(_events(spark, d), path, [F.col("event_type"), F.col("date"), F.floor(F.col("lat") / 40.0)], ["event_type", "date", "lat", "lng"], ["lat"])
    e = items.read_items(spark, path, ["event_type", "date", "lat", "lng", "value"])
    held = e.where(F.col("event_type").isin("click", "view") & (F.col("date") >= F.lit(date(2024, 1, 5))) & (F.col("date") < F.lit(date(2024, 1, 12))) & F.col("lat").between(-40.0, 40.0))
    return held.select("event_type", "date", R("lat"), R("lng"), "value")


@query(SQL["timeseries_range"])
def chunk_series(spark, d):
    """One cell's series out of a store of chunks of 16 cells and 512 days."""
    path = scratch(spark, "chunks")
    chunks.write_chunks(A.daily(spark, d), path, "cell", F.floor(F.col("cell") / 16), "date", ["top", "low", "n"])
    held = chunks.read_chunks(spark, path, ["cell", "date", "top"])
    return held.where((F.col("cell") == 7) & F.col("date").between(F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 20)))).select("date", F.col("top").alias("value"))


@query(f"WITH {A.DAILY} SELECT cell, date, top, low, n::DOUBLE AS n, vi FROM day")
def chunk_cube(spark, d):
    """The whole cube through the store and back."""
    path = scratch(spark, "chunk-cube")
    chunks.write_chunks(A.daily(spark, d), path, "cell", F.floor(F.col("cell") / 16), "date", ["top", "low", "n", "vi"], 16)
    return chunks.read_chunks(spark, path)


@query("SELECT " + _W + " AS window_start, count(DISTINCT user_id) AS n, min(user_id) AS least_user, max(user_id) AS most_user FROM events WHERE " + _HELD + " GROUP BY 1")
def export_manifest(spark, d):
    """Windows' composites exported, and what the manifest says of them."""
    path = scratch(spark, "export")
    e = A.read(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("date"), "value")
    exports.write_export(composite.composite(e, ["user_id"], ["value"], START, END), path, "window_start", ["user_id"], ["user_id"])
    m = exports.manifest(spark, path).groupBy(F.col("window").alias("window_start"))
    return m.agg(F.sum("n").alias("n"), F.min("least_user_id").alias("least_user"), F.max("most_user_id").alias("most_user"))


@query(f"WITH {A.DAILY} SELECT cell::VARCHAR AS field_id, (row_number() OVER (PARTITION BY cell ORDER BY date) - 1)::INT AS step, top AS dr, low AS raw FROM day")
def feature_series(spark, d):
    """Series written as properties of features and read back in ranges of 64 KB."""
    path = scratch(spark, "features").removeprefix("file://")
    each = A.daily(spark, d).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("date", "top", "low"))).alias("s"))
    of = lambda n: F.transform("s", lambda x: x[n])
    made = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("cell").cast("string").alias("field_id"), of("top").alias("dr_series"), of("low").alias("raw_series")).alias("properties"))
    features.write_collection(each.select(F.to_json(made).alias("feature")), path)
    kinds = "field_id: string, dr_series: array<double>, raw_series: array<double>"
    f = features.read_features(spark, path, f"properties struct<{kinds}>", 1 << 16).select("properties.*")
    zipped = F.arrays_zip(F.col("dr_series").alias("dr"), F.col("raw_series").alias("raw"))
    return f.select("field_id", F.posexplode(zipped).alias("step", "z")).select("field_id", "step", "z.*")


@query(f"""WITH {A.DAILY}, o AS (SELECT cell, date, top, date - row_number() OVER (PARTITION BY cell ORDER BY date)::INT AS g FROM day WHERE top >= 60)
    SELECT cell AS key, min(date) AS first, max(date) AS last, count(*)::INT AS days, max(top) AS worst, round(sum(top), 6) AS total, CASE WHEN count(*) >= 3 THEN 'irrigate now' WHEN count(*) = 2 THEN 'irrigate soon' ELSE 'watch' END AS recommendation FROM o GROUP BY cell, g""")
def dry_spells(spark, d):
    """Spells of days over a limit, by a table function called from SQL."""
    spells.register(spark)
    A.daily(spark, d).select("cell", "date", "top").createOrReplaceTempView("field_days")
    return spark.sql("SELECT key, first, last, days, worst, round(total, 6) + 0.0D AS total, recommendation FROM spells(60.0D, TABLE(SELECT cell AS key, date, top AS value FROM field_days) PARTITION BY key ORDER BY date)")
