"""Queries of row-wise operators, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import advisory, crop, et0, geo, indices, optical, sar, soil, stress
from ..operators import polygons
from . import adapters as A

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def rounded(df, keys, exprs: dict):
    return df.select(*keys, *[A.rounded(c, 6).alias(n) for n, c in exprs.items()])


def sd(n: str, d: str) -> str:
    return f"CASE WHEN abs({d}) >= 1e-12 THEN ({n}) / ({d}) END"


def nd(a: str, b: str) -> str:
    return sd(f"({a}) - ({b})", f"(({a}) + ({b}))")


def cl(x: str, lo=None, hi=None) -> str:
    low = f"WHEN ({x}) < {lo} THEN {lo}::DOUBLE" if lo is not None else ""
    high = f" WHEN ({x}) > {hi} THEN {hi}::DOUBLE" if hi is not None else ""
    return f"(CASE {low}{high} ELSE ({x}) END)"


def r6(**c: str) -> str:
    return ", ".join(f"round({x}, 6) + 0 AS {n}" for n, x in c.items())


PK = ["l_orderkey", "l_linenumber"]
KEYS = "l_orderkey, l_linenumber"


@query(f"""WITH {A.PIXELS} SELECT {KEYS}, scl NOT IN (0, 1, 2, 3, 8, 9, 10) AS scl_ok, coalesce(cs, 0) >= 0.6::DOUBLE AS score_ok,
    (qa >> 3) & 1 = 0 AND (qa >> 4) & 1 = 0 AS qa_ok, qa & 30 = 0 AS landsat_ok FROM pix""")
def cloud_masks(spark, d):
    return A.pixels(spark, d).select(*PK, optical.scl_valid("scl").alias("scl_ok"), optical.score_valid("cs").alias("score_ok"), optical.qa_clear("qa").alias("qa_ok"), optical.landsat_clear("qa").alias("landsat_ok"))


@query(f"WITH {A.PIXELS} SELECT {KEYS}, " + ", ".join(f"CASE WHEN scl NOT IN (0, 1, 2, 3, 8, 9, 10) THEN round({b}, 6) END AS {b}" for b in ("red", "nir", "blue")) + " FROM pix")
def apply_cloud_mask(spark, d):
    return A.pixels(spark, d).select(*PK, *[optical.masked(A.rounded(b, 6), optical.scl_valid("scl")).alias(b) for b in ("red", "nir", "blue")])


@query(f"WITH {A.PIXELS} SELECT {KEYS}, " + r6(s2=cl("dn * 1e-4", "0.0", "1.0"), landsat=cl("dn * 2.75e-5 + (-0.2)::DOUBLE", "0.0", "1.0"), raw="dn * 2.75e-5 + (-0.2)::DOUBLE") + " FROM pix")
def sr_scale(spark, d):
    return rounded(A.pixels(spark, d), PK, {"s2": optical.scale_reflectance("dn"), "landsat": optical.scale_landsat("dn"), "raw": optical.scale_landsat("dn", False)})


_BANDS = ["b2", "G", "red", "B8A", "swir16", "b12", "unknown"]


@query(f"""WITH {A.PIXELS}, co(band, s, i) AS (VALUES ('b2', 0.9778, -0.0040), ('G', 1.0053, -0.0009), ('red', 0.9765, 0.0009), ('B8A', 0.9983, -0.0001), ('swir16', 0.9987, -0.0011), ('b12', 1.0030, -0.0012)),
    p AS (SELECT *, {A.sql_list(_BANDS)}[(l_partkey % 7 + 1)::INT] AS band FROM pix)
    SELECT {KEYS}, p.band, {r6(harmonised=cl("nir * s::DOUBLE + i::DOUBLE", "0.0", "1.0"), red_oli=cl("red * 0.9765::DOUBLE + 0.0009::DOUBLE", "0.0", "1.0"), calibrated="1.02::DOUBLE * nir + 0.01::DOUBLE")} FROM p LEFT JOIN co USING (band)""")
def bandpass_harmonise(spark, d):
    df = A.pixels(spark, d).withColumn("band", A.nth(_BANDS, F.col("l_partkey") % 7))
    return rounded(df, [*PK, "band"], {"harmonised": optical.harmonise("nir", F.col("band")), "red_oli": optical.harmonise("red", "B4"), "calibrated": optical.cross_calibrate("nir", 1.02, 0.01)})


_DB = lambda x: f"10::DOUBLE * log10(CASE WHEN ({x}) < 1e-12 THEN 1e-12 ELSE ({x}) END)"


@query(f"WITH {A.PIXELS} SELECT {KEYS}, " + r6(vv_db=_DB("vv"), vh_db=_DB("vh"), ratio="vh / vv", ratio_db=f"{_DB('vh')} - {_DB('vv')}", rvi="4 * vh / (vv + vh)", back=f"pow(10::DOUBLE, ({_DB('vv')}) / 10::DOUBLE)", server_ratio=f"{_DB('vh')} - {_DB('vv')}",
    flat=f"vv * cos(radians(40::DOUBLE)) / cos(radians(20 + l_linenumber * 5::DOUBLE))", ndvi=cl("0.55::DOUBLE + 0.45::DOUBLE * tanh(1.2::DOUBLE * (4 * vh / (vv + vh)) - 0.6::DOUBLE)", "0.0", "1.0")) + f", {_DB('vv')} > -30 AND {_DB('vh')} > -30 AS edge_free FROM pix")
def sar_features(spark, d):
    df = A.pixels(spark, d)
    f = sar.features("vv", "vh")
    df = df.withColumns({"vv_db": f["vv"], "vh_db": f["vh"], "rvi": f["rvi"], "lia": F.col("l_linenumber") * 5.0 + 20.0})
    out = {"vv_db": F.col("vv_db"), "vh_db": F.col("vh_db"), "ratio": f["vh_vv_ratio"], "ratio_db": f["cross_ratio_db"], "rvi": F.col("rvi"), "back": sar.to_linear("vv_db"), "server_ratio": sar.features_db("vv_db", "vh_db")["vh_vv_ratio"], "flat": sar.terrain_flatten("vv", "lia"), "ndvi": sar.ndvi_proxy("rvi")}
    return df.select(*PK, *[A.rounded(c, 6).alias(n) for n, c in out.items()], sar.edge_free("vv_db", "vh_db").alias("edge_free"))


_IDX = {
    "ndvi": nd("nir", "red"), "evi": sd("2.5::DOUBLE * (nir - red)", "(nir + 6 * red - 7.5::DOUBLE * blue + 1)"), "evi2": sd("2.5::DOUBLE * (nir - red)", "(nir + 2.4::DOUBLE * red + 1)"),
    "savi": sd("1.5::DOUBLE * (nir - red)", "(nir + red + 0.5::DOUBLE)"), "msavi": "(2 * nir + 1 - sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) / 2", "gcvi": f"{sd('nir', 'green')} - 1", "ndre": nd("nir", "red_edge"),
    "ndwi_gao": nd("nir", "swir1"), "ndwi_mcfeeters": nd("green", "nir"), "ndmi": nd("nir_n", "swir1"), "nmdi": sd("nir - (swir1 - swir2)", "(nir + (swir1 - swir2))"), "psri": sd("red - blue", "red_edge"),
    "sar_rvi": sd("4 * vh", "(vv + vh)"), "sar_cross_ratio": sd("vh", "vv"), "str": sd("(1 - swir1) * (1 - swir1)", "(2 * swir1)"),
}


@query(f"WITH {A.PIXELS} SELECT {KEYS}, " + r6(**{(f'"{k}"' if k == "str" else k): v for k, v in _IDX.items()}) + " FROM pix")
def idx_stack(spark, d):
    return rounded(A.pixels(spark, d), PK, indices.available(A.pixels(spark, d).columns))


def _one_index(name: str):
    def f(spark, d):
        return rounded(A.pixels(spark, d), PK, indices.available(indices.RECIPES[name][1], [name]))

    f.__name__ = f"idx_{name}"
    quoted = f'"{name}"' if name == "str" else name
    query(f"WITH {A.PIXELS} SELECT {KEYS}, round({_IDX[name]}, 6) + 0 AS {quoted} FROM pix")(f)


for _n in indices.RECIPES:
    _one_index(_n)


@query(f"WITH {A.PIXELS} SELECT {KEYS}, " + r6(ndvi_s=nd("nir", "red"), evi_s=_IDX["evi"], ndwi_s=nd("green", "nir"), ndmi_s=nd("nir", "swir1"), str_s="(1 - swir2) * (1 - swir2) / (CASE WHEN 2 * swir2 < 1e-4 THEN 1e-4 ELSE 2 * swir2 END)") + " FROM pix")
def idx_server_set(spark, d):
    return rounded(A.pixels(spark, d), PK, indices.server_set())


_E0 = lambda t: f"(0.6108::DOUBLE * exp(17.27::DOUBLE * ({t}) / (({t}) + 237.3::DOUBLE)))"
_ET = f"""b AS (SELECT *, (tmin + tmax) / 2 AS t, radians(lat) AS phi, 0.409::DOUBLE * sin(2 * pi() * doy / 365 - 1.39::DOUBLE) AS dec, 1 + 0.033::DOUBLE * cos(2 * pi() * doy / 365) AS dist FROM wx),
  c AS (SELECT *, 4098 * {_E0("t")} / ((t + 237.3::DOUBLE) * (t + 237.3::DOUBLE)) AS delta, 0.000665::DOUBLE * (101.3::DOUBLE * pow((293 - 0.0065::DOUBLE * elevation) / 293, 5.26::DOUBLE)) AS gamma,
    ({_E0("tmin")} + {_E0("tmax")}) / 2 AS es, ({_E0("tmin")} * rh_max / 100 + {_E0("tmax")} * rh_min / 100) / 2 AS ea, acos({cl("-tan(phi) * tan(dec)", "-1.0", "1.0")}) AS ws FROM b),
  e AS (SELECT *, 24 * 60 / pi() * 0.0820::DOUBLE * dist * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)) AS ra FROM c),
  f AS (SELECT *, (0.75::DOUBLE + 2e-5 * elevation) * ra AS rso, (1 - 0.23::DOUBLE) * rs AS rns FROM e),
  g AS (SELECT *, 4.903e-9 * ((pow(tmax + 273.16::DOUBLE, 4) + pow(tmin + 273.16::DOUBLE, 4)) / 2) * (0.34::DOUBLE - 0.14::DOUBLE * sqrt(ea)) * (1.35::DOUBLE * (CASE WHEN rso > 0 THEN {cl("rs / rso", "0.3", "1.0")} ELSE 1 END) - 0.35::DOUBLE) AS rnl FROM f),
  h AS (SELECT *, rns - rnl AS rn FROM g),
  et AS (SELECT *, (0.408::DOUBLE * delta * rn + gamma * (900 / (t + 273)) * u2 * (es - ea)) / (delta + gamma * (1 + 0.34::DOUBLE * u2)) AS raw FROM h)"""


@query(f"WITH {A.WEATHER}, {_ET} SELECT o_orderkey, " + r6(delta="delta", gamma="gamma", es="es", ea="ea", ra="ra", rso="rso", rns="rns", rnl="rnl", rn="rn", et0="greatest(raw, 0)", hargreaves="greatest(0.0023::DOUBLE * (t + 17.8::DOUBLE) * sqrt(greatest(tmax - tmin, 0)) * ra * 0.408::DOUBLE, 0)") + " FROM et")
def et0_components(spark, d):
    c = et0.components("tmin", "tmax", "rs", "elevation", "lat", "doy", "u2", "rh_min", "rh_max")
    df = A.weather(spark, d).withColumns({"ra": c["ra"]})
    return rounded(df, ["o_orderkey"], c | {"hargreaves": et0.hargreaves("tmin", "tmax", "ra")})


@query(f"""WITH {A.WEATHER}, b AS (SELECT o_orderkey, tmin + 5 AS t, tmin AS td, u2, rs, elevation FROM wx), c AS (SELECT *, 4098 * {_E0("(t + 273.15::DOUBLE - 273.15::DOUBLE)")} / ((t + 273.15::DOUBLE - 273.15::DOUBLE + 237.3::DOUBLE) * (t + 273.15::DOUBLE - 273.15::DOUBLE + 237.3::DOUBLE)) AS dl, (101300 - elevation * 10) / 1000 * 0.000665::DOUBLE AS g, sqrt(u2 * u2 + 1) * 0.748::DOUBLE AS u FROM b)
    SELECT o_orderkey, round(greatest((0.408::DOUBLE * dl * rs + g * (900 / (t + 273)) * u * ({_E0("t")} - {_E0("td")})) / (dl + g * (1 + 0.34::DOUBLE * u)), 0) * 8, 5) AS et0_8day FROM c""")
def et0_reanalysis(spark, d):
    df = A.weather(spark, d)
    x = et0.reanalysis(F.col("tmin") + 5.0 + 273.15, F.col("tmin") + 273.15, "u2", F.lit(1.0), F.col("rs") * 1e6, 101300.0 - F.col("elevation") * 10.0)
    return df.select("o_orderkey", A.rounded(x, 5).alias("et0_8day"))


@query(f"""WITH {A.WEATHER} SELECT o_orderkey, {r6(tdew=_E0("tmin"), both=f"({_E0('tmin')} * rh_max / 100 + {_E0('tmax')} * rh_min / 100) / 2", high=f"{_E0('tmin')} * rh_max / 100", mean=f"rh_max / 100 * (({_E0('tmin')} + {_E0('tmax')}) / 2)")} FROM wx""")
def vapour_pressure_ways(spark, d):
    a = et0.actual_pressure
    return rounded(A.weather(spark, d), ["o_orderkey"], {"tdew": a("tmin", "tmax", "rh_min", "rh_max", tdew="tmin"), "both": a("tmin", "tmax", "rh_min", "rh_max"), "high": a("tmin", "tmax", rh_max="rh_max"), "mean": a("tmin", "tmax", rh_mean="rh_max")})


_CROPS = "crops(crop, l1, l2, l3, l4, ki, km, ke) AS (VALUES " + ", ".join(f"('{k}', {v[0][0]}, {v[0][1]}, {v[0][2]}, {v[0][3]}, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE)" for k, v in crop.CROPS.items()) + ")"
_NAMES = ["Initial", " dev ", "MID-season", "maturity", "flowering", "bogus"]
_CROP_OF = f"{A.sql_list([c.upper() for c in A.CROP_OF])}[(o_orderkey % 6 + 1)::INT]"


@query(f"""WITH {A.WEATHER}, {_CROPS}, a AS (SELECT *, {_CROP_OF} AS c, {A.sql_list(_NAMES)}[(o_orderkey % 6 + 1)::INT] AS s, doy - 1 AS das FROM wx), b AS (SELECT * FROM a JOIN crops ON lower(c) = crop)
    SELECT o_orderkey, CASE lower(trim(s)) WHEN 'initial' THEN 'ini' WHEN 'dev' THEN 'dev' WHEN 'mid-season' THEN 'mid' WHEN 'flowering' THEN 'mid' WHEN 'maturity' THEN 'late' END AS stage,
    round(CASE lower(trim(s)) WHEN 'initial' THEN ki WHEN 'dev' THEN (ki + km) / 2 WHEN 'mid-season' THEN km WHEN 'flowering' THEN km WHEN 'maturity' THEN ke END, 6) AS kc_stage,
    CASE WHEN das <= l1 THEN 'ini' WHEN das <= l1 + l2 THEN 'dev' WHEN das <= l1 + l2 + l3 THEN 'mid' ELSE 'late' END AS das_stage,
    round(CASE WHEN das <= l1 THEN ki WHEN das <= l1 + l2 THEN ki + (km - ki) * ((das - l1)::DOUBLE / l2) WHEN das <= l1 + l2 + l3 THEN km WHEN das <= l1 + l2 + l3 + l4 THEN km + (ke - km) * ((das - l1 - l2 - l3)::DOUBLE / l4) ELSE ke END, 6) AS kc,
    round(km + (0.04::DOUBLE * (u2 - 2) - 0.004::DOUBLE * ({cl("rh_min", "20.0", "80.0")} - 45)) * pow(0.5::DOUBLE / 3, 0.3::DOUBLE), 6) AS kc_climate FROM b""")
def kc_curve(spark, d):
    k = F.col("o_orderkey") % 6
    df = A.weather(spark, d).withColumns({"c": A.nth([c.upper() for c in A.CROP_OF], k), "s": A.nth(_NAMES, k), "das": F.col("doy") - 1})
    df = crop.with_crop(df, "c")
    return df.select("o_orderkey", crop.stage_name("s").alias("stage"), A.rounded(crop.kc_for_stage("s"), 6).alias("kc_stage"), crop.stage_for_day("das").alias("das_stage"), A.rounded(crop.kc_curve("das"), 6).alias("kc"), A.rounded(crop.kc_climate("kc_mid", "u2", "rh_min", F.lit(0.5)), 6).alias("kc_climate"))


@query(f"WITH {A.PIXELS}, v AS (SELECT *, {nd('nir', 'red')} AS x FROM pix) SELECT {KEYS}, " + r6(kc=cl("1.457::DOUBLE * x + (-0.1725)::DOUBLE", "0.0", "1.3"), kc_server=cl("1.45::DOUBLE * x + (-0.10)::DOUBLE", "0.15", "1.2")) + " FROM v")
def kc_ndvi(spark, d):
    x = indices.ndvi("nir", "red")
    return rounded(A.pixels(spark, d), PK, {"kc": crop.kc_from_ndvi(x), "kc_server": crop.kc_from_ndvi_server(x)})


_BOUNDS = "gd(crop, b) AS (VALUES " + ", ".join(f"('{k}', {v[1]})" for k, v in crop.DEGREE_DAYS.items()) + ")"


@query(f"""WITH {A.WEATHER}, {_BOUNDS}, a AS (SELECT o_orderkey, (o_orderkey * 7 % 2700)::DOUBLE AS gdd, ['Wheat', 'rice', 'soybean', 'barley'][(o_orderkey % 4 + 1)::INT] AS c FROM wx)
    SELECT o_orderkey, gdd, {A.sql_list(crop.STAGES)}[len(list_filter(coalesce(g.b, (SELECT b FROM gd WHERE crop = 'default')), lambda x: x <= gdd)) + 1] AS stage FROM a LEFT JOIN gd g ON g.crop = lower(c)""")
def stage_gdd(spark, d):
    k = F.col("o_orderkey")
    df = A.weather(spark, d).select("o_orderkey", (k * 7 % 2700).cast("double").alias("gdd"), A.nth(["Wheat", "rice", "soybean", "barley"], k % 4).alias("c"))
    return df.select("o_orderkey", "gdd", crop.degree_day_stage("gdd", "c").alias("stage"))


@query(f"""WITH {A.FIELDS}, {_BOUNDS}, s AS (SELECT crop, generate_subscripts(list_concat([0.0], b), 1) AS i, b FROM gd) SELECT field_id, crop, {A.sql_list(crop.STAGES)}[i] AS stage, (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END)::DOUBLE AS lo, (CASE WHEN i = 5 THEN 'inf'::DOUBLE ELSE b[i] END)::DOUBLE AS hi FROM fld JOIN s USING (crop)""")
def stage_intervals(spark, d):
    """The stages of each field's crop in degree days."""
    return A.fields(spark, d).select("field_id", "crop").join(F.broadcast(crop.stage_intervals(spark)), "crop").select("field_id", "crop", "stage", "lo", "hi")


@query(f"WITH {A.FIELDS} SELECT field_id, t.* FROM fld JOIN (VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE, {v[5]}::DOUBLE, {str(v[6]).upper()})" for k, v in crop.CROPS.items()) + ") t(crop, stage_lengths, kc_ini, kc_mid, kc_end, zr_m, depletion_p, ponded) ON fld.crop = t.crop")
def crop_table(spark, d):
    """The coefficients of each field's crop."""
    return crop.with_crop(A.fields(spark, d).select("field_id", "crop"))


_TAW = "(1000 * (theta_fc - theta_wp) * zr)"


@query(f"""WITH {A.FIELDS}, a AS (SELECT *, {_TAW} AS taw FROM fld) SELECT field_id, {r6(taw="taw", raw="p * taw", tew="1000 * (theta_fc - 0.5::DOUBLE * theta_wp) * 0.1::DOUBLE", ks=f"CASE WHEN taw <= 0 OR dr <= p * taw THEN 1 ELSE {cl('(taw - dr) / ((1 - p) * taw)', '0.0', '1.0')} END")} FROM a""")
def soil_water(spark, d):
    df = A.fields(spark, d).withColumn("taw", soil.total_available("theta_fc", "theta_wp", "zr"))
    return rounded(df, ["field_id"], {"taw": F.col("taw"), "raw": soil.readily_available("taw", "p"), "tew": soil.total_evaporable("theta_fc", "theta_wp"), "ks": soil.stress_coefficient("dr", "taw", "p")})


@query(f"""WITH {A.WEATHER}, a AS (SELECT o_orderkey, rain, (o_orderkey % 60 + 40)::DOUBLE AS cn FROM wx), b AS (SELECT *, 25400 / cn - 254 AS s FROM a), c AS (SELECT *, CASE WHEN rain > 0.2::DOUBLE * s THEN (rain - 0.2::DOUBLE * s) * (rain - 0.2::DOUBLE * s) / (rain - 0.2::DOUBLE * s + s) ELSE 0 END AS q FROM b)
    SELECT o_orderkey, {r6(usda="greatest(CASE WHEN rain <= 250 THEN rain * (125 - 0.2::DOUBLE * rain) / 125 ELSE 125 + 0.1::DOUBLE * rain END, 0)", runoff="q", scs="greatest(rain - q, 0)")} FROM c""")
def effective_rain(spark, d):
    df = A.weather(spark, d).withColumn("cn", (F.col("o_orderkey") % 60 + 40).cast("double"))
    return rounded(df, ["o_orderkey"], {"usda": soil.rain_usda_monthly("rain"), "runoff": soil.runoff_cn("rain", F.col("cn")), "scs": soil.rain_cn("rain", F.col("cn"))})


@query(f"""WITH {A.WEATHER}, a AS (SELECT o_orderkey, rs / 30 AS ssm, CASE WHEN o_orderkey % 4 > 0 THEN rh_min / 60 END AS prev, (o_orderkey % 9 - 2)::DOUBLE AS dt FROM wx)
    SELECT o_orderkey, round(CASE WHEN prev IS NULL THEN ssm ELSE prev + 1 / (1 + exp(-(CASE WHEN dt < 0 THEN 0 ELSE dt END) / 5)) * (ssm - prev) END, 6) AS swi FROM a""")
def swi_step(spark, d):
    k = F.col("o_orderkey")
    df = A.weather(spark, d).select("o_orderkey", (F.col("rs") / 30.0).alias("ssm"), F.when(k % 4 > 0, F.col("rh_min") / 60.0).alias("prev"), (k % 9 - 2).cast("double").alias("dt"))
    return rounded(df, ["o_orderkey"], {"swi": soil.swi_step("ssm", "dt", "prev")})


_EDGES = {"dry_intercept": 0.5, "dry_slope": 1.0, "wet_intercept": 4.0, "wet_slope": 3.0}


@query(f"""WITH {A.PIXELS}, a AS (SELECT *, {nd("nir", "red")} AS v, {_IDX["str"]} AS s, min(nir) OVER (PARTITION BY l_suppkey) AS lo, max(nir) OVER (PARTITION BY l_suppkey) AS hi, min(lst) OVER (PARTITION BY l_suppkey) AS tlo, max(lst) OVER (PARTITION BY l_suppkey) AS thi FROM pix),
    b AS (SELECT *, {cl(sd("nir - lo", "(hi - lo)"), "0.0", "1.0")} AS vci, {cl(sd("thi - lst", "(thi - tlo)"), "0.0", "1.0")} AS tci FROM a)
    SELECT {KEYS}, {r6(optram=cl(sd("s - (0.5::DOUBLE + 1 * v)", "((4 + 3 * v) - (0.5::DOUBLE + 1 * v))"), "0.0", "1.0"), vci="vci", tci="tci", vhi="0.5::DOUBLE * vci + (1 - 0.5::DOUBLE) * tci", tvdi=cl(sd("lst - 288", "((310 + (-15) * v) - 288)"), "0.0", "1.0"), cwsi=cl(sd("lst - 285 - 2", "(20 - 2)"), "0.0", "1.0"))} FROM b""")
def condition_indices(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey")
    df = A.pixels(spark, d).withColumns({"lo": F.min("nir").over(w), "hi": F.max("nir").over(w), "tlo": F.min("lst").over(w), "thi": F.max("lst").over(w), "v": indices.ndvi("nir", "red"), "s": indices.str_index("swir1")})
    df = df.withColumns({"vci": stress.vci("nir", "lo", "hi"), "tci": stress.tci("lst", "tlo", "thi")})
    return rounded(df, PK, {"optram": stress.optram("v", "s", _EDGES), "vci": F.col("vci"), "tci": F.col("tci"), "vhi": stress.vhi("vci", "tci"), "tvdi": stress.tvdi("v", "lst", (310.0, -15.0), 288.0), "cwsi": stress.cwsi("lst", F.lit(285.0), F.lit(2.0), F.lit(20.0))})


_STAGES7 = ["initial", "development", "mid-season", "late-season", "mature", "unheard"]
_TH = "th(stage, b0, b1, b2, b3) AS (VALUES " + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE)" for k, v in stress.THRESHOLDS.items()) + ")"


@query(f"""WITH {A.PIXELS}, {_TH}, a AS (SELECT {KEYS}, CASE WHEN l_linenumber <> 5 THEN nir - 0.1::DOUBLE END AS x, {A.sql_list(_STAGES7)}[(l_partkey % 6 + 1)::INT] AS stage FROM pix), b AS (SELECT a.*, {cl("x", "0.0", "1.0")} AS c, t.* EXCLUDE (stage) FROM a JOIN th t ON t.stage = CASE WHEN a.stage = 'unheard' THEN 'default' ELSE a.stage END),
    e AS (SELECT *, CASE WHEN c IS NULL THEN -1 WHEN c >= b0 THEN 0 WHEN c >= b1 THEN 1 WHEN c >= b2 THEN 2 WHEN c >= b3 THEN 3 ELSE 4 END AS severity FROM b)
    SELECT {KEYS}, stage, round(c, 6) AS condition, severity, ['no_data', 'none', 'mild', 'moderate', 'high', 'severe'][severity + 2] AS label, severity >= 1 AS stressed, ((x >= 0.15::DOUBLE)::INT + (x >= 0.35::DOUBLE)::INT + (x >= 0.6::DOUBLE)::INT) AS bucket FROM e""")
def stage_stress(spark, d):
    df = A.pixels(spark, d).select(*PK, F.when(F.col("l_linenumber") != 5, F.col("nir") - 0.1).alias("x"), A.nth(_STAGES7, F.col("l_partkey") % 6).alias("stage"))
    c = stress.classify("x", "stage")
    return df.select(*PK, "stage", A.rounded(c["condition"], 6).alias("condition"), c["severity"].alias("severity"), c["label"].alias("label"), c["stressed"].alias("stressed"), stress.bucket("x").alias("bucket"))


_SCALE = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in advisory.STAGE_SCALE.items()) + " ELSE 1.0::DOUBLE END"
_ADV = f"""a AS (SELECT *, {_TAW} AS taw, {cl(f"p * ({_SCALE})", "0.05", "0.95")} AS pe FROM fld), b AS (SELECT *, pe * taw AS raw, CASE WHEN taw <= 0 OR dr <= pe * taw THEN 1 ELSE {cl("(taw - dr) / ((1 - pe) * taw)", "0.0", "1.0")} END AS ks FROM a),
    c AS (SELECT *, CASE WHEN ks <= 0.4::DOUBLE OR dr / taw >= 0.9::DOUBLE THEN 4 WHEN dr >= raw THEN 3 WHEN dr >= 0.75::DOUBLE * raw THEN 2 WHEN dr >= 0.4::DOUBLE * raw THEN 1 ELSE 0 END AS up,
      CASE WHEN stage IN ('late', 'maturity', 'senescence') AND dr >= raw THEN 0 WHEN dr >= 0.9::DOUBLE * taw THEN 4 WHEN dr >= raw THEN 3 WHEN dr >= 0.6::DOUBLE * raw THEN 2 WHEN dr <= 0.05::DOUBLE * taw THEN 0 ELSE 1 END AS pond FROM b),
    adv AS (SELECT *, (CASE WHEN crop = 'rice' THEN pond ELSE up END)::TINYINT AS status FROM c)"""


@query(f"""WITH {A.FIELDS}, {_ADV} SELECT field_id, {r6(p_eff="pe", raw="raw", ks="ks", dnet="greatest(dr, 0)", dgross="greatest(dr, 0) / 0.6::DOUBLE", days_to_trigger="greatest((raw - dr) / etc, 0)")}, status, ['NO_IRRIGATION', 'WATCH', 'IRRIGATE_SOON', 'IRRIGATE_NOW', 'CRITICAL'][status + 1] AS status_name, up::TINYINT AS upland, pond::TINYINT AS ponded FROM adv""")
def advisory_field(spark, d):
    df = A.fields(spark, d).withColumns({"taw": soil.total_available("theta_fc", "theta_wp", "zr"), "is_rice": F.col("crop") == "rice"})
    e = advisory.evaluate("dr", "taw", "p", "stage", "etc", is_ponded="is_rice")
    df = df.withColumns({"raw": e["raw"], "ks": e["ks"]})
    nums = ("p_eff", "raw", "ks", "dnet", "dgross", "days_to_trigger")
    return df.select("field_id", *[A.rounded(e[n], 6).alias(n) for n in nums], e["status"].alias("status"), e["status_name"].alias("status_name"), advisory.upland("dr", "raw", "ks", "taw").alias("upland"), advisory.ponded("dr", "raw", "taw", "stage").alias("ponded"))


@query(f"""WITH {A.PIXELS}, a AS (SELECT {KEYS}, CASE WHEN l_linenumber <> 4 THEN dn / 100 END AS d, 60 + l_discount_ AS r, vv * 10 AS ks, 120::DOUBLE AS taw FROM (SELECT *, green * 100 AS l_discount_ FROM pix))
    SELECT {KEYS}, (CASE WHEN d IS NULL OR r IS NULL THEN -1 WHEN coalesce(ks <= 0.4::DOUBLE, false) OR d / taw >= 0.9::DOUBLE THEN 4 WHEN d >= r THEN 3 WHEN d >= 0.75::DOUBLE * r THEN 2 WHEN d >= 0.4::DOUBLE * r THEN 1 ELSE 0 END)::TINYINT AS code FROM a""")
def advisory_map(spark, d):
    df = A.pixels(spark, d).select(*PK, F.when(F.col("l_linenumber") != 4, F.col("dn") / 100.0).alias("d"), (F.lit(60) + F.col("green") * 100.0).alias("r"), (F.col("vv") * 10.0).alias("ks"), F.lit(120.0).alias("taw"))
    return df.select(*PK, advisory.codes("d", "r", "ks", "taw").alias("code"))


@query(f"""WITH {A.FIELDS}, a AS (SELECT field_id, greatest(1.1::DOUBLE * etc * 8 - area_ha - 2, 0) AS d, dr / 60 AS ratio, ['initial', 'development', 'mid', 'late'][(field_id % 4 + 1)::INT] AS s FROM fld),
    b AS (SELECT *, ratio * (0.85::DOUBLE + 0.25::DOUBLE * ((CASE s WHEN 'initial' THEN 0.4::DOUBLE WHEN 'development' THEN 0.8::DOUBLE WHEN 'mid' THEN 1.2::DOUBLE ELSE 0.7::DOUBLE END) - 0.4::DOUBLE)) AS eff FROM a)
    SELECT field_id, round(d, 6) AS deficit, ((d >= 5)::INT + (d >= 15)::INT + (d >= 30)::INT) AS class4, CASE WHEN eff < 0.5 THEN 'no_irrigation' WHEN eff < 0.85::DOUBLE THEN 'watch' WHEN eff < 1 THEN 'irrigate_soon' WHEN eff < 1.25 THEN 'irrigate_now' ELSE 'critical' END AS advisory,
    CASE WHEN eff < 0.5 THEN 'none' WHEN eff < 0.85::DOUBLE THEN 'mild' WHEN eff < 1 THEN 'moderate' WHEN eff < 1.25 THEN 'severe' ELSE 'extreme' END AS stress_class, CASE WHEN d <= 2 THEN 'adequate' WHEN d <= 10 THEN 'mild_deficit' WHEN d <= 25 THEN 'moderate_deficit' ELSE 'severe_deficit' END AS serving,
    CASE WHEN field_id % 9 = 0 OR ((field_id % 23) - 3) / greatest(1, field_id % 15)::DOUBLE < 0.2 THEN 'initial' WHEN ((field_id % 23) - 3) / greatest(1, field_id % 15)::DOUBLE < 0.45 THEN 'development' WHEN ((field_id % 23) - 3) / greatest(1, field_id % 15)::DOUBLE < 0.75 THEN 'mid' ELSE 'late' END AS season_stage FROM b""")
def advisory_variants(spark, d):
    k = F.col("field_id")
    df = A.fields(spark, d).select("field_id", advisory.server_deficit(F.lit(1.1), F.col("etc") * 8.0, "area_ha", F.lit(2.0)).alias("d0"), (F.col("dr") / 60.0).alias("ratio"), A.nth(["initial", "development", "mid", "late"], k % 4).alias("s"), F.col("etc"), F.col("area_ha"))
    df = df.withColumn("d", F.greatest(F.lit(1.1) * F.col("etc") * 8.0 - F.col("area_ha") - 2.0, F.lit(0.0)))
    r, s = advisory.from_ratio("ratio", "s"), advisory.serving_status("d")
    return df.select("field_id", A.rounded("d", 6).alias("deficit"), advisory.server_classes("d").alias("class4"), r["advisory"].alias("advisory"), r["stress_class"].alias("stress_class"), s["status"].alias("serving"), advisory.season_stage(k % 23, F.lit(3), k % 15, k % 9 == 0).alias("season_stage"))


_CELL = lambda lat, lng, res: f"printf('f%02d%08x%08x', {res}, floor(({lat} + 90) / (60 / pow(2::DOUBLE, {res})))::BIGINT, floor(({lng} + 180) / (60 / pow(2::DOUBLE, {res})))::BIGINT)"


@query(f"""WITH {A.POINTS}, a AS (SELECT *, 60 / pow(2::DOUBLE, 9) AS s FROM pts), b AS (SELECT *, floor((lat + 90) / s)::BIGINT AS r, floor((lng + 180) / s)::BIGINT AS c FROM a), e AS (SELECT *, (r + 0.5::DOUBLE) * s - 90 AS clat, (c + 0.5::DOUBLE) * s - 180 AS clng FROM b)
    SELECT c_custkey, printf('f%02d%08x%08x', 9, r, c) AS cell, round(clat, 6) AS clat, round(clng, 6) AS clng, {_CELL("clat", "clng", 8)} AS parent, list_sort([printf('f%02d%08x%08x', 10, r * 2 + i, c * 2 + j) FOR i IN [0] FOR j IN [0]] || [printf('f%02d%08x%08x', 10, r * 2, c * 2 + 1), printf('f%02d%08x%08x', 10, r * 2 + 1, c * 2), printf('f%02d%08x%08x', 10, r * 2 + 1, c * 2 + 1)]) AS children FROM e""".replace("[printf('f%02d%08x%08x', 10, r * 2 + i, c * 2 + j) FOR i IN [0] FOR j IN [0]]", "[printf('f%02d%08x%08x', 10, r * 2, c * 2)]"))
def cell_keys(spark, d):
    df = A.points(spark, d).withColumn("cell", geo.cell("lat", "lng", 9))
    lat, lng = geo.centre("cell")
    return df.select("c_custkey", "cell", A.rounded(lat, 6).alias("clat"), A.rounded(lng, 6).alias("clng"), geo.parent("cell").alias("parent"), geo.children("cell").alias("children"))


@query(f"""WITH {A.POINTS}, a AS (SELECT c_custkey, floor((lat + 90) / (60 / 512::DOUBLE))::BIGINT AS r, floor((lng + 180) / (60 / 512::DOUBLE))::BIGINT AS c FROM pts)
    SELECT c_custkey, printf('f%02d%08x%08x', 9, r + i, (c + j + 3072) % 3072) AS cell FROM a, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE r + i BETWEEN 0 AND 1535""")
def cell_disk(spark, d):
    return A.points(spark, d).select("c_custkey", F.explode(geo.disk(geo.cell("lat", "lng", 9), 1)).alias("cell"))


_RING = [(-100.0, -40.0), (120.0, -55.0), (60.0, 10.0), (150.0, 60.0), (-20.0, 45.0), (-130.0, 30.0)]


def _parity(x: str, y: str) -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1]):
        out.append(f"((({y1} > {y}) <> ({y2} > {y})) AND {x} < ({x2 - x1})::DOUBLE * ({y} - ({y1})) / ({y2 - y1})::DOUBLE + ({x1}))::INT")
    return f"(({' + '.join(out)}) % 2 = 1)"


@query(f"WITH {A.POINTS} SELECT c_custkey, {_parity('lng', 'lat')} AS inside FROM pts")
def point_in_polygon(spark, d):
    return A.points(spark, d).select("c_custkey", geo.inside("lng", "lat", _RING).alias("inside"))


def _rings(spark, d):
    """A star of eight points for each supplier."""
    k = F.col("s_suppkey")
    cx, cy, r = (k * 91 % 300).cast("double") - 149.9863, (k * 37 % 120).cast("double") - 59.9863, (k % 7).cast("double") + 3.0
    corner = lambda j: F.struct((cx + r * (1.0 + 0.6 * (j % 2)) * math.cos(math.pi / 4 * j)).alias("lng"), (cy + r * (1.0 + 0.6 * (j % 2)) * math.sin(math.pi / 4 * j)).alias("lat"))
    return A.read(spark, d, "supplier").select(k.alias("polygon_id"), F.array(*[corner(j) for j in range(8)]).alias("ring"))


_STARS = f"""ring AS (SELECT s_suppkey AS polygon_id, j, (s_suppkey * 91 % 300)::DOUBLE - 149.9863::DOUBLE + ((s_suppkey % 7)::DOUBLE + 3) * (1 + 0.6::DOUBLE * (j % 2)) * [{', '.join(repr(math.cos(math.pi / 4 * j)) + '::DOUBLE' for j in range(8))}][j + 1] AS x,
    (s_suppkey * 37 % 120)::DOUBLE - 59.9863::DOUBLE + ((s_suppkey % 7)::DOUBLE + 3) * (1 + 0.6::DOUBLE * (j % 2)) * [{', '.join(repr(math.sin(math.pi / 4 * j)) + '::DOUBLE' for j in range(8))}][j + 1] AS y FROM supplier, range(8) t(j)),
    edge AS (SELECT a.polygon_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN ring b ON b.polygon_id = a.polygon_id AND b.j = (a.j + 1) % 8)"""
_ODD = "sum(((y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)::INT) % 2 = 1"


@query(f"WITH {A.POINTS}, {_STARS} SELECT c_custkey, polygon_id FROM pts, edge GROUP BY 1, 2 HAVING {_ODD}")
def points_in_polygons(spark, d):
    """Every point in every polygon that holds it, over the cover of all polygons."""
    return polygons.within(A.points(spark, d), _rings(spark, d), "c_custkey", 6)


@query(f"""WITH {_STARS}, g AS (SELECT r, c, (r + 0.5::DOUBLE) * 7.5::DOUBLE - 90 AS lat, (c + 0.5::DOUBLE) * 7.5::DOUBLE - 180 AS lng FROM range(24) a(r), range(48) b(c)),
    i AS (SELECT polygon_id, r, c FROM g, edge GROUP BY ALL HAVING {_ODD}),
    m AS (SELECT polygon_id, avg(x) AS x, avg(y) AS y FROM ring GROUP BY 1 HAVING polygon_id NOT IN (SELECT polygon_id FROM i))
    SELECT polygon_id, printf('f%02d%08x%08x', 3, r, c) AS cell FROM i UNION ALL SELECT polygon_id, printf('f%02d%08x%08x', 3, floor((y + 90) / 7.5::DOUBLE)::BIGINT, floor((x + 180) / 7.5::DOUBLE)::BIGINT) FROM m""")
def cells_for_polygon(spark, d):
    """The cells of every polygon at resolution 3; those of none have their middle's."""
    return polygons.cells_of(_rings(spark, d), 3)


_T = lambda c, f: f"least(greatest(trunc({f})::INT, 0), 1023)"


@query(f"""WITH {A.POINTS}, a AS (SELECT c_custkey, {_T("x", "(lng + 180) / 360 * 1024")} AS x, {_T("y", "(1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024")} AS y FROM pts)
    SELECT c_custkey, x, y, {r6(west="x / 1024::DOUBLE * 360 - 180", south="degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 1024::DOUBLE))))", east="(x + 1) / 1024::DOUBLE * 360 - 180", north="degrees(atan(sinh(pi() * (1 - 2 * y / 1024::DOUBLE))))")} FROM a""")
def tiles(spark, d):
    x, y = geo.tile("lng", "lat", 10)
    df = A.points(spark, d).select("c_custkey", x.alias("x"), y.alias("y"))
    return df.select("c_custkey", "x", "y", *[A.rounded(c, 6).alias(n) for n, c in geo.tile_bounds(F.lit(10), "x", "y").items()])


@query("SELECT c_custkey, (('0x' || substr(sha256(c_custkey || '/' || c_mktsegment), 1, 12))::BIGINT % 10000) / 10000::DOUBLE AS u FROM customer")
def unit_hash(spark, d):
    return A.read(spark, d, "customer").select("c_custkey", geo.unit_hash(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("u"))
