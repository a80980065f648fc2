"""Worked examples and closed forms."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fieldlark.functions import advisory, crop, et0, geo, indices, optical, sar, soil, stress


def one(spark, **exprs):
    return spark.range(1).select(*[(c if not isinstance(c, (int, float)) else F.lit(c)).alias(k) for k, c in exprs.items()]).first().asDict()


def lits(**kw):
    return {k: F.lit(float(v)) for k, v in kw.items()}


def test_reference_evapotranspiration_example(spark):
    c = et0.components(**lits(tmin=12.3, tmax=21.5, rs=22.07, elevation=100, lat=50.80, doy=187, u2=2.078, rh_min=63, rh_max=84))
    r = one(spark, **c)
    for name, want, tol in (("et0", 3.88, 0.2), ("delta", 0.122, 0.002), ("gamma", 0.0666, 0.0005), ("ea", 1.409, 0.005), ("es", 1.997, 0.005), ("ra", 41.09, 0.1), ("rso", 30.90, 0.1), ("rns", 17.0, 0.05), ("rnl", 3.71, 0.05), ("rn", 13.28, 0.1)):
        assert r[name] == pytest.approx(want, abs=tol), name


@pytest.mark.parametrize("t,e", [(1.5, 0.681), (12.3, 1.431), (21.5, 2.564), (24.0, 2.984)])
def test_saturation_pressure(spark, t, e):
    assert one(spark, x=et0.saturation_pressure(F.lit(t)))["x"] == pytest.approx(e, abs=0.01)


def test_kc_curve_and_stages(spark):
    df = spark.createDataFrame([("WHEAT", d) for d in (0, 30, 50, 90, 140, 200)], "crop string, das int")
    got = {r.das: r.kc for r in crop.with_crop(df).select("das", crop.kc_curve("das").alias("kc")).collect()}
    assert got == pytest.approx({0: 0.30, 30: 0.30, 50: 0.725, 90: 1.15, 140: 0.30, 200: 0.30})
    days = spark.createDataFrame([("wheat", d) for d in (10, 50, 90, 130)], "crop string, das int")
    assert [r.s for r in crop.with_crop(days).orderBy("das").select(crop.stage_for_day("das").alias("s")).collect()] == ["ini", "dev", "mid", "late"]


def test_degree_day_bounds_belong_to_the_next_stage(spark):
    r = one(spark, a=crop.degree_day_stage(F.lit(199.9), F.lit("wheat")), b=crop.degree_day_stage(F.lit(200.0), F.lit("wheat")), c=crop.degree_day_stage(F.lit(2000.0), F.lit("what")))
    assert (r["a"], r["b"], r["c"]) == ("initial", "development", "mature")


def test_soil(spark):
    ks = {f"k{d}": soil.stress_coefficient(F.lit(float(d)), F.lit(120.0), F.lit(0.5)) for d in (0, 30, 60, 90, 120, 150)}
    assert one(spark, **ks) == pytest.approx({"k0": 1, "k30": 1, "k60": 1, "k90": 0.5, "k120": 0, "k150": 0})
    r = one(spark, taw=soil.total_available(F.lit(0.22), F.lit(0.10), F.lit(1.0)), u=soil.rain_usda_monthly(F.lit(100.0)), v=soil.rain_usda_monthly(F.lit(300.0)), w=soil.rain_cn(F.lit(2.0)), z=soil.stress_coefficient(F.lit(1.0), F.lit(0.0), F.lit(0.5)))
    assert r == pytest.approx({"taw": 120, "u": 84, "v": 155, "w": 2.0, "z": 1})


def test_indices_guard_and_propagate(spark):
    n = indices.ndvi
    r = one(spark, a=n(F.lit(0.8), F.lit(0.2)), b=n(F.lit(0.5), F.lit(0.5)), c=n(F.lit(0.0), F.lit(1.0)), d=n(F.lit(0.0), F.lit(0.0)), e=n(F.lit(None).cast("double"), F.lit(1.0)), f=indices.msavi(F.lit(-5.0), F.lit(-8.0)))
    assert r["a"] == pytest.approx(0.6) and r["b"] == 0 and r["c"] == -1 and r["d"] is None and r["e"] is None
    assert set(indices.available(["nir", "red"])) == {"ndvi", "evi2", "savi", "msavi"}
    assert set(indices.available(["nir", "red"], ["ndvi", "nothing"])) == {"ndvi"}


def test_masks(spark):
    df = spark.createDataFrame([(s, q, c) for s, q, c in ((4, 0, 0.6), (7, 8, float("nan")), (3, 16, None), (11, 2, 0.59))], "scl int, qa int, cs double")
    got = df.select(optical.scl_valid("scl").alias("s"), optical.qa_clear("qa").alias("q"), optical.landsat_clear("qa").alias("l"), optical.score_valid("cs").alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (True, False, False, False), (False, False, False, False), (True, True, False, False)]


def test_radar(spark):
    f = sar.features(F.lit(0.1), F.lit(0.02))
    r = one(spark, **{k: f[k] for k in ("vv", "vh_vv_ratio", "ratio_db", "rvi")}, back=sar.to_linear(f["vv"]), neg=sar.features(F.lit(-1.0), F.lit(0.0))["vv"], same=sar.terrain_flatten(F.lit(0.3)))
    assert r == pytest.approx({"vv": -10, "vh_vv_ratio": 0.2, "ratio_db": 10 * math.log10(0.2), "rvi": 2 / 3, "back": 0.1, "neg": -120, "same": 0.3})


def test_stress_classes(spark):
    df = spark.createDataFrame([(0.9, "initial"), (0.3, "initial"), (0.2, "initial"), (0.1, "initial"), (None, "initial"), (float("nan"), "x"), (0.6, "mid-season"), (0.6, "unheard")], "x double, s string")
    c = stress.classify("x", "s")
    assert [tuple(r) for r in df.select(c["severity"].alias("a"), c["label"].alias("b")).collect()] == [(0, "none"), (2, "moderate"), (3, "high"), (4, "severe"), (-1, "no_data"), (-1, "no_data"), (1, "mild"), (0, "none")]
    with pytest.raises(KeyError):
        stress.optram("a", "b", {"dry_slope": 1})


def test_advisory_codes(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (50.0,), (60.0,), (115.0,), (None,)], "d double")
    code = advisory.codes("d", F.lit(60.0), soil.stress_coefficient("d", F.lit(120.0), F.lit(0.5)), F.lit(120.0))
    assert [r[0] for r in df.select(code).collect()] == [0, 1, 2, 3, 4, -1]
    e = advisory.evaluate(F.lit(10.0), F.lit(120.0), F.lit(0.5), F.lit("mid"), F.lit(0.0))
    assert one(spark, d=e["days_to_trigger"], p=e["p_eff"]) == {"d": math.inf, "p": pytest.approx(0.425)}


def test_cells(spark):
    df = spark.createDataFrame([(30.7, 76.8), (-12.0, 3.0)], "lat double, lng double").withColumn("c", geo.cell("lat", "lng", 9))
    lat, lng = geo.centre("c")
    for r in df.select("lat", "lng", "c", lat.alias("a"), lng.alias("b"), geo.parent("c").alias("p"), geo.children("c").alias("k"), geo.disk("c", 2).alias("d")).collect():
        assert abs(r.a - r.lat) <= 30 / 512 and abs(r.b - r.lng) <= 30 / 512
        assert len(r.k) == 4 and r.k == sorted(r.k) and len(r.d) == 25 and r.c in r.d
    kids = df.select("c", F.explode(geo.children("c")).alias("k")).select("c", geo.parent("k").alias("p")).collect()
    assert all(r.c == r.p for r in kids)


def test_unknown_band_and_stage_are_null(spark):
    r = one(spark, a=optical.harmonise(F.lit(0.3), F.lit("nope")), b=crop.stage_name(F.lit("nope")), c=optical.harmonise(F.lit(0.3), "B4"))
    assert r["a"] is None and r["b"] is None and r["c"] == pytest.approx(0.3 * 0.9765 + 0.0009)
