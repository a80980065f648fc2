"""The daily root-zone water balance: a fold over each field's days, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.soil import runoff_cn

STATE = "array<struct<date:date,dr:double,ks:double,etc:double,etc_adj:double,peff:double,irrigation:double,deep_perc:double,runoff:double>>"


def _least(a: Column, b: Column) -> Column:
    return F.when(a > b, b).otherwise(a)


def _most(a: Column, b: Column) -> Column:
    return F.when(a < b, b).otherwise(a)


def _step(taw: Column, p: Column, curve_number):
    share = F.when(p > 0.999999, F.lit(0.999999)).when(p < 0, F.lit(0.0)).otherwise(p)

    def step(acc, d):
        dr0 = acc["dr"]
        ks = F.when((taw <= 0) | (dr0 <= share * taw), F.lit(1.0)).otherwise(_most(_least((taw - dr0) / F.when(taw > 0, (1.0 - share) * taw), F.lit(1.0)), F.lit(0.0)))
        runoff = runoff_cn(d["rain"], curve_number) if curve_number is not None else F.lit(0.0)
        peff = _most(d["rain"] - runoff, F.lit(0.0))
        etc = d["kc"] * d["et0"]
        adjusted = ks * etc
        before = dr0 - peff - d["irrigation"] - d["rise"] + adjusted
        deep = _most(-before, F.lit(0.0))
        dr = _least(before + deep, taw)
        row = F.struct(d["date"].alias("date"), dr.alias("dr"), ks.alias("ks"), etc.alias("etc"), adjusted.alias("etc_adj"), peff.alias("peff"), d["irrigation"].alias("irrigation"), deep.alias("deep_perc"), runoff.alias("runoff"))
        return F.struct(dr.alias("dr"), F.concat(acc["out"], F.array(row)).alias("out"))

    return step


def _days(df: DataFrame, field: str, date: str) -> Column:
    value = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    return F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), F.col("et0").cast("double").alias("et0"), F.col("kc").cast("double").alias("kc"), value("rain").alias("rain"), value("irrigation").alias("irrigation"), value("capillary_rise").alias("rise"))))


def run(df: DataFrame, field: str = "field_id", date: str = "date", taw: str = "taw", p: str = "p", dr0: str | None = None, curve_number: float | None = None) -> DataFrame:
    """One row per field and day: dr, ks, etc, etc_adj, peff, irrigation, deep_perc, runoff.

    Ks comes from the deficit at the day's start; the deficit stays in [0, TAW]
    and what would fall below 0 drains. A field's days (a season's) fold in one
    row; fields spread over the cluster.
    """
    first = F.first(dr0) if dr0 else F.lit(0.0)
    got = df.groupBy(field).agg(_days(df, field, date).alias("days"), F.first(taw).cast("double").alias("taw"), F.first(p).cast("double").alias("p"), first.cast("double").alias("dr0"))
    start = _most(_least(F.col("dr0"), F.col("taw")), F.lit(0.0))
    zero = F.struct(start.alias("dr"), F.expr(f"cast(array() as {STATE})").alias("out"))
    return got.select(field, F.inline(F.aggregate("days", zero, _step(F.col("taw"), F.col("p"), curve_number), lambda a: a["out"])))


def eight_day_deficit(df: DataFrame, field: str = "field_id", date: str = "date", taw: str = "taw", p: str = "p", efficiency: float = 0.6, days: int = 8, curve_number: float | None = None) -> DataFrame:
    """Deficit after the first ``days`` days (short series go on with their last day): dnet, dgross, ks_end."""
    if not 0 < efficiency <= 1:
        raise ValueError("the efficiency has to be in (0, 1]")
    got = df.groupBy(field).agg(_days(df, field, date).alias("days"), F.first(taw).cast("double").alias("taw"), F.first(p).cast("double").alias("p"))
    held = F.slice("days", 1, days)
    padded = F.concat(held, F.array_repeat(F.element_at(held, -1), days - F.size(held)))
    zero = F.struct(F.lit(0.0).alias("dr"), F.expr(f"cast(array() as {STATE})").alias("out"))
    out = got.select(field, F.aggregate(padded, zero, _step(F.col("taw"), F.col("p"), curve_number), lambda a: a["out"]).alias("s"))
    last = F.element_at("s", days)
    return out.select(field, last["dr"].alias("dnet"), (last["dr"] / efficiency).alias("dgross"), last["ks"].alias("ks_end"))


BUCKET = "array<struct<step:int,dr:double,advisory:string,stress_class:string>>"


def bucket(df: DataFrame, field: str = "field_id", step: str = "step") -> DataFrame:
    """The simple bucket per field and step: demand less rain within [0, TAW], the advisory of what that is, and a part
    of RAW refilled where it says to irrigate now. ``df`` has etc, rain, stage, taw, raw, refill and dr0."""
    from ..functions.advisory import from_ratio

    days = F.array_sort(F.collect_list(F.struct(F.col(step).cast("int").alias("step"), F.col("etc").alias("etc"), F.col("rain").alias("rain"), F.col("stage").alias("stage"))))
    got = df.groupBy(field).agg(days.alias("days"), *[F.first(c).cast("double").alias(c) for c in ("taw", "raw", "refill", "dr0")])

    def go(acc, d):
        dr = _least(_most(acc["dr"] + d["etc"] - d["rain"], F.lit(0.0)), F.col("taw"))
        told = from_ratio(dr / _most(F.col("raw"), F.lit(1e-6)), d["stage"])
        after = F.when(told["advisory"].isin("irrigate_now", "critical"), _most(dr - F.col("raw") * F.col("refill"), F.lit(0.0))).otherwise(dr)
        row = F.struct(d["step"].alias("step"), after.alias("dr"), told["advisory"].alias("advisory"), told["stress_class"].alias("stress_class"))
        return F.struct(after.alias("dr"), F.concat(acc["out"], F.array(row)).alias("out"))

    zero = F.struct(F.col("dr0").alias("dr"), F.expr(f"cast(array() as {BUCKET})").alias("out"))
    return got.select(field, F.inline(F.aggregate("days", zero, go, lambda a: a["out"])))
