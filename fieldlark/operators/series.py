"""Time series by key as window expressions: one sort per key serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import at_least, clip


def _by(keys: list[str], t: str):
    return Window.partitionBy(*keys).orderBy(t)


def growing_degree_days(df: DataFrame, keys: list[str], t: str = "date", tmin: str = "tmin", tmax: str = "tmax", base: float = 10.0, cap: float = 30.0) -> DataFrame:
    """Adds ``gdd`` (of the day; a missing day counts 0) and ``gdd_sum``."""
    held = lambda c: clip(clip(F.col(c), None, cap), base, None)
    day = F.coalesce(at_least((held(tmin) + held(tmax)) / 2.0 - base, 0.0), F.lit(0.0))
    w = _by(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("gdd", day).withColumn("gdd_sum", F.sum("gdd").over(w))


#: Time constants that a block of a series spans: weights relative to its start stay within a double's range.
BLOCK = 100


def soil_water_index(df: DataFrame, keys: list[str], t: str = "t", value: str = "ssm", t_char: float = 10.0) -> DataFrame:
    """Adds ``swi``: the exponential filter in closed form, weights exp(t / T) relative to the start of a block of time.

    Gaps carry the last value; before the first observation it is NULL. A series
    may span any time: what came before a block enters by the totals of the two
    blocks before it that have values, as all older ones weigh less than e^-100
    of these.
    """
    whole = Window.partitionBy(*keys)
    ahead = (F.col(t) - F.min(t).over(whole)) / t_char
    held = df.withColumn("__b", F.floor(ahead / BLOCK).cast("long"))
    held = held.withColumn("__w", F.when(F.col(value).isNotNull(), F.exp(ahead - F.col("__b") * BLOCK))).withColumn("__wx", F.col("__w") * F.col(value))
    run, block = Window.partitionBy(*keys, "__b").orderBy(t).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, "__b")
    held = held.withColumns({"__cw": F.sum("__w").over(run), "__cx": F.sum("__wx").over(run), "__tw": F.sum("__w").over(block), "__tx": F.sum("__wx").over(block)})
    earlier = whole.orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)

    def carried(w: str, x: str) -> Column:
        return F.last(F.when(F.col(w).isNotNull(), F.struct(F.col("__b").alias("b"), F.col(w).alias("w"), F.col(x).alias("x"))), True).over(earlier)

    fade = F.exp((F.col("__p.b") - F.col("__b")) * float(BLOCK))
    held = held.withColumn("__p", carried("__tw", "__tx"))
    held = held.withColumns({c: F.col(f"__t{k}") + F.coalesce(F.col(f"__p.{k}") * fade, F.lit(0.0)) for k, c in (("w", "__uw"), ("x", "__ux"))})
    held = held.withColumn("__p", carried("__uw", "__ux"))
    total = lambda k: F.col(f"__c{k}") + F.coalesce(F.col(f"__p.{k}") * fade, F.lit(0.0))
    swi = F.when(F.col("__cw").isNull(), F.col("__p.x") / F.col("__p.w")).otherwise(total("x") / total("w"))
    return held.withColumn("swi", swi).drop(*[f"__{c}" for c in ("b", "w", "wx", "cw", "cx", "tw", "tx", "uw", "ux", "p")])


def gradient(df: DataFrame, keys: list[str], value: str, t: str = "date") -> DataFrame:
    """Adds ``gradient``: central differences, one-sided at the ends."""
    w = _by(keys, t)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumn("gradient", F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2.0))


def phenophase(vi: Column, slope: Column) -> Column:
    """0 bare, 1 emergence, 2 vegetative, 3 reproductive, 4 maturity, 5 senescence; later rules win."""
    low = (vi >= 0.25) & (vi < 0.5)
    return (
        F.when(low & (slope < 0), 5).when((vi >= 0.5) & (slope < 0), 4).when((vi >= 0.6) & (F.abs(slope) < 0.01), 3)
        .when((vi >= 0.5) & (slope >= 0), 2).when(low & (slope >= 0), 1).otherwise(0)
    )


def interpolated(df: DataFrame, keys: list[str], value: str, t: str = "t") -> DataFrame:
    """Adds ``filled``: linear over the row number, flat beyond the ends."""
    w = _by(keys, t)
    df = df.withColumn("__i", F.row_number().over(w).cast("double"))
    at = F.when(F.col(value).isNotNull(), F.col("__i"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x0, x1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    i0, i1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    line = F.when(i0 == i1, x0).otherwise(x0 + (x1 - x0) * (F.col("__i") - i0) / F.when(i1 > i0, i1 - i0))
    return df.withColumn("filled", F.when(x0.isNull(), x1).when(x1.isNull(), x0).otherwise(line)).drop("__i")


def _savgol_rows(window: int, order: int):
    import numpy as np

    half = window // 2
    x = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    return [(np.power(float(p), np.arange(order + 1)) @ fit).tolist() for p in x]


def savitzky_golay(df: DataFrame, keys: list[str], value: str, t: str = "t", window: int = 7, order: int = 2) -> DataFrame:
    """Adds ``smooth``: gaps filled linearly, then a moving polynomial; the ends take the first and last window's one.

    Series shorter than the window stay as filled.
    """
    window += 1 - window % 2
    half, w = window // 2, _by(keys, t)
    df = interpolated(df, keys, value, t).withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = _savgol_rows(window, order)
    near = [F.lag("filled", -o).over(w) if o < 0 else F.lead("filled", o).over(w) for o in range(-window, window + 1)]
    dot = lambda row, first: sum((F.lit(c) * near[window + first + k] for k, c in enumerate(row)), F.lit(0.0))
    out = F.when(F.col("__n") < window, F.col("filled"))
    for k in range(half):
        out = out.when(F.col("__i") == k + 1, dot(rows[k], -k))
        out = out.when(F.col("__i") == F.col("__n") - k, dot(rows[window - 1 - k], k - window + 1))
    return df.withColumn("smooth", out.otherwise(dot(rows[half], -half))).drop("__i", "__n")


def crossings(df: DataFrame, keys: list[str], level: Column, value: str = "vi", t: str = "t", rising: bool = True, name: str = "crossing") -> DataFrame:
    """(keys, name): the first time the series crosses the level, interpolated; NULL if it never does."""
    w = _by(keys, t)
    held = df.withColumns({"__level": level, "__x0": F.lag(value).over(w), "__t0": F.lag(t).over(w)})
    x0, x1, lv = F.col("__x0"), F.col(value), F.col("__level")
    hit = ((x0 < lv) & (x1 >= lv)) if rising else ((x0 >= lv) & (x1 < lv))
    when = F.when(hit, F.when(x1 == x0, F.col(t)).otherwise(F.col("__t0") + (lv - x0) * (F.col(t) - F.col("__t0")) / F.when(x1 != x0, x1 - x0)))
    return held.groupBy(*keys).agg(F.min(when).alias(name))


def phenometrics(df: DataFrame, keys: list[str], value: str = "vi", t: str = "t", threshold: float = 0.5) -> DataFrame:
    """Season metrics straight from the observations: sos, pos, eos, lgp, amplitude, peak, base, integral.

    The peak is the first maximum; season start and end are the crossings of
    base + threshold * amplitude up to and from the peak, else the series' ends.
    """
    whole, w = Window.partitionBy(*keys), _by(keys, t)
    s = df.where(F.col(value).isNotNull()).select(*keys, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("x"))
    s = s.withColumns({"peak": F.max("x").over(whole), "base": F.min("x").over(whole)})
    s = s.withColumns({"pos": F.min(F.when(F.col("x") == F.col("peak"), F.col("t"))).over(whole), "thr": F.col("base") + threshold * (F.col("peak") - F.col("base")), "x0": F.lag("x").over(Window.partitionBy(*keys).orderBy("t")), "t0": F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))})
    cut = F.col("t0") + (F.col("thr") - F.col("x0")) * (F.col("t") - F.col("t0")) / F.when(F.col("x") != F.col("x0"), F.col("x") - F.col("x0"))
    up = F.when((F.col("t") <= F.col("pos")) & (F.col("x0") < F.col("thr")) & (F.col("x") >= F.col("thr")), cut)
    down = F.when((F.col("t0") >= F.col("pos")) & (F.col("x0") >= F.col("thr")) & (F.col("x") < F.col("thr")), cut)
    area = (F.col("t") - F.col("t0")) * ((F.col("x") - F.col("base")) + (F.col("x0") - F.col("base"))) / 2.0
    out = s.groupBy(*keys).agg(
        F.coalesce(F.min(up), F.min("t")).alias("sos"), F.first("pos").alias("pos"), F.coalesce(F.min(down), F.max("t")).alias("eos"),
        F.first("peak").alias("peak_value"), F.first("base").alias("base_value"), F.coalesce(F.sum(area), F.lit(0.0)).alias("integral"),
    )
    return out.withColumns({"amplitude": F.col("peak_value") - F.col("base_value"), "lgp": at_least(F.col("eos") - F.col("sos"), 0.0)})


def season_by_threshold(df: DataFrame, keys: list[str], value: str = "ndvi", doy: str = "doy", fraction: float = 0.2) -> DataFrame:
    """First and last day of year at or above min + fraction * (max - min), and the days between."""
    w = Window.partitionBy(*keys)
    s = df.withColumn("__thr", F.min(value).over(w) + (F.max(value).over(w) - F.min(value).over(w)) * fraction)
    out = s.where(F.col(value) >= F.col("__thr")).groupBy(*keys).agg(F.min(doy).alias("sos_doy"), F.max(doy).alias("eos_doy"))
    return out.withColumn("lgp", F.col("eos_doy") - F.col("sos_doy"))


def double_logistic(t: Column, base, amp, sos, r_sp, eos, r_au) -> Column:
    sig = lambda z: 1.0 / (1.0 + F.exp(-z))
    return base + amp * (sig(r_sp * (t - sos)) - sig(r_au * (t - eos)))
