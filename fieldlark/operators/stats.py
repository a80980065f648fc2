"""Statistics over sensors and series: anomalies, consensus, collocation, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import EPS, clip, finite, safe_divide
from ..functions.geo import unit_hash


def anomaly(series: DataFrame, baseline: DataFrame, keys: list[str], value: str, robust: bool = False) -> DataFrame:
    """Adds ``z`` against the baseline of the same keys; NULL where the baseline has no spread."""
    if robust:
        mid = baseline.groupBy(*keys).agg(F.median(value).alias("__m"))
        off = baseline.join(mid, keys).groupBy(*keys).agg(F.first("__m").alias("__m"), (1.4826 * F.median(F.abs(F.col(value) - F.col("__m")))).alias("__s"))
    else:
        off = baseline.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return series.join(off, keys, "left").withColumn("z", safe_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def zonal(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, low, high, mean, std, median, spread) of each zone's values; the deviation is the population's."""
    x = finite(value)
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.median(x).alias("median"))
    return out.withColumn("spread", F.col("high") - F.col("low"))


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0)


def consensus(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None, threshold: float = 3.5) -> DataFrame:
    """Weighted mean of the sources whose modified z is within the threshold; all are kept where the MAD vanishes,
    and where none is left the median stands. One shuffle: a pixel has a few sources."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    got = df.where(finite(value).isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col(value).cast("double").alias("x"), w.alias("w"))).alias("s"))
    got = got.withColumn("median", _median(F.transform("s", lambda e: e["x"])))
    got = got.withColumn("mad", _median(F.transform("s", lambda e: F.abs(e["x"] - F.col("median")))))
    ok = lambda e: (F.col("mad") <= 1e-9) | (0.6745 * F.abs(e["x"] - F.col("median")) / F.when(F.col("mad") > 1e-9, F.col("mad")) <= threshold)
    got = got.withColumn("kept", F.array_sort(F.filter("s", lambda e: F.coalesce(ok(e), F.lit(True)))))
    total = F.aggregate("kept", F.lit(0.0), lambda a, e: a + e["w"])
    mean = F.aggregate("kept", F.lit(0.0), lambda a, e: a + e["w"] * e["x"]) / F.when(total > 0, total)
    return got.select(*keys, "median", "mad", F.size("kept").alias("n_kept"), F.coalesce(mean, F.col("median")).alias("consensus"))


def triple_collocation(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Error variance, correlation with the truth and signal-to-noise ratio (dB) of three sensors, from one aggregate."""
    ok = df.where(finite(x).isNotNull() & finite(y).isNotNull() & finite(z).isNotNull())
    s = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.var_samp(z).alias("zz"),
        F.covar_samp(x, y).alias("xy"), F.covar_samp(x, z).alias("xz"), F.covar_samp(y, z).alias("yz"),
    ).where("n >= 3")
    out = {}
    for name, own, a, b, far in (("x", "xx", "xy", "xz", "yz"), ("y", "yy", "xy", "yz", "xz"), ("z", "zz", "xz", "yz", "xy")):
        signal = safe_divide(F.col(a) * F.col(b), F.col(far))
        raw = F.col(own) - signal
        rho2 = clip(safe_divide(signal, F.col(own)), 0.0, 1.0)
        out |= {f"var_err_{name}": clip(raw, 0.0), f"rho_{name}": F.sqrt(rho2), f"snr_db_{name}": F.when((raw > 0) & (signal > 0), 10.0 * F.log10(signal / F.when(raw > 0, raw)))}
    return s.select(*keys, "n", *[c.alias(k) for k, c in out.items()])


def fitted_calibration(df: DataFrame, keys: list[str], source: str, reference: str) -> DataFrame:
    """Least squares of the reference on the source: gain, bias and the number of pairs (two at least)."""
    ok = df.where(finite(source).isNotNull() & finite(reference).isNotNull())
    return ok.groupBy(*keys).agg(F.regr_slope(reference, source).alias("gain"), F.regr_intercept(reference, source).alias("bias"), F.count(F.lit(1)).alias("n")).where("n >= 2")


#: Bins of one pass of ``medians``.
BINS = 4096


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """The exact median of each expression over a table of any size, None where it has no values.

    A pass counts the values in ``BINS`` equal bins of a range, with each bin's
    smallest and largest; the bin that holds the middle rank is the next pass's
    range, until all of its values are one. Each pass is one aggregate with
    map-side combine, and the driver sees as many rows as there are bins.
    """
    spans = df.agg(*[f(c).cast(k).alias(f"{n}{i}") for i, c in enumerate(columns.values()) for n, f, k in (("lo", F.min, "double"), ("hi", F.max, "double"), ("n", F.count, "long"))]).first()
    return {name: _middle(df.select(c.cast("double").alias("x")), spans[f"lo{i}"], spans[f"hi{i}"], spans[f"n{i}"]) for i, (name, c) in enumerate(columns.items())}


def _middle(df: DataFrame, lo: float, hi: float, n: int) -> float | None:
    if not n:
        return None
    ranks, below = sorted({(n - 1) // 2, n // 2}), 0
    while (width := (hi - lo) / BINS) > 0:
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1))
        bins = df.where(F.col("x").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect()
        held = []
        for b in bins:
            held += [(b["lo"], b["hi"], below) for r in ranks if below <= r < below + b["n"]]
            below += b["n"]
        if held[0] != held[-1]:  # neighbours in two bins: the one's largest value and the other's smallest
            return (held[0][1] + held[1][0]) / 2.0
        lo, hi, below = held[0]
    return lo


def downscaled(df: DataFrame, coarse: str = "smap", radar: str = "s1", optical: str = "optical") -> DataFrame:
    """Adds ``downscaled``: coarse moisture moved by robust z-scores of radar and optical detail."""
    mid = medians(df, {"s1": F.col(radar), "optical": F.col(optical)})
    off = {n: F.abs(F.col(c) - F.lit(mid[n])) for n, c in (("s1", radar), ("optical", optical))}
    spread, sd = medians(df, off), df.agg(F.stddev_pop(coarse)).first()[0]
    z = lambda n, c: (F.col(c) - F.lit(mid[n])) / (1.4826 * (F.lit(spread[n]) + EPS))
    x = F.col(coarse) + 0.10 * z("s1", radar) * F.lit(sd) - 0.05 * z("optical", optical) * F.lit(sd)
    return df.withColumn("downscaled", clip(x, 0.0, 0.6))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values by the column's exact median, 0 for an all-missing column."""
    mids = medians(df, {c: finite(c) for c in columns})
    return df.withColumns({c: F.coalesce(finite(c), F.lit(mids[c]).cast("double"), F.lit(0.0)) for c in columns})


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` n / (k * count of the class); classes are few, so their counts are broadcast."""
    each = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    both = each.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return df.join(F.broadcast(each.crossJoin(both)), label).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def block_id(df: DataFrame, x: str, y: str, k: int) -> DataFrame:
    """Adds ``block``: the cell of a k x k grid over the points' extent."""
    ext = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(c) - F.col(lo)) / F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)) * k), F.lit(k - 1))).otherwise(F.lit(0))
    return df.crossJoin(F.broadcast(ext)).withColumn("block", (at(y, "y0", "y1") * k + at(x, "x0", "x1")).cast("int")).drop("x0", "x1", "y0", "y1")


def block_split(df: DataFrame, x: str, y: str, k: int = 8, test: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``block`` and ``is_test``: whole blocks go to the test side, in the order of a hash that any SQL has too."""
    held = block_id(df, x, y, k)
    blocks = held.select("block").distinct()
    n = blocks.agg(F.count(F.lit(1)).alias("__nb"))
    ranked = blocks.withColumn("__r", F.row_number().over(Window.orderBy(unit_hash(str(seed), F.col("block").cast("string")), "block"))).crossJoin(n)  # k * k rows at most
    chosen = ranked.select("block", (F.col("__r") <= F.greatest(F.lit(1), F.rint(F.col("__nb") * test))).alias("is_test"))
    return held.join(F.broadcast(chosen), "block")
