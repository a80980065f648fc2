"""Raster neighbourhoods over pixel rows (patch, y, x, value).

A patch is cut into square tiles; a pixel goes to its own tile and to those whose
windows reach it, so that each tile has its halo. That is one shuffle of about
(1 + 2 radius / side)^2 times the raster, whatever the window's area, and a patch
of any size spreads over many tasks. Within a tile, windows are sums of shifted
arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
#: Side of a tile in pixels.
TILE = 256


def with_totals(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Each patch's aggregates beside its pixels: a patch may hold most pixels, so no window gathers it; the table of
    patches is small beside that of pixels, and adaptive execution broadcasts it where its size allows."""
    return df.join(df.groupBy(key).agg(*aggregates), key)


def shape(df: DataFrame, key: str = "patch") -> DataFrame:
    """Adds height ``__h`` and width ``__w`` of each patch."""
    return with_totals(df, key, (F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))


def _reads(i: np.ndarray, n: int, edge: str) -> np.ndarray:
    """What a window reads at index i of n: beyond the border the edge pixel, the mirrored one, or -1 for nothing."""
    if edge == "clamp":
        return np.clip(i, 0, n - 1)
    if edge == "reflect":
        fold = np.mod(i, max(2 * (n - 1), 1))
        return np.zeros_like(i) if n == 1 else np.minimum(fold, 2 * (n - 1) - fold)
    return np.where((i >= 0) & (i < n), i, -1)


def tiled(df: DataFrame, radius: int, values: list[str], names: list[str], fn, key: str = "patch", edge: str = "clamp", constants: tuple[str, ...] = (), tile: int | None = None) -> DataFrame:
    """(key, y, x, names) of every pixel of ``df``, by ``fn`` over whole tiles.

    ``fn`` takes an array for each value, ``radius`` wider than the tile on all
    sides, with NaN where there is no pixel or no value, and the patch's
    ``constants``; it returns an array of the tile's size for each name.
    """
    side = tile or TILE
    kind = df.schema[key].dataType.simpleString()
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(key, kinds[kind]), ("y", pa.int32()), ("x", pa.int32()), *[(n, pa.float64()) for n in names]])
    held = shape(df.select(key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(v) for v in values], *constants), key)
    meets = lambda c, n: F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col(c) - radius) / side).cast("int"), F.floor(F.least(F.col(n) - 1, F.col(c) + radius) / side).cast("int")))
    dealt = held.withColumn("__ty", meets("y", "__h")).withColumn("__tx", meets("x", "__w"))

    def run(at: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        h, w = rows.column("__h")[0].as_py(), rows.column("__w")[0].as_py()
        y, x = rows.column("y").to_numpy(), rows.column("x").to_numpy()
        y0, x0 = at[1].as_py() * side, at[2].as_py() * side
        y1, x1 = min(h, y0 + side), min(w, x0 + side)
        top, left = max(0, y0 - radius), max(0, x0 - radius)
        size = min(h, y1 + radius) - top, min(w, x1 + radius) - left
        iy, ix = _reads(np.arange(y0 - radius, y1 + radius), h, edge), _reads(np.arange(x0 - radius, x1 + radius), w, edge)
        windows = []
        for v in values:
            flat = np.full((size[0] + 1, size[1] + 1), np.nan)  # the last row and column are what "nothing" reads
            flat[y - top, x - left] = rows.column(v).to_numpy(zero_copy_only=False)
            windows.append(flat[np.where(iy < 0, size[0], iy - top)][:, np.where(ix < 0, size[1], ix - left)])
        own = np.flatnonzero((y >= y0) & (y < y1) & (x >= x0) & (x < x1))
        got = fn(*windows, *[rows.column(c)[0].as_py() for c in constants])
        out = [g[y[own] - y0, x[own] - x0] for g in got]
        cols = [pa.array([at[0].as_py()] * len(own), schema.types[0]), pa.array(y[own], pa.int32()), pa.array(x[own], pa.int32()), *[pa.array(o, pa.float64(), mask=np.isnan(o)) for o in out]]
        return pa.Table.from_arrays(cols, schema=schema)

    return dealt.groupBy(key, "__ty", "__tx").applyInArrow(run, f"{key} {kind}, y int, x int, " + ", ".join(f"{n} double" for n in names))


def _sums(a: np.ndarray, radius: int) -> np.ndarray:
    """The sum over each window, rows first."""
    n = 2 * radius + 1
    rows = sum(a[:, i : a.shape[1] - n + 1 + i] for i in range(n))
    return sum(rows[i : a.shape[0] - n + 1 + i] for i in range(n))


def _means(a: np.ndarray, radius: int) -> np.ndarray:
    """The mean over the values in each window; NaN where there are none."""
    ok = np.isfinite(a)
    n = _sums(ok.astype(float), radius)
    return np.where(n > 0, _sums(np.where(ok, a, 0.0), radius) / np.maximum(n, 1), np.nan)


def box_mean(df: DataFrame, size: int, key: str = "patch", value: str = "value", edge: str = "clamp", name: str = "mean", tile: int | None = None) -> DataFrame:
    """(key, y, x, name): the mean over a square, of the values there are; ``drop`` reads nothing beyond the border."""
    return tiled(df, size // 2, [value], [name], lambda a: [_means(a, size // 2)], key, edge, tile=tile)


def box_mean_wide(df: DataFrame, size: int, key: str = "patch", value: str = "value", name: str = "mean") -> DataFrame:
    """The clamped box mean by a row pass and a column pass: cost does not grow with the window's area."""
    r = size // 2

    def along(d: DataFrame, over: str, across: str, c: str) -> DataFrame:
        w = Window.partitionBy(key, across).orderBy(over)
        near = w.rowsBetween(-r, r)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(key, across))
        before, after = F.greatest(F.lit(0), r + 1 - i), F.greatest(F.lit(0), i + r - n)
        total = F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole)
        return d.withColumn(c, total / float(size))

    out = along(along(df.withColumn("__v", F.col(value).cast("double")), "x", "y", "__v"), "y", "x", "__v")
    return out.select(key, "y", "x", F.col("__v").alias(name))


def refined_lee(df: DataFrame, size: int = 7, looks: float = 1.0, key: str = "patch", value: str = "value", tile: int | None = None) -> DataFrame:
    """Speckle filter: the local mean moved towards the pixel as far as the local variance exceeds speckle's."""
    if size < 3 or size % 2 == 0:
        raise ValueError("the window has to be odd and at least 3")
    cu2, r = 1.0 / looks, size // 2
    x = with_totals(df, key, F.avg(value).alias("__fill")).withColumn("v", F.coalesce(F.col(value).cast("double"), F.col("__fill")))

    def filtered(v):
        m, m2 = _means(v, r), _means(v * v, r)
        noise = m * m * cu2
        signal = np.maximum((np.maximum(m2 - m * m, 0.0) - noise) / (1.0 + cu2), 0.0)
        den = signal + noise
        return [m + np.where(den > 1e-12, signal / np.where(den > 1e-12, den, 1.0), 0.0) * (v[r : v.shape[0] - r, r : v.shape[1] - r] - m)]

    return tiled(x, r, ["v"], ["filtered"], filtered, key, tile=tile)


def quantise(df: DataFrame, levels: int = 16, key: str = "patch", value: str = "value") -> DataFrame:
    """Adds ``q``: min-max to 0..levels-1, ties to even; missing and constant patches are 0."""
    if levels < 2:
        raise ValueError("two levels at least")
    lo, hi = F.col("__lo"), F.col("__hi")
    q = F.rint((F.col(value) - lo) / F.when(hi > lo, hi - lo) * float(levels - 1))
    both = with_totals(df, key, F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return both.withColumn("q", F.coalesce(q, F.lit(0.0)).cast("int")).drop("__lo", "__hi")


def cooccurrence(df: DataFrame, key: str = "patch", q: str = "q", distance: int = 1, symmetric: bool = True) -> DataFrame:
    """(key, angle, i, j, p): how often levels i and j lie beside each other, in four directions."""
    d = distance
    offsets = [(0, 0, d), (45, -d, d), (90, -d, 0), (135, -d, -d)]
    # each pixel is the first of its own pairs and the second of the pairs it ends
    first = F.array(*[F.struct(F.lit(a).alias("angle"), F.col("y").alias("py"), F.col("x").alias("px"), F.lit(0).alias("end")) for a, _, _ in offsets])
    second = F.array(*[F.struct(F.lit(a).alias("angle"), (F.col("y") - dy).alias("py"), (F.col("x") - dx).alias("px"), F.lit(1).alias("end")) for a, dy, dx in offsets])
    pairs = df.select(key, F.col(q).alias("q"), F.inline(F.concat(first, second)))
    pairs = pairs.groupBy(key, "angle", "py", "px").agg(F.max(F.when(F.col("end") == 0, F.col("q"))).alias("i"), F.max(F.when(F.col("end") == 1, F.col("q"))).alias("j")).where("i is not null and j is not null")
    if symmetric:
        pairs = pairs.select(key, "angle", F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    n = pairs.groupBy(key, "angle", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key, "angle"))).select(key, "angle", "i", "j", "p")


def haralick(glcm: DataFrame, key: str = "patch") -> DataFrame:
    """Texture of each patch, averaged over directions."""
    i, j, p = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    w = Window.partitionBy(key, "angle")
    g = glcm.withColumns({"mi": F.sum(i * p).over(w), "mj": F.sum(j * p).over(w)})
    di, dj = i - F.col("mi"), j - F.col("mj")
    each = g.groupBy(key, "angle").agg(
        F.sum(p * (i - j) * (i - j)).alias("contrast"), F.sum(p * F.abs(i - j)).alias("dissimilarity"), F.sum(p / (1.0 + (i - j) * (i - j))).alias("homogeneity"),
        F.sum(p * p).alias("asm"), (-F.sum(p * F.ln(p))).alias("entropy"), F.sum(di * di * p).alias("vi"), F.sum(dj * dj * p).alias("vj"), F.sum(di * dj * p).alias("cov"),
    )
    den = F.sqrt(F.col("vi") * F.col("vj"))
    each = each.withColumns({"energy": F.sqrt("asm"), "correlation": F.when(den < 1e-12, 1.0).otherwise(F.col("cov") / F.when(den >= 1e-12, den))})
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "correlation", "entropy")
    return each.groupBy(key).agg(*[F.avg(c).alias(c) for c in names])


def starfm(df: DataFrame, fine: str = "f0", coarse0: str = "c0", coarse1: str = "c1", win: int = 25, tolerance: float | None = None, classes: int = 4, key: str = "patch", name: str = "pred", tile: int | None = None) -> DataFrame:
    """(key, y, x, name): fine pixels moved by the coarse change of spectrally similar neighbours, near and steady ones first."""
    win += 1 - win % 2
    r = win // 2
    s = with_totals(df, key, F.stddev_pop(fine).alias("__sd"))
    s = s.withColumn("__tol", F.lit(float(tolerance)) if tolerance is not None else F.col("__sd") * 2.0 / float(max(classes, 1)) + EPS)

    def moved(f, a, b, tol):
        h, w = f.shape[0] - 2 * r, f.shape[1] - 2 * r
        own = f[r : r + h, r : r + w]
        change = b - a
        steady = np.abs(change) + EPS
        total, best = np.zeros((h, w)), np.zeros((h, w))
        for dy in range(win):
            for dx in range(win):
                near = np.s_[dy : dy + h, dx : dx + w]
                off = np.abs(f[near] - own)
                weight = np.where(off <= tol, 1.0 / ((off + EPS) * steady[near] * (1.0 + np.hypot(dy - r, dx - r))), 0.0)
                ok = np.isfinite(weight) & np.isfinite(f[near] + change[near])
                total += np.where(ok, weight, 0.0)
                best += np.where(ok, weight * (f[near] + change[near]), 0.0)
        return [np.where(total > 0, best / np.where(total > 0, total, 1.0), own + change[r : r + h, r : r + w])]

    return tiled(s, r, [fine, coarse0, coarse1], [name], moved, key, "reflect", ("__tol",), tile)


def estarfm(df: DataFrame, fine0: str = "f0", coarse0: str = "c0", fine2: str = "f2", coarse2: str = "c2", coarse1: str = "c1", win: int = 25, classes: int = 4, key: str = "patch", tile: int | None = None) -> DataFrame:
    """Two predictions, from before and after, weighted by how near their coarse image is to the target date's."""
    p0 = starfm(df, fine0, coarse0, coarse1, win, None, classes, key, "p0", tile)
    p2 = starfm(df, fine2, coarse2, coarse1, win, None, classes, key, "p2", tile)
    far = df.groupBy(key).agg((F.avg(F.abs(F.col(coarse1) - F.col(coarse0))) + EPS).alias("d0"), (F.avg(F.abs(F.col(coarse1) - F.col(coarse2))) + EPS).alias("d2"))
    w0 = (1.0 / F.col("d0")) / (1.0 / F.col("d0") + 1.0 / F.col("d2"))
    return p0.join(p2, [key, "y", "x"]).join(far, key).select(key, "y", "x", (w0 * F.col("p0") + (1.0 - w0) * F.col("p2")).alias("pred"))


def _targets(df: DataFrame, height: int, width: int, key: str) -> DataFrame:
    """All target pixels of each patch with their real-valued source positions."""
    dims = df.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    grid = dims.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("tx"))
    at = lambda t, size, n: F.lit(0.0) if n == 1 else F.col(t) * ((F.col(size) - 1) / float(n - 1))
    return grid.withColumns({"sy": at("ty", "h", height), "sx": at("tx", "w", width)})


def resample_nearest(df: DataFrame, height: int, width: int, key: str = "patch", value: str = "value") -> DataFrame:
    t = _targets(df, height, width, key).select(key, "ty", "tx", F.rint("sy").cast("int").alias("y"), F.rint("sx").cast("int").alias("x"))
    return t.join(df.select(key, "y", "x", value), [key, "y", "x"]).select(key, F.col("ty").alias("y"), F.col("tx").alias("x"), value)


def resample_bilinear(df: DataFrame, height: int, width: int, key: str = "patch", value: str = "value") -> DataFrame:
    """Four neighbours by weight: one join on the exploded corners."""
    t = _targets(df, height, width, key)
    y0, x0 = F.floor("sy").cast("int"), F.floor("sx").cast("int")
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    corner = lambda a, b: F.struct(F.least(y0 + a, F.col("h") - 1).alias("y"), F.least(x0 + b, F.col("w") - 1).alias("x"), ((fy if a else 1.0 - fy) * (fx if b else 1.0 - fx)).alias("weight"))
    t = t.select(key, "ty", "tx", F.inline(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    j = t.join(df.select(key, "y", "x", value), [key, "y", "x"])
    return j.groupBy(key, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def sharpened_moisture(df: DataFrame, size: int = 3, key: str = "patch", moisture: str = "sm", radar: str = "vv") -> DataFrame:
    """(key, y, x, sm): coarse moisture with radar detail, the focal mean over the pixels there are."""
    focal = box_mean(df, size, key, radar, "drop", "focal")
    x = F.col(moisture) + 0.02 * (F.col(radar) - F.col("focal"))
    return df.join(focal, [key, "y", "x"]).select(key, "y", "x", F.when(x < 0, 0.0).when(x > 0.6, 0.6).otherwise(x).alias("sm"))
