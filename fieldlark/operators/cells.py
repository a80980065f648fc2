"""The tidy cell table (cell, date, variable, value): build, aggregate, pivot, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.core import finite


def melt(df: DataFrame, keys: list[str], variables: list[str] | None = None) -> DataFrame:
    """Wide to long; by default every numeric column that is no key. Missing values are dropped."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    variables = variables or [c for c, t in df.dtypes if c not in keys and (t in numeric or t.startswith("decimal"))]
    cast = df.select(*keys, *[finite(v).alias(v) for v in variables])
    return cast.unpivot(keys, variables, "variable", "value").where("value is not null")


def cell_table(pixels: DataFrame, res: int = 9, variables: list[str] | None = None, how: str = "avg", lat: str = "lat", lng: str = "lng", date: str = "date") -> DataFrame:
    """One value per cell, date and variable. The cell is computed once per pixel, before the melt."""
    keyed = pixels.withColumn("cell", geo.cell(lat, lng, res)).drop(lat, lng)
    agg = {"mean": "avg", "std": "stddev_samp"}.get(how, how)
    return melt(keyed, ["cell", date], variables).groupBy("cell", date, "variable").agg(getattr(F, agg)("value").alias("value"))


def pivot(table: DataFrame, variables: list[str], keys=("cell", "date")) -> DataFrame:
    """Long to wide; naming the variables spares a pass to find them."""
    return table.groupBy(*keys).pivot("variable", variables).agg(F.first("value", ignorenulls=True))


def to_features(table: DataFrame, keys=("cell", "date")) -> DataFrame:
    """Long to one map of features per key."""
    return table.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "value")))).alias("features"))


def to_json(features: DataFrame, keys=("cell", "date")) -> DataFrame:
    return features.select(*keys, F.to_json("features").alias("features"))


def from_json(stored: DataFrame, keys=("cell", "date")) -> DataFrame:
    return stored.select(*keys, F.from_json("features", "map<string,double>").alias("features"))


def _comparable(df: DataFrame, but: list[str]) -> list[str]:
    """Columns that ties may be settled by: Spark doesn't order maps."""
    return [c for c, t in df.dtypes if c not in but and "map<" not in t and t != "variant"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; at equal order the new one, then the largest by its other columns."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"), *[F.desc(c) for c in _comparable(old, [*keys, order])])
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, on ties the largest by its other columns: one aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(order, *_comparable(df, [*keys, order]))).alias("r")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """Adds to ``left`` the ``values`` of the last row of ``right`` at or before its time, per key; NULL where there is none.

    Both sides go through one window over their union: one shuffle, no join on
    inequalities. Of several right rows at one time the largest by ``values``
    counts.
    """
    carried = F.struct(*values)
    both = left.withColumns({"__v": F.lit(None).cast(right.select(carried.alias("v")).schema["v"].dataType), "__left": F.lit(1)}).unionByName(
        right.select(*keys, t, carried.alias("__v")).withColumn("__left", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(t, "__left", "__v").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("__v", F.last("__v", True).over(w)).where("__left = 1")
    return held.select(*left.columns, *[F.col(f"__v.{c}").alias(c) for c in values])


def timeseries(records: DataFrame, cell, variable: str, start, end) -> DataFrame:
    """(date, value) of one cell between two dates, both included; a variable is sought in stress, then advisory, then crop."""
    layers = [F.try_element_at(F.col(c), F.lit(variable)) for c in ("stress", "advisory", "crop")]
    found = records.where((F.col("cell") == cell) & F.col("date").between(start, end)).select("date", F.coalesce(*layers).try_cast("double").alias("value"))
    return found.where("value is not null").orderBy("date")


def align(layers: dict[str, DataFrame], static: dict[str, DataFrame] | None = None) -> DataFrame:
    """Layers (time, y, x, value) side by side, static ones (y, x, value) on every date; qa 1 and sigma 0.02 where absent."""
    out = None
    for name, df in layers.items():
        one = df.select("time", "y", "x", F.col("value").alias(name))
        out = one if out is None else out.join(one, ["time", "y", "x"], "full")
    for name, df in (static or {}).items():
        out = out.join(df.select("y", "x", F.col("value").alias(name)), ["y", "x"], "left")
    qa = F.coalesce("qa", F.lit(1)) if "qa" in out.columns else F.lit(1)
    sigma = F.coalesce("sigma", F.lit(0.02)) if "sigma" in out.columns else F.lit(0.02)
    return out.withColumns({"qa": qa.cast("smallint"), "sigma": sigma.cast("float")})


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Inner join with the first right row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    one = right.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return left.join(one, key)
