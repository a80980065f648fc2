"""A table of the latest record of each key, kept by a stream: sorted runs, merged on reading.

A batch writes its own records, one of each key, as a run sorted by key, and
nothing else. Reading takes the latest of each key over all runs; a lookup by key
reaches every run's scan, where sorted row groups are skipped. As soon as ``FAN`` runs of a
level are there they are merged into one of the next, so that a record is
written again once for each level, of which there are as many as the logarithm
of the number of batches. A list that is written after the runs says which of
them hold: a batch that fails leaves none, and one that is run again finds its
entry and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import latest
from ..operators.serving import version

#: Runs of a level that are merged into one of the next.
FAN = 4
LIST = "run string, level int, bytes long, batch long"


def _listed(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, list]:
    """The last list (of batches before ``before``): its batch, and the runs that hold. As many rows as runs: some for each level."""
    known = spark.read.schema(f"{LIST}, v long").option("basePath", f"{path}/lists").parquet(f"{path}/lists")
    held = known if before is None else known.where(F.col("v") < before)
    last = held.agg(F.max("v")).first()[0]
    return last, [r for r in held.where(F.col("v") == F.lit(last)).collect() if r["run"] is not None]


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _list(spark: SparkSession, path: str, number: int, runs: list[tuple]) -> None:
    rows = runs or [(None, None, None, None)]
    spark.createDataFrame(rows, LIST).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/v={number}")


def _run(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], name: str, level: int, batch: int) -> tuple:
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/runs/{name}")
    return name, level, version(spark, f"{path}/runs/{name}")[0][2], batch


def _read(spark: SparkSession, path: str, runs, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/runs/{r[0]}" for r in runs])


def upsert_into(spark: SparkSession, path: str, keys: list[str], order: str, fan: int = FAN):
    """A foreachBatch sink that keeps the record of the largest ``order`` of each key under ``path`` (ties as in ``latest``)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not _has(spark, f"{path}/lists/v=-1/_SUCCESS"):
            _list(spark, path, -1, [])
        if _has(spark, f"{path}/lists/v={number}/_SUCCESS"):
            return  # the batch is a part of the table
        runs = [tuple(r)[:4] for r in _listed(spark, path, number)[1]]
        held = latest(batch, keys, order)
        if not batch.isEmpty():
            runs.append(_run(spark, path, held, keys, f"{number}-0", 0, number))
        level = 0
        while sum(r[1] == level for r in runs) >= fan:
            old = [r for r in runs if r[1] == level]
            merged = latest(_read(spark, path, old, batch.schema), keys, order)
            runs = [r for r in runs if r[1] != level] + [_run(spark, path, merged, keys, f"{number}-{level + 1}", level + 1, number)]
            level += 1
        _list(spark, path, number, runs)

    return write


def upserted(spark: SparkSession, path: str, schema, keys: list[str], order: str) -> DataFrame:
    """The table that ``upsert_into`` keeps, as of its last batch; empty where no batch came.

    A predicate on keys goes below the merge, to the scan of each run.
    """
    runs = _listed(spark, path)[1] if _has(spark, f"{path}/lists/v=-1/_SUCCESS") else []
    return latest(_read(spark, path, runs, schema), keys, order) if runs else spark.createDataFrame([], schema)


def tidy(spark: SparkSession, path: str, lists: int = 2) -> int:
    """Removes runs that none of the last ``lists`` lists holds, and older lists; gives the number of runs removed.

    To be called when no reader uses an older list any more.
    """
    numbers = sorted(r[0] for r in spark.read.schema(f"{LIST}, v long").option("basePath", f"{path}/lists").parquet(f"{path}/lists").select("v").distinct().collect())
    kept = {r["run"] for n in numbers[-lists:] for r in _listed(spark, path, n + 1)[1]}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in kept] if fs.exists(root) else []
    for at in gone:
        fs.delete(at, True)
    for n in numbers[:-lists]:
        if n >= 0:  # the first list tells that the table is there
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/v={n}"), True)
    return len(gone)
