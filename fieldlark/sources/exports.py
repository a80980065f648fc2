"""Exports with a manifest: each window's rows in files of its own, and a list of the files with their extents.

The writer's tasks write into a version that nobody reads yet. Once all have ended
the version is named as the one that holds; if one fails, it is removed, and the
former export stays as it was.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import versions
from .files import opened

#: Fixed value: windows that an export writes at most unless told otherwise, the first ones.
MOST = 64


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, window: str, extents: list[str], schema: str):
        self.path, self.window, self.extents, self.schema, self.version = path.rstrip("/"), window, extents, schema, versions.fresh()

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        system, at = opened(f"{self.path}/{self.version}")
        system.create_dir(f"{at}/manifest", recursive=True)
        said: list[dict] = []
        held = None  # the writer of the window at hand; rows come sorted by window
        for b in batches:
            days = b.column(self.window)
            for day in pc.unique(days):
                part = b.filter(pc.equal(days, day))
                if held is None or said[-1]["window"] != day.as_py():
                    if held is not None:
                        held.close()
                    folder = f"rows/{day.as_py()}"
                    system.create_dir(f"{at}/{folder}", recursive=True)
                    said.append({"window": day.as_py(), "file": f"{folder}/{name}.parquet", "n": 0} | {f"{end}_{c}": None for c in self.extents for end in ("least", "most")})
                    held = pq.ParquetWriter(f"{at}/{said[-1]['file']}", b.schema, filesystem=system)
                held.write_batch(part)
                said[-1]["n"] += part.num_rows
                for c in self.extents:
                    ends = pc.min_max(part.column(c))
                    for end, pick, better in (("least", "min", min), ("most", "max", max)):
                        both = [x for x in (said[-1][f"{end}_{c}"], ends[pick].as_py()) if x is not None]
                        said[-1][f"{end}_{c}"] = better(both) if both else None
        if held is not None:
            held.close()
            kinds = {c: b.schema.field(c).type for c in (self.window, *self.extents)}
            schema = pa.schema([("window", kinds[self.window]), ("file", pa.string()), ("n", pa.int64()), *[(f"{end}_{c}", kinds[c]) for c in self.extents for end in ("least", "most")]])
            with system.open_output_stream(f"{at}/manifest/{name}.parquet") as f:
                pq.write_table(pa.Table.from_pylist(said, schema), f)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        before = versions.current(self.path)
        system, at = opened(f"{self.path}/{self.version}")
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/about.json") as f:
            f.write(json.dumps({"window": self.window, "extents": self.extents, "schema": self.schema}).encode())
        versions.publish(self.path, self.version)
        if before:
            versions.discard(self.path, before)

    def abort(self, messages: list) -> None:
        versions.discard(self.path, self.version)


class Export(DataSource):
    """Options: ``path``, ``window`` and ``extents``, columns parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        extents = [c for c in self.options.get("extents", "").split(",") if c]
        return ExportWriter(self.options["path"], self.options["window"], extents, schema.json())


def write_export(df: DataFrame, path: str, window: str, extents: list[str] = (), within=(), most: int | None = MOST) -> None:
    """Write the first ``most`` windows of ``df`` (all, if None). Rows without a window are left out, as they are in none.

    Tasks take ranges of window and ``within``, so that a large window is written by several.
    """
    df = df.where(F.col(window).isNotNull())
    if most is not None:
        first = df.select(window).distinct().orderBy(window).limit(most)  # at most `most` rows
        df = df.join(F.broadcast(first), window, "left_semi")
    df.sparkSession.dataSource.register(Export)
    rows = df.repartitionByRange(window, *within).sortWithinPartitions(window, *within)
    rows.write.format("export").option("path", path).option("window", window).option("extents", ",".join(extents)).mode("overwrite").save()


def _about(path: str) -> tuple[str, dict]:
    version = versions.current(path)
    if version is None:
        raise ValueError(f"no export at {path}")
    system, at = opened(f"{path.rstrip('/')}/{version}/about.json")
    with system.open_input_stream(at) as f:
        return f"{path.rstrip('/')}/{version}", json.loads(f.read())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(window, file, n, least and most of each extent) of the export that holds."""
    at, about = _about(path)
    whole = StructType.fromJson(json.loads(about["schema"]))
    kind = lambda c: whole[c].dataType.simpleString()
    ddl = [f"window {kind(about['window'])}", "file string", "n long", *[f"{end}_{c} {kind(c)}" for c in about["extents"] for end in ("least", "most")]]
    system, folder = opened(f"{at}/manifest")
    if not system.get_file_info(folder).type == fs.FileType.Directory:  # no rows, no list
        return spark.createDataFrame([], ", ".join(ddl))
    return spark.read.schema(", ".join(ddl)).parquet(f"{at}/manifest")


def read_export(spark: SparkSession, path: str, windows: list | None = None) -> DataFrame:
    """The rows of the export, or of some windows, whose folders alone are listed."""
    at, about = _about(path)
    whole = StructType.fromJson(json.loads(about["schema"]))
    listed = manifest(spark, path).select(F.col("window").cast("string").alias("w")).distinct()
    names = [r["w"] for r in listed.orderBy("w").collect()]  # as many as windows
    wanted = [n for n in names if windows is None or n in {str(w) for w in windows}]
    return spark.read.schema(whole).parquet(*[f"{at}/rows/{n}" for n in wanted]) if wanted else spark.createDataFrame([], whole)
