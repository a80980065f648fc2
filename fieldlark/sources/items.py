"""Scenes as a data source: ``spark.read.format("items")`` opens only scenes whose extent a query can meet.

A collection of scenes is a folder of Parquet files, one or more a scene, and an
index of them with the least and largest date, place and collection of each. The
predicates of a query reach the source while Spark plans; it reads
the index with them, and makes partitions of the scenes that are left. What it
reads, Spark filters again, so that a row is given out by its own values.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from .files import opened, read_text
from .pushed import Pushed

#: Bytes of Parquet that one partition reads; a single file may be larger.
SPLIT = 64 << 20


def write_items(df: DataFrame, path: str, scene: list[Column], extents: list[str], within=()) -> None:
    """Write rows as scenes under ``path``, with the index that the source reads.

    ``scene`` says which rows belong together (collection, day, tile), ``extents``
    which columns' least and largest values the index keeps for each file. Spark
    writes the files, tasks taking ranges of scenes, and makes the index from them.
    """
    name = F.sha2(F.concat_ws("/", *[F.coalesce(s.cast("string"), F.lit("")) for s in scene]), 256)
    held = df.withColumn("__scene", F.substring(name, 1, 16))
    held.repartitionByRange(*scene, *within).sortWithinPartitions("__scene", *within).write.partitionBy("__scene").mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    kinds = dict(df.dtypes)
    far = lambda c: F.when(F.isnan(c), float("inf")).otherwise(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)  # noqa: E731  as Spark orders it
    ends = [f(far(c)).alias(f"{n}_{c}") for c in extents for n, f in (("least", F.min), ("most", F.max))]
    index = rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("n"), *ends)
    root = F.lit(f"{path.rstrip('/')}/rows/")
    inner = F.substring_index("file", "/rows/", -1)
    index.withColumn("file", F.concat(root, inner)).write.mode("overwrite").parquet(f"{path}/index")
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


@dataclass
class Scenes(InputPartition):
    files: tuple[str, ...]


class ItemsReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split: int):
        self.schema, self.path, self.split = schema, path, split
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]):
        self.pushed.take(filters)
        return filters  # Spark decides on each row

    def index(self) -> pa.Table:
        """The files that the predicates leave, in order."""
        fs, at = opened(f"{self.path}/index")
        index = ds.dataset(at, filesystem=fs, format="parquet")
        known = [n.removeprefix("least_") for n in index.schema.names if n.startswith("least_")]
        return index.to_table(columns=["file", "bytes", "n"], filter=self.pushed.on_extents(known)).sort_by("file")

    def partitions(self) -> list[Scenes]:
        out: list[list[str]] = []
        room = 0
        for file, size in zip(*(self.index().column(c).to_pylist() for c in ("file", "bytes"))):
            if not out or size > room:
                out.append([])
                room = self.split
            out[-1].append(file)
            room -= size
        return [Scenes(tuple(f)) for f in out] or [Scenes(())]

    def read(self, partition: Scenes):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for file in partition.files:
            fs, at = opened(file)
            data = ds.dataset(at, filesystem=fs, format="parquet")
            # not on doubles: NaN is the largest to Spark and no number to Arrow
            exact = [f.name for f in data.schema if not pa.types.is_floating(f.type)]
            for b in data.to_batches(columns=schema.names, filter=self.pushed.on_rows(exact)):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, schema.types)], schema=schema)


class Items(DataSource):
    """Options: ``path``; ``bands``, the columns to read (all by default); ``split``, bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "items"

    def schema(self) -> StructType:
        import json

        whole = StructType.fromJson(json.loads(read_text(f"{self.options['path'].rstrip('/')}/schema")))
        bands = [b.strip() for b in self.options.get("bands", "").split(",") if b.strip()]
        return StructType([whole[b] for b in bands]) if bands else whole

    def reader(self, schema: StructType) -> ItemsReader:
        return ItemsReader(schema, self.options["path"].rstrip("/"), int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> SparkSession:
    """Let the session read ``items``, predicates included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Items)
    return spark


def read_items(spark: SparkSession, path: str, bands: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    reader = register(spark).read.format("items").option("path", path).option("split", split)
    return (reader.option("bands", ",".join(bands)) if bands else reader).load()
