"""A store of time-long chunks: arrays of a block of cells over many days, delta-coded, and an index of them.

A chunk holds, for each variable, a matrix of cells by days. Along a cell's days
each value is XORed with the one before it (as bits, so nothing is lost), and the
bytes are put together by significance before they are compressed: a slow
series leaves zeros. Chunks of one task lie in one file one after the other, and
the index keeps their places, keys and days. A keyed read opens the bytes of the
chunks of that key and no others; a scan reads a range of chunks per task.

Spark groups the rows into chunks and hands them to the writer's tasks. What they
write is a version of its own that holds once all have ended, and is removed if one fails.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import versions
from .files import opened
from .pushed import Pushed

#: Days of a chunk, and bytes of chunks that one task of a scan reads.
DAYS, SPLIT = 512, 32 << 20
EPOCH = np.datetime64("1970-01-01", "D")


def coded(values: np.ndarray, there: np.ndarray) -> bytes:
    """A matrix of doubles (cells by days) and where it has values, compressed without loss."""
    held = np.where(there, values, 0.0)
    # a gap repeats the value before it, and so costs nothing
    last = np.maximum.accumulate(np.where(there, np.arange(there.shape[1]), 0), axis=1)
    bits = np.take_along_axis(held, last, 1).view(np.uint64)
    bits[:, 1:] ^= bits[:, :-1].copy()
    planes = np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes() + np.packbits(there).tobytes(), "zstd", asbytes=True)


def decoded(raw: bytes, cells: int, days: int) -> tuple[np.ndarray, np.ndarray]:
    n = cells * days
    flat = np.frombuffer(pa.decompress(raw, 8 * n + -(-n // 8), "zstd"), np.uint8)
    bits = np.ascontiguousarray(flat[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(cells, days)
    return np.bitwise_xor.accumulate(bits, axis=1).view(np.float64), np.unpackbits(flat[8 * n :], count=n).reshape(cells, days).astype(bool)


def packed(rows: pa.Table, key: str, date: str, variables: list[str]) -> bytes:
    """A chunk of rows, no two of which share key and date: its keys, days, and the matrix of each variable."""
    keys = pc.unique(rows.column(key)).sort()
    days = np.unique(rows.column(date).to_numpy().astype("datetime64[D]"))
    i = pc.index_in(rows.column(key), value_set=keys).to_numpy()
    j = np.searchsorted(days, rows.column(date).to_numpy().astype("datetime64[D]"))
    if len(np.unique(i.astype(np.int64) * len(days) + j)) < rows.num_rows:
        raise ValueError(f"a chunk has more than one row of a {key} and {date}")
    parts = []
    for v in (None, *variables):  # first, which rows there are
        values, there = np.zeros((len(keys), len(days))), np.zeros((len(keys), len(days)), bool)
        if v is None:
            there[i, j] = True
        else:
            column = rows.column(v).cast(pa.float64()).combine_chunks()
            there[i, j] = pc.is_valid(column).to_numpy(zero_copy_only=False)
            values[i, j] = pc.fill_null(column, 0.0).to_numpy()
        parts.append(coded(values, there))
    sink = io.BytesIO()
    head = pa.BufferOutputStream()
    with pa.ipc.new_stream(head, pa.schema([("key", keys.type)])) as w:
        w.write_table(pa.table({"key": keys}))
    names = head.getvalue().to_pybytes()
    steps = (days - EPOCH).astype("<i4").tobytes()
    sink.write(json.dumps({"keys": len(names), "days": len(days), "parts": [len(p) for p in parts]}).encode() + b"\n")
    for part in (names, steps, *parts):
        sink.write(part)
    return sink.getvalue()


def unpacked(raw: bytes, key: str, date: str, variables: list[str], wanted: list[str]) -> pa.Table:
    """The rows of a chunk, with the ``wanted`` of its ``variables``; the others aren't decoded."""
    head, _, rest = raw.partition(b"\n")
    said = json.loads(head)
    keys = pa.ipc.open_stream(rest[: said["keys"]]).read_all().column("key").combine_chunks()
    at = said["keys"]
    days = np.frombuffer(rest[at : at + 4 * said["days"]], "<i4")
    at += 4 * said["days"]
    ends = at + np.cumsum([0, *said["parts"]])
    part = lambda k: decoded(rest[ends[k] : ends[k + 1]], len(keys), len(days))
    i, j = np.nonzero(part(0)[1])
    columns = {key: keys.take(pa.array(i)), date: pa.array(days[j], pa.int32()).cast(pa.date32())}
    for k, v in enumerate(variables, 1):
        if v in wanted:
            values, there = part(k)
            columns[v] = pa.array(values[i, j], mask=~there[i, j])
    return pa.table(columns)


def write_chunks(df: DataFrame, path: str, key: str, block: Column, date: str, variables: list[str], days: int = DAYS) -> None:
    """Write rows (key, date, variables) as chunks of a block of keys and of ``days`` days.

    Variables are kept as doubles; missing values stay missing. A block has to hold
    so many keys that a chunk fits a task; rows without key or date are an error, as are
    two rows of a key and date.
    """
    kind = dict(df.dtypes)[key]
    bad = F.col("key").isNull() | F.col("date").isNull()
    rows = df.select(F.col(key).alias("key"), F.col(date).cast("date").alias("date"), block.cast("string").alias("block"), *[F.col(v).cast("double").alias(v) for v in variables])
    rows = rows.withColumn("period", F.when(bad, F.raise_error(F.lit(f"a row without {key} or {date}")).cast("int")).otherwise(F.floor(F.unix_date("date") / days).cast("int")))

    def pack(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ends = [pc.min_max(rows.column(c)) for c in ("key", "date")]
        return pa.table({"least_key": pa.array([ends[0]["min"].as_py()], rows.schema.field("key").type), "most_key": pa.array([ends[0]["max"].as_py()], rows.schema.field("key").type), "least_date": pa.array([ends[1]["min"].as_py()], pa.date32()), "most_date": pa.array([ends[1]["max"].as_py()], pa.date32()), "chunk": pa.array([packed(rows, "key", "date", variables)], pa.binary())})

    ddl = f"least_key {kind}, most_key {kind}, least_date date, most_date date, chunk binary"
    df.sparkSession.dataSource.register(Chunks)
    said = json.dumps({"key": key, "kind": kind, "date": date, "variables": variables})
    rows.groupBy("block", "period").applyInArrow(pack, ddl).write.format("chunks").option("path", path).option("about", said).mode("overwrite").save()


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, about: str):
        self.path, self.about, self.version = path.rstrip("/"), about, versions.fresh()

    def write(self, batches) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        system, at = opened(f"{self.path}/{self.version}")
        system.create_dir(f"{at}/index", recursive=True)
        index, offset = [], 0
        with system.open_output_stream(f"{at}/{name}.chunks") as f:
            for b in batches:
                chunks = b.column("chunk").to_pylist()
                sizes = [len(c) for c in chunks]
                for c in chunks:
                    f.write(c)
                starts = offset + np.cumsum([0, *sizes])[:-1]
                offset += sum(sizes)
                index.append(pa.Table.from_batches([b]).drop_columns(["chunk"]).append_column("file", pa.array([f"{name}.chunks"] * len(sizes), pa.string())).append_column("start", pa.array(starts, pa.int64())).append_column("size", pa.array(sizes, pa.int64())))
        if index:
            with system.open_output_stream(f"{at}/index/{name}.parquet") as f:
                pq.write_table(pa.concat_tables(index), f)
        return Written(sum(t.num_rows for t in index))

    def commit(self, messages: list) -> None:
        before = versions.current(self.path)
        system, at = opened(f"{self.path}/{self.version}")
        system.create_dir(f"{at}/index", recursive=True)
        with system.open_output_stream(f"{at}/about.json") as f:
            f.write(self.about.encode())
        versions.publish(self.path, self.version)
        if before:
            versions.discard(self.path, before)

    def abort(self, messages: list) -> None:
        versions.discard(self.path, self.version)


@dataclass
class Ranges(InputPartition):
    places: tuple[tuple[str, int, int], ...]


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, version: str, about: dict, names: list[str], split: int):
        self.path, self.about, self.names, self.split = f"{path}/{version}", about, names, split
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]):
        own = {self.about["key"]: "key", self.about["date"]: "date"}
        self.pushed.take(filters)
        self.pushed.known = [(k, own[c], v) for k, c, v in self.pushed.known if c in own]
        return filters

    def partitions(self) -> list[Ranges]:
        system, at = opened(f"{self.path}/index")
        index = ds.dataset(at, filesystem=system, format="parquet")
        places = index.to_table(columns=["file", "start", "size"], filter=self.pushed.on_extents(("key", "date"))).sort_by([("file", "ascending"), ("start", "ascending")]) if index.files else None
        out: list[list[tuple[str, int, int]]] = []
        room = 0
        for place in zip(*(places.column(c).to_pylist() for c in ("file", "start", "size"))) if places else []:
            if not out or place[2] > room:
                out.append([])
                room = self.split
            out[-1].append(place)
            room -= place[2]
        return [Ranges(tuple(p)) for p in out] or [Ranges(())]

    def read(self, partition: Ranges):
        key, date = self.about["key"], self.about["date"]
        for file, start, size in partition.places:
            system, at = opened(f"{self.path}/{file}")
            with system.open_input_file(at) as f:
                f.seek(start)
                rows = unpacked(f.read(size), "key", "date", self.about["variables"], self.names)
            where = self.pushed.on_rows(("key", "date"))
            rows = rows.filter(where) if where is not None else rows
            yield from rows.rename_columns([{"key": key, "date": date}.get(n, n) for n in rows.column_names]).select(self.names).to_batches()


class Chunks(DataSource):
    """Options: ``path``; ``bands``, the columns to read (all by default); ``split``, bytes a partition."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def _about(self) -> tuple[str, dict]:
        path = self.options["path"].rstrip("/")
        version = versions.current(path)
        if version is None:
            raise ValueError(f"no store of chunks at {path}")
        system, at = opened(f"{path}/{version}/about.json")
        with system.open_input_stream(at) as f:
            return version, json.loads(f.read())

    def schema(self) -> str:
        about = self._about()[1]
        whole = {about["key"]: about["kind"], about["date"]: "date"} | dict.fromkeys(about["variables"], "double")
        bands = [b.strip() for b in self.options.get("bands", "").split(",") if b.strip()] or list(whole)
        return ", ".join(f"`{b}` {whole[b]}" for b in bands)

    def reader(self, schema: StructType) -> ChunkReader:
        version, about = self._about()
        return ChunkReader(self.options["path"].rstrip("/"), version, about, schema.names, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"], self.options["about"])


def read_chunks(spark: SparkSession, path: str, bands: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """(key, date, variables) of the store at ``path``; predicates on key and date decide which chunks are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Chunks)
    reader = spark.read.format("chunks").option("path", path).option("split", split)
    return (reader.option("bands", ",".join(bands)) if bands else reader).load()
