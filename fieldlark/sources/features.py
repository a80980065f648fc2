"""Feature collections of any size: a GeoJSON file read by many tasks, each a range of bytes.

Where a range begins, only what comes before it tells whether that is within a string
and how deep in brackets. So a first pass has every range count its brackets for
both cases, and say in which case the next one begins; put together in order (a
row for each range), these give each range its beginning. In the second pass a task cuts out
the features that begin in its range, reading on beyond the end for the last one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened

SPLIT = 64 << 20
RANGES = "file string, start long, end long"
SEEN = f"{RANGES}, quotes int, outside long, inside long"
TEXTS = "feature string"
#: How deep a feature lies: in the collection, and in its list.
DEPTH = 2
_OPEN, _CLOSE, _QUOTE, _BACK = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8), ord('"'), ord("\\")


def _read(file: str, start: int, end: int) -> np.ndarray:
    system, at = opened(file)
    with system.open_input_file(at) as f:
        f.seek(start)
        return np.frombuffer(f.read(end - start), np.uint8)


def _escaped(file: str, start: int) -> bool:
    """Whether the byte at ``start`` stands behind an odd number of backslashes."""
    n, step = 0, 64
    while start - n > 0:
        before = _read(file, max(0, start - n - step), start - n)
        run = len(before) - (np.flatnonzero(before != _BACK)[-1] + 1 if (before != _BACK).any() else 0)
        n += run
        if run < len(before):
            break
    return n % 2 == 1


def marks(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotation marks begin or end a string."""
    back = data == _BACK
    at = np.arange(len(data))
    # the length of the run of backslashes that ends before each byte
    last = np.maximum.accumulate(np.where(~back, at, -1))
    before = np.concatenate([[-1], last[:-1]])
    run = at - 1 - before
    if escaped:
        run[before < 0] += 1
    return (data == _QUOTE) & (run % 2 == 0)


def _steps(data: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    return np.where(quoted, 0, np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8))


def _scanned(batches):
    """Of each range: its marks, modulo 2, and the depth it adds if it begins outside of a string, or inside."""
    for b in batches:
        out = []
        for file, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
            data = _read(file, start, end)
            m = marks(data, _escaped(file, start))
            inner = np.cumsum(m) % 2 == 1  # begins outside; a closing mark counts as outside, no bracket stands there
            out.append((file, start, end, int(m.sum() % 2), int(_steps(data, inner).sum()), int(_steps(data, ~inner).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["file", "start", "end", "quotes", "outside", "inside"])


def _cut(batches, more: int = 1 << 20):
    """The features that begin in each range (file, start, end, inside a string, depth)."""
    for b in batches:
        for file, start, end, inside, depth in zip(*(b.column(i).to_pylist() for i in range(5))):
            system, at = opened(file)
            size = system.get_file_info(at).size
            data, escaped, stop = _read(file, start, end), _escaped(file, start), end
            while True:
                inner = (np.cumsum(marks(data, escaped)) + inside) % 2 == 1
                steps = _steps(data, inner)
                deep = depth + np.cumsum(steps)
                begins = np.flatnonzero((steps > 0) & (deep == DEPTH + 1))
                ends = np.flatnonzero((steps < 0) & (deep == DEPTH))
                begins = begins[begins < end - start]
                ends = ends[ends > begins[0]] if len(begins) else ends[:0]
                if len(ends) >= len(begins) or stop >= size:
                    break
                data, stop, more = np.concatenate([data, _read(file, stop, min(size, stop + more))]), min(size, stop + more), 2 * more
            raw = data.tobytes()
            texts = [raw[i : j + 1].decode("utf-8") for i, j in zip(begins.tolist(), ends.tolist())]
            for k in range(0, len(texts), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(texts[k : k + 4096], pa.string())], names=["feature"])


def read_features(spark: SparkSession, path: str, schema: str, split: int = SPLIT) -> DataFrame:
    """The features of all collections under ``path`` as columns of ``schema`` (as "id long, properties struct<..>").

    Objects of the collection count if they are of type Feature, or tell no type and have
    properties, whatever the order of their members; a member that ``schema`` doesn't name isn't read.
    """
    system, at = opened(path)
    info = system.get_file_info(at)
    files = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
    scheme = path[: path.index("://") + 3] if "://" in path else "file://" if path.startswith("file:") else ""
    ranges = [(scheme + f.path, s, min(s + split, f.size)) for f in files for s in range(0, f.size, split)]  # a row for each split
    given = spark.createDataFrame(ranges, RANGES)
    seen = given.repartition(max(1, len(ranges))).mapInArrow(_scanned, SEEN).collect()
    begin, depth, inside, file = [], 0, False, None
    for r in sorted(seen, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, depth, inside = r["file"], 0, False
        begin.append((r["file"], r["start"], r["end"], int(inside), depth))
        depth, inside = depth + (r["inside"] if inside else r["outside"]), inside != (r["quotes"] == 1)
    at = spark.createDataFrame(begin, f"{RANGES}, inside int, depth long").repartition(max(1, len(begin)))
    parsed = at.mapInArrow(_cut, TEXTS).select("feature", F.from_json("feature", f"type string, {schema}").alias("f"))
    untold = F.col("f.type").isNull() & F.get_json_object("feature", "$.properties").isNotNull()
    return parsed.where((F.col("f.type") == "Feature") | untold).select(*[f"f.{c}" for c in spark.createDataFrame([], schema).columns])


def write_collection(df: DataFrame, path: str, feature: str = "feature") -> None:
    """A file for each task: a collection of the JSON objects in the column ``feature``."""
    one = df.select(F.spark_partition_id().alias("p"), feature).groupBy("p").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list(feature), ",\n"), F.lit("]}")).alias("value"))
    one.select("value").write.mode("overwrite").text(path)
