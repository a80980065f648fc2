"""Shared helpers: tables of the data set, the folder all executors share, plain joins on ids."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session, as in tests, gets one of its own where none is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        d = f"file://{tempfile.mkdtemp(prefix='fieldlark-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under the application's own id."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so that later steps neither repeat the work nor depend on
    the executors that did it.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The number of a row in a table that ``numbered`` wrote.
ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """All rows and columns with a row number, stored so that the number stays the same."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


#: Words of marks that are broadcast at most: 8 MB of 64 rows each.
WORDS = 1 << 19


def marked(df: DataFrame, rows: DataFrame, keep: bool, words: int = WORDS) -> DataFrame:
    """The rows of a numbered table whose number is in ``rows`` (column ROW), or those whose isn't.

    A join by number would move all texts for the sake of a few marks. Numbers run within each part of the
    table, so the marks go to the texts instead, 64 to a word; where there are more than ``words``, it is the join.
    """
    row, bit = F.col(ROW), F.expr(f"shiftleft(1L, cast({ROW} & 63 as int))")
    marks = stored(rows.groupBy(F.shiftright(row, 6).alias("__word")).agg(F.bit_or(bit).alias("__marks")), "marks")
    if marks.count() > words:
        return df.join(rows.select(ROW), ROW, "left_semi" if keep else "left_anti").select(*df.columns)
    hit = F.coalesce(F.col("__marks").bitwiseAND(bit) != 0, F.lit(False))
    met = df.join(F.broadcast(marks), F.shiftright(row, 6) == F.col("__word"), "left")
    return met.where(hit if keep else ~hit).drop("__word", "__marks")


def text_rows(df: DataFrame, id_col: str, text_col: str, text_type: str = "string", *more: str) -> DataFrame:
    """Just (id, text), and columns named in ``more``: the id as a long, a null text as the empty one."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).cast(text_type).alias("text"),
        *more,
    )


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` does that by itself on an all-ASCII text, which is far quicker than
    ``translate``.
    """
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def plainly(docs: DataFrame, step, **columns: str) -> DataFrame:
    """``step(docs, **columns)`` with the columns named by place, and their own names after it.

    So no name of the input clashes with one that the step needs for itself.
    """
    names = docs.columns
    at = {k: f"in{names.index(c)}" for k, c in columns.items()}
    return step(docs.toDF(*[f"in{i}" for i in range(len(names))]), **at).toDF(*names)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda a column's expression would be anew for each element."""
    return F.transform(F.array(value), body)[0]


#: Elements that one step of ``prefix`` folds; a fold that builds an array costs the square of its length.
FOLD = 256


def prefix(values: Column, zero: Column, step) -> Column:
    """Of each place in an array of longs, ``step`` folded over all values before it; the last entry is that of the whole array.

    ``step`` has to be associative, with ``zero`` as its neutral value. Blocks of
    ``FOLD`` values are folded each by itself, then what goes before each block.
    """

    def fold(items):
        begin = F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(items, begin, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda i: fold(F.slice(v, i * FOLD + 1, FOLD)))

    def whole(b):
        moved = lambda before: F.concat(F.flatten(F.zip_with(b, before["out"], lambda x, z: F.transform(x["out"], lambda y: step(z, y)))), F.array(before["at"]))
        return let(fold(F.transform(b, lambda x: x["at"])), moved)

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), whole)).otherwise(F.array(zero)))


def running(lengths: Column) -> Column:
    """Where consecutive pieces of these lengths begin, and where the last one ends."""
    return prefix(F.transform(lengths, lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)


#: Pieces that are cut out of a text by place; a text with more is taken apart once instead.
FEW = 64


def cut(text: Column, pieces: Column) -> Column:
    """The parts of a text at (at, len), in code points from 0, as an array of strings."""

    def both(x):
        few = F.transform(x["p"], lambda p: F.substr(x["t"], (p["at"] + 1).cast("int"), p["len"].cast("int")))
        many = lambda c: F.transform(x["p"], lambda p: F.array_join(F.slice(c, (p["at"] + 1).cast("int"), p["len"].cast("int")), ""))
        return F.when(F.size(x["p"]) <= FEW, few).otherwise(let(F.regexp_extract_all(x["t"], F.lit("(?s)."), F.lit(0)), many))

    return let(F.struct(text.alias("t"), pieces.alias("p")), both)


def batches_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; made on executors too, where there is no session to parse it."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = (f.split() for f in ddl.split(","))
    return pa.schema([pa.field(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k]) for n, k in fields])


def sliced(batches, rows: int = 256):
    """Arrow batches in slices, so that only so many rows' texts are Python objects at once; memory goes back at the end."""
    try:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and share a machine with the JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
