"""Near-dedup of documents at a five-word resemblance of 0.8: linked by proposals, decided on whole shingle sets.

Two kinds of prints propose. SimHashes of the word *set* meet at four or fewer
differing bits, by the same covering masks as ``simhash``; an edit changes five
shingles but one word, so they find scattered edits. They leave out what changes
many words in one place, so forty min-hash prints of the shingle set, of five
min-hashes each, propose too: they find pairs by their resemblance alone,
whatever the edit, and a pair at just 0.8 shares one but for a chance of
(1 - 0.8^5)^40 = 1.2e-7.

Every proposed pair is decided on the whole sets of shingle hashes. First each
row is held against the smallest row of each print; where a print's rows are not
one group after that, the groups are held against each other within tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SEED = 42
#: Min-hash prints of a text, and min-hashes of a print.
PRINTS, DEPTH = 40, 5
ROWS = "row long, doc_id long, size long, fp long, prints array<long>"
SETS = "row long, shingles array<long>"
PAIRS = "a long, b long"
#: Least resemblance, as a fraction.
LEAST = (4, 5)
#: Shingles that a task compares at a time; a print with more is dealt out by pairs of blocks.
BLOCK = 1 << 20
_rng = np.random.default_rng(11)
_XORS, _ODDS = (_rng.integers(0, 1 << 64, (PRINTS * DEPTH, 1), np.uint64) for _ in range(2))
_ODDS |= np.uint64(1)


def min_prints(h: np.ndarray) -> np.ndarray:
    """The min-hash prints of a set of 64-bit hashes."""
    low = np.full(PRINTS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        low = np.minimum(low, ((h[i : i + 1024] ^ _XORS) * _ODDS).min(1))
    out = np.arange(PRINTS, dtype=np.uint64)
    for column in low.reshape(PRINTS, DEPTH).T:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column
    return out.view(np.int64)


def _shingles(text: bytes, width: int) -> np.ndarray:
    return np.unique(np.array(simhash.shingle_hashes(text, width), np.uint64))


def described(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of numbered rows the prints and the number of shingles; rows without words or id are left out."""

    def run(batches):
        from xxhash import xxh64_intdigest

        schema = common.batches_of(ROWS)
        for b in common.sliced(batches):
            out = []
            for doc, text, row in zip(*(c.to_pylist() for c in b.columns)):
                words = set(text.lower().split())
                if doc is None or not words:
                    continue
                fp = simhash.majority(np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64))
                h = _shingles(text, width)
                out.append((row, doc, len(h), fp, min_prints(h)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return common.text_rows(docs, id_col, text_col, "binary", common.ROW).mapInArrow(run, ROWS)


def shingle_sets(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of numbered rows the whole set of shingle hashes."""

    def run(batches):
        schema = common.batches_of(SETS)
        for b in common.sliced(batches, 64):
            sets = [_shingles(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(sets, schema.types[1])], schema=schema)

    return common.text_rows(docs, id_col, text_col, "binary", common.ROW).mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have the least resemblance."""
    first, second = sets.select(F.col("row").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("row").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    near = both * LEAST[1] >= (F.size("s") + F.size("t") - both) * LEAST[0]
    return pairs.join(first, "a").join(second, "b").where(near).select("a", "b")


def joined(rows: np.ndarray, roots: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join, of the groups given by ``roots``, what any near pair of the rows joins; at most one per group.

    ``flat`` has the rows' shingles one after the other. Each row outside the
    largest group is held against all rows of other groups.
    """
    label, held = np.unique(roots, return_inverse=True)[1], []
    large = label == np.bincount(label).argmax()
    ids = np.unique(flat, return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    for i in np.flatnonzero(~large).tolist():
        others = label != label[i]
        if not others.any():
            break
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[mine] = 0
        near = np.flatnonzero(others & (both * LEAST[1] >= (sizes + sizes[i] - both) * LEAST[0]))
        for k, j in zip(*np.unique(label[near], return_index=True)):
            held.append((int(rows[i]), int(rows[near[j]])))
            label[label == k] = label[i]
    return held


def _regrouped(batches):
    """Over rows (key, i, j, row, root, shingles) sorted by the first three, the pairs of each print or pair of blocks."""
    schema = common.batches_of(PAIRS)
    at, kept = None, []

    def close():
        if len(kept) > 1:
            rows, roots, sets = zip(*kept)
            sizes = np.array([len(s) for s in sets])
            found = joined(np.array(rows), np.array(roots), np.concatenate(sets), sizes)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=schema)

    for batch in batches:
        for b in common.sliced([batch]):
            keys = zip(*(b.column(k).to_pylist() for k in range(3)))
            for key, row, root, s in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                if key != at:
                    yield from close()
                    at, kept = key, []
                kept.append((row, root, s.values.to_numpy()))
    yield from close()


def regrouped(members: DataFrame, roots: DataFrame, rows: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Near pairs (a, b) that join the groups which meet under a print; ``members`` has (key, row) of shared prints.

    Prints of the same rows are looked at once. A print of over ``block``
    shingles is dealt out: every two of its blocks of rows meet in a task.
    """
    named = members.join(roots, members.row == roots.node, "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    named = common.stored(named.join(rows.select("row", "size"), "row"), "members")
    met = named.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"),
        F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"),
    ).where("low < high")
    once = met.groupBy("n", "size", "x", "y").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("size") * 2 / block).cast("int")
    todo = named.drop("size").join(once.select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    # one part meets itself; of several, every two do, which has each with itself too
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    dealt = todo.withColumn("other", F.explode(other)).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "root")
    return dealt.join(sets, "row").select("key", "i", "j", "row", "root", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_regrouped, PAIRS)


def _by_words(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of rows that the SimHashes of the word sets propose."""
    reps = common.stored(rows.groupBy("fp").agg(F.min("row").alias("rep")), "reps")
    same = rows.select("row", "fp").join(reps, "fp").select(F.col("row").alias("a"), F.col("rep").alias("b"))
    left, right = reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), reps.select(F.col("fp").alias("b"), F.col("rep").alias("y"))
    near = simhash.links(reps.select("fp"), radius).distinct().join(left, "a").join(right, "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(row, root, doc_id) of every numbered row with a near copy, stored; root is the same for all rows of a group."""
    rows = common.stored(described(docs, id_col=id_col, text_col=text_col), "described", "zstd")
    prints = rows.select("row", F.explode("prints").alias("key"))
    # stored, so that adaptive execution can split a print that many rows share
    shared = common.stored(prints.groupBy("key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-prints")
    members = common.stored(prints.join(shared, "key"), "shared")
    pairs = members.select(F.col("row").alias("a"), F.col("rep").alias("b")).unionByName(_by_words(rows, radius))
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = common.stored(pairs.distinct(), "proposed")
    asked = pairs.select(F.explode(F.array("a", "b")).alias(common.ROW)).distinct()
    sets = common.stored(shingle_sets(common.marked(docs, asked, keep=True), id_col=id_col, text_col=text_col), "shingles")
    first = common.stored(confirmed(pairs, sets), "confirmed")
    more = regrouped(members.select("key", "row"), common.stored(components(first), "groups"), rows, sets, block)
    found = components(first.unionByName(more))
    every = found.select(F.col("node").alias("row"), "root").unionByName(found.select(F.col("root").alias("row"), "root").distinct())
    return common.stored(every.join(rows.select("row", "doc_id"), "row"), "grouped")


def groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root): every doc_id with a near copy, and the smallest doc_id of its group.

    Null, empty and wordless texts, and rows without an id, are in no group. An
    id that repeats with different texts can be in several. Other columns are not
    read; an empty table gives an empty result.
    """
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = _grouped(common.numbered(given), radius, "doc_id", "text")
    first = found.groupBy("root").agg(F.min("doc_id").alias("first"))
    return found.join(first, "root").where("doc_id <> first").select(F.col("doc_id").alias("node"), F.col("first").alias("root")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of near copies only one row of the smallest doc_id."""

    def kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        docs = common.numbered(docs)
        found = _grouped(docs, 4, id_col, text_col, block)
        first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
        lost = found.join(first, "row", "left_anti").select(F.col("row").alias(common.ROW))
        return common.marked(docs, lost, keep=False).drop(common.ROW)

    return common.plainly(docs, kept, id_col=id_col, text_col=text_col)
