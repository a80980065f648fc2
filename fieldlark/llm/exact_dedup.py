"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, merged in a tree, name the few digests that may be
frequent. Their exact counts are taken in one pass that combines on the map
side; those that are frequent indeed are broadcast (at most ``counters`` rows,
by construction of the summary) and settled where they lie. All other digests
are rare, so an ordinary shuffle by digest meets no hot key.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SUMMARY = "digest binary, n long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased, in UTF-8; with the number of a numbered row if asked."""
    rows = common.text_rows(docs, id_col, text_col, "string", *([common.ROW] if row else []))
    digest = F.unhex(F.sha2(common.lower_ascii(F.col("text")).cast("binary"), 256)).alias("digest")
    return rows.select("doc_id", digest, *([F.col(common.ROW).alias("row")] if row else []))


def _reduce(counts: Counter, k: int) -> Counter:
    """At most k counters: the (k+1)th largest count is taken off all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: c - cut for d, c in counts.items() if c > cut})


def misra_gries(rows: DataFrame, k: int, fan_in: int = 32) -> DataFrame:
    """(digest, n): at most k candidates; every digest with over 1/(k+1) of all rows is one.

    Summaries merge without losing that guarantee, so they do in a tree: no task
    reads more than ``fan_in * k`` rows.
    """

    def run(batches):
        mine: Counter = Counter()
        for b in batches:
            if b.num_columns == 1:
                mine.update(b.column(0).to_pylist())
            else:
                for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    mine[d] += n
            mine = _reduce(mine, k)
        items = list(mine.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in items], pa.binary()), pa.array([n for _, n in items], pa.int64())],
            schema=common.batches_of(SUMMARY),
        )

    out = rows.select("digest").mapInArrow(run, SUMMARY)
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInArrow(run, SUMMARY)
    return out


def _settled(rows: DataFrame, order: Column, counters: int) -> DataFrame:
    """Adds to rows (column digest) the largest ``order`` of those of the digest, ``best``, and their number, ``group_size``."""
    n = rows.count()
    named = misra_gries(rows, counters).select("digest")
    frequent = (
        rows.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") * counters >= n)
    )
    winners = F.broadcast(common.stored(frequent, "winners"))  # at most `counters` rows
    heavy = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    # counted on the map side first, so that a digest's rows meet only to be told, a partition at a time
    light = rest.join(rest.groupBy("digest").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size")), "digest")
    return heavy.unionByName(light)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is the
    empty one, which is a text like any other. The largest doc_id of a group
    stays; a null doc_id is smaller than all others (a group of nulls only keeps
    a null). Rows that repeat the kept doc_id with the same text are all marked
    kept: they are one document. Other columns are not read; an empty table gives
    an empty result.
    """
    rows = common.stored(digests(docs, id_col, text_col), "digests")
    return _settled(rows, F.col("doc_id"), counters).select(
        "doc_id",
        F.col("best").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """Of each group of equal texts one row of ``docs``, all columns: one with the doc_id that exact dedup keeps.

    It is settled by row, as ids may be null or repeat, with one text or several.
    """

    def kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        docs = common.numbered(docs)
        rows = common.stored(digests(docs, id_col, text_col, row=True), "digests")
        lost = _settled(rows, F.struct("doc_id", "row"), counters).where(F.col("row") != F.col("best.row"))
        return common.marked(docs, lost.select(F.col("row").alias(common.ROW)), keep=False).drop(common.ROW)

    return common.plainly(docs, kept, id_col=id_col, text_col=text_col)
