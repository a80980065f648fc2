"""Best-fit packing of token sequences: best two-fit over the histogram of lengths.

A piece is at most ``capacity`` tokens long, so the packing problem is a table of
at most ``capacity`` counts, however many pieces there are. It is solved on the
driver: each bin is filled greedily with the longest pieces that fit, then its
smallest piece is replaced by the two unpacked ones that fill the widened gap
best, and the bin's pattern is repeated as often as the counts allow. Pieces get
their places back by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .word_ids import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces of one length that a task ranks at once; such groups are split by a hash.
GROUP = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document's ids and end id: only those over ``capacity`` are cut."""

    def run(batches):
        schema = common.batches_of(PIECES)
        coder = word_ids(tokenizer)
        end = end_id.to_bytes(4, "little")
        for b in common.sliced(batches):
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    out.append((doc, k, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)
        coder.memo.forget()  # a task's memo only, so that a worker is small between tasks
        common.give_back()

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, PIECES)


def two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ([(length, copies)], repeats): every counted piece in some bin, none over ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} tokens does not fit into {capacity}")
        left[n] = c
    lengths = np.flatnonzero(left).tolist()
    bins = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        i = len(lengths) - 1
        while i >= 0:  # the longest that fits, again and again
            n = lengths[i]
            k = min(gap // n, int(left[n]) - used.get(n, 0))
            if used:
                k = min(k, 1) if n != lengths[-1] else k
            if k > 0:
                used[n] = used.get(n, 0) + k
                gap -= n * k
            i = min(i - 1 if k <= 0 or left[n] == used[n] else i, bisect_right(lengths, gap) - 1)
        while gap:
            small = min(used)
            room = gap + small
            free = left[: room + 1].copy()
            for n, k in used.items():
                if n <= room:
                    free[n] -= k
            have = np.flatnonzero(free)
            if len(have) == 0:
                break
            fit = np.searchsorted(have, np.minimum(room - have, have), "right") - 1
            twice = (fit >= 0) & (have[fit] == have) & (free[have] < 2)
            fit = np.where(twice, fit - 1, fit)
            total = np.where(fit >= 0, have + have[fit], 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            used[small] -= 1
            if not used[small]:
                del used[small]
            for n in (int(have[best]), int(have[fit[best]])):
                used[n] = used.get(n, 0) + 1
            gap = room - int(total[best])
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        if any(left[n] == 0 for n in used):
            lengths = [n for n in lengths if left[n]]
        bins.append((sorted(used.items(), reverse=True), times))
    return bins


def _places(bins) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length, by ranges of ranks: first rank, repeats, first sequence, offset of the first copy."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for used, times in bins:
        offset = 0
        for n, k in used:
            rows.setdefault(n, []).append((seen.get(n, 0), times, sequence, offset))
            seen[n] = seen.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (PIECES) with sequence_id and offset: each sequence is gapless from 0 and at most ``capacity`` long."""
    pieces = common.stored(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = _places(two_fit(counts, capacity))
    salts = max(1, -(-sum(counts.values()) // GROUP))
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select(*pieces.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def run(batches):
        schema = common.batches_of(PACKED)
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                first, times, base, at = places[n]
                k = np.searchsorted(first, rank[rows], "right") - 1
                slot = rank[rows] - first[k]
                sequence[rows] = base[k] + slot % times[k]
                offset[rows] = at[k] + slot // times[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed each by
    itself; ties go by doc_id; a null doc_id is kept as such. Other columns are
    not read; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
