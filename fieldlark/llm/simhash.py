"""SimHash near-dedup with covering locality-sensitive hashing.

A map that gives each of the 64 bits a random non-zero label of
``radius + 1`` bits makes one mask for each non-zero vector v: the bits whose
label has an odd inner product with v. For any set of at most ``radius``
positions some v is orthogonal to all their labels, so two fingerprints that
differ there agree under that mask: they collide in some of the
2^(radius+1) - 1 tables, always.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

PRINTS = "doc_id long, fingerprint long"
FOUND = "kind int, v int, a long, b long"
#: Distinct fingerprints of one bucket compared within a task; larger buckets take the way of `_overflow`.
BUCKET = 32_768


def majority(h: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the words."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer.

    Words are what white space (0x20, 0x09-0x0D) divides, A-Z lower-cased,
    joined by single spaces.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), seed)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - width + 1].tolist()
    return [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fingerprint) of every row; a text without words (or null) has fingerprint 0."""

    def run(batches):
        schema = common.batches_of(PRINTS)
        for b in common.sliced(batches):
            out = [majority(np.array(shingle_hashes(t, width), np.uint64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], schema=schema)

    return common.text_rows(docs, id_col, text_col, "binary").mapInArrow(run, PRINTS)


def covering_masks(radius: int, seed: int = 7, bits: int = 64) -> np.ndarray:
    """The 2^(radius+1) - 1 masks. Labels are dealt evenly, so that masks have much the same weight."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    deal = np.concatenate([rng.permutation(np.arange(1, size)) for _ in range(-(-bits // (size - 1)))])
    labels = rng.permutation(deal[:bits])
    odd = np.bitwise_count(np.arange(1, size)[:, None] & labels[None, :]) & 1
    return (odd.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def forest(f: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect what pairs of ``f`` within the radius connect, one per vertex at most."""
    left = np.sort(f).view(np.uint64)
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                a += [int(x.view(np.int64))] * len(found)
                b += found.view(np.int64).tolist()
                queue += list(found)
    return a, b


def _buckets(radius: int, limit: int):
    """Over rows (v, key, fp) sorted so: edges (kind 0) of small buckets, the rows (kind 1: key, fp) of large ones."""

    def run(batches):
        schema = common.batches_of(FOUND)
        at, kept, over = None, [], False

        def rows(kind, v, a, b):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, v, np.int32) if np.isscalar(v) else v, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        def close():
            if at is not None and not over and sum(map(len, kept)) > 1:
                a, b = forest(np.concatenate(kept), radius)
                if a:
                    yield rows(0, at[0], a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            v, key, fp = (batch.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(v)]])
            last = len(starts) - 1
            busy = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)
            for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):  # a lone row amid a batch links nothing
                if at != (int(v[s]), int(key[s])):
                    yield from close()
                    at, kept, over = (int(v[s]), int(key[s])), [], False
                kept.append(fp[s:e])
                if over or sum(map(len, kept)) > limit:
                    over = True
                    f = np.concatenate(kept)
                    yield rows(1, at[0], np.full(len(f), at[1]), f)
                    kept = []
        yield from close()

    return run


def _overflow(rows: DataFrame, masks: np.ndarray, radius: int) -> DataFrame:
    """Edges of buckets of any size: fingerprints within the radius meet at a point half way.

    Each row goes to all points within radius/2 of it that keep the bucket's key.
    Two rows that share a point are within the radius, and any two within it
    share one; so linking each row of a point to its smallest row connects what
    the pairs would, without making them. The radius is even here.
    """
    from itertools import combinations

    half = radius // 2
    flips = []
    for v, m in enumerate(masks.view(np.uint64).tolist()):
        free = [1 << i for i in range(64) if not m >> i & 1]
        for k in range(half + 1):
            flips += [(v, int(np.uint64(sum(c)).view(np.int64))) for c in combinations(free, k)]
    deltas = rows.sparkSession.createDataFrame(flips, "v int, delta long")  # a number fixed by the radius
    points = rows.join(F.broadcast(deltas), "v").select("v", F.expr("b ^ delta").alias("p"), "b")
    low = points.groupBy("v", "p").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return points.join(low, ["v", "p"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def links(prints: DataFrame, radius: int = 4, seed: int = 7, limit: int = BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) that connect just what pairs within the radius connect."""
    if radius % 2:
        raise ValueError("the radius must be even: over-full buckets are halved")
    masks = covering_masks(radius, seed)
    tables = F.array(*[F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(int(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = prints.select("fp", F.inline(tables)).select("v", "key", "fp")
    found = common.stored(dealt.repartition("v", "key").sortWithinPartitions("v", "key").mapInArrow(_buckets(radius, limit), FOUND), "links")
    edges = found.where("kind = 0").select("a", "b")
    over = found.where("kind = 1").select("v", "b")
    if not over.isEmpty():
        edges = edges.unionByName(_overflow(over, masks, radius))
    return edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, limit: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Equal fingerprints meet first, so copies cost one row; distinct ones link at
    ``radius`` or fewer differing bits, and a component takes the smallest doc_id
    that any chain of links reaches. Texts without words, empty or null ones have
    fingerprint zero and link like any other. A null doc_id is no smallest one
    (a component of nulls only has a null component_id). Repeated rows repeat in
    the result; an empty table gives an empty one; other columns are not read.
    """
    rows = common.stored(fingerprints(docs, id_col, text_col, width), "prints")
    reps = common.stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "reps")
    roots = components(links(reps.select("fp"), radius, limit=limit))
    rooted = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    # stored, so that adaptive execution can split a fingerprint that many rows share
    named = common.stored(rooted.join(first, "root").select("fp", "component_id"), "named")
    return rows.join(named, rows.fingerprint == named.fp).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
