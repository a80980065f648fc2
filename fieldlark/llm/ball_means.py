"""Centroid clustering by ball k-means, exact on integer vectors.

After a first assignment the vectors are dealt into blocks by cluster and by
distance from its centroid, so that a block is a thin shell of a ball: it has the
ball's centre of that time, an inner and an outer radius, and its vectors' number
and sum. In a round the centroid of the ball has moved by some way, which bounds
how far any vector of the block is from it now, and a centroid is a neighbour of
the block only if it is at most twice that far from the ball's. A block without
neighbours lies in the stable core: it isn't read, its number and sum are
known. In the others each vector's distance to its ball's centroid is exact; what
is nearer than half the way to the nearest neighbour is core too, and a vector of
the annulus between the j-th and the next neighbour is compared with the first j
neighbours alone. By the triangle inequality no other centroid can be as near.
The ball that a vector is filed under needn't be its cluster for that: a vector that
moves is compared with its ball's neighbours. Blocks are written once, and
once more after the first rounds, when centroids have come near their places.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import quantised

#: Vectors of a block.
BLOCK = 2048
#: Components up to this size have squared distances (of up to 1024 components) that double precision holds exactly.
EXACT = 1 << 20
BLOCKS = "ball int, n long, outer double, total array<decimal(38,0)>, ids array<long>, vectors binary"
SUMS = "cluster int, n long, total array<decimal(38,0)>"
FOUND = "vec_id long, cluster int, distance long"


def integers(rows: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    out = np.empty(rows.shape, object)
    out[:] = [[int(x) for x in r] for r in rows.tolist()]
    return out


def matrix(rows: np.ndarray) -> np.ndarray:
    """Integers as doubles where all arithmetic on them is exact in doubles, else as Python's integers."""
    return rows if not rows.size or np.abs(rows).max() <= EXACT else integers(rows)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to one centroid."""
    d = x - c
    return (d * d).sum(1)


class Balls:
    """Centroids and, of each, the others by distance."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        exact = all(abs(x) <= EXACT for c in centroids for x in c)
        self.centroids = np.array(centroids, float if exact else object)
        k = len(centroids)
        self.apart = [[sum((a - b) ** 2 for a, b in zip(centroids[i], centroids[j])) for j in range(k)] for i in range(k)]
        self.order = [sorted((j for j in range(k) if j != i), key=lambda j: (self.apart[i][j], j)) for i in range(k)]

    def nearest(self, x: np.ndarray, ball: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of vectors filed under ``ball``: their clusters (ties to the smaller number), squared distances, and how many distances that took."""
        centroids = self.centroids
        if object in (centroids.dtype, x.dtype):
            x, centroids = integers(x), integers(centroids)
        best = squared(x, centroids[ball])
        own, cluster, made = best, np.full(len(x), ball, np.int32), len(x)
        for j in self.order[ball]:  # nearest neighbour first: the annuli that it matters to only get smaller
            rows = np.flatnonzero(4 * own >= self.apart[ball][j])
            if not len(rows):
                break
            made += len(rows)
            d = squared(x[rows], centroids[j])
            less = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            if best is own:
                best = own.copy()
            best[rows[less]], cluster[rows[less]] = d[less], j
        return cluster, best, made

    def reach(self, before: list[tuple[int, ...]]) -> list[float]:
        """Of each ball, the outer radius about its centre of ``before`` from which on a block has neighbours; infinite for one centroid."""
        out = []
        for i, c in enumerate(before):
            moved = math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(c, self.centroids[i])))
            near = self.apart[i][self.order[i][0]] if self.order[i] else math.inf
            out.append(math.sqrt(near) / 2 * (1 - 1e-9) - moved * (1 + 1e-9) - 1e-6)  # to the safe side of rounding
        return out


def _given(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _kept(raw: bytes, dim: int) -> np.ndarray:
    return matrix(np.frombuffer(raw, "<f8").reshape(-1, dim))


def _decimals(x) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in x]


def _blocks(rows: DataFrame, first: Balls, dim: int, block: int) -> DataFrame:
    """Vectors in shells of the balls of ``first``: blocks of one ball and close radii, with their outer radius, number and sum."""

    def filed(batches):
        for b in common.sliced(batches, 4096):
            x = matrix(_given(b.column(1), dim))
            cluster, best, _ = first.nearest(x, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(np.sqrt(best.astype(float)))], names=["vec_id", "v", "row", "ball", "radius"])

    def cut(batches):
        schema = pa.schema([("ball", pa.int32()), ("n", pa.int64()), ("outer", pa.float64()), ("total", pa.list_(pa.decimal128(38, 0))), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])
        for b in common.sliced(batches, block):
            balls = b.column(2).to_numpy()
            for s, e in zip(*(np.flatnonzero(np.append(True, balls[1:] != balls[:-1])), np.flatnonzero(np.append(balls[1:] != balls[:-1], True)) + 1)):
                part = b.slice(int(s), int(e - s))
                x = _given(part.column(1), dim)
                total = [sum(map(int, c)) for c in x.T.tolist()]
                row = [[int(balls[s])], [part.num_rows], [float(part.column(3).to_numpy().max())], [_decimals(total)], [part.column(0).to_pylist()], [x.astype("<f8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

    # equal vectors are told apart by a row's hash, so that a vector that many rows share is no large partition
    dealt = rows.mapInArrow(filed, "vec_id long, v array<double>, row long, ball int, radius double").withColumn("salt", F.xxhash64("row"))
    dealt = dealt.repartitionByRange("ball", "radius", "salt").sortWithinPartitions("ball", "radius", "salt").select("vec_id", "v", "ball", "radius")
    return common.stored(dealt.mapInArrow(cut, BLOCKS), "balls")


def _sums(blocks: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """(cluster, n, total) of blocks whose vectors may have other clusters than their ball's, added up by task."""

    def run(batches):
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in common.sliced(batches, 1):
            x = _kept(b.column(1)[0].as_py(), dim)
            cluster, _, _ = balls.nearest(x, b.column(0)[0].as_py())
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                n[c] = n.get(c, 0) + len(own)
                total[c] = total.get(c, 0) + np.array([int(v) for v in own.sum(0)], object)
        schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))])
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([_decimals(total[c]) for c in n], schema.types[2])], schema=schema)

    return blocks.select("ball", "vectors").mapInArrow(run, SUMS)


def _assigned(blocks: DataFrame, balls: Balls, dim: int) -> DataFrame:
    def run(batches):
        for b in common.sliced(batches, 1):
            x = _kept(b.column(2)[0].as_py(), dim)
            cluster, best, _ = balls.nearest(x, b.column(0)[0].as_py())
            fits = [int(d) if d < 1 << 63 else None for d in best.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(1).flatten(), pa.array(cluster), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.select("ball", "ids", "vectors").mapInArrow(run, FOUND)


def _stable(balls: Balls, before: list[tuple[int, ...]]) -> Column:
    """Whether a block lies in its ball's core; simple comparisons, which reach the scan."""
    return reduce(lambda a, b: a | b, [(F.col("ball") == i) & (F.col("outer") < r) for i, r in enumerate(balls.reach(before))])


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, again: int = 3, told: list | None = None) -> DataFrame:
    """Of every vector vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors of exactly ``dim`` components, none null or non-finite, take part as
    floor(``scale`` * x). The centroids 0, 1, ... begin as the ``k`` vectors with the
    smallest hex sha256 of ``seed:vec_id`` (of one id the vector that is smaller by
    components; all vectors, if there are fewer). Each of ``rounds`` rounds assigns
    every vector to the nearest centroid by squared Euclidean distance, ties to the
    smaller number, and replaces every centroid that has vectors by the floor of
    their mean; then all are assigned once more. Distance is squared; the inertias
    are its sums over the cluster and over all.

    Rows that repeat an id, or have none, are vectors each. A distance or sum that
    a long can't hold is null, sums of components over 1e38 are an error. Other columns are
    not read; an empty table gives an empty result. After ``again`` rounds vectors
    are filed anew if some blocks still have neighbours. ``told`` gets, for each
    round, how many blocks there are and how many were read.
    """
    c = F.col
    given = vectors.select(vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vec_col], scale).alias("v")).where(F.size("v") == dim)
    rows = common.stored(given.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [tuple(map(int, r["v"])) for r in rows.orderBy(name, "v").limit(k).select("v").collect()]
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], out)
    begin, balls = centroids, Balls(centroids)
    blocks = _blocks(rows, balls, dim, block)
    for t in range(rounds):
        if t == again and not blocks.where(~_stable(balls, begin)).isEmpty():
            begin, blocks = centroids, _blocks(rows, balls, dim, block)
        stable = _stable(balls, begin)
        core = blocks.where(stable).select(c("ball").alias("cluster"), "n", "total")
        parts = core.unionByName(_sums(blocks.where(~stable), balls, dim))
        flat = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        sums: dict[int, dict[int, tuple[int, int]]] = {}
        for r in flat.collect():  # k times dim numbers
            sums.setdefault(r["cluster"], {})[r["i"]] = int(r["x"]), r["n"]
        if told is not None:
            told.append((blocks.count(), blocks.where(~stable).count()))
        centroids = [tuple(sums[j][i][0] // sums[j][i][1] for i in range(dim)) if j in sums else old for j, old in enumerate(centroids)]
        balls = Balls(centroids)
    found = common.stored(_assigned(blocks, balls, dim), "assigned")
    per = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(c("distance").cast("decimal(38,0)"))).alias("s")).collect()
    inertia = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in per}
    total = None if None in inertia.values() else sum(inertia.values())
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    said = [(j, fits(inertia.get(j, 0)), fits(total), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for j, x in enumerate(centroids)]
    said = vectors.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows
    return found.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
