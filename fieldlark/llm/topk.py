"""Exact top-k search by inner product: KD-trees per shard, traversed best first by blocks of queries.

Median splits, fitted on a bounded sample, divide space into regions; a region's
rows are dealt to as many shards as its size asks for, so that a vector that
many rows share is no large shard. Each shard's tree is built once: it splits at
medians of the widest component and keeps tight bounding boxes. No vector of a
box can score above the sum, over components, of the better of the two corners.

The queries of a region come in blocks, as matrices. A block first searches one
shard of its own region, which gives each of its queries a kth score, and then
the shards whose own box can beat one of these: boxes of blocks meet boxes of shards
before any matrix is sent. Within a shard nodes are visited in the order of the best
bound that a query of the block has for them, by those queries whose kth score
the bound still beats; a leaf is one matrix product. What is shuffled are blocks, not
vectors. Where boxes don't tell vectors apart (many components of like spread) every leaf
is visited, and the search is a scan by matrix products.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FOUND = "query_id long, vec_id long, score long"
TREES = "dim int, region int, part int, low array<double>, high array<double>, tree binary"
BLOCKS = "dim int, region int, block int, n int, low array<double>, high array<double>, ids binary, v binary"
TOLD = "dim int, region int, block int, floor double, floors binary, query_id array<long>, vec_id array<long>, score array<long>, leaves int, visited int"
ROUTES = "dim int, region int, block int, to int"
#: Rows of a tree's leaf, of a shard, queries of a block (the last two on average, as they are dealt by hash); blocks that one task searches a shard for.
LEAF, SHARD, BLOCK, TURN = 256, 16_384, 2_048, 8
#: Rows that the regions' splits are fitted on, and regions, at most.
SAMPLE, REGIONS = 8_192, 256


class Tree:
    """A KD-tree over the rows of ``points`` (float64 holding integers), or one read from its bytes."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        spans: list[tuple[int, int]] = []
        children: list[tuple[int, int]] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(spans)
            spans.append((a, b))
            children.append((-1, -1))
            if parent >= 0:
                left, right = children[parent]
                children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > leaf:
                rows = order[a:b]
                x = points[rows]
                axis = int(np.ptp(x, axis=0).argmax())
                mid = (b - a) // 2
                order[a:b] = rows[np.argpartition(x[:, axis], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        for (a, b), (left, _) in zip(spans, children):
            if left < 0:
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]  # equal scores then come by id
        self.spans, self.children = np.array(spans), np.array(children)
        self.ids, self.points = ids[order], points[order]
        self.low = np.array([self.points[a:b].min(0) for a, b in spans])
        self.high = np.array([self.points[a:b].max(0) for a, b in spans])
        self.least = np.array([self.ids[a:b].min() for a, b in spans])

    PARTS = ("spans", "children", "ids", "points", "low", "high", "least")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{p: getattr(self, p) for p in self.PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Tree:
        tree, parts = cls.__new__(cls), np.load(io.BytesIO(raw))
        for p in cls.PARTS:
            setattr(tree, p, parts[p])
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each query the k best scores of at least its floor and their ids (-inf and -1 beyond those), and how many leaves were visited."""
        best, ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64)
        kth = floors.copy()
        everyone = np.arange(len(queries))
        bound = most(queries, self.low[:1], self.high[:1])[:, 0]
        heap = [(-bound.max(initial=-np.inf), 0, everyone, bound)]
        visited = 0
        while heap:
            _, node, who, bound = heapq.heappop(heap)
            held = bound >= kth[who]  # an equal score may be of a smaller id
            who = who[held]
            if not len(who):
                continue
            if self.children[node, 0] >= 0:
                for c in self.children[node].tolist():
                    b = most(queries[who], self.low[c : c + 1], self.high[c : c + 1])[:, 0]
                    heapq.heappush(heap, (-b.max(), c, who, b))
                continue
            visited += 1
            a, e = self.spans[node]
            scores = queries[who] @ self.points[a:e].T
            scores[own[who, None] == self.ids[None, a:e]] = -np.inf
            some = (scores >= kth[who, None]).any(1)
            who, scores = who[some], scores[some]
            if not len(who):
                continue
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            s, i = np.concatenate([best[who], np.take_along_axis(scores, at, 1)], 1), np.concatenate([ids[who], self.ids[a:e][at]], 1)
            at = np.lexsort((i, -s), axis=1)[:, :k]
            best[who], ids[who] = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
            kth[who] = np.maximum(kth[who], best[who, k - 1])
        ids[best == -np.inf] = -1
        return best, ids, visited


def most(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query and box, a score that no vector in the box exceeds."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def splits(points: np.ndarray, regions: int) -> list[tuple[int, float]]:
    """Median splits of the widest component, a complete tree in heap order with ``regions`` (a power of two) leaves."""
    out: list[tuple[int, float]] = []
    level = [points]
    while len(level) < regions:
        after = []
        for x in level:
            axis = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
            cut = float(np.median(x[:, axis])) if len(x) else 0.0
            out.append((axis, cut))
            after += [x[x[:, axis] < cut], x[x[:, axis] >= cut]]
        level = after
    return out


def region_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if cuts:
        axes, at = np.array([a for a, _ in cuts]), np.array([c for _, c in cuts])
        while node[0] < len(cuts):  # all leaves are of one depth
            node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] >= at[node])
    return (node - len(cuts)).astype(np.int32)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def quantised(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null for a null vector or one with null or non-finite components."""
    x = F.transform(vectors, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    ok = vectors.isNotNull() & F.forall(vectors, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(ok, x)


def _placed(rows: DataFrame, cuts: dict[int, list[tuple[int, float]]]) -> DataFrame:
    """Adds ``region`` to rows (row, vec_id, dim, v)."""

    def run(batches):
        for b in batches:
            dims, vectors = b.column(2).to_numpy(), b.column(3)
            region = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                region[own] = region_of(_matrix(vectors.take(pa.array(own)), d), cuts.get(d, []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=[*b.schema.names, "region"])

    return rows.mapInArrow(run, "row long, vec_id long, dim int, v array<double>, region int")


def _built(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    dim, region, part = (x.as_py() for x in key)
    tree = Tree(rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dim))
    row = [[dim], [region], [part], [tree.low[0].tolist()], [tree.high[0].tolist()], [tree.to_bytes()]]
    schema = common.batches_of(TREES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)


def _blocked(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    dim, region, block = (x.as_py() for x in key)
    v, ids = _matrix(rows.column("v"), dim), rows.column("query_id").to_numpy()
    row = [[dim], [region], [block], [len(ids)], [v.min(0).tolist()], [v.max(0).tolist()], [ids.astype("<i8").tobytes()], [v.astype("<f8").tobytes()]]
    schema = common.batches_of(BLOCKS)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)


def _searched(asks: DataFrame, trees: DataFrame, k: int, turn: int) -> DataFrame:
    """Blocks (dim, region, block, ids, v, floors, to, part) in the shard ``part`` of region ``to``, a shard and some ``turn`` blocks at a time."""
    turns = asks.groupBy("dim", "to", "part").agg(F.ceil(F.count(F.lit(1)) / turn).cast("int").alias("turns"))
    asks = asks.join(turns, ["dim", "to", "part"]).withColumn("turn", F.pmod(F.xxhash64("region", "block"), F.col("turns")).cast("int"))
    dealt = trees.select("dim", F.col("region").alias("to"), "part", "tree").join(turns, ["dim", "to", "part"]).select("dim", "to", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "tree")
    asked = asks.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "to", "part", "turn", "region", "block", "ids", "v", "floors")])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = common.batches_of(TOLD)
        out = []
        if left.num_rows and right.num_rows:
            dim, tree = key[0].as_py(), Tree.from_bytes(left.column("tree")[0].as_py())
            leaves = int((tree.children[:, 0] < 0).sum())
            for r in right.to_pylist():
                own, v, floors = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_v"], "<f8").reshape(-1, dim), np.frombuffer(r["q_floors"], "<f8")
                best, ids, visited = tree.search(v, own, floors, k)
                i, j = np.nonzero(best > -np.inf)
                kth = best[:, k - 1]
                out.append([dim, r["q_region"], r["q_block"], float(kth.min()), kth.astype("<f8").tobytes(), own[i].tolist(), ids[i, j].tolist(), best[i, j].astype(np.int64).tolist(), leaves, visited])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()

    return dealt.groupBy("dim", "to", "part", "turn").cogroup(asked.groupBy("q_dim", "q_to", "q_part", "q_turn")).applyInArrow(run, TOLD)


def _routed(told: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Of blocks with floors a row for each region whose box may hold a score that one of their queries needs."""

    def run(batches):
        schema = common.batches_of(ROUTES)
        for b in common.sliced(batches, 1):
            dim = b.column(0)[0].as_py()
            regions, low, high = boxes[dim]
            v, floors = np.frombuffer(b.column(3)[0].as_py(), "<f8").reshape(-1, dim), np.frombuffer(b.column(4)[0].as_py(), "<f8")
            to = regions[(most(v, low, high) >= floors[:, None]).any(0)]
            cols = [[b.column(i)[0].as_py()] * len(to) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, to], schema.types)], schema=schema)

    return told.select("dim", "region", "block", "v", "floors").mapInArrow(run, ROUTES)


def _meet(low: Column, high: Column, s_low: Column, s_high: Column) -> Column:
    """A score that no query of one box has with a vector of the other: over components, the best of the four products of corners."""
    ends = F.arrays_zip(low.alias("a"), high.alias("b"), s_low.alias("c"), s_high.alias("d"))
    return F.aggregate(ends, F.lit(0.0), lambda t, e: t + F.greatest(e["a"] * e["c"], e["a"] * e["d"], e["b"] * e["c"], e["b"] * e["d"]))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, regions: int = REGIONS, told: list | None = None) -> DataFrame:
    """The k best rows of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id. Scores are inner products of
    floor(``scale`` * x); ties go to the smaller id. Rows with a null id, a null
    vector or null or non-finite components take no part; vectors are of one
    length, and those of another length than the query are no candidates of it.
    Rows that repeat an id are candidates each; a query id is searched once,
    by the first of its vectors (the shortest, then by components). Other columns are not read; an empty
    table, and vectors without components, give an empty result. ``told`` gets
    how many leaves the blocks' shards had, and how many were visited.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vec_col], scale).alias("v")).where("vec_id is not null and size(v) > 0")
    rows = common.stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v"), "vectors")
    n = rows.count()
    # the splits only balance the regions: a bounded sample will do, and any sample gives right results
    sample = rows.select("dim", "v").orderBy(F.xxhash64("row", F.lit(3))).limit(SAMPLE).toArrow() if n > shard else None
    cuts: dict[int, list[tuple[int, float]]] = {}
    if sample is not None:
        dims = sample.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            share = n * len(own) / len(dims) / shard
            cuts[d] = splits(_matrix(sample.column("v").take(pa.array(own)), d), min(regions, 1 << max(0, int(np.ceil(np.log2(max(share, 1)))))))
    placed = _placed(rows, cuts)
    deal = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    sizes = placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
    dealt = placed.join(sizes, ["dim", "region"]).withColumn("part", deal("row", "parts"))
    trees = common.stored(dealt.select("dim", "region", "part", "vec_id", "v").groupBy("dim", "region", "part").applyInArrow(_built, TREES), "trees")

    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "v", "region")).alias("q")).select("query_id", "q.dim", "q.v", "q.region")
    counts = queries.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asks = queries.join(counts, ["dim", "region"]).withColumn("block", deal("query_id", "blocks"))
    asks = common.stored(asks.select("dim", "region", "block", "query_id", "v").groupBy("dim", "region", "block").applyInArrow(_blocked, BLOCKS), "blocks")
    parts = trees.groupBy("dim", "region").agg((F.max("part") + 1).alias("parts"))
    # a home without rows has no tree and sets no floor
    at_home = asks.join(parts, ["dim", "region"]).withColumns({"to": F.col("region"), "part": deal("block", "parts")})
    lowest = F.unhex(F.repeat(F.lit("000000000000F0FF"), F.col("n")))  # -inf as a double, once for each query
    home = common.stored(_searched(at_home.withColumn("floors", lowest), trees, k, TURN), "top-home")

    # a number of boxes that the number of regions bounds
    edges = trees.select("dim", "region", F.posexplode(F.arrays_zip("low", "high")).alias("i", "e")).groupBy("dim", "region", "i").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    found: dict[int, dict[int, tuple[list, list]]] = {}
    for r in edges.orderBy("dim", "region", "i").collect():
        low, high = found.setdefault(r["dim"], {}).setdefault(r["region"], ([], []))
        low.append(r["low"]), high.append(r["high"])
    boxes = {d: (np.array(list(b), np.int32), *(np.array(c) for c in zip(*b.values()))) for d, b in found.items()}

    floored = asks.join(home.select("dim", "region", "block", "floor", "floors"), ["dim", "region", "block"])
    shards = trees.select("dim", F.col("region").alias("to"), "part", F.col("low").alias("s_low"), F.col("high").alias("s_high"))
    small = at_home.select("dim", "region", "block", "low", "high", F.col("part").alias("home")).join(home.select("dim", "region", "block", "floor"), ["dim", "region", "block"])
    pairs = _routed(floored, boxes).join(small, ["dim", "region", "block"]).join(shards, ["dim", "to"])
    pairs = pairs.where((F.col("to") != F.col("region")) | (F.col("part") != F.col("home"))).where(_meet(F.col("low"), F.col("high"), F.col("s_low"), F.col("s_high")) >= F.col("floor"))
    far = floored.drop("low", "high", "floor").join(pairs.select("dim", "region", "block", "to", "part"), ["dim", "region", "block"])
    far = common.stored(_searched(far, trees, k, TURN), "top-far") if len(boxes) > 1 or any(len(b[0]) > 1 for b in boxes.values()) or n > shard else home.limit(0)
    every_one = home.unionByName(far)
    if told is not None:
        told.append(tuple(every_one.agg(F.sum("leaves"), F.sum("visited")).first()))
    flat = every_one.select(F.inline(F.arrays_zip("query_id", "vec_id", "score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
