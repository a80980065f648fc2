"""Boosted trees of several classes at once: softmax gradients on binned features.

Rows lie in stored blocks with their features' bins, their class and their
margins. A level of the trees of all classes is one aggregate: every task adds up gradients by
class, node, feature and bin over its blocks, sums of a class and node meet in one
group, which finds its best split there, and the driver gets a row for each class and
node. Margins are written anew every few rounds; in between a task takes the
trees since then into account.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

#: Rows of a block, bins of a feature, rows that the bins' edges come from, rounds between two writings of margins.
BLOCK, BINS, SAMPLE, KEEP = 4096, 32, 16_384, 10
#: Weight of the penalty on leaves, and least sum of second derivatives of a leaf.
PENALTY, LEAST = 1.0, 1e-3
BLOCKS = "n int, bins binary, y binary, margins binary"


@dataclass
class Model:
    """Trees by round and class, in heap order: feature (-1: a leaf), last bin that goes left, value."""

    classes: list
    edges: np.ndarray
    start: np.ndarray
    depth: int
    trees: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value; missing ones are in the first."""
        return np.column_stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), "left") for e, c in zip(self.edges, x.T)]).astype(np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return grown(self.trees, bins, np.tile(self.start, (len(bins), 1)))


def nodes_of(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels, or the leaf it stays in."""
    feature, cut, _ = tree
    node = np.zeros(len(bins), np.int64)
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[node]
        node = np.where(inner, 2 * node + 1 + right, node)
    return node


def grown(trees, bins: np.ndarray, margins: np.ndarray) -> np.ndarray:
    for round_ in trees:
        for k, tree in enumerate(round_):
            margins[:, k] += tree[2][nodes_of(tree, bins, int(np.log2(len(tree[0]) + 1)) - 1)]
    return margins


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sums(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, first: int, many: int, width: int) -> np.ndarray:
    """Of each of ``many`` nodes from ``first`` on, each feature and bin, the sums of g and h."""
    own = np.flatnonzero((node >= first) & (node < first + many))
    out = np.zeros((many, bins.shape[1], width, 2))
    if len(own):
        at = ((node[own, None] - first) * bins.shape[1] + np.arange(bins.shape[1])) * width + bins[own]
        for i, v in enumerate((g, h)):
            out[..., i] = np.bincount(at.ravel(), np.repeat(v[own], bins.shape[1]), many * bins.shape[1] * width).reshape(out.shape[:3])
    return out


def best_split(total: np.ndarray, penalty: float = PENALTY, least: float = LEAST) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, last bin of the left side, gain, sums of all, sums of the left) of sums (feature, bin, 2); feature -1 where nothing gains."""
    whole = total[0].sum(0)
    left = total.cumsum(1)[:, :-1]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)  # the first of equals
    if not gain[f, b] > 1e-12:
        return -1, 0, 0.0, whole, whole
    return int(f), int(b), float(gain[f, b]), whole, left[f, b]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def fit(df: DataFrame, features: str, label: str, rounds: int = 300, depth: int = 5, rate: float = 0.1, bins: int = BINS, block: int = BLOCK, keep: int = KEEP) -> Model:
    """Boosted trees for the classes in ``label`` from the array column ``features``.

    Rows without features or label teach nothing; features of one length, missing
    values count as less than all others. Edges of bins come from a bounded
    sample. The classes start at the logarithm of their shares. Every class has a tree of at most ``depth`` levels in each round.
    """
    spark = df.sparkSession
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("y")).where("x is not null and y is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()}  # as many rows as classes
    classes = list(counts)
    if not classes:
        raise ValueError("no row has features and a label")
    sample = rows.select("x").orderBy(F.xxhash64("x", F.lit(7))).limit(SAMPLE).toArrow()
    x = _matrix(sample.column("x").combine_chunks(), sample.num_rows)
    edges = np.nanquantile(x, np.arange(1, bins) / bins, axis=0).T
    start = np.log(np.array([counts[c] for c in classes]) / sum(counts.values()))
    model, number, k = Model(classes, edges, start, depth), {c: i for i, c in enumerate(classes)}, len(classes)

    def blocked(batches):
        for b in batches:
            for s in range(0, b.num_rows, block):
                part = b.slice(s, block)
                n = part.num_rows
                y = np.array([number[c] for c in part.column(1).to_pylist()], "<i4")
                cols = [[n], [model.bins(_matrix(part.column(0), n)).tobytes()], [y.tobytes()], [np.tile(start, (n, 1)).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["n", "bins", "y", "margins"])

    def stored(blocks: DataFrame) -> DataFrame:
        path = scratch(spark, "boosting")
        blocks.write.parquet(path)
        return spark.read.schema(BLOCKS).parquet(path)

    def opened(b):
        n = b.column(0)[0].as_py()
        held = np.frombuffer(b.column(1)[0].as_py(), np.uint8).reshape(n, -1)
        return held, np.frombuffer(b.column(2)[0].as_py(), "<i4"), np.frombuffer(b.column(3)[0].as_py(), "<f8").reshape(n, k).copy()

    def partial(since, growing, level):
        def run(batches):
            total = None
            for b in batches:
                for i in range(b.num_rows):
                    held, y, margins = opened(b.slice(i, 1))
                    p = softmax(grown(since, held, margins))
                    first, many = 2**level - 1, 2**level
                    each = [sums(held, nodes_of(growing[c], held, level), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), first, many, bins) for c in range(k)]
                    total = np.array(each) if total is None else total + each
            if total is not None:
                keys = [(c, j) for c in range(k) for j in range(total.shape[1]) if total[c, j, 0, :, 1].sum() > 0]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([total[c, j].tobytes() for c, j in keys], pa.binary())], names=["k", "node", "total"])

        return run

    width = edges.shape[0]

    def split(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r, "<f8").reshape(width, bins, 2) for r in rows.column("total").to_pylist())
        f, cut, _, whole, left = best_split(total)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "f": pa.array([f], pa.int32()), "cut": pa.array([cut], pa.int32()), "sums": pa.array([[*whole.tolist(), *left.tolist()]], pa.list_(pa.float64()))})

    blocks = stored(rows.repartition(max(1, -(-sum(counts.values()) // block // 8))).mapInArrow(blocked, BLOCKS))
    since: list = []
    for t in range(rounds):
        size = 2 ** (depth + 1) - 1
        growing = [(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(k)]
        for level in range(depth):
            found = blocks.mapInArrow(partial(since, growing, level), "k int, node int, total binary").groupBy("k", "node").applyInArrow(split, "k int, node int, f int, cut int, sums array<double>").collect()
            open_ = False
            for r in found:
                feature, cut, value = growing[r["k"]]
                at, (g, h, left_g, left_h) = 2**level - 1 + r["node"], r["sums"]
                leaf = lambda g, h: -rate * g / (h + PENALTY)
                value[at] = leaf(g, h)
                if r["f"] >= 0:
                    feature[at], cut[at], open_ = r["f"], r["cut"], True
                    value[2 * at + 1], value[2 * at + 2] = leaf(left_g, left_h), leaf(g - left_g, h - left_h)
            if not open_:
                break
        model.trees.append(growing)
        since.append(growing)
        if len(since) == keep and t + 1 < rounds:
            told = since

            def moved(batches, told=told):
                for b in batches:
                    for i in range(b.num_rows):
                        one = b.slice(i, 1)
                        held, _, margins = opened(one)
                        yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([grown(told, held, margins).tobytes()], pa.binary())], names=one.schema.names)

            blocks, since = stored(blocks.mapInArrow(moved, BLOCKS)), []
    return model


def predict(df: DataFrame, model: Model, features: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``predicted``, the most likely class (the first on ties); null without features."""
    raw = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(raw.value)
        for b in batches:
            x = b.column(len(keep))
            some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            out = np.full(b.num_rows, None, object)
            if len(some):
                best = m.margins(m.bins(_matrix(x.take(pa.array(some)), len(some)))).argmax(1)
                out[some] = np.array(m.classes, object)[best]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out.tolist(), pa.string())], names=[*keep, "predicted"])

    given = df.select(*keep, F.col(features).cast("array<double>").alias("__x"))
    return given.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in given.dtypes[:-1]) + ", predicted string")
