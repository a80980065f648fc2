"""Random forests on binned features, for many deep trees: Gini splits, Poisson bags, a random subset of features at each node.

Rows lie in stored blocks. While a node has more than ``rows`` rows, its class counts by
feature and bin are added up in every task and meet in one group a tree. Once it has
fewer, its rows go to one group, which grows the rest of it: there the counts of a node would
be more than its rows, and many times so, as each task has its own.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, spread
from .boosting import SAMPLE, _matrix

#: Rows of a block, bins of a feature, most rows of a node that one group grows, cells of counts that a task adds up in one pass.
BLOCK, BINS, ROWS, CELLS = 16_384, 32, 32_768, 1 << 23
#: Cells of counts that are looked through at once.
AT_ONCE = 1 << 20
BLOCKS = "n int, bins binary, y binary"


@dataclass
class Tree:
    """Nodes from the root on: feature (-1: a leaf), last bin that goes left, left child (the right one is next to it), class counts."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, rest = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rest):
            f = self.feature[node[rest]]
            rest, f = rest[f >= 0], f[f >= 0]
            at = node[rest]
            node[rest] = self.left[at] + (bins[rest, f] > self.cut[at])
        return node


@dataclass
class Model:
    classes: list
    edges: np.ndarray
    trees: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value; missing ones are in the first."""
        return np.column_stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), "left") for e, c in zip(self.edges, x.T)]).astype(np.uint8)

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """The sum over trees of the class shares of each row's leaf."""
        out = np.zeros((len(bins), len(self.classes)))
        for t in self.trees:
            c = t.counts[t.nodes(bins)]
            out += c / np.maximum(c.sum(1, keepdims=True), 1)  # an empty bag has no vote
        return out


def weights(seed: int, tree: int, bins: bytes, n: int) -> np.ndarray:
    """How often each row of a block is in the tree's bag."""
    return np.random.default_rng([seed, tree, zlib.crc32(bins)]).poisson(1.0, n).astype(np.uint8)


def subsets(seed: int, tree: int, nodes: np.ndarray, width: int, m: int) -> np.ndarray:
    """The features that each node, numbered as in a heap, may split by: (nodes, m). Drawn by node, so that it doesn't matter where that is."""
    with np.errstate(over="ignore"):
        h = np.asarray(nodes, np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((seed * 1_000_003 + tree + 1) * 0x2545F4914F6CDD1D % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # splitmix64
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.sort(np.argpartition(h, m - 1, 1)[:, :m], 1)


def histogram(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, features: np.ndarray, width: int, k: int) -> np.ndarray:
    """Counts (node, feature of its subset, bin, class) of rows at nodes 0, 1, ..."""
    q, m = features.shape
    b = bins[np.arange(len(bins))[:, None], features[at]]
    cell = ((at[:, None] * m + np.arange(m)) * width + b) * k + y[:, None]
    return np.bincount(cell.ravel(), np.repeat(w, m), q * m * width * k).reshape(q, m, width, k)


def best_splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the subset, last bin of the left side, counts of all, counts of the left) for each node; place -1 where no split lowers the impurity."""
    whole = counts[:, 0].sum(1)
    n = whole.sum(1)
    left = counts.cumsum(2)[:, :, :-1]
    n_left = left.sum(3)
    n_right = n[:, None, None] - n_left
    squares = np.einsum("qmbk,qmbk->qmb", left, left)
    rest = (whole * whole).sum(1)[:, None, None] - 2 * np.einsum("qmbk,qk->qmb", left, whole) + squares
    fit = (n_left > 0) & (n_right > 0)
    score = np.where(fit, squares / np.maximum(n_left, 1) + rest / np.maximum(n_right, 1), -np.inf).reshape(len(n), -1)
    best = score.argmax(1)  # the first of equals
    own = np.arange(len(n))
    base = (whole * whole).sum(1) / np.maximum(n, 1)
    place, cut = np.divmod(best, left.shape[2])
    place = np.where(score[own, best] > base * (1 + 1e-12), place, -1)
    return place, cut, whole, left[own, np.maximum(place, 0), cut]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int, tree: int, root: int, depth: int, m: int, width: int, k: int) -> Tree:
    """What grows under heap node ``root`` from its rows, at most ``depth`` levels of splits."""
    feature, cut, left, counts = [np.array([-1])], [np.array([0])], [np.array([0])], [np.bincount(y, w, k)[None, :]]
    heap, own, at, total = np.array([root], np.int64), np.array([0]), np.zeros(len(y), np.int64), 1  # open nodes, and their places in the last level
    for _ in range(depth):
        chosen = subsets(seed, tree, heap, bins.shape[1], m)
        order = np.argsort(at, kind="stable")
        bins, y, w, at = bins[order], y[order], w[order], at[order]
        many = max(1, AT_ONCE // (m * width * k))
        place, c, lefts = np.full(len(heap), -1), np.zeros(len(heap), np.int64), np.zeros((len(heap), k))
        for s in range(0, len(heap), many):
            a, b = np.searchsorted(at, [s, s + many])
            place[s : s + many], c[s : s + many], _, lefts[s : s + many] = best_splits(histogram(bins[a:b], y[a:b], w[a:b], at[a:b] - s, chosen[s : s + many], width, k))
        split = np.flatnonzero(place >= 0)
        if not len(split):
            break
        f = np.where(place >= 0, chosen[np.arange(len(heap)), np.maximum(place, 0)], -1)
        child = np.zeros(len(heap), np.int64)
        child[split] = 2 * np.arange(len(split))
        for out, v in ((feature, f), (cut, c), (left, np.where(place >= 0, child + total, 0))):
            out[-1][own] = v
        whole = counts[-1][own][split]
        both = np.stack([lefts[split], whole - lefts[split]], 1).reshape(-1, k)
        feature.append(np.full(len(both), -1)), cut.append(np.zeros(len(both), np.int64)), left.append(np.zeros(len(both), np.int64)), counts.append(both)
        total += len(both)
        going = place[at] >= 0
        bins, y, w, at = bins[going], y[going], w[going], at[going]
        at = child[at] + (bins[np.arange(len(at)), f[at]] > c[at])
        heap = np.stack([2 * heap[split] + 1, 2 * heap[split] + 2], 1).ravel()
        # only nodes of two classes go on
        mixed = (both > 0).sum(1) > 1
        number, own = np.cumsum(mixed) - 1, np.flatnonzero(mixed)
        going = mixed[at]
        bins, y, w, at, heap = bins[going], y[going], w[going], number[at[going]], heap[mixed]
        if not len(heap):
            break
    return Tree(np.concatenate(feature).astype(np.int32), np.concatenate(cut).astype(np.uint8), np.concatenate(left).astype(np.int32), np.concatenate(counts).astype(np.float32))


def fit(df: DataFrame, features: str, label: str, trees: int = 300, depth: int = 12, seed: int = 42, bins: int = BINS, block: int = BLOCK, rows: int = ROWS) -> Model:
    """A forest for the classes in ``label`` from the array column ``features``, with the root of its length features tried at a node.

    Rows without features or label teach nothing; features of one length, missing
    values count as less than all others. Edges of bins come from a bounded sample. The
    driver gets the splits, at most ``trees * 2 ** depth``, never rows.
    """
    spark = df.sparkSession
    held = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("y")).where("x is not null and y is not null")
    path = scratch(spark, "forest")
    held.write.parquet(f"{path}/rows")
    held = spark.read.schema("x array<double>, y string").parquet(f"{path}/rows")
    per = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()}  # as many rows as classes
    classes = list(per)
    if not classes:
        raise ValueError("no row has features and a label")
    sample = held.select("x").orderBy(F.xxhash64("x", F.lit(7))).limit(SAMPLE).toArrow()
    x = _matrix(sample.column("x").combine_chunks(), sample.num_rows)
    edges = np.nan_to_num(np.nanquantile(x, np.arange(1, bins) / bins, axis=0).T)
    model, number, k = Model(classes, edges), {c: i for i, c in enumerate(classes)}, len(classes)
    width, m = len(edges), int(np.ceil(len(edges) ** 0.5))

    def blocked(batches):
        got, n = [], 0
        for b in batches:
            got.append((model.bins(_matrix(b.column(0), b.num_rows)), np.array([number[c] for c in b.column(1).to_pylist()], "<i4")))
            n += b.num_rows
            if n >= block:
                yield _block(got, n)
                got, n = [], 0
        if n:
            yield _block(got, n)

    spread(held, F.xxhash64("x", "y")).sortWithinPartitions("x", "y").mapInArrow(blocked, BLOCKS).write.parquet(f"{path}/blocks")  # in order, as bags go by place in a block
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def opened(b, i):
        raw = b.column(1)[i].as_py()
        n = b.column(0)[i].as_py()
        return raw, np.frombuffer(raw, np.uint8).reshape(n, -1), np.frombuffer(b.column(2)[i].as_py(), "<i4").astype(np.int64)

    # the tops: lists of nodes, each with its heap number; open nodes have over ``rows`` rows, given ones at most so many
    tops = [{"heap": [0], "feature": [-1], "cut": [0], "left": [0], "counts": [np.zeros(k)]} for _ in range(trees)]
    open_, given = {t: [0] for t in range(trees)}, {}
    if sum(per.values()) <= rows:
        open_, given = {}, {t: [0] for t in range(trees)}

    def frozen(top):
        return Tree(np.array(top["feature"]), np.array(top["cut"]), np.array(top["left"]), np.array(top["counts"]))

    def reached(told, raw, held, t):
        """(rows in the tree's bag, their times in it, the node they are at)."""
        w = weights(seed, t, raw, len(held))
        some = np.flatnonzero(w)
        return some, w[some], told[t].nodes(held[some])

    def counted(told, asked):
        def run(batches):
            total = {t: 0 for t in asked}
            for b in batches:
                for i in range(b.num_rows):
                    raw, held, y = opened(b, i)
                    for t, nodes in asked.items():
                        some, w, at = reached(told, raw, held, t)
                        place = np.full(len(told[t].feature), -1)
                        place[nodes] = np.arange(len(nodes))
                        at = place[at]
                        own = at >= 0
                        chosen = subsets(seed, t, np.array([tops_heap[t][j] for j in nodes]), width, m)
                        total[t] = total[t] + histogram(held[some[own]], y[some[own]], w[own], at[own], chosen, bins, k).astype(np.int64)
            for t, s in total.items():
                if not np.isscalar(s):
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["tree", "total"])

        tops_heap = {t: list(tops[t]["heap"]) for t in asked}
        return run

    def split(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r, "<i8") for r in part.column("total").to_pylist()).reshape(-1, m, bins, k).astype(float)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "found": pa.array([pickle.dumps(best_splits(total))], pa.binary())})

    level, most = 0, max(1, CELLS // (m * bins * k))
    while open_ and level < depth:
        turns, n = [{}], 0
        for t, nodes in open_.items():
            if n + len(nodes) > most and turns[-1]:
                turns.append({})
                n = 0
            turns[-1][t] = nodes
            n += len(nodes)
        following = {}
        for asked in turns:
            told = {t: frozen(tops[t]) for t in asked}
            found = blocks.mapInArrow(counted(told, asked), "tree int, total binary").groupBy("tree").applyInArrow(split, "tree int, found binary").collect()
            for r in found:
                t, (place, cut, whole, lefts) = r["tree"], pickle.loads(r["found"])
                top = tops[t]
                chosen = subsets(seed, t, np.array([top["heap"][j] for j in asked[t]]), width, m)
                for i, j in enumerate(asked[t]):
                    top["counts"][j] = whole[i]
                    if place[i] < 0:
                        continue
                    top["feature"][j], top["cut"][j], top["left"][j] = int(chosen[i, place[i]]), int(cut[i]), len(top["heap"])
                    for side, c in ((1, lefts[i]), (2, whole[i] - lefts[i])):
                        if level + 1 < depth and (c > 0).sum() > 1:
                            (following if c.sum() > rows else given).setdefault(t, []).append(len(top["heap"]))
                        for name, v in (("heap", 2 * top["heap"][j] + side), ("feature", -1), ("cut", 0), ("left", 0), ("counts", c)):
                            top[name].append(v)
        open_, level = following, level + 1

    told = {t: frozen(tops[t]) for t in given}
    heaps = {t: {j: tops[t]["heap"][j] for j in nodes} for t, nodes in given.items()}

    def dealt(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw, held, y = opened(b, i)
                for t, nodes in heaps.items():
                    some, w, at = reached(told, raw, held, t)
                    order = np.argsort(at, kind="stable")
                    some, w, at = some[order], w[order], at[order]
                    out = []
                    for j in nodes:
                        s, e = np.searchsorted(at, [j, j + 1])
                        if e > s:
                            out.append((t, j, int(e - s), *(pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in (held[some[s:e]], y[some[s:e]].astype("<i4"), w[s:e]))))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, s) for c, s in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["tree", "node", "n", "bins", "y", "w"])

    def grown(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        t, j = key[0].as_py(), key[1].as_py()
        sizes = part.column("n").to_pylist()
        unpacked = lambda c, each: b"".join(pa.decompress(r, n * each, "zstd", asbytes=True) for r, n in zip(part.column(c).to_pylist(), sizes))
        held, y, w = (np.frombuffer(unpacked(c, each), s) for c, each, s in (("bins", width, np.uint8), ("y", 4, "<i4"), ("w", 1, np.uint8)))
        heap = heaps[t][j]
        tree = grow(held.reshape(len(y), -1), y.astype(np.int64), w, seed, t, heap, depth - int(heap + 1).bit_length() + 1, m, bins, k)
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([j], pa.int32()), "grown": pa.array([pickle.dumps(tree)], pa.binary())})

    if given:
        parts = spread(blocks.mapInArrow(dealt, "tree int, node int, n int, bins binary, y binary, w binary"), "tree", "node").groupBy("tree", "node").applyInArrow(grown, "tree int, node int, grown binary")
        parts.write.parquet(f"{path}/grown")
        under: dict = {}
        for r in spark.read.schema("tree int, node int, grown binary").parquet(f"{path}/grown").toLocalIterator():
            under.setdefault(r["tree"], []).append((r["node"], pickle.loads(r["grown"])))
    for t in range(trees):
        whole = frozen(tops[t])
        model.trees.append(_joined(whole, sorted(under.get(t, []), key=lambda p: p[0]) if given else []))
    return model


def _block(got: list, n: int) -> pa.RecordBatch:
    cols = [[n], [np.concatenate([g[0] for g in got]).tobytes()], [np.concatenate([g[1] for g in got]).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["n", "bins", "y"])


def _joined(top: Tree, under: list[tuple[int, Tree]]) -> Tree:
    """The top with what has grown under its given nodes; the root of each takes that node's place."""
    cols, total = [[c.copy()] for c in (top.feature, top.cut, top.left, top.counts)], len(top.feature)
    for j, t in under:
        left = t.left + np.int32(total - 1)  # all but its root follow
        for col, v in zip(cols, (t.feature, t.cut, left, t.counts)):
            col[0][j] = v[0]
            col.append(v[1:])
        total += len(t.feature) - 1
    feature, cut, left, counts = (np.concatenate(c) for c in cols)
    return Tree(feature.astype(np.int32), cut.astype(np.uint8), left.astype(np.int32), counts.astype(np.float32))


def predict(df: DataFrame, model: Model, features: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``predicted``, the class with most votes (the first on ties); null without features."""
    raw = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(raw.value)
        for b in batches:
            x = b.column(len(keep))
            some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            out = np.full(b.num_rows, None, object)
            if len(some):
                out[some] = np.array(m.classes, object)[m.votes(m.bins(_matrix(x.take(pa.array(some)), len(some)))).argmax(1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out.tolist(), pa.string())], names=[*keep, "predicted"])

    given = df.select(*keep, F.col(features).cast("array<double>").alias("__x"))
    return spread(given).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in given.dtypes[:-1]) + ", predicted string")
