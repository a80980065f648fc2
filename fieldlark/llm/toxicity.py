"""Toxicity by a classifier chain: linear models over the words of a text.

Categories are predicted in a fixed order; each model sees the words and the
probabilities of the categories before it, and is trained with out-of-fold
predictions of those, as it will meet them: neither the features nor the model
of a fold's predictions saw its rows. The last category decides. The models are
fitted on a bounded sample of labelled rows; which words may matter at all is
decided on that sample by a G-test, and scoring covers all rows and whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows of either class of the last category that the models are fitted on, and bytes of their features, at most.
SAMPLE, BUDGET = 4_000, 128 << 20
BUCKETS, FOLDS, SIGNIFICANT = 1 << 19, 3, 20.0
#: Word beginnings that count as features of their own, beside the whole word; how often a text has to have one, in
#: all and as a share of its words, for each feature made of it.
PREFIXES, TIERS = (4, 5), ((1, 0), (2, 0), (2, 0.003), (2, 0.008), (3, 0), (3, 0.02))
WIDTH = BUCKETS * len(TIERS)  # a feature for each tier
FEATURES = "doc_id long, features binary"
_TRIM = "\"'.,;:!?()[]{}<>*#$%&|-_/\\"


def word_features(word: str) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings."""
    w = word.strip(_TRIM)
    if not w:
        return ()
    return tuple({zlib.crc32(f"w{w}".encode()) % BUCKETS, *(zlib.crc32(f"{n}{w[:n]}".encode()) % BUCKETS for n in PREFIXES if len(w) >= n)})


def tiers(counts: dict[int, int], words: int) -> list[int]:
    least = [max(n, math.ceil(share * words)) for n, share in TIERS]
    return [k * BUCKETS + f for f, n in counts.items() for k, m in enumerate(least) if n >= m]


class Featuriser:
    """Features of a text; words met before are looked up."""

    def __init__(self, limit: int = 100_000):
        self.memo: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def __call__(self, text: str) -> np.ndarray:
        if len(self.memo) > self.limit:
            self.memo.clear()
        out: dict[int, int] = {}
        words = text.lower().split()
        for w, n in Counter(words).items():
            f = self.memo.get(w)
            if f is None:
                f = self.memo[w] = word_features(w)
            for x in f:
                out[x] = out.get(x, 0) + n
        return np.array(tiers(out, len(words)), np.uint32)


def featurised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        schema, f = common.batches_of(FEATURES), Featuriser()
        for b in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], schema=schema)

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, FEATURES)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _counted(cols: np.ndarray, d: int) -> np.ndarray:
    """How often each of ``d`` numbers occurs; in slices, as numpy widens what it counts."""
    out = np.zeros(d, np.int64)
    for i in range(0, len(cols), 1 << 18):
        out += np.bincount(cols[i : i + (1 << 18)], minlength=d)
    return out


class Linear:
    """Logistic regression with an L2 penalty over sparse binary features and a few dense ones, classes weighted evenly."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, d: int, dense: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 200):
        share = max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)
        weight = np.where(y > 0, 0.5 / share[0], 0.5 / share[1]) / n
        w, v, b = np.zeros(d), np.zeros(dense.shape[1]), 0.0
        m = np.zeros(d + dense.shape[1] + 1)
        s = np.zeros_like(m)
        for t in range(1, steps + 1):  # Adam on the whole sample
            z = np.bincount(rows, w[cols], n) + dense @ v + b
            g = (_sigmoid(z) - y) * weight
            grad = np.concatenate([np.bincount(cols, g[rows], d) + penalty * w, dense.T @ g + penalty * v, [g.sum()]])
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
            w -= step[:d]
            v -= step[d:-1]
            b -= step[-1]
        self.w, self.v, self.b = w, v, b

    def predict(self, rows, cols, n, dense):
        return _sigmoid(np.bincount(rows, self.w[cols], n) + dense @ self.v + self.b)


class Chain:
    """Models of the categories in order; each takes the probabilities of those before it as features."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray):
        n, k = labels.shape
        have = np.zeros(WIDTH, np.int32)
        for f in features:
            have[f] += 1  # a text's features differ
        seen = np.flatnonzero(have >= SIGNIFICANT / 10)  # rarer ones cannot be significant
        place = np.full(WIDTH, -1, np.int32)
        place[seen] = np.arange(len(seen))
        kept = [p[p >= 0] for p in (place[f] for f in features)]
        del features
        rows, cols = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in kept]), np.concatenate([*kept, np.zeros(0, np.int32)])
        del kept
        fold = np.arange(n) % FOLDS
        before = np.zeros((n, 0))
        self.models: list[Linear] = []
        self.selected: list[np.ndarray] = []
        for c in range(k):
            y = labels[:, c].astype(float)
            own, model = self._fitted(rows, cols, len(seen), before, y)
            self.selected.append(seen[own])
            self.models.append(model)
            if c + 1 < k:
                told = np.zeros(n)
                for x in range(FOLDS):
                    out = fold == x
                    if out.any() and not out.all():
                        told[out] = self._told(rows, cols, len(seen), before, y, out)
                before = np.column_stack([before, told])

    @classmethod
    def _fitted(cls, rows, cols, d, before, y):
        """The features (of ``d``) that these rows choose, and the model they fit."""
        own = cls._select(rows, cols, d, y)
        r, f = cls._placed(rows, cols, d, own)
        return own, Linear(r, f, len(y), len(own), before, y)

    @classmethod
    def _told(cls, rows, cols, d, before, y, out):
        """Probabilities of the rows in ``out``, by features and a model that none of them had a part in."""
        number = np.where(out, np.cumsum(out), np.cumsum(~out)).astype(np.int32) - 1
        held = out[rows]
        own, model = cls._fitted(number[rows[~held]], cols[~held], d, before[~out], y[~out])
        return model.predict(*cls._placed(number[rows[held]], cols[held], d, own), int(out.sum()), before[out])

    @staticmethod
    def _placed(rows, cols, d, own):
        place = np.full(d, -1, np.int32)
        place[own] = np.arange(len(own))
        to = place[cols]
        return rows[to >= 0], to[to >= 0]

    @staticmethod
    def _select(rows, cols, d, y) -> np.ndarray:
        """Features whose presence depends on the category, by a G-test."""
        n, p = len(y), y.mean() if len(y) else 0
        if not 0 < p < 1:
            return np.zeros(0, np.int64)
        have, both = _counted(cols, d), _counted(cols[(y > 0)[rows]], d)
        seen = np.flatnonzero(have >= SIGNIFICANT / 10)
        have, both = have[seen].astype(float), both[seen].astype(float)
        g = np.zeros(len(seen))
        for o, e in ((both, have * p), (have - both, have * (1 - p)), (y.sum() - both, (n - have) * p), (n - y.sum() - have + both, (n - have) * (1 - p))):
            some = (o > 0) & (e > 0)
            g[some] += 2 * o[some] * np.log(o[some] / e[some])
        return seen[g >= SIGNIFICANT]

    def weights(self) -> dict[int, tuple[float, ...]]:
        out: dict[int, list[float]] = {}
        for c, (own, m) in enumerate(zip(self.selected, self.models)):
            for f, w in zip(own.tolist(), m.w.tolist()):
                out.setdefault(f, [0.0] * len(self.models))[c] = w
        return {f: tuple(w) for f, w in out.items()}


class Scorer:
    """Probabilities of all categories for a text, through the chain."""

    def __init__(self, chain: Chain, limit: int = 150_000):
        self.weights = chain.weights()
        self.known = {f % BUCKETS for f in self.weights}
        self.tops = [(m.v.tolist(), m.b) for m in chain.models]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def __call__(self, text: str) -> list[float]:
        if len(self.memo) > self.limit:
            self.memo.clear()
        memo, known = self.memo, self.known
        counts: dict[int, int] = {}
        words = text.lower().split()
        for w, n in Counter(words).items():
            f = memo.get(w)
            if f is None:
                f = tuple(x for x in word_features(w) if x in known)
                if len(w) <= 64:  # so that its limit bounds the memo's bytes too
                    memo[w] = f
            for x in f:
                counts[x] = counts.get(x, 0) + n
        none = (0.0,) * len(self.tops)
        found = [self.weights.get(f, none) for f in sorted(tiers(counts, len(words)))]
        out: list[float] = []
        for c, (v, b) in enumerate(self.tops):
            z = b + sum(w[c] for w in found) + sum(x * y for x, y in zip(v, out))
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


def train(docs: DataFrame, labels: DataFrame, targets: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, budget: int = BUDGET) -> Chain | None:
    """Fit the chain for ``targets`` ((category, SQL condition over labels), in order; the last is the one that decides).

    At most ``sample`` labelled rows are taken of those in the last category and
    as many of the others, by a hash of their id, and of these as many as have
    ``budget`` bytes of features. Rows with a null label value or id teach
    nothing; of an id's several labels each category's largest counts, of its
    several texts the one with the least features in byte order. Where a category
    has no two classes its model only tells their share. None without any
    labelled text.
    """
    names = [f"y{i}" for i in range(len(targets))]
    named = [F.expr(f"cast({cond} as int)").alias(y) for y, (_, cond) in zip(names, targets)]
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), *named).dropna().groupBy("doc_id").agg(*[F.max(y).alias(y) for y in names])
    order = F.xxhash64("doc_id", F.lit(11))
    taken = marks.where(f"{names[-1]} = 1").orderBy(order).limit(sample).unionByName(marks.where(f"{names[-1]} = 0").orderBy(order).limit(sample))
    taken = common.stored(taken, "taken")  # at most twice `sample` rows, so they may be broadcast
    texts = common.text_rows(docs, id_col, text_col)
    rows = featurised(texts.join(F.broadcast(taken.select("doc_id")), "doc_id")).groupBy("doc_id").agg(F.min("features").alias("features"))
    rows = common.stored(rows.join(F.broadcast(taken), "doc_id"), "training")
    sizes = rows.select("doc_id", F.sum(F.octet_length("features")).over(Window.orderBy(order, "doc_id")).alias("bytes"))
    got = rows.join(F.broadcast(sizes.where(F.col("bytes") <= budget).select("doc_id")), "doc_id").select("doc_id", *names, "features")

    def fit(batches):
        import pickle

        whole = pa.Table.from_batches(list(batches), schema=common.batches_of(f"doc_id long, {', '.join(f'{y} int' for y in names)}, features binary"))
        if whole.num_rows:
            whole = whole.take(np.argsort(whole.column("doc_id").to_numpy(), kind="stable"))
            y = np.column_stack([whole.column(y).to_numpy() for y in names])
            chain = Chain([np.frombuffer(x.as_buffer(), np.uint32) for x in whole.column("features")], y)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])
        common.give_back()

    # one task, of `budget` bytes of features at most; the driver gets the weights
    told = got.repartition(1).mapInArrow(fit, "chain binary").collect()
    if not told:
        return None
    import pickle

    return pickle.loads(told[0]["chain"])


#: The categories that the labels tell, in the chain's order: whether a text is toxic is asked last, knowing the other.
TARGETS = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]


def _schema(targets) -> str:
    return "doc_id long, " + ", ".join(f"p_{c} double" for c, _ in targets)


def score(docs: DataFrame, chain: Chain | None, targets=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of each category, of every row; 0 where nothing was learnt."""
    targets = targets or TARGETS
    ddl = _schema(targets)

    def run(batches):
        schema = common.batches_of(ddl)
        of = Scorer(chain) if chain else lambda t: [0.0] * len(targets)
        for b in common.sliced(batches):
            got = [of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[c] for g in got], pa.float64()) for c in range(len(targets)))], schema=schema)

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, ddl)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, p_low_quality, p_toxic, toxic (p_toxic over ``threshold``).

    A null or empty text has no words; its probabilities are the models' own
    bias. Repeated rows repeat, a null doc_id stays null, ties cannot matter;
    other columns are not read; an empty table gives an empty result, and without
    labels nothing is toxic.
    """
    found = score(docs, train(docs, labels, TARGETS, sample=sample))
    return found.withColumn("toxic", F.col("p_toxic") > threshold)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic; judged row by row, so nothing is joined."""
    chain = train(docs, labels, TARGETS, sample=sample)
    if chain is None:
        return docs

    at = docs.columns.index(text_col)

    def keep(batches):
        of = Scorer(chain)  # with its memo, it ends with the task
        for b in common.sliced(batches):
            yield b.filter(pa.array([of(t or "")[-1] <= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
