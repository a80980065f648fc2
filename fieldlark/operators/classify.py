"""Classifiers over embeddings and feature tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import unit_hash
from ..session import scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; one shorter than 1e-12 stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n < 1e-12, 1.0).otherwise(n))


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centre): the mean of each class's unit vectors, at length 1. As many rows as classes."""
    each = df.select(F.col(label).alias("label"), F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    whole = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
    return whole.select("label", unit(F.col("c")).alias("centre"))


def _units(column) -> np.ndarray:
    """The rows of a list column, of one length, as unit vectors; one shorter than 1e-12 stays as it is."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n < 1e-12, 1.0, n)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind]


def _cosines(df: DataFrame, centres: DataFrame, key: str, vector: str, finish, columns: list[tuple[str, str]]) -> DataFrame:
    """Each batch's matrix of cosines to the centres, through ``finish`` (keys, cosines, labels) to columns."""
    kind, label = df.schema[key].dataType.simpleString(), centres.schema["label"].dataType.simpleString()
    ddl = [(key, kind), *[(n, label if t == "label" else t) for n, t in columns]]
    schema = pa.schema([(n, _arrow(t)) for n, t in ddl])
    table = centres.orderBy("label").toArrow()  # as many rows as classes
    labels, matrix = table.column("label").to_numpy(), _units(table.column("centre"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                cols = finish(b.column(0), _units(b.column(1)) @ matrix.T, labels)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, schema.types)], schema=schema)

    held = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    return held.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in ddl))


def by_centroid(df: DataFrame, centres: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, predicted, score): the class of the nearest centre by cosine, the smaller label on ties. A batch is one matrix product."""

    def best(keys, cosines, labels):
        held = np.round(cosines, 9)
        at = held.argmax(1)  # the first of equals, and labels are in order
        return keys, labels[at], held[np.arange(len(at)), at]

    return _cosines(df, centres, key, vector, best, [("predicted", "label"), ("score", "double")])


def probabilities(df: DataFrame, centres: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, label, probability): softmax of the cosines."""

    def softmax(keys, cosines, labels):
        e = np.exp(cosines)
        p = e / e.sum(1, keepdims=True)
        return keys.take(pa.array(np.repeat(np.arange(len(p)), p.shape[1]))), np.tile(labels, len(p)), p.ravel()

    return _cosines(df, centres, key, vector, softmax, [("label", "label"), ("probability", "double")])


#: Rows that pivots are chosen from, and pivots, at most.
SAMPLE, PIVOTS = 4096, 64
#: Radians by which angles are widened against rounding.
SLACK = 1e-6


def pivots_of(units: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows that have a direction, each as far from those before it as can be; any direction if there are none."""
    units = units[(units * units).sum(1) > 0.5]
    if not len(units):
        return np.ones((1, units.shape[1])) / max(units.shape[1], 1) ** 0.5
    chosen = [0]
    near = units @ units[0]
    while len(chosen) < min(n, len(units)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def _placed(df: DataFrame, pivots: np.ndarray, names: list[str], vector: str) -> DataFrame:
    """Adds the nearest pivot of each row and the angle to it; that of a vector without direction is pi, which meets all."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u = _units(b.column(len(names)))
            cosines = np.clip(u @ pivots.T, -1.0, 1.0)
            at = cosines.argmax(1)
            angle = np.where((u * u).sum(1) < 0.5, np.pi, np.arccos(cosines[np.arange(len(at)), at]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "pivot", "angle"])

    held = df.select(*names, vector)
    ddl = ", ".join(f"{n} {t}" for n, t in held.dtypes) + ", pivot int, angle double"
    return held.mapInArrow(run, ddl)


def _in_blocks(rows: DataFrame, key: str, block: int, side: str) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): rows with the pivot and part that make their block, and of each block its largest angle and its rows' number."""
    parts = rows.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # a row for each pivot
    held = rows.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    held = held.withColumnsRenamed({"pivot": f"{side}p", "part": f"{side}a"})
    return held, held.groupBy(f"{side}p", f"{side}a").agg((F.max("angle") + SLACK).alias(f"{side}_angle"), F.count(F.lit(1)).alias(f"{side}_n"))


def _finite(table: pa.Table, units: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    ok = np.isfinite(units).all(1)
    return (table, units) if ok.all() else (table.filter(pa.array(ok)), units[ok])


def candidates(queries: np.ndarray, units: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of pairs among which are the k nearest of each query, and all that tie with them; ``ids`` are in order.

    Told by products in single precision: the columns are dealt to groups, and k groups have a cosine of at least the kth
    largest of the groups' maxima. What that precision can be wrong by is allowed for.
    """
    groups = 64 * -(-k // 16)
    n, dim = units.shape
    filled = np.zeros((-(-n // groups) * groups, dim), np.float32)
    filled[:n] = units
    c = queries.astype(np.float32) @ filled.T
    c[:, n:] = -np.inf
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")  # the query itself
    same = np.repeat(np.arange(len(own)), last - first)
    c[same, np.arange(len(same)) - np.repeat(np.cumsum(last - first) - last, last - first)] = -np.inf
    most = c.reshape(len(c), -1, groups).max(1)
    edge = np.maximum(np.partition(most, groups - k, 1)[:, groups - k] - np.float32((dim + 16) * 2.0**-23), np.float32(-4.0))
    return np.divmod(np.flatnonzero(c >= edge[:, None]), c.shape[1])


def best_of(queries: np.ndarray, units: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, negative cosine to nine digits) of the k nearest of each query but itself, ties to the smaller id."""
    rows, cols = candidates(queries, units, own, ids, k)
    d = np.empty(len(rows))
    for s in range(0, len(rows), 1 << 16):
        d[s : s + (1 << 16)] = np.einsum("ij,ij->i", queries[rows[s : s + (1 << 16)]], units[cols[s : s + (1 << 16)]])
    d = np.round(-d, 9)
    order = np.lexsort((cols, d, rows))
    rows = rows[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[order][kept], d[order][kept]


def by_neighbours(queries: DataFrame, train: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 8192, told: list | None = None) -> DataFrame:
    """(key, predicted): majority of the k nearest training rows by cosine, other rows than the query itself; the
    smaller label on ties.

    Both sides come in blocks of about ``block`` rows that have one pivot as their nearest. A block of queries first meets a
    training block of its own pivot or the nearest, which says how near the kth neighbours are at least; then only blocks that
    can be as near, by the triangle inequality on the sphere: two rows are no nearer than their pivots less
    their angles to these. Every two blocks that meet do so in one matrix product of single
    precision, which leaves few pairs of each query to be told exactly. ``told`` gets the pairs of blocks that met, and all there are.
    """
    kind, lab = queries.schema[key].dataType.simpleString(), train.schema[label].dataType.simpleString()
    v = F.col(vector)  # singles stay so in the shuffle
    t = train.where(v.isNotNull()).select(F.col(key).alias("t_id"), F.col(label).alias("t_label"), v.alias("t_v"))
    q = queries.where(v.isNotNull()).select(F.col(key).alias("q_id"), v.alias("q_v"))
    n = t.count()
    if not n:
        return q.limit(0).select(F.col("q_id").alias(key), F.lit(None).cast(lab).alias("predicted"))
    sample = t.select("t_v").orderBy(F.xxhash64("t_id", F.lit(5))).limit(SAMPLE if n > block else 1).toArrow()
    pivots = pivots_of(_units(sample.column(0)), min(PIVOTS, -(-n // block)))
    t, t_blocks = _in_blocks(_placed(t, pivots, ["t_id", "t_label"], "t_v"), "t_id", block, "t")
    q, q_blocks = _in_blocks(_placed(q, pivots, ["q_id"], "q_v"), "q_id", block, "q")
    schema = pa.schema([("q_id", _arrow(kind)), ("t_id", _arrow(kind)), ("t_label", _arrow(lab)), ("d", pa.float64())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("t_id")  # equal cosines then come by id
        units, others = _units(left.column("t_v")), _units(right.column("q_v"))
        left, units = _finite(left, units)
        right, others = _finite(right, others)
        ids, own = left.column("t_id").to_numpy(), right.column("q_id").to_numpy()
        if not len(ids) or not len(own):
            return schema.empty_table()
        found = []
        for s in range(0, len(own), 1024):
            rows, cols, d = best_of(others[s : s + 1024], units, own[s : s + 1024], ids, k)
            found.append(pa.table({"q_id": right.column("q_id").slice(s, 1024).take(pa.array(rows)), "t_id": left.column("t_id").take(pa.array(cols)), "t_label": left.column("t_label").take(pa.array(cols)), "d": d}))
        return pa.concat_tables(found).cast(schema)

    def met(pairs: DataFrame) -> DataFrame:
        by = ["qp", "qa", "tp", "ta"]
        left, right = t.join(pairs, ["tp", "ta"]).select(*by, "t_id", "t_label", "t_v"), q.join(pairs, ["qp", "qa"]).select(*by, "q_id", "q_v")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(nearest, f"q_id {kind}, t_id {kind}, t_label {lab}, d double")

    path = scratch(queries.sparkSession, "nearest")
    apart = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    apart = queries.sparkSession.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "qp int, tp int, apart double")  # PIVOTS squared rows
    every = q_blocks.join(F.broadcast(apart), "qp").join(t_blocks, "tp")
    # the nearest block that has k rows besides the query itself, any of its pivot's
    turn = F.xxhash64("qp", "qa", "ta")
    home = every.where(F.col("t_n") > k).groupBy("qp", "qa").agg(F.min_by(F.struct("tp", "ta"), F.struct("apart", turn)).alias("h")).select("qp", "qa", "h.tp", "h.ta")
    home.write.parquet(f"{path}/home")
    home = queries.sparkSession.read.schema("qp int, qa int, tp int, ta int").parquet(f"{path}/home")
    met(home).write.parquet(f"{path}/first")
    first = queries.sparkSession.read.schema(f"q_id {kind}, t_id {kind}, t_label {lab}, d double").parquet(f"{path}/first")
    # the least cosine that a kth neighbour of the block's queries is known to have; -1 where one has fewer than k
    kth = q.select("q_id", "qp", "qa").join(first.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")), "q_id", "left")
    kth = kth.groupBy("qp", "qa").agg(F.min(F.when(F.col("n") >= k, -F.col("far")).otherwise(-1.0)).alias("kth"))
    near = every.join(kth, ["qp", "qa"])
    best = F.cos(F.greatest(F.col("apart") - F.col("q_angle") - F.col("t_angle"), F.lit(0.0)))
    pairs = near.where(best >= F.col("kth") - 2e-9).select("qp", "qa", "tp", "ta").join(home, ["qp", "qa", "tp", "ta"], "left_anti")
    pairs.write.parquet(f"{path}/pairs")
    pairs = queries.sparkSession.read.schema("qp int, qa int, tp int, ta int").parquet(f"{path}/pairs")
    if told is not None:
        told.append((home.count() + pairs.count(), q_blocks.count() * t_blocks.count()))
    found = first.unionByName(met(pairs))
    w = Window.partitionBy("q_id").orderBy("d", "t_id")
    votes = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("q_id", "t_label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("q_id").alias(key)).agg((-F.max(F.struct("n", (-F.col("t_label")).alias("m")))["m"]).alias("predicted"))


BACKENDS = ("rf", "gbm", "logistic")


def fit(df: DataFrame, features: list[str], label: str, model: str = "rf", trees: int = 300, depth: int = 12, rate: float = 0.1, seed: int = 42, weight: str | None = None):
    """A fitted ML pipeline: label index, feature vector, model. A vector column may stand among the features.

    Class weights (see ``stats.balanced_weights``) are given by column; an unknown backend falls back to the forest.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(df)
    extra = {"weightCol": weight} if weight else {}
    if model == "logistic":
        head = LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", maxIter=1000, **extra)
    elif model == "gbm":
        head = OneVsRest(classifier=GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=trees, stepSize=rate, maxDepth=min(depth, 5), seed=seed), featuresCol="__x", labelCol="__y")
    else:
        head = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=min(depth, 30), seed=seed, **extra)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep" if len(features) > 1 else "error"), head, names]).fit(df)


def importances(model, features: list[str], spark, top: int = 15) -> DataFrame:
    """(feature, importance), the largest first."""
    tree = next(s for s in model.stages if hasattr(s, "featureImportances"))
    rows = [(f, float(v)) for f, v in zip(features, tree.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def stacked(df: DataFrame, keys: list[str], t: str, values: list[str], steps: list[int], prefix: str = "s") -> DataFrame:
    """Time steps side by side: {prefix}_t{step}_{value}."""
    out = [F.max(F.when(F.col(t) == s, F.col(v))).alias(f"{prefix}_t{s:02d}_{v}") for s in steps for v in values]
    return df.groupBy(*keys).agg(*out)


def feature_stack(df: DataFrame, keys: list[str], t: str, values: list[str], steps: list[int]) -> DataFrame:
    """Each value at each step, and its mean, maximum and population spread over time."""
    stats = [f(v).alias(f"{v}_{n}") for v in sorted(values) for n, f in (("mean", F.avg), ("max", F.max), ("std", F.stddev_pop))]
    wide = [F.max(F.when(F.col(t) == s, F.col(v))).alias(f"{v}_t{s}") for v in sorted(values) for s in steps]
    return df.groupBy(*keys).agg(*wide, *stats)


def hash_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``is_train`` by a hash of the key, whatever the partitioning."""
    return df.withColumn("is_train", unit_hash(str(seed), F.col(key).cast("string")) < share)


def save(model, path: str) -> None:
    """Write a fitted pipeline where all executors can read it."""
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
