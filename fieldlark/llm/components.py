"""Connected components of an edge table, without gathering it anywhere.

What lies together in a task is contracted first, in chunks of bounded size.
Then rounds of a large-star and a small-star step, each written to the shared
folder, make the table smaller, until it fits one chunk, which a task contracts
to the end, or until it stays the same. Labels end as (node, root) with the
smallest node as root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDGES = "a long, b long"


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest node of its component) that connect what the edges connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _local(chunk: int):
    def run(batches):
        held, size = [], 0

        def flush():
            a = np.concatenate([h[0] for h in held])
            b = np.concatenate([h[1] for h in held])
            a, b = contract(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=common.batches_of(EDGES))

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= chunk:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (a, b), a > b. Large star: of each node, the larger neighbours go to its smallest; small star: the others."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # stored, so that the joins below are of two shuffled tables, of which adaptive execution splits a hub's edges
    low = common.stored(both.groupBy("a").agg(F.min("b").alias("m")), "lows")
    if small:
        joined = both.join(low, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    else:
        moved = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, chunk: int = 1_000_000, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node it reaches.

    ``edges`` has two long columns a and b in any order and number; loops are
    ignored, an empty table gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = common.stored(e.mapInArrow(_local(chunk), EDGES).distinct(), "edges")
    before, n = None, e.count()
    for _ in range(rounds):
        if n <= chunk:
            e = common.stored(e.coalesce(1).mapInArrow(_local(chunk), EDGES), "edges")
            break
        e = common.stored(_star(_star(e, False), True), "edges")
        sums = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(sums) == before:
            break
        before, n = tuple(sums), sums[0]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
