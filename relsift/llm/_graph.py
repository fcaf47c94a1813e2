"""Connected components by alternating large-star and small-star steps, each a pair of shuffles.

Edges stay distributed: the driver sees only a count and a checksum each round. Minima are written
before edges meet them, so that Spark can split the join of a hub with very many neighbours. Each round
contracts the graph; once ALONE edges or fewer are left (16 MB), one task finishes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsift.llm._session import dropped, written

MAX_ROUNDS = 64
#: So many edges at most are one task's work.
ALONE = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour v of u is linked to the least of u and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    out = written(both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "star")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them. Edges have a > b here."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    dropped(least)
    return out


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: (node, root)."""
    held = [tuple(b.column(c).to_numpy() for c in ("a", "b")) for b in batches if len(b)]
    if not held:
        return
    node, root = forest(*map(np.concatenate, zip(*held)))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not the least of its component.

    a and b are longs. Self-links and repeated edges are allowed; an empty table gives an
    empty table.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new[0] <= alone:
            return now.repartition(1).mapInArrow(_alone, "node long, root long")
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
        star = _large_star(now)
        dropped(now)
        now = _small_star(star)
        dropped(star)
    raise RuntimeError("components did not settle")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to keep what the links a-b connect: each node but the least of its group, and that least one."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    loose = label != np.arange(len(nodes))
    return nodes[loose], nodes[label[loose]]
