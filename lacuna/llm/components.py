"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a minimum per node (with partial aggregation) and a join; no list of neighbours is ever gathered. The
edges of a node that has more than its share of them all are not dealt by it, so the middle of a large star is no
task's lot. Each round's edges are checkpointed to the shared folder, so executors may be lost at any time.

``forest`` is for inside a task: it joins what numpy arrays of pairs link, and keeps no pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, join_counted


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the least neighbour v of each u, and how many there are."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


#: So few edges are no burden to a task, whichever node has them.
PLAIN_EDGES = 100_000


def _joined(edges: DataFrame, least: DataFrame, size: int) -> DataFrame:
    return edges.join(least.drop("n"), "u") if size <= PLAIN_EDGES else join_counted(edges, least, "u", "n", total=size)


def _round(edges: DataFrame, size: int) -> DataFrame:
    """One large-star and one small-star step over ``size`` edges (u, v) with u > v."""
    both = edges.union(edges.select("v", "u"))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    large = _joined(both, least, 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = _least(large)
    small = _joined(large, least, size).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", "m")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.crc32(F.concat_ws(":", "u", "v")))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (u, v): ``root`` is the least node of its component, itself a row too."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    last, state = None, _state(edges)
    while state != last:
        edges = cut(_round(edges, state[0]))
        last, state = state, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def forest(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join in place: afterwards rows that pairs (u, v) link, however far, have equal labels, the least row among them."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:  # point every row at its root
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
