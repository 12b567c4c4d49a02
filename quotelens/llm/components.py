"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import discard, stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the least node of each one's component, in one process."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all() and (label[x] == label[y]).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the least node that links reach.

    Every step is a pair of aggregations and equi-joins of stored tables; nothing is gathered on the driver, and a
    node with many links is only ever reduced by partial aggregation or split by adaptive joins. Self-links give a
    component of one; an empty table gives an empty result.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, edges = edges, stored(linked.union(small.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
        n = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if n == before:
            break
        before = n
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
