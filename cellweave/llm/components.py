"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import checkpointed


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex) that connect what the edges ``a``-``b`` connect."""
    if not len(a):
        return a, b
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertices))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(label)))
    return vertices[other], vertices[label[other]]


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges of integers to ``(u, v)``: each vertex but the smallest of its component, with that smallest.

    Every round writes its edges to the checkpoint folder. A star moves through joins on a vertex, whose
    frequent keys the adaptive planner splits, and never gathers a neighbourhood. Edges of a vertex with
    itself and nulls are ignored. The number of rounds is logarithmic in a component's diameter.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v"))
        small = small.unionByName(lows.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(small)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges
