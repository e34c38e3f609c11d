"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import checkpointed


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to ``n`` - 1 of a task the smallest that it is connected with over the edges ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        a, b, x, y = (v[x != y] for v in (a, b, x, y))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return root


def united(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(u, v)``, longs: the smallest node that it is connected with.

    Each round takes the smallest root among a node's neighbours', and the root's own root in turn, so that ways double; rounds are
    checkpointed and end when none changes. Edges of a node with itself are allowed.
    """
    both = checkpointed(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u is not null and v is not null").distinct())
    roots = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("now"))
        # What a node's old root has learnt goes to the node as well.
        learnt = step.groupBy(F.col("root").alias("old")).agg(F.min("now").alias("least"))
        new = step.join(learnt, step["root"] == learnt["old"]).select("node", F.col("root").alias("was"), F.least("now", "least").alias("root"))
        new = checkpointed(new)
        above = new.select(F.col("node").alias("root"), F.col("root").alias("__top"))
        new = checkpointed(new.join(above, "root").select("node", "was", F.least("root", "__top").alias("root")))
        changed = new.where("root <> was").limit(1).count()
        roots = new.drop("was")
        if not changed:
            return roots
