"""Connected components by contraction.

Each round, every node takes its smallest neighbour (or itself) as parent, parents are
replaced by their own parents until nothing moves (doubling the reach each time), and the
edges are rewritten between the roots. Every tree has two nodes at least, so the graph
shrinks geometrically; a star of any size and a path in order are one round.
Every step is an aggregate that combines before its shuffle or a join with one row per node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import stored


def roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place is linked to, over any number of links."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes with an edge.

    ``edges`` has whole numbers ``a`` and ``b``; order, repeats and loops do not matter.
    """
    pairs = lambda df: df.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    left = stored(pairs(edges), "edges")
    found = None
    while not left.isEmpty():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(
            left.select(F.col("a").alias("node"), F.col("b").alias("other"))
        )
        near = both.groupBy("node").agg(F.min("other").alias("other"))
        parent = stored(near.select("node", F.least("node", "other").alias("parent")), "parents")
        while True:
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            step = parent.join(above, "parent").select(
                "node", F.col("_above").alias("parent"), (F.col("_above") != F.col("parent")).alias("_moved")
            )
            parent = stored(step, "parents")
            if parent.filter("_moved").isEmpty():
                break
            parent = parent.drop("_moved")
        parent = parent.drop("_moved")
        if found is None:
            found = parent.withColumnRenamed("parent", "component")
        else:
            step = parent.select(F.col("node").alias("component"), F.col("parent").alias("_next"))
            found = stored(
                found.join(step, "component", "left").select(
                    "node", F.coalesce("_next", "component").alias("component")
                ),
                "components",
            )
        of = lambda name: parent.select(F.col("node").alias(name), F.col("parent").alias(f"_{name}"))
        moved = left.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = stored(pairs(moved), "edges")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
