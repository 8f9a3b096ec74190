"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on tables only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to rows (node, component) for every node that isn't the smallest of its component.

    Each round writes its edges to the shared folder; neighbours are never gathered in one place. Loops and repeated edges
    don't matter, edges with a null end are left out, no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges", now[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", now[0])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over links i - j: so many links become at most n."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
