"""Per-vertex measures from hop distances, of their levels or of the sums over these. Direction `out` uses distances from the vertex, `in` those to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.functions.scalars import bucket, closeness_sample_size, ratio, sample_size
from trailgraph.operators import sketches
from trailgraph.operators.sampling import connected_pairs, uniform
from trailgraph.operators.traverse import node_levels, node_sums
from trailgraph.plans.durable import stored
from trailgraph.sources.graphs import Graph


def levels(graph: Graph, direction: str = "out", sources: DataFrame | None = None) -> DataFrame:
    """node, d, n. Traversing the transpose from all sources gives each vertex its out-distances. Repeated sources count again."""
    if direction not in ("out", "in"):
        raise ValueError(f"unknown direction {direction}")
    return node_levels(graph.transpose() if direction == "out" else graph, sources)


def sums(graph: Graph, direction: str = "out", sources: DataFrame | None = None) -> DataFrame:
    """node, reach, dist_sum, nearness (the sum of 1 / (1 + d)): what the measures below need of the levels, without a row per level."""
    if direction not in ("out", "in"):
        raise ValueError(f"unknown direction {direction}")
    return node_sums(graph.transpose() if direction == "out" else graph, sources).select("node", "reach", "dist_sum", "nearness")


def _sums(found: DataFrame) -> DataFrame:
    """The sums of found, which has them already or has levels."""
    if "n" not in found.columns:
        return found
    near = F.sum(F.col("n") * (F.lit(1.0) / (F.lit(1.0) + F.col("d"))))
    return found.groupBy("node").agg(F.sum("n").alias("reach"), F.sum(F.col("d") * F.col("n")).alias("dist_sum"), near.alias("nearness"))


def reach(found: DataFrame) -> DataFrame:
    return _sums(found).select("node", "reach")


def distance_sum(found: DataFrame) -> DataFrame:
    return _sums(found).select("node", "dist_sum")


def closeness(found: DataFrame, n: int, scale: str = "raw") -> DataFrame:
    """node, c: 1 / (sum of distances * n), or with scale `mean` n / sum; n is the number of sources. Vertices without distances are absent."""
    total = distance_sum(found).where("dist_sum > 0")
    if scale == "mean":
        return total.select("node", ratio(F.lit(n), F.col("dist_sum")).alias("c"))
    return total.select("node", (F.lit(1.0) / (F.col("dist_sum") * F.lit(n))).alias("c"))


def harmonic(found: DataFrame, n: int) -> DataFrame:
    """node, c: the sum of 1 / (1 + d) over n sources; the vertex itself is left out."""
    return _sums(found).select("node", (F.col("nearness") * (F.lit(1.0) / F.lit(float(n)))).alias("c"))


def sampled_closeness(graph: Graph, eps: float = 0.1, seed: int = 42, direction: str = "out") -> DataFrame:
    """node, c: closeness from draws with replacement of vertices that reach another against the direction, in proportion to how many.

    As many draws as the error eps takes, whatever the number of vertices. Values are on the draws' own scale: compare ranks.
    """
    k = closeness_sample_size(eps)
    walked = graph.transpose() if direction == "out" else graph
    draws = connected_pairs(walked, k, seed).select(F.col("v").alias("src"))
    return closeness(sums(graph, direction, draws), k)


def sampled_harmonic(graph: Graph, eps: float = 0.1, seed: int = 42, direction: str = "out") -> DataFrame:
    """node, c: harmonic centrality from uniform draws of vertices with replacement, as many as the error eps takes."""
    k = sample_size(graph.vertices.count(), eps)
    return harmonic(sums(graph, direction, uniform(graph, k, seed).select(F.col("v").alias("src"))), k)


def indices(found: DataFrame) -> DataFrame:
    """node, reach, dist_sum, lin (reach^2 / sum) and nieminen (reach^2 - sum)."""
    square = F.col("reach") * F.col("reach")
    return _sums(found).select("node", "reach", "dist_sum", ratio(square, F.col("dist_sum")).alias("lin"), (square - F.col("dist_sum")).alias("nieminen"))


def ranking(c: DataFrame) -> DataFrame:
    """By value, the greatest first; ties by node."""
    return c.orderBy(F.desc("c"), F.asc("node"))


def buckets(c: DataFrame, scale: float = 1e9) -> DataFrame:
    """bucket, cnt, members in order, the highest bucket first. A bucket's members are one row: meant for reports."""
    own = c.groupBy(bucket(F.col("c"), scale).alias("bucket")).agg(F.count("*").alias("cnt"), F.array_sort(F.collect_list("node")).alias("members"))
    return own.orderBy(F.desc("bucket"))


def histogram(c: DataFrame, scale: float = 1e6) -> DataFrame:
    """bucket, lo, hi, cnt of the buckets that aren't empty, the highest first."""
    own = c.groupBy(bucket(F.col("c"), scale).alias("bucket")).agg(F.count("*").alias("cnt"))
    return own.select("bucket", (F.col("bucket") / F.lit(scale)).alias("lo"), ((F.col("bucket") + 1) / F.lit(scale)).alias("hi"), "cnt").orderBy(F.desc("bucket"))


def equal_width(c: DataFrame, bins: int = 10) -> DataFrame:
    """bin, cnt over `bins` equal widths between the least and the greatest value; the last bin holds the greatest. Empty bins are absent."""
    c = stored(c.select("c"), "values")  # asked for twice, and made once
    low, high = c.agg(F.min("c"), F.max("c")).first()
    if low is None:
        return c.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("cnt")).limit(0)
    at = F.lit(0) if high == low else F.least(F.floor((F.col("c") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
    return c.where("c IS NOT NULL").groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("cnt"))


def approximate_reach(graph: Graph, precision: int = sketches.PRECISION) -> DataFrame:
    """node, reach (an estimate, the vertex left out) by sketches that flow against the arcs until nothing changes, however deep the graph."""
    return sketches.measures(graph, precision).select("node", "reach")
