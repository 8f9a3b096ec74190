"""Strong components, and reach on the graph of components.

Every vertex learns the smallest vertex that reaches it and the smallest that it reaches. Where both are the same, that one names
its component. Arcs between vertices whose pairs differ lie in no component and go, and what is left is asked again: as in a
quicksort, few times. Chains are contracted before, so long ones cost the logarithm of their length.

A core that can be broadcast is asked by every task in several random orders of its vertices at once, over arrays, so a level is
no round of jobs and hardly an arc between components is left to be asked again. Beyond the bound, by joins, until it is below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.operators.arrays import BROADCAST_ARCS, Arrays, combined
from trailgraph.operators.chains import BLOCK, contracted
from trailgraph.operators.fixpoint import SMALLEST, fixpoint
from trailgraph.operators.traverse import _over_sources, arcs_to_send, counted, hop_distances
from trailgraph.plans.durable import ship, stored
from trailgraph.plans.index import indexed
from trailgraph.sources.graphs import Graph

#: Random orders that a task asks at once at most, and bytes that their labels may take.
ORDERS = 16
LABEL_BYTES = 256 << 20


def smallest(g: Arrays, labels: np.ndarray) -> np.ndarray:
    """The smallest of the labels (a row per vertex, a column per order) of the vertices that reach each vertex, its own included."""
    labels, nodes = labels.copy(), np.arange(len(g.ids))
    while len(nodes):
        arcs = g.followed(nodes)
        if not len(arcs):
            break
        nodes, new = combined(g.head[arcs], g.tail[arcs], labels, np.minimum)
        before = labels[nodes]
        less = np.flatnonzero((new < before).any(axis=1))
        nodes = nodes[less]
        labels[nodes] = np.minimum(new[less], before[less])
    return labels


def _by_arrays(arcs: DataFrame, seed: int) -> DataFrame:
    """node, component, pattern of the vertices of arcs (src, dst), which are broadcast: of each task a row per vertex.

    component is a vertex of the strong component, the same for all in it, or null where no order of the task tells it; the pattern
    is a digest of all labels. What is found doesn't depend on the orders, only how much of it.
    """
    spark = arcs.sparkSession
    ship(spark)
    found = arcs.select("src", "dst").toArrow()
    tails, heads = (found.column(c).to_numpy() for c in ("src", "dst"))
    shared = spark.sparkContext.broadcast(Arrays(np.unique(np.concatenate([tails, heads])), tails, heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        n = len(g.ids)
        back, every = Arrays(np.arange(n), g.head, g.tail), max(1, min(ORDERS, LABEL_BYTES // (32 * n)))
        for task in (k for batch in batches for k in batch.column("id").to_pylist()):
            rng = np.random.default_rng((seed, task))
            orders = [rng.permutation(n) for _ in range(every)]
            labels = np.empty((n, every), np.int32)
            for k, order in enumerate(orders):
                labels[order, k] = np.arange(n)
            before, after = smallest(g, labels), smallest(back, labels)
            component, pattern = np.full(n, n), np.zeros(n, np.int64)
            for k, order in enumerate(orders):
                same = before[:, k] == after[:, k]
                component[same] = np.minimum(component[same], order[before[same, k]])
                for side in (before, after):
                    pattern += (side[:, k].astype(np.int64) + 1) * rng.integers(1 << 62)
            for at in range(0, n, 65536):
                own = component[at : at + 65536]
                names = pa.array(g.ids[np.minimum(own, n - 1)], mask=own == n)
                yield pa.RecordBatch.from_pydict({"node": g.ids[at : at + 65536], "component": names, "pattern": pattern[at : at + 65536]})

    tasks = spark.sparkContext.defaultParallelism
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "node long, component long, pattern long")


def _labelled(arcs: DataFrame, seed: int) -> DataFrame:
    """node, component, pattern: a vertex that names the strong component, null where it isn't found yet. Vertices of one component have the same pattern."""
    if arcs.count() <= BROADCAST_ARCS:
        return stored(_by_arrays(arcs, seed).groupBy("node").agg(F.min("component").alias("component"), F.bit_xor("pattern").alias("pattern")), "labels")
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    before = _smallest(arcs, nodes, "before")
    after = _smallest(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes, "after")
    return stored(before.join(after, "node").select("node", F.expr("CASE WHEN before = after THEN before END AS component"), F.xxhash64("before", "after").alias("pattern")), "labels")


def _smallest(arcs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """node, name: the smallest vertex that reaches each of nodes along arcs (src, dst), itself included."""
    index = indexed(arcs)
    found = fixpoint(index, nodes.select("node", F.lit(0).cast("long").alias("key"), F.col("node").alias("value")), SMALLEST)
    out = stored(found.groupBy("node").agg(F.min("value").alias(name)), name)
    index.discard()
    return out


def strong_components(graph: Graph) -> DataFrame:
    """node, component: the smallest vertex of the set in which each reaches each."""
    c = contracted(graph)
    arcs, found = c.arcs.select("src", "dst"), []
    while not arcs.isEmpty():
        labels = _labelled(arcs, len(found))
        found.append(labels.where("component IS NOT NULL").select("node", "component"))
        open_ = labels.where("component IS NULL")
        a, b = (open_.select(F.col("node").alias(side), F.col("pattern").alias(f"of_{side}")) for side in ("src", "dst"))
        arcs = stored(arcs.join(a, "src").join(b, "dst").where("of_src = of_dst").select("src", "dst"), "arcs")
    core = c.core.withColumnRenamed("id", "node")
    core = core.join(reduce(DataFrame.union, found), "node", "left") if found else core.withColumn("component", F.lit(None).cast("long"))
    alone = stored(core.select("node", F.coalesce("component", "node").alias("component")), "components")
    # A chain lies in its ends' component if they share one, and else its vertices are alone. It may hold that component's smallest.
    ends = c.chains.join(alone.select(F.col("node").alias("tail"), F.col("component").alias("one")), "tail").join(alone.select(F.col("node").alias("head"), F.col("component").alias("two")), "head")
    shared = ends.where("one = two").select("chain", F.col("one").alias("component"))
    members = c.places.join(shared, "chain", "left").select("node", F.coalesce("component", "node").alias("component"))
    every = stored(alone.union(members), "components")
    names = every.groupBy("component").agg(F.min("node").alias("name"))
    return every.join(names, "component").select("node", F.col("name").alias("component"))


def condensed(graph: Graph, components: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of components (node, component), which has no rings, and their sizes (component, size)."""
    a, b = (components.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in ("src", "dst"))
    arcs = graph.edges.join(a, "src").join(b, "dst").where("of_src <> of_dst").select(F.col("of_src").alias("src"), F.col("of_dst").alias("dst"))
    sizes = stored(components.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    return Graph.of(stored(arcs.distinct(), "arcs"), sizes.select(F.col("component").alias("id"))), sizes


def _weighed(core: Graph, weights: DataFrame, strategy: str) -> DataFrame:
    """node, others: the sum of the weights (id, weight) of the other vertices that reach a vertex, where there are any.

    Over a graph that can be broadcast a task sends a row per vertex, and no pairs are made: the sources' bits are counted once
    for each binary digit of the weights. Else by pairs.
    """
    arcs = arcs_to_send(core, strategy) if strategy in ("auto", "bits") else None
    if arcs is None:
        pairs = hop_distances(core, strategy=strategy).join(weights.withColumnRenamed("id", "src"), "src")
        return pairs.groupBy("node").agg(F.sum("weight").alias("others"))
    sources = weights.join(core.edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    table = sources.toArrow().sort_by("id")
    shared = core.spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("id", "weight")))

    def by_node(g: Arrays, batches: Iterator) -> Iterator[dict[str, np.ndarray]]:
        (ids, weight), total = shared.value, np.zeros(len(g.ids), np.int64)
        for own, levels in batches:
            w = np.zeros(-(-len(own) // 64) * 64, np.int64)
            w[: len(own)] = weight[np.searchsorted(ids, own)]
            digits = [(k, np.packbits(w >> k & 1, bitorder="little").view(np.uint64)) for k in range(int(w.max()).bit_length())]
            digits = [(k, mask) for k, mask in digits if mask.any()]
            for d, nodes, bits in levels:
                if d:
                    for k, mask in digits:
                        total[nodes] += counted(bits & mask) << k
        some = np.flatnonzero(total)
        for at in range(0, len(some), 65536):
            yield {"node": g.ids[some[at : at + 65536]], "others": total[some[at : at + 65536]]}

    parts = _over_sources(arcs, sources.select(F.col("id").alias("src")), by_node, "node long, others long", None)
    return parts.groupBy("node").agg(F.sum("others").alias("others"))


def _others(graph: Graph, sizes: DataFrame, strategy: str) -> DataFrame:
    """component, others: the summed sizes (component, size) of the other vertices that reach each vertex of a graph without rings.

    Chains are contracted. All of a chain reaches its head, so it weighs there; its own vertices are reached by what reaches its
    tail, the tail, and those before them in the chain.
    """
    c, none = contracted(graph), F.lit(0).cast("long")
    size = sizes.withColumnRenamed("component", "node")
    placed = stored(c.places.join(size, "node").withColumn("block", F.floor((F.col("at") - 1) / BLOCK)), "placed")
    earlier = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    blocks = placed.groupBy("chain", "block").agg(F.sum("size").alias("total"))
    blocks = stored(blocks.withColumn("earlier", F.coalesce(F.sum("total").over(earlier), none)), "blocks")
    inside = Window.partitionBy("chain", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(blocks, ["chain", "block"]).select("node", "chain", (F.col("earlier") + F.coalesce(F.sum("size").over(inside), none)).alias("ahead"))
    whole = c.chains.join(blocks.groupBy("chain").agg(F.sum("total").alias("total")), "chain").groupBy(F.col("head").alias("node")).agg(F.sum("total").alias("led"))
    core = c.core.withColumnRenamed("id", "node").join(size, "node").join(whole, "node", "left").select("node", "size", F.coalesce("led", none).alias("led"))
    core = stored(core, "weights")
    sums = _weighed(Graph(c.core, c.arcs.select("src", "dst")), core.select(F.col("node").alias("id"), (F.col("size") + F.col("led")).alias("weight")), strategy)
    core = stored(core.join(sums, "node", "left").select("node", "size", (F.col("led") + F.coalesce("others", none)).alias("others")), "others")
    tails = c.chains.join(core.withColumnRenamed("node", "tail"), "tail").select("chain", (F.col("others") + F.col("size")).alias("others"))
    members = placed.join(tails, "chain").select("node", (F.col("others") + F.col("ahead")).alias("others"))
    return core.select("node", "others").union(members).withColumnRenamed("node", "component")


def reach_by_components(graph: Graph, direction: str = "in", strategy: str = "auto") -> DataFrame:
    """node, reach: how many others reach a vertex (`in`) or are reached by it (`out`), by the components that do, with their sizes.

    Vertices with a reach of 0 are absent, as in centrality.reach. Only components are traversed: one giant one is one vertex, and
    chains of them are contracted.
    """
    if direction not in ("out", "in"):
        raise ValueError(f"unknown direction {direction}")
    components = stored(strong_components(graph), "components")
    small, sizes = condensed(graph, components)
    small = small.transpose() if direction == "out" else small
    reach = sizes.join(_others(small, sizes, strategy), "component").select("component", (F.col("size") - 1 + F.col("others")).alias("reach"))
    return components.join(reach.where("reach > 0"), "component").select("node", "reach")
