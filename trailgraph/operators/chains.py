"""Deep graphs: chains of vertices with one arc in and one out become single arcs with a length.

Places in a chain are found by pointer jumping, in as many rounds as the logarithm of the longest chain. What is left, the core,
is traversed with lengths; a chain's vertices follow from where it begins. A traversal then takes as many rounds as a path has
arcs in the core, not as it has hops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.operators.arrays import BROADCAST_ARCS, Arrays, combined
from trailgraph.operators.fixpoint import LEAST, fixpoint
from trailgraph.plans.durable import ship, stored
from trailgraph.plans.index import BROADCAST_ROWS, indexed, met
from trailgraph.sources.graphs import Graph

#: Vertices of a chain that are expanded in one group.
BLOCK = 4096
#: Sources times arcs up to which a core of at most BROADCAST_ARCS arcs is traversed as arrays, and bytes that a task's distances may take.
ARRAY_WORK = 10**10
DISTANCE_BYTES = 256 << 20


@dataclass
class Contracted:
    """core (id) and arcs (src, dst, w) between its vertices; chains (chain, tail, head, length); places (node, chain, at).

    A chain leads from the core's vertex tail over `length` others, at 1 to length, to head. It is named by its first. Of a large
    graph no table is sent whole in joins.
    """

    core: DataFrame
    arcs: DataFrame
    chains: DataFrame
    places: DataFrame
    large: bool


def contracted(graph: Graph, keep: DataFrame | None = None) -> Contracted:
    """Contracts all chains, but for the vertices of keep (src), which stay in the core. Of a ring, its smallest vertex stays."""
    edges = stored(graph.edges.where("src <> dst"), "arcs")
    large = edges.count() > BROADCAST_ROWS
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("before"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("after"))
    inner = met(ins.where("ins = 1"), outs.where("outs = 1"), "node", large=large)
    if keep is not None:
        inner = met(inner, keep.select(F.col("src").alias("node")).distinct(), "node", "left_anti", large)
    inner = stored(inner.select("node", "before", "after"), "inner")
    places, rings = _placed(inner, large)
    if rings is not None:
        least = stored(rings.where("node = low").select("node"), "least")
        again, _ = _placed(met(met(inner, rings.select("node"), "node", "left_semi", large), least, "node", "left_anti", large), large)
        places = stored(places.union(again), "places")
        inner = met(inner, least, "node", "left_anti", large)
    ends = places.groupBy("chain").agg(F.max("at").alias("length"), F.max_by("node", "at").alias("last"))
    tails = inner.select(F.col("node").alias("chain"), F.col("before").alias("tail"))
    heads = inner.select(F.col("node").alias("last"), F.col("after").alias("head"))
    chains = stored(met(met(ends, tails, "chain", large=large), heads, "last", large=large).select("chain", "tail", "head", "length"), "chains")
    members = places.select(F.col("node").alias("id"))
    core = stored(met(graph.vertices, members, "id", "left_anti", large), "core")
    plain = met(met(edges, members.withColumnRenamed("id", "src"), "src", "left_anti", large), members.withColumnRenamed("id", "dst"), "dst", "left_anti", large)
    arcs = plain.select("src", "dst", F.lit(1).cast("long").alias("w"))
    arcs = arcs.union(chains.where("tail <> head").select(F.col("tail").alias("src"), F.col("head").alias("dst"), F.col("length") + 1))
    return Contracted(core, stored(arcs.groupBy("src", "dst").agg(F.min("w").alias("w")), "arcs"), chains, places, large)


def _placed(inner: DataFrame, large: bool) -> tuple[DataFrame, DataFrame | None]:
    """Places (node, chain, at) of the vertices in inner (node, before), and the rings among them (node, low), low the ring's smallest.

    A vertex points to one before it, with the steps to there. Following the pointer of where it points doubles the steps, until
    all point to a chain's first. While any chain has vertices left, one of them arrives in each round.
    """
    inside = inner.select(F.col("node").alias("before"), F.lit(True).alias("inside"))
    first = F.col("inside").isNull()
    start = met(inner.select("node", "before"), inside, "before", "left", large)
    start = start.select("node", F.when(first, F.col("node")).otherwise(F.col("before")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("steps"), first.alias("done"), F.col("node").alias("low"))
    start = stored(start, "pointers")
    arrived, left = [start.where("done")], start.where("NOT done")
    many, before = left.count(), None
    while many and many != before:
        left = stored(_jumped(left, arrived, large), "pointers")
        arrived.append(left.where("done"))
        left, before = left.where("NOT done"), many
        many = left.count()
    places = arrived[0]
    for more in arrived[1:]:
        places = places.union(more)
    places = stored(places.select("node", F.col("to").alias("chain"), (F.col("steps") + 1).alias("at")), "places")
    if not many:
        return places, None
    lows, now = None, tuple(left.agg(F.sum("low"), F.bit_xor(F.xxhash64("node", "low"))).first())
    while now != lows:
        left, lows = stored(_jumped(left, [], large), "rings"), now
        now = tuple(left.agg(F.sum("low"), F.bit_xor(F.xxhash64("node", "low"))).first())
    return places, left.select("node", "low")


def _jumped(left: DataFrame, arrived: list[DataFrame], large: bool) -> DataFrame:
    """Every pointer of left moved on by the pointer that it leads to."""
    targets = left
    for more in arrived:
        targets = targets.union(more)
    targets = targets.select(F.col("node").alias("to"), F.col("to").alias("on"), F.col("steps").alias("more"), F.col("done").alias("there"), F.col("low").alias("lower"))
    both = met(left.drop("done"), targets, "to", large=large)
    return both.select("node", F.col("on").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"), F.least("low", "lower").alias("low"))


def _core_distances(c: Contracted, sources: DataFrame, told: Callable[[int, int], None] | None) -> DataFrame:
    """src, node, d between the sources and the core's vertices; a source reaches itself at 0.

    Over a core that can be broadcast, from few sources or if it is small, by tasks of some sources each; else, or if told is given, by joins.
    """
    arcs = c.arcs.count()
    if told is None and arcs <= BROADCAST_ARCS and sources.count() * arcs <= ARRAY_WORK:
        return stored(_by_arrays(c.arcs, sources), "distances")
    index = indexed(c.arcs)
    found = fixpoint(index, sources.select(F.col("src").alias("node"), F.col("src").alias("key"), F.lit(0).cast("long").alias("value")), LEAST, told=told)
    out = stored(found.groupBy(F.col("key").alias("src"), "node").agg(F.min("value").alias("d")), "distances")
    index.discard()
    return out


def nearest(g: Arrays, w: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The distances by lengths w of the arcs, which are by head, to each vertex (row) from the vertices at the places sources (column); -1 is none."""
    far = np.iinfo(np.int64).max >> 1
    state = np.full((len(g.ids), len(sources)), far)
    state[sources, np.arange(len(sources))] = 0
    nodes, row = np.unique(sources), np.zeros(len(g.ids), np.int32)
    now = state[nodes]
    while len(nodes):
        arcs = g.followed(nodes)
        if not len(arcs):
            break
        row[nodes] = np.arange(len(nodes))
        nodes, new = combined(g.head[arcs], np.arange(len(arcs)), now[row[g.tail[arcs]]] + w[arcs, None], np.minimum)
        before = state[nodes]
        less = np.flatnonzero((new < before).any(axis=1))
        nodes, now = nodes[less], np.minimum(new[less], before[less])
        state[nodes] = now
    return np.where(state < far, state, -1)


def _by_arrays(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """src, node, d from each source along arcs (src, dst, w), which are broadcast."""
    spark = sources.sparkSession
    ship(spark)
    found = arcs.select("src", "dst", "w").toArrow()
    tails, heads, w = (found.column(c).to_numpy() for c in ("src", "dst", "w"))
    g = Arrays(np.unique(np.concatenate([tails, heads])), tails, heads)
    shared = spark.sparkContext.broadcast((g, w[np.argsort(np.searchsorted(g.ids, heads), kind="stable")]))
    at_once = max(1, min(64, DISTANCE_BYTES // (32 * max(1, len(g.ids) + len(tails)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w = shared.value
        for batch in batches:
            every = batch.column("src").to_numpy(zero_copy_only=False)
            known = np.isin(every, g.ids)
            alone = every[~known]
            yield pa.RecordBatch.from_pydict({"src": alone, "node": alone, "d": np.zeros(len(alone), np.int64)})
            for k in range(0, known.sum(), at_once):
                some = every[known][k : k + at_once]
                d = nearest(g, w, np.searchsorted(g.ids, some))
                for at in range(0, len(d), 1 << 14):
                    node, source = np.nonzero(d[at : at + (1 << 14)] >= 0)
                    yield pa.RecordBatch.from_pydict({"src": some[source], "node": g.ids[node + at], "d": d[node + at, source]})

    return sources.select("src").repartition(spark.sparkContext.defaultParallelism, "src").mapInArrow(run, "src long, node long, d long")


def _expanded(rows: DataFrame, c: Contracted, length: str) -> DataFrame:
    """rows (chain, its length and others) with the chain's vertices, node and at; in blocks, so a long chain is no hot group."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(length) - 1) / BLOCK))
    places = c.places.withColumn("block", F.floor((F.col("at") - 1) / BLOCK))
    return met(rows.withColumn("block", F.explode(blocks)), places, ["chain", "block"], large=c.large)


def mostly_chains(graph: Graph) -> bool:
    """Whether at least two thirds of the vertices with arcs have one in and one out, so that the core has at most about a ninth of the pairs."""
    arcs, one, none = graph.edges.where("src <> dst"), F.lit(1), F.lit(0)
    ends = arcs.select(F.col("src").alias("node"), one.alias("outs"), none.alias("ins")).union(arcs.select("dst", none, one))
    inner = F.expr("CAST(outs = 1 AND ins = 1 AS INT)")
    many, n = ends.groupBy("node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins")).agg(F.sum(inner), F.count(one)).first()
    return bool(many) and 3 * many >= 2 * n


@dataclass
class Ends:
    """core (src, node, d) between the core's vertices; and of every vertex its chain and place (null in the core), where its chain leaves to (head, after more hops) and comes from (tail, at hops)."""

    core: DataFrame
    every: DataFrame


def _ends(graph: Graph) -> Ends:
    c = contracted(graph)
    core = _core_distances(c, c.core.select(F.col("id").alias("src")), None)
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    alone = c.core.select(F.col("id").alias("node"), none.alias("chain"), zero.alias("at"), F.col("id").alias("head"), zero.alias("more"), F.col("id").alias("tail"))
    inside = met(c.places, c.chains, "chain", large=c.large).select("node", "chain", "at", "head", (F.col("length") + 1 - F.col("at")).alias("more"), "tail")
    return Ends(core, stored(alone.union(inside), "ends"))


def _ahead(every: DataFrame) -> DataFrame:
    """src, node, d of the pairs of which the second follows the first in its chain; each chain's pairs, over blocks of its places."""
    places = every.where("chain IS NOT NULL").select("node", "chain", "at", F.floor((F.col("at") - 1) / BLOCK).alias("block"))
    most = places.groupBy("chain").agg(F.max("block").alias("last"))
    first = places.join(most, "chain").select(F.col("node").alias("src"), "chain", F.col("at").alias("from"), F.explode(F.sequence("block", "last")).alias("block"))
    return first.join(places, ["chain", "block"]).where("at > from").select("src", "node", (F.col("at") - F.col("from")).alias("d"))


def all_distances(graph: Graph, include_start: bool = False) -> DataFrame:
    """src, node, d from all vertices: ahead in one's chain, or out by its head, through the core and in by the other's tail."""
    e = _ends(graph)
    out = e.every.select(F.col("node").alias("u"), F.col("head").alias("src"), "more", F.col("chain").alias("of"), F.col("at").alias("from"))
    into = e.every.select(F.col("node").alias("v"), F.col("tail").alias("node"), "at", "chain")
    through = e.core.join(out, "src").join(into, "node")
    # Behind in the same chain is reached around; ahead of it is nearer along the chain, and a core's vertex reaches itself at 0.
    through = through.where("chain IS NULL OR of IS NULL OR chain <> of OR at < from").where("u <> v")
    pairs = through.select(F.col("u").alias("src"), F.col("v").alias("node"), (F.col("d") + F.col("more") + F.col("at")).alias("d")).union(_ahead(e.every))
    if include_start:
        pairs = pairs.union(graph.vertices.select("id", "id", F.lit(0).cast("long")))
    return pairs


def all_levels(graph: Graph) -> DataFrame:
    """node, d, n as traverse.node_levels has them from all vertices: all that come to a chain's tail are counted there once, by distance, not for each of its vertices.

    Of the counts that a chain's vertex takes from there, those of the vertices behind it in the chain, which come around, stay; its own
    and those of the vertices before it go, as these are nearer along the chain.
    """
    e = _ends(graph)
    out = e.every.select("node", F.col("head").alias("src"), "more")
    core = e.core.withColumnRenamed("node", "tail")
    x = (F.col("d") + F.col("more")).alias("x")
    at_tail = core.join(out, "src").groupBy("tail", x).agg(F.count("*").alias("n"))
    parts = e.every.select("node", "tail", "at").join(at_tail, "tail").select("node", (F.col("x") + F.col("at")).alias("d"), "n")
    chained = e.every.where("chain IS NOT NULL")
    # From place j of a chain around to place i; those with j <= i are taken off again.
    back = chained.select("chain", "at", "node", F.col("head").alias("src"), "tail", "more").join(core, ["src", "tail"])
    last = F.col("d") + F.col("at") + F.col("more")  # from the vertex to itself around, the length of the round
    off = back.select("node", F.explode(F.sequence(last, last + F.col("at") - 1)).alias("d"), F.lit(-1).cast("long").alias("n"))
    along = chained.where("at > 1").select("node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("at") - 1)).alias("d"), F.lit(1).cast("long").alias("n"))
    return parts.union(off).union(along).where("d > 0").groupBy("node", "d").agg(F.sum("n").alias("n")).where("n > 0")


def distances(graph: Graph, sources: DataFrame, include_start: bool = False, told: Callable[[int, int], None] | None = None) -> DataFrame:
    """src, node, d as traverse.hop_distances has them, by contraction."""
    sources = stored(sources.select("src").distinct(), "sources")
    c = contracted(graph, sources)
    core = _core_distances(c, sources, told)
    begun = met(core, c.chains.withColumnRenamed("tail", "node"), "node", large=c.large).select("src", "chain", "length", "d")
    inside = _expanded(begun, c, "length").select("src", "node", (F.col("d") + F.col("at")).alias("d"))
    return (core if include_start else core.where("d > 0")).union(inside)


def summary(graph: Graph, sources: DataFrame | None = None, told: Callable[[int, int], None] | None = None) -> DataFrame:
    """src, ecc, dist_sum, reach as traverse.bfs_summary has them, by contraction; no chain is expanded.

    From all vertices, the core is traversed from its own vertices, and a chain's vertex at place i of m follows from the head:
    it reaches m - i vertices ahead, the head after m - i + 1 hops, and what the head reaches that much later, but for those of
    its own chain from i on, which it has met already.
    """
    every = sources is None
    keep = None if every else stored(sources.select("src").distinct(), "sources")
    c = contracted(graph, keep)
    core = _core_distances(c, c.core.select(F.col("id").alias("src")) if every else keep, told)
    begun = stored(met(core, c.chains.withColumnRenamed("tail", "node"), "node", large=c.large).select("src", "chain", "length", "d"), "begun")
    far, length = F.col("d") + F.col("length"), F.col("length")
    none = F.lit(None).cast("long")
    parts = core.select("src", F.col("d").alias("far"), F.col("d").alias("sum"), F.lit(1).cast("long").alias("n"), none.alias("chain"))
    parts = parts.union(begun.select("src", far, length * F.col("d") + F.expr("length * (length + 1) div 2"), length, "chain"))
    # top: the farthest chain, with its name; those of the core have none.
    own = stored(parts.groupBy("src").agg(F.max("far").alias("ecc"), F.sum("sum").alias("dist_sum"), (F.sum("n") - 1).alias("reach"), F.max(F.struct("far", "chain")).alias("top")), "summary")
    out = own.select("src", "ecc", "dist_sum", "reach")
    if not every:
        return out
    second = met(begun, own.select("src", F.col("top.chain").alias("top")), "src", large=c.large).where("chain <> top").groupBy("src").agg(F.max(far).alias("far"))
    second = met(core.groupBy("src").agg(F.max("d").alias("d")), second, "src", "left", c.large).select("src", F.greatest("d", "far").alias("second"))
    heads = met(own, second, "src", large=c.large).withColumnRenamed("src", "head")
    back = begun.select(F.col("src").alias("head"), "chain", F.col("d").alias("back"))
    ahead = met(c.chains.select("chain", "head", F.col("length").alias("m")), heads, "head", large=c.large)
    ahead = met(ahead, back, ["head", "chain"], "left", c.large)
    # A head's own greatest distance without the chain itself: the second one where the chain is the farthest.
    ahead = stored(ahead.withColumn("others", F.when(F.col("top.chain") == F.col("chain"), F.col("second")).otherwise(F.col("ecc"))), "ahead")
    both = _expanded(ahead, c, "m").withColumn("r", F.expr("m - at + 1"))
    again = F.col("back").isNotNull()
    ecc = F.col("r") + F.greatest(F.col("others"), F.when(again & (F.col("at") > 1), F.col("back") + F.col("at") - 1).otherwise(F.lit(0)))
    total = F.expr("(r - 1) * r div 2 + r + dist_sum + r * reach") - F.when(again, F.expr("r * (r + back) + (m * (m + 1) - (at - 1) * at) div 2")).otherwise(F.lit(0))
    reach = F.expr("r + reach") - F.when(again, F.col("r")).otherwise(F.lit(0))
    return out.union(both.select(F.col("node").alias("src"), ecc, total, reach))
