"""What a task sends and holds, which has to follow from the graph and not from the number of its pairs or levels."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.brute import distances
from trailgraph.operators import arrays, centrality, chains, components, sketches, traverse
from trailgraph.plans import index

#: Two paths into a hub of 40 arcs in and 40 out, a tail of 6 levels beside it, a loop and a vertex alone.
ARCS = [(i, 50) for i in range(40)] + [(50, 60 + i) for i in range(40)] + [(i, i + 1) for i in range(99, 105)] + [(0, 1), (1, 2), (45, 0), (7, 7)]
N = 108


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(traverse, "SOURCES_AT_ONCE", 64)


def test_sums_are_a_row_per_task_and_vertex(spark, graph, small_batches):
    g, far = graph(ARCS, N), distances(ARCS, range(N))
    parts = traverse._node_parts(traverse.arcs_to_send(g, "bits"), traverse.all_sources(g))
    rows, tasks, nodes = parts.agg(F.count("*"), F.lit(spark.sparkContext.defaultParallelism), F.count_distinct("node")).first()
    assert nodes <= rows <= tasks * nodes < g.edges.count() * 30
    want = {v: [d for (_, u), d in far.items() if u == v] for v in range(N)}
    want = {v: (max(x), sum(x), len(x), round(sum(1 / (1 + d) for d in x), 9)) for v, x in want.items() if x}
    for strategy in ("bits", "frontier"):
        got = traverse.node_sums(g, strategy=strategy).collect()
        assert {r["node"]: (r["ecc"], r["dist_sum"], r["reach"], round(r["nearness"], 9)) for r in got} == want


def test_measures_of_sums_are_those_of_levels(graph, small_batches):
    g = graph(ARCS, N)
    for direction in ("out", "in"):
        levels, sums = centrality.levels(g, direction), centrality.sums(g, direction)
        assert sums.count() == sums.select("node").distinct().count() < levels.count()
        for measure in (centrality.reach, centrality.distance_sum, centrality.indices, lambda f: centrality.closeness(f, N), lambda f: centrality.harmonic(f, N).withColumn("c", F.round("c", 9))):
            assert sorted(measure(sums).collect()) == sorted(measure(levels).collect())
    with pytest.raises(ValueError):
        centrality.sums(g, "up")


def test_listed_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(traverse, "PAIRS_AT_ONCE", 500)
    tail, head = (np.array(c) for c in zip(*[(i, j) for i in range(60) for j in range(60, 160)], strict=True))
    g, own = arrays.Arrays(np.arange(160), tail, head), np.arange(60)
    frames = [f for d, nodes, bits in g.levels(own) if d for f in traverse.listed(g, own, d, nodes, bits)]
    assert max(len(f["src"]) for f in frames) <= 500
    assert {(s, v) for f in frames for s, v in zip(f["src"], f["node"], strict=True)} == set(zip(tail, head, strict=True))


def test_only_arcs_of_new_vertices_are_followed():
    n = 3000
    g, followed = arrays.Arrays(np.arange(n), np.arange(n - 1), np.arange(1, n)), []
    own = g.followed
    g.followed = lambda nodes: followed.append(len(own(nodes))) or own(nodes)
    assert sum(1 for _ in g.levels(np.array([0]))) == n and sum(followed) == n - 1


def test_sketches_by_arrays_are_those_by_joins(graph):
    g = graph(ARCS, N)
    by = {s: {(r["node"], r["d"]): r["within"] for r in sketches.level_counts(g, strategy=s).collect()} for s in ("bits", "frontier")}
    assert by["bits"] == by["frontier"] and len(by["bits"]) > N
    parts = sketches._by_arrays(traverse.arcs_to_send(g, "bits"), g, sketches.PRECISION)
    assert parts.agg(F.sum("used")).first()[0] <= sum(1 for _ in distances(ARCS, range(N))) + N


def test_core_from_few_sources_takes_no_round_a_level(spark, graph, monkeypatch):
    """Ladders of two lengths: the core has a level a step, which by joins are as many jobs."""
    arcs = [x for i in range(0, 120, 4) for x in ((i, i + 1), (i + 1, i + 4), (i, i + 2), (i + 2, i + 3), (i + 3, i + 4))] + [(0, 60), (130, 130)]
    g, some = graph(arcs, 132), spark.createDataFrame([(0,), (8,), (50,), (130,), (131,)], "src LONG")
    monkeypatch.setattr(chains, "fixpoint", None)
    got = {(r["src"], r["node"]): r["d"] for r in traverse.hop_distances(g, some, strategy="chains").collect()}
    assert got == distances(arcs, [0, 8, 50, 130, 131])


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_over_long_chains_take_the_core_s_rounds(graph, monkeypatch, seed):
    """Chains between few vertices, a ring, chains from a vertex back to itself, chains that end; no level a round."""
    rng, arcs, new = random.Random(seed), [(20, 20)], 21
    for a, b, m in [(rng.randrange(6), rng.randrange(6), rng.randrange(9)) for _ in range(9)] + [(3, 3, 4), (7, None, 6), (None, 8, 5)]:
        path = [a, *range(new, new + m), b]
        new += m
        arcs += [(x, y) for x, y in zip(path, path[1:], strict=False) if x is not None and y is not None]
    arcs += [(new + i, new + (i + 1) % 7) for i in range(7)]
    n = new + 7
    g, far = graph(arcs, n), distances(arcs, range(n))
    monkeypatch.setattr(traverse, "_frontier", None)
    assert {(r["src"], r["node"]): r["d"] for r in traverse.hop_distances(g, strategy="frontier").collect()} == far
    levels = Counter((v, d) for (_, v), d in far.items())
    assert {(r["node"], r["d"]): r["n"] for r in traverse.node_levels(g, strategy="frontier").collect()} == levels
    assert sum(r["dist_sum"] for r in traverse.bfs_summary(g, strategy="frontier").collect()) == sum(far.values())


def test_large_tables_are_not_sent_whole(spark, graph, monkeypatch):
    """Of large tables none is broadcast in a round of joins nor in a contraction, however few bytes they take."""
    arcs = [(i, i + 1) for i in range(40)] + [(5, 30), (40, 0), (41, 42), (42, 20)]
    g, far = graph(arcs, 43), distances(arcs, range(43))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for bound, sent in ((100, True), (10, False)):
        monkeypatch.setattr(index, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(chains, "BROADCAST_ROWS", bound)
        arcs_of = index.indexed(g.edges)
        now = index.bucketed(spark.range(43).select(F.col("id").alias("node"), F.col("id").alias("key")), ["node", "key"], "round")
        assert ("Broadcast" in plan(arcs_of.ahead(now.rows))) == sent
        arcs_of.discard()
        out = chains.summary(g)
        assert ("Broadcast" in plan(out)) == sent
        assert {r["src"]: (r["dist_sum"], r["reach"]) for r in out.collect()} == {v: (sum(d for (s, _), d in far.items() if s == v), sum(s == v for s, _ in far)) for v in range(43)}


def strong(far, n):
    return {v: min([v] + [u for u in range(n) if (u, v) in far and (v, u) in far]) for v in range(n)}


@pytest.mark.parametrize("orders", [16, 1])
def test_components_of_a_core_take_no_round_a_level(graph, monkeypatch, orders):
    """A ladder, which by joins is a job a level, into a ring with shortcuts, into another ladder."""
    def ladder(at):
        return [x for i in range(at, at + 60, 3) for x in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]

    arcs = ladder(0) + [(i, i + 1) for i in range(60, 80)] + [(80, 60), (70, 65), (75, 62)] + [(80, 81)] + ladder(81)
    names = list(range(150))
    random.Random(orders).shuffle(names)
    arcs = [(names[a], names[b]) for a, b in arcs]
    monkeypatch.setattr(components, "ORDERS", orders)
    monkeypatch.setattr(components, "fixpoint", None)
    got = {r["node"]: r["component"] for r in components.strong_components(graph(arcs, 150)).collect()}
    assert got == strong(distances(arcs, range(150)), 150)


def test_components_beyond_the_bound_are_those_by_arrays(graph, monkeypatch):
    rng = random.Random(3)
    arcs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    monkeypatch.setattr(components, "BROADCAST_ARCS", 10)
    got = {r["node"]: r["component"] for r in components.strong_components(graph(arcs, 40)).collect()}
    assert got == strong(distances(arcs, range(40)), 40)


def test_reach_by_components_makes_no_pairs(graph, monkeypatch):
    """Chains into a ring, through parallel chains and out by others; sizes of several digits; blocks of a chain."""
    arcs, new = [(i, (i + 1) % 9) for i in range(9)] + [(20, 21), (21, 22), (22, 20), (8, 20)], 30
    for a, b, m in [(None, 3, 5), (None, 3, 2), (0, 20, 4), (0, 20, 3), (21, None, 6), (5, None, 1), (21, 10, 2), (5, 10, 0), (10, 11, 7)]:
        path = [a, *range(new, new + m), b]
        new += m
        arcs += [(x, y) for x, y in zip(path, path[1:], strict=False) if x is not None and y is not None]
    far = distances(arcs, range(new))
    monkeypatch.setattr(components, "hop_distances", None)
    monkeypatch.setattr(components, "BLOCK", 2)
    for direction, side in (("in", 1), ("out", 0)):
        reach = Counter(k[side] for k in far)
        got = components.reach_by_components(graph(arcs, new), direction).collect()
        assert {r["node"]: r["reach"] for r in got} == reach and len(got) == len(reach)
