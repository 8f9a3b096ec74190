"""All-pairs sums, of which followers are not traversed."""

import random

import numpy as np
import pytest

from tests.brute import distances
from trailgraph.operators import arrays, centrality, traverse


def wanted(arcs, n):
    far = distances(arcs, range(n))
    each = {v: [] for v in range(n)}
    for (_, v), d in far.items():
        each[v].append(d)
    return {v: (max(x), sum(x), len(x), round(sum(1 / (1 + d) for d in x), 9)) for v, x in each.items() if x}


def sparse(seed):
    """Vertices of mostly one arc, so followers of followers, rings, hubs with followers, loops and repeated ways back."""
    rng = random.Random(seed)
    n = rng.randrange(5, 60)
    arcs = {(v, rng.randrange(n)) for v in range(n) for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))}
    return sorted(arcs | {(v, 0) for v in range(0, n, rng.choice((2, 7, 100)))}), n


@pytest.mark.parametrize("at_once", [1, 3, 70])
@pytest.mark.parametrize("rows", [2, 4096])
def test_sums_with_followers_are_those_of_all_sources(monkeypatch, at_once, rows):
    monkeypatch.setattr(arrays, "ROWS_AT_ONCE", rows)
    spared = 0
    for seed in range(60):
        arcs, n = sparse(seed)
        tail, head = (np.array(c) for c in zip(*arcs, strict=True))
        g = arrays.Arrays(np.unique(np.concatenate([tail, head])), tail, head)
        sums, batches = traverse.NodeSums(len(g.ids)), traverse.batches_of(g, at_once)
        for m, sources, behind in batches:
            assert len(sources) <= at_once and len(behind) == m * len(sources)
            sums.add(g, m, sources, behind)
        got = {k: v for c in sums.rows(g) for k, *v in zip(*(c[x].tolist() for x in ("node", "ecc", "dist_sum", "reach", "nearness")), strict=True)}
        assert {k: (e, t, r, round(h, 9)) for k, (e, t, r, h) in got.items()} == wanted(arcs, n)
        spared += sum(len(behind) for _, _, behind in batches)
    assert spared > 0 or at_once == 70


def test_measures_traverse_no_followers(graph, monkeypatch):
    """200 vertices that lead into a ring: the ring alone is traversed. Before, each vertex was."""
    arcs = [x for v in range(9) for x in ((v, (v + 1) % 9), (v, (v + 2) % 9))] + [(v, v % 8) for v in range(9, 209)]
    tail, head = (np.array(c) for c in zip(*arcs, strict=True))
    assert sum(len(s) for _, s, _ in traverse.batches_of(arrays.Arrays(np.arange(209), tail, head), 64)) == 9
    g, want = graph(arcs, 209), wanted(arcs, 209)
    monkeypatch.setattr(traverse, "COUNTED_AT_ONCE", 64)
    monkeypatch.setattr(traverse, "_over_sources", None)
    assert {r["node"]: (r["ecc"], r["dist_sum"], r["reach"], round(r["nearness"], 9)) for r in traverse.node_sums(g).collect()} == want
    out = {r["src"]: (r["ecc"], r["dist_sum"], r["reach"]) for r in traverse.bfs_summary(g).collect()}
    far = distances(arcs, range(209))
    assert {v: x[1:] for v, x in out.items()} == {v: (sum(d for (s, _), d in far.items() if s == v), sum(s == v for s, _ in far)) for v in range(209)}
    assert centrality.closeness(centrality.sums(g), 209).count() == 209


def test_arcs_from_outside_the_vertices_are_no_sources(spark, graph):
    from trailgraph import Graph

    g = Graph(spark.range(3), graph([(0, 1), (1, 2), (9, 0)]).edges)
    assert {r["node"]: (r["reach"], r["dist_sum"]) for r in traverse.node_sums(g).collect()} == {1: (1, 1), 2: (2, 3)}


def test_equal_widths_ask_for_the_values_once(spark):
    """The least and greatest value and the counts are of one evaluation, as it may be a traversal from all vertices."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    c = spark.range(50).selectExpr("id AS node", "CAST(id AS DOUBLE) AS c").mapInArrow(counted, "node long, c double")
    assert sorted(map(tuple, centrality.equal_width(c).collect())) == [(k, 5) for k in range(10)]
    assert seen.value == 50
