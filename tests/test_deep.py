"""The stored index, fixpoints on it, contraction of chains, strong components and sketches, held against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from tests.brute import distances
from trailgraph import Graph
from trailgraph.operators import centrality, components, sketches, traverse
from trailgraph.operators.fixpoint import LEAST, fixpoint
from trailgraph.plans.index import bucketed, indexed
from trailgraph.sources import graphs


def summary(arcs, n):
    out = {v: [0, 0, 0] for v in range(n)}
    for (s, _), d in distances(arcs, range(n)).items():
        out[s] = [max(out[s][0], d), out[s][1] + d, out[s][2] + 1]
    return {v: tuple(x) for v, x in out.items()}


def chained(seed, n=40):
    """A random graph of long chains, rings and a loop, under random names."""
    rng = random.Random(seed)
    arcs = [(i, i + 1) for i in range(n - 1) if rng.random() < 0.85] + [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * seed)] + [(20, 20)]
    if not seed:
        arcs = [(i, (i + 1) % 10) for i in range(10)] + [(i, i + 1) for i in range(10, 38)] + [(39, 39)]
    names = list(range(n))
    rng.shuffle(names)
    return [(names[a], names[b]) for a, b in arcs]


def test_a_level_moves_no_arcs(spark, graph):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = indexed(graph([(i, (i * 7 + k) % 50) for i in range(50) for k in range(3)]).edges)
        now = bucketed(spark.range(50).select(F.col("id").alias("node"), F.col("id").alias("key")), ["node", "key"], "round")
        out = index.ahead(now.rows)
        assert out.count() == 150
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        # The one exchange is of the rows sent, right above their own scan.
        below = plan[plan.index("Exchange") :].split("FileScan")[1].split("\n")[0]
        assert "node" in below and "head" not in below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hubs_are_dealt(spark, graph):
    arcs = [(0, i) for i in range(1, 30)] + [(i, 0) for i in range(1, 5)] + [(7, 8)]
    index = indexed(graph(arcs).edges, part_arcs=4)
    assert index.hubs.count == 1 and index.arcs.rows.where("tail = 0").select("part").distinct().count() > 4
    first = spark.createDataFrame([(0, 0, 0), (7, 1, 0)], "node LONG, key LONG, value LONG")
    got = {(r["key"], r["node"]): r["value"] for r in fixpoint(index, first, LEAST).groupBy("key", "node").agg(F.min("value").alias("value")).collect()}
    assert got == {(0, 0): 0, **{(0, i): 1 for i in range(1, 30)}, (1, 7): 0, (1, 8): 1}
    index.discard()


def test_lengths_and_many_rounds(spark):
    """More rounds than the state has tables, later arrivals that are shorter, and what is told of each round."""
    rng = random.Random(5)
    arcs = [(i, i + 1, 1) for i in range(15)] + [(rng.randrange(16), rng.randrange(16), rng.randrange(1, 9)) for _ in range(20)] + [(0, 12, 30)]
    index, told = indexed(spark.createDataFrame(arcs, "src LONG, dst LONG, w LONG")), []
    first = spark.createDataFrame([(0, 0, 0), (9, 9, 0)], "node LONG, key LONG, value LONG")
    rows = fixpoint(index, first, LEAST, told=lambda d, n: told.append(n))
    got = {(r["key"], r["node"]): r["value"] for r in rows.groupBy("key", "node").agg(F.min("value").alias("value")).collect()}
    want = {}
    for s in (0, 9):
        far = {s: 0}
        for _ in range(20):
            for a, b, w in arcs:
                if a in far:
                    far[b] = min(far.get(b, 999), far[a] + w)
        want |= {(s, v): d for v, d in far.items()}
    assert got == want and told[-1] == 0 and len(told) > 6


@pytest.mark.parametrize("seed", [0, 4])
def test_chains(spark, graph, seed):
    arcs = chained(seed)
    g = graph(arcs, 40)
    assert {r["src"]: (r["ecc"], r["dist_sum"], r["reach"]) for r in traverse.bfs_summary(g, strategy="chains").collect()} == summary(arcs, 40)
    some = spark.createDataFrame([(3,), (7,), (25,)], "src LONG")
    want = {k: v for k, v in distances(arcs, [3, 7, 25]).items()}
    assert {(r["src"], r["node"]): r["d"] for r in traverse.hop_distances(g, some, strategy="chains").collect()} == want
    got = {r["src"]: r["reach"] for r in traverse.bfs_summary(g, some, strategy="chains").collect()}
    assert got == {s: sum(a == s for a, _ in want) for s in (3, 7, 25)}
    with pytest.raises(ValueError):
        traverse.hop_distances(g, some, max_depth=2, strategy="chains")


def test_a_path_of_100000(spark):
    """Levels without end, in few jobs: distances from one vertex, and the summary of every one."""
    n = 100_000
    g = Graph(spark.range(n), spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    from trailgraph.operators import chains

    told = []
    one = spark.createDataFrame([(10,)], "src LONG")
    out = chains.distances(g, one, told=lambda d, rows: told.append(d))
    assert out.agg(F.count("*"), F.sum(F.expr("CAST(node - 10 = d AS INT)")), F.max("d")).first() == (n - 11, n - 11, n - 11)
    assert len(told) < 5
    every = chains.summary(g)
    right = F.expr(f"ecc = {n - 1} - src AND reach = {n - 1} - src AND dist_sum = ({n - 1} - src) * ({n} - src) div 2")
    assert every.agg(F.count("*"), F.sum(right.cast("int"))).first() == (n, n)


@pytest.mark.parametrize("seed", [0, 9])
def test_strong_components(graph, seed):
    rng = random.Random(seed)
    arcs = chained(seed) if seed < 9 else [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    g, far = graph(arcs, 40), distances(arcs, range(40))
    want = {v: min([v] + [u for u in range(40) if (u, v) in far and (v, u) in far]) for v in range(40)}
    assert {r["node"]: r["component"] for r in components.strong_components(g).collect()} == want
    for direction, side in (("in", 1), ("out", 0)):
        reach = {v: sum(k[side] == v for k in far) for v in range(40)}
        assert {r["node"]: r["reach"] for r in components.reach_by_components(g, direction).collect()} == {v: n for v, n in reach.items() if n}
    with pytest.raises(ValueError):
        components.reach_by_components(g, "up")


@pytest.mark.parametrize("kind", ["random", "star", "path"])
def test_sketches_are_within_their_error(spark, graph, kind):
    """Reach within three standard errors, sums over levels within four, or one vertex, as two may share a register; however deep."""
    n = {"random": 400, "star": 601, "path": 90}[kind]
    g = graphs.gnp(spark, n, 0.006) if kind == "random" else graphs.star(spark, 300) if kind == "star" else graph([(i, i + 1) for i in range(n - 1)], n)
    error = sketches.standard_error()
    exact = {r["src"]: r for r in traverse.bfs_summary(g).collect()}
    harmonic = {r["node"]: r["c"] for r in centrality.harmonic(centrality.levels(g), n).collect()}
    told = []
    got = {r["node"]: r for r in sketches.measures(g, told=lambda d, rows: told.append(d)).collect()}
    assert len(got) == n
    for v, r in got.items():
        want = exact[v]
        assert abs(r["reach"] - want["reach"]) <= max(1, 3 * error * (want["reach"] + 1)), v
        assert abs(r["dist_sum"] - want["dist_sum"]) <= max(want["ecc"], 4 * error * (want["dist_sum"] + 1)), v
        assert abs(r["harmonic"] - harmonic.get(v, 0)) <= max(1 / n, 4 * error * (harmonic.get(v, 0) + 1 / n)), v
        assert (r["closeness"] is None) == (want["reach"] == 0) or r["reach"] < 0.5
    if kind == "path":
        assert len(told) == n and got[0]["reach"] > 64
