import json

import pytest

from tests import brute
from trailgraph import Graph
from trailgraph.operators import traverse
from trailgraph.sources import graphs

ARCS = [(0, 1), (0, 2), (1, 3), (2, 1), (2, 3), (3, 3), (4, 0), (0, 1)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_basics(graph):
    g = graph(ARCS, 6)
    assert tuple(g.size().first()) == (6, 7)
    assert rows(g.out_degree()) == [(0, 2), (1, 1), (2, 2), (3, 1), (4, 1), (5, 0)]
    assert rows(g.sinks()) == [(5,)]
    assert rows(g.transpose().sinks()) == [(4,), (5,)]
    assert rows(g.transpose().transpose().edges) == rows(g.edges)
    assert rows(g.clustered().edges) == rows(g.edges)
    assert [list(r) for _, r in rows(g.successors())] == [[1, 2], [3], [1, 3], [3], [0]]
    g.check_transposed(g.transpose())
    with pytest.raises(ValueError):
        g.check_transposed(graph(ARCS[:2], 6))


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,1\n1,2\n")
    assert rows(Graph.from_csv(spark, str(tmp_path / "a.csv"), 5).edges) == [(0, 1), (1, 2)]
    (tmp_path / "l.tsv").write_text("b\ta\na\tc\nc\tb\n")
    g, labels = Graph.from_label_file(spark, str(tmp_path / "l.tsv"))
    assert rows(labels) == [(0, "b"), (1, "a"), (2, "c")]
    assert rows(g.edges) == [(0, 1), (1, 2), (2, 0)]
    graphs.write_labels(labels, str(tmp_path / "nodes"))
    assert rows(graphs.decode(g.edges, labels, "src")) == [("a", 2), ("b", 1), ("c", 0)]
    (tmp_path / "n.nodes").write_text("x\ny\n")
    assert rows(graphs.read_labels(spark, str(tmp_path / "n.nodes"))) == [(0, "x"), (1, "y")]
    (tmp_path / "p.properties").write_text("#comment\nnodes=3\narcs = 4\n")
    assert rows(graphs.read_properties(spark, str(tmp_path / "p.properties"))) == [("arcs", "4"), ("nodes", "3")]
    (tmp_path / "v.txt").write_text("[0.5, 1.0, 2.25]")
    assert rows(graphs.read_vector(spark, str(tmp_path / "v.txt"))) == [(0, 0.5), (1, 1.0), (2, 2.25)]
    (tmp_path / "c.csv").write_text("0,0.5\n1,nan\n2,-nan\n")
    assert [r["cc"] for r in graphs.read_centrality(spark, str(tmp_path / "c.csv")).orderBy("node").collect()] == [0.5, None, None]
    g.edges.write.parquet(str(tmp_path / "e"))
    assert rows(Graph.from_table(spark, str(tmp_path / "e")).vertices) == [(0,), (1,), (2,)]


def test_generators(spark):
    assert rows(graphs.star(spark, 3).edges) == [(0, 1), (0, 2), (0, 3), (1, 4), (2, 5), (3, 6)]
    a, b = graphs.gnp(spark, 60, 0.1), graphs.gnp(spark, 60, 0.1)
    assert rows(a.edges) == rows(b.edges) and 200 < a.edges.count() < 520
    ba = graphs.dual_barabasi_albert(spark, 200, 5)
    assert ba.vertices.count() == 200 and 3 * 190 < ba.edges.count() < 5 * 200


@pytest.mark.parametrize("strategy", ["bits", "frontier"])
def test_distances_match_brute_force(graph, strategy):
    g = graph(ARCS, 6)
    want = brute.distances(ARCS, range(6))
    got = {(r["src"], r["node"]): r["d"] for r in traverse.hop_distances(g, strategy=strategy).collect()}
    assert got == want
    near = traverse.hop_distances(g, max_depth=1, include_start=True, strategy=strategy).collect()
    assert {(r["src"], r["node"]): r["d"] for r in near} == {k: d for k, d in want.items() if d <= 1} | {(v, v): 0 for v in range(6)}
    summary = {r["src"]: (r["ecc"], r["dist_sum"], r["reach"]) for r in traverse.bfs_summary(g, strategy=strategy).collect()}
    for v in range(6):
        own = [d for (s, _), d in want.items() if s == v]
        assert summary[v] == (max(own, default=0), sum(own), len(own))
    levels = traverse.node_levels(g, strategy=strategy)
    assert sum(r["n"] for r in levels.collect()) == len(want)


def test_strategies_agree_on_a_random_graph(spark):
    g = graphs.gnp(spark, 80, 0.03)
    assert rows(traverse.hop_distances(g, strategy="bits")) == rows(traverse.hop_distances(g, strategy="frontier"))
    arcs = [tuple(r) for r in g.edges.collect()]
    d = brute.distances(arcs, range(80))
    for (u, v), k in d.items():  # the triangle inequality along arcs
        assert all(d.get((u, w), 0) <= k + 1 for a, w in arcs if a == v)


def test_no_arcs(graph):
    g = graph([], 3)
    assert traverse.hop_distances(g).count() == 0
    assert rows(traverse.bfs_summary(g)) == [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0)]
    with pytest.raises(ValueError):
        traverse.hop_distances(g, strategy="x")


def test_ancestors_are_distances_of_the_transpose(graph, spark):
    g = graph(ARCS, 6)
    targets = spark.createDataFrame([(3,)], "src BIGINT")
    assert rows(traverse.ancestors(g, targets)) == [(3, 0, 2), (3, 1, 1), (3, 2, 1), (3, 3, 0), (3, 4, 3)]
    assert json.loads(json.dumps(rows(traverse.ancestors(g, targets, include_start=False))))


@pytest.mark.parametrize("strategy", ["bits", "frontier"])
def test_repeated_sources_count_as_often_in_levels(graph, spark, strategy):
    g = graph(ARCS, 6)
    draws = spark.createDataFrame([(0,), (0,), (0,), (4,), (5,), (99,), (99,)], "src BIGINT")
    d = brute.distances(ARCS, [0, 4])
    want = {}
    for (s, v), k in d.items():
        want[v, k] = want.get((v, k), 0) + (3 if s == 0 else 1)
    assert {(r["node"], r["d"]): r["n"] for r in traverse.node_levels(g, draws, strategy).collect()} == want
    assert {r["src"]: r["reach"] for r in traverse.bfs_summary(g, draws, strategy).collect()} == {0: 3, 4: 4, 5: 0, 99: 0}


def test_more_than_a_word_of_sources_by_joins(spark):
    arcs = [(i, (i * 7 + 1) % 150) for i in range(150)] + [(i, (i * 3 + 2) % 150) for i in range(0, 150, 2)]
    g = Graph.of(spark.createDataFrame(arcs, "src BIGINT, dst BIGINT"))
    assert {(r["src"], r["node"]): r["d"] for r in traverse.hop_distances(g, strategy="frontier", max_depth=4).collect()} == {k: d for k, d in brute.distances(arcs, range(150)).items() if d <= 4}


def test_a_long_path_ends(spark):
    n = 2000
    g = Graph.of(spark.range(n).selectExpr("id AS src", "id + 1 AS dst"))
    assert tuple(traverse.bfs_summary(g, spark.createDataFrame([(0,)], "src BIGINT")).first()) == (0, n, n * (n + 1) // 2, n)


def test_sources_at_once_follow_from_memory():
    assert traverse.sources_at_once(1000, 5000) == traverse.SOURCES_AT_ONCE
    few = traverse.sources_at_once(5_000_000, 5_000_000)
    assert few % 64 == 0 and 64 <= few < traverse.SOURCES_AT_ONCE
