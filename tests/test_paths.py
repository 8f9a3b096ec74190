import pytest

from tests import brute
from trailgraph.operators import paths
from trailgraph.sources import graphs


def found(df):
    return {tuple(r["path"]) for r in df.collect()}


@pytest.mark.parametrize(("arcs", "s", "t", "directed", "forward"), [
    ([(0, 1), (0, 2), (1, 3), (2, 1), (2, 3)], 0, 3, {(0, 1, 3), (0, 2, 1, 3), (0, 2, 3)}, {(0, 1, 3), (0, 2, 3)}),
    ([(0, 1), (0, 2), (1, 2), (2, 3), (3, 1)], 0, 1, {(0, 1), (0, 2, 3, 1)}, {(0, 1), (0, 2, 1)}),
    ([(0, 1)], 0, 1, {(0, 1)}, {(0, 1)}),
])
def test_modes(graph, arcs, s, t, directed, forward):
    g = graph(arcs)
    assert found(paths.simple_paths(g, s, t)) == directed == brute.walks(arcs, s, t)
    assert found(paths.simple_paths(g, s, t, "forward")) == forward
    nodes, numbered = paths.diagram(g, s, t)
    assert found(paths.decode(nodes, numbered, s)) == forward


def test_star_diagram(spark):
    nodes, arcs = paths.diagram(graphs.star(spark, 3), 0, 5)
    rows = sorted((r["var"], r["lo"] == 0, r["hi"] == 1) for r in nodes.collect())
    assert [x[0] for x in rows] == [2, 5] and rows[1] == (5, True, True)
    assert found(paths.decode(nodes, arcs, 0)) == {(0, 2, 5)}


def test_numbering(graph):
    arcs = [(5, 2), (5, 9), (2, 7), (9, 1), (9, 7), (1, 5), (8, 5)]
    g = graph(arcs)
    assert {r["id"]: r["num"] for r in paths.bfs_numbering(g, 5).collect()} == brute.numbering(arcs, 5)
    members = g.vertices.where("id <> 9")
    assert {r["id"] for r in paths.bfs_numbering(g, 5, members).collect()} == {5, 2, 7}
    num = brute.numbering(arcs, 5)
    ahead = sorted((num[a], b) for a, b in arcs if a in num and b in num and num[b] > num[a])
    assert [(r["j"], r["dst"]) for r in paths.forward_arcs(g, 5).orderBy("arc").collect()] == ahead


def test_errors_and_bounds(graph):
    g = graph([(0, 1), (1, 2), (0, 2)], 4)
    for mode in ("directed", "forward"):
        with pytest.raises(ValueError):
            paths.simple_paths(g, 0, 0, mode)
        with pytest.raises(ValueError):
            paths.simple_paths(g, 0, 3, mode)
    with pytest.raises(ValueError):
        paths.simple_paths(g, 0, 1, "other")
    assert found(paths.simple_paths(g, 0, 2, max_length=1)) == {(0, 2)}
    assert paths.count_paths(g, 0, 2).first()["paths"] == 2


def grid(side):
    at = lambda r, c: r * side + c
    return [(at(r, c), at(r, c + 1)) for r in range(side) for c in range(side - 1)] + [(at(r, c), at(r + 1, c)) for r in range(side - 1) for c in range(side)]


def test_counts_without_listing(graph):
    g = graph(grid(4))
    assert paths.count_all_paths(g, 0, 15).first()["paths"] == len(found(paths.simple_paths(g, 0, 15, "forward"))) == 184
    arcs = [(0, 1), (0, 2), (1, 3), (2, 1), (2, 3), (3, 4), (1, 4), (4, 5)]
    for target in (3, 4, 5):
        h = graph(arcs)
        assert paths.count_all_paths(h, 0, target).first()["paths"] == len(found(paths.simple_paths(h, 0, target, "forward")))
    with pytest.raises(ValueError):
        paths.count_all_paths(h, 0, 0)
    with pytest.raises(ValueError):
        paths.count_all_paths(graph([(0, 1), (2, 3)]), 0, 3)


def test_states_are_as_wide_as_the_frontier():
    """A grid of 5 x 5 with 40 arcs: at most its side and an end or two, and no vertex before it is touched."""
    arcs = sorted(grid(5), key=lambda a: (sum(divmod(a[0], 5)), a))
    order = {v: i + 1 for i, v in enumerate(sorted({v for a in arcs for v in a}, key=lambda v: (sum(divmod(v, 5)), v)))}
    steps = paths.Steps([(order[a], order[b]) for a, b in arcs], order[24])
    assert max(len(steps.frontier(i)) for i in range(41)) <= 7 and steps.start() == [order[24], 1] and steps.frontier(40) == []
