import math

import pytest

from tests import brute
from trailgraph import programs
from trailgraph.functions import scalars
from trailgraph.operators import centrality, estimate, sampling
from trailgraph.sources import graphs, sinks

ARCS = [(0, 1), (1, 2), (2, 0), (2, 3)]


def test_star_is_exact(spark):
    row = estimate.exact(graphs.star(spark, 1000)).first()
    assert (row["total"], row["pairs"], row["diameter"]) == (4000, 3000, 2) and row["average"] == 4 / 3


def test_three_cycle(graph):
    row = estimate.exact(graph([(0, 1), (1, 2), (2, 0)])).first()
    assert (row["total"], row["pairs"], row["diameter"], row["average"]) == (9, 6, 2, 1.5)


def test_nothing_reached_gives_nan(graph):
    row = estimate.exact(graph([], 3)).first()
    assert (row["total"], row["pairs"]) == (0, 0) and math.isnan(row["average"])
    with pytest.raises(ValueError):
        sampling.connected_pairs(graph([], 3), 2)


def test_star_centralities(spark):
    g = graphs.star(spark, 1000)
    found = centrality.levels(g)
    close = {r["node"]: r["c"] for r in centrality.closeness(found, 2001).collect()}
    assert close[1] == 1 / 2001 and close[0] == 1 / (3000 * 2001) and len(close) == 1001
    harm = {r["node"]: r["c"] for r in centrality.harmonic(found, 2001).collect()}
    assert harm[0] == pytest.approx((1000 / 2 + 1000 / 3) / 2001) and harm[1] == pytest.approx(0.5 / 2001)
    hist = [(r["bucket"], r["cnt"]) for r in centrality.histogram(centrality.closeness(found, 2001)).collect()]
    assert hist == [(499, 1000), (0, 1)]
    groups = centrality.buckets(centrality.closeness(found, 2001)).collect()
    assert [(r["cnt"], r["members"][0]) for r in groups] == [(1000, 1), (1, 0)]
    assert centrality.ranking(centrality.closeness(found, 2001)).first()["node"] == 1
    assert {r["bin"]: r["cnt"] for r in centrality.equal_width(centrality.closeness(found, 2001)).collect()} == {9: 1000, 0: 1}


def test_indices_and_directions(graph):
    g = graph(ARCS, 5)
    d = brute.distances(ARCS, range(5))
    out = {r["node"]: r for r in centrality.indices(centrality.levels(g)).collect()}
    into = {r["node"]: r["reach"] for r in centrality.reach(centrality.levels(g, "in")).collect()}
    for v in range(5):
        own = [x for (s, _), x in d.items() if s == v]
        if own:
            assert (out[v]["reach"], out[v]["dist_sum"], out[v]["nieminen"]) == (len(own), sum(own), len(own) ** 2 - sum(own))
        assert into.get(v, 0) == sum(t == v for _, t in d)
    mean = {r["node"]: r["c"] for r in centrality.closeness(centrality.levels(g), 5, "mean").collect()}
    assert mean[0] == 5 / out[0]["dist_sum"]
    with pytest.raises(ValueError):
        centrality.levels(g, "up")


def test_approximate_reach_is_near(spark):
    g = graphs.gnp(spark, 100, 0.03)
    want = {r["node"]: r["reach"] for r in centrality.reach(centrality.levels(g)).collect()}
    got = {r["node"]: r["reach"] for r in centrality.approximate_reach(g).collect()}
    assert all(abs(got[v] - want.get(v, 0)) <= 0.1 * want.get(v, 0) + 1 for v in got)


def test_sample_sizes():
    assert scalars.sample_size(2001, 0.1) == 549 and scalars.sample_size(1, 0.1) == 0
    assert scalars.closeness_sample_size(0.05) == 1382


def test_estimators_are_near_the_truth(spark):
    g = graphs.gnp(spark, 150, 0.03)
    truth = estimate.exact(g).first()["average"]
    pairs = estimate.average_distance(g, "pairs", eps=0.1).first()
    assert pairs["average"] == pytest.approx(truth, rel=0.1)
    reach = estimate.average_distance(g, "reach", "ratio_of_sums", eps=0.1, batch=50).first()
    assert reach["average"] == pytest.approx(truth, rel=0.15) and reach["batches"] > 5
    uniform = estimate.average_distance(g, "uniform", "ratio_of_sums", eps=0.1).first()
    assert uniform["average"] == pytest.approx(truth, rel=0.1) and math.isnan(uniform["spread"])
    with pytest.raises(ValueError):
        estimate.average_distance(g, "other")


def test_mean_of_ratios_and_ratio_of_sums_differ_on_a_star(spark):
    g = graphs.star(spark, 200)
    assert estimate.average_distance(g, "pairs", eps=0.1).first()["average"] == pytest.approx(4 / 3, abs=0.05)
    draws = sampling.reach_weighted(g, 600, sampling.uniform(g, 300, 1, sampling.SECOND), 5).select("draw_id", "v")
    sums = estimate.batch_stats(g, draws, 600).first()
    assert sums["norm"] == pytest.approx(1.5, abs=0.06)


def test_compat_draw_gives_the_first_vertex_one_more(spark):
    """With weights 2, 1 and 1 a draw takes 1 to 4; compat also takes 0, which is the first vertex's."""
    g = graphs.star(spark, 1)
    targets = spark.createDataFrame([(0, 1), (1, 2)], "draw_id BIGINT, v BIGINT")
    assert [tuple(r) for r in sampling.reach_weights(g, targets).orderBy("node").collect()] == [(0, 2, 2), (1, 2, 4), (2, 1, 5)]

    def share(**kw):
        draws = sampling.reach_weighted(g, 3000, targets, 9, **kw)
        assert draws.count() == 3000
        return {r["v"]: r["count"] / 3000 for r in draws.groupBy("v").count().collect()}

    assert share()[0] == pytest.approx(2 / 5, abs=0.04) and share(compat=True)[0] == pytest.approx(3 / 6, abs=0.04)


def test_running_averages(spark):
    stats = spark.createDataFrame([(0, 1.0, 2), (1, 3.0, 4)], "batch BIGINT, norm DOUBLE, diameter BIGINT")
    first, second = estimate.running_averages(stats).orderBy("batch").collect()
    assert first["average"] == 1.0 and math.isnan(first["spread"])
    assert second["average"] == 2.0 and second["spread"] == pytest.approx(2**0.5)


def test_lines(spark):
    ranked = spark.createDataFrame([(1, 0.5), (0, 0.5), (2, 0.75)], "node BIGINT, c DOUBLE")
    assert [r["line"] for r in sinks.ranked_lines(ranked).collect()] == ["2, 0.750000", "0, 0.500000", "1, 0.500000"]
    nodes = spark.createDataFrame([(17, 3, 0, 1)], "id BIGINT, var INT, lo BIGINT, hi BIGINT")
    assert sinks.diagram_lines(nodes).first()["line"] == "0x11: (~3?0x0:0x1)"
    assert sinks.header(5, 4, 3, 1) == "|V| = 5, |E| = 4, |S| = 3, s = 1."
    assert "1.500" in sinks.average_line(1.5, 0, 2, 0)


def test_pairs_are_drawn_where_few_are_connected(graph, spark):
    """On a star with many spokes pairs come by their number: each connected pair with the same chance, and none raises."""
    g = graphs.star(spark, 2000)
    out = sampling.connected_pairs(g, 600, 7).collect()
    assert len(out) == 600 and {r["draw_id"] for r in out} == set(range(600))
    d = {(0, i): 1 for i in range(1, 2001)} | {(0, i): 2 for i in range(2001, 4001)} | {(i, i + 2000): 1 for i in range(1, 2001)}
    assert all(d[r["v"], r["w"]] == r["d"] for r in out)
    assert sum(r["v"] == 0 for r in out) / 600 == pytest.approx(2 / 3, abs=0.07)
    one = sampling.connected_pairs(graph([(3, 9)], 4000), 5).collect()
    assert [(r["v"], r["w"], r["d"]) for r in one] == [(3, 9, 1)] * 5


def test_a_star_of_20001_is_estimated(spark):
    row = estimate.average_distance(graphs.star(spark, 10_000), "pairs", eps=0.1).first()
    assert row["average"] == pytest.approx(1.330, abs=0.03) and row["diameter"] == 2


def test_sampled_measures_count_repeated_draws(graph):
    """With so many draws of few vertices each comes often; the ranking is that from all vertices."""
    g = graph(ARCS, 4)
    k = scalars.closeness_sample_size(0.3)
    draws = [r["v"] for r in sampling.connected_pairs(g.transpose(), k, 42).collect()]
    d = brute.distances(ARCS, range(4))
    want = {u: sum(d.get((u, v), 0) for v in draws) for u in range(4)}
    got = {r["node"]: r["c"] for r in centrality.sampled_closeness(g, 0.3).collect()}
    assert got == {u: pytest.approx(1 / (x * k)) for u, x in want.items() if x}
    k = scalars.sample_size(4, 0.2)
    draws = [r["v"] for r in sampling.uniform(g, k, 42).collect()]
    got = {r["node"]: r["c"] for r in centrality.sampled_harmonic(g, 0.2).collect()}
    want = {u: sum(1 / (1 + d[u, v]) for v in draws if (u, v) in d) / k for u in range(4)}
    assert got == {u: pytest.approx(x) for u, x in want.items() if x}


def test_programs(spark, tmp_path, capsys):
    """Every program's report on a star, as lines."""
    (tmp_path / "a.csv").write_text("".join(f"0,{i}\n{i},{i + 5}\n" for i in range(1, 6)))

    def run(*argv):
        lines = []
        programs.main([*argv], spark, lines.append)
        return lines

    arcs = str(tmp_path / "a.csv")
    lines = run("sinks", arcs)
    assert lines[0].startswith("|V| = 11, |E| = 10, |S| = 5, eta = ")
    lines = run("pairs", arcs, "--exact")
    assert lines[0].startswith("((|V| 11) (|E| 10) (|S| 11)") and lines[-1].startswith("((average distance 1.333333) (diameter 2) (eta ")
    lines = run("pairs", arcs, "--eps", "0.4")
    assert sum("remaining" in x for x in lines) == scalars.sample_size(11, 0.4) and "(remaining 1))" in lines[-3]
    lines = run("average", arcs, "--truth")
    assert lines[0] == "|V| = 11, |E| = 10, |S| = 173, s = 1." and "averages: distance 0.133, diameter 2.000." in lines and any("(norm 1.333), std nan" in x for x in lines)
    lines = run("average", arcs, "--eps", "0.3", "--batch", "8")
    assert any(x.startswith("average of averages: distance 0.1") for x in lines) and lines[-1].startswith("Total time: ")
    lines = run("closeness", arcs, "--exact")
    assert "1, 0.090909" in lines and any(x.startswith("0.090909: 5 nodes [1, 2, 3, 4, 5]") for x in lines)
    lines = run("harmonic", arcs, "--exact")
    assert lines[lines.index(sinks.ORDERED) + 1].startswith("0\t0.378787")
    assert run("harmonic", arcs, "--eps", "0.5") and run("closeness", arcs, "--eps", "0.5")
    assert run("paths", arcs, "0", "7")[0].startswith("0x2: (~")
    assert "[0, 2, 7]" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        run("pairs")
