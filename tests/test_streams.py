import json
import math
import statistics

import pytest

from trailgraph.operators import estimate
from trailgraph.streaming import channels, estimates


def test_merged_streams_go_on_where_they_ended(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(json.dumps({"m": f"{name}{i}"}) for i in range(4)))
    def both():
        return channels.merged(*(channels.from_folder(spark, str(tmp_path / x), "m STRING") for x in ("a", "b")))
    channels.drained(both(), str(tmp_path / "out"), str(tmp_path / "state"))
    (tmp_path / "a" / "2.json").write_text(json.dumps({"m": "late"}))
    channels.drained(both(), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(r["m"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([f"{x}{i}" for x in "ab" for i in range(4)] + ["late"])


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"t": f"2024-01-01T00:0{i}:00Z"}) for i in range(4)))
    stream = channels.from_folder(spark, str(tmp_path / "in"), "t TIMESTAMP")
    own = channels.windowed_counts(stream, "t", "2 minutes", "0 seconds")
    channels.drained(own, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()][:1] == [2]


def test_running_averages_of_a_stream(spark, tmp_path):
    sink = channels.RunningAverages(str(tmp_path / "avg"))
    for batch, values in enumerate([[1.0], [3.0]]):
        sink(spark.createDataFrame([(v, 2.0) for v in values], "norm DOUBLE, diameter DOUBLE"), batch)
    sink(spark.createDataFrame([(3.0, 2.0)], "norm DOUBLE, diameter DOUBLE"), 1)  # the same batch again
    row = sink.averages(spark).first()
    assert row["average"] == 2.0 and row["spread"] == pytest.approx(2**0.5) and row["diameter_spread"] == 0.0


def test_running_averages_keep_a_small_spread_of_large_values(spark, tmp_path):
    sink = channels.RunningAverages(str(tmp_path / "avg"))
    for batch, values in enumerate([[1e9, 1e9 + 1], [1e9 + 2]]):
        sink(spark.createDataFrame([(v, 1.0) for v in values], "norm DOUBLE, diameter DOUBLE"), batch)
    row = sink.averages(spark).first()
    assert row["average"] == pytest.approx(1e9 + 1) and row["spread"] == pytest.approx(1.0) and row["diameter_spread"] == 0.0


def test_state_goes_on_from_its_checkpoint_and_ends_when_precise(spark, tmp_path):
    """Two names in one stream over three starts: each has its own state; the one that is precise takes no later batch."""
    path = str(tmp_path / "in")
    wide = [1e9, 1e9 + 8, 1e9 + 3, 1e9 + 1, 1e9 + 7]
    tight = [4.0, 4.5, 4.25, 9.0, 9.0]
    for some in ((0, 1), (2,), (3, 4)):
        rows = [(name, b, values[b], float(b)) for b in reversed(some) for name, values in (("wide", wide), ("tight", tight))]
        spark.createDataFrame(rows, estimates.BATCHES).write.mode("append").parquet(path)
        own = estimates.averages(spark.readStream.schema(estimates.BATCHES).parquet(path), eps=0.5)
        channels.drained(own, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["name"], r["batch"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {("wide", b) for b in range(5)} | {("tight", b) for b in range(3)}
    for (name, b), r in got.items():
        values = {"wide": wide, "tight": tight}[name][: b + 1]
        assert r["n"] == b + 1 and r["average"] == pytest.approx(statistics.fmean(values), rel=1e-12) and r["diameter"] == b / 2
        assert r["precise"] == (name == "tight" and b == 2)
        if b:
            assert r["spread"] == pytest.approx(statistics.stdev(values)) and r["half_width"] == pytest.approx(1.96 * statistics.stdev(values) / math.sqrt(b + 1))
        else:
            assert math.isnan(r["spread"]) and math.isnan(r["half_width"])


def test_draws_are_traversed_until_precise(spark, graph, tmp_path):
    """The same rows as running averages of all batches, up to the precise one; a second call goes on where the first ended."""
    g = graph([(i, i + 1) for i in range(29)], 30)
    draws = spark.createDataFrame([(i, i * 7 % 30) for i in range(24)], "draw_id LONG, v LONG")
    whole = {r["batch"]: r for r in estimate.running_averages(estimate.batch_stats(g, draws, 4)).collect()}
    first = estimates.until_precise(g, draws.where("draw_id < 8"), 4, 0.0, str(tmp_path / "all"), together=1).collect()
    every = estimates.until_precise(g, draws, 4, 0.0, str(tmp_path / "all")).collect()
    assert {r["batch"] for r in first} == {0, 1} and sorted(r["batch"] for r in every) == sorted(whole)
    for r in every:
        assert r["average"] == pytest.approx(whole[r["batch"]]["average"]) and r["diameter_spread"] == pytest.approx(whole[r["batch"]]["diameter_spread"], nan_ok=True)
    few = estimates.until_precise(g, draws, 4, 100.0, str(tmp_path / "few"), together=2)
    assert sorted(r["batch"] for r in few.collect()) == [0, 1, 2] and few.where("precise").count() == 1
    assert spark.read.parquet(str(tmp_path / "few" / "batches")).count() == 4  # the last two batches were not traversed
    assert estimates.until_precise(g, draws.limit(0), 4, 0.1, str(tmp_path / "none")).count() == 0
