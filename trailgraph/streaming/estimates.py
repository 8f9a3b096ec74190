"""Estimates that end when they are precise: batches of draws arrive as a stream, mean and deviation are keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailgraph.operators.estimate import batch_stats
from trailgraph.plans.durable import ship
from trailgraph.sources.graphs import Graph
from trailgraph.streaming.channels import drained

BATCHES = "name string, batch long, norm double, diameter double"
AVERAGES = "name string, batch long, n long, average double, spread double, diameter double, diameter_spread double, half_width double, precise boolean"
STATE = "n long, mean double, squares double, diameter double, diameter_squares double, precise boolean"

#: Deviations of the mean on either side of it, for 95 of 100 estimates; and the fewest batches that can be precise.
DEVIATIONS, LEAST = 1.96, 3


def averages(stream: DataFrame, eps: float, least: int = LEAST) -> DataFrame:
    """From a stream of batches (BATCHES) the running averages after each (AVERAGES), for each name on its own.

    half_width is that of the mean's interval, NaN with spread for a single batch. The first batch after which it is under eps, with
    at least `least` batches, is precise and a name's last: later ones give no rows. A trigger's batches are taken by number. The
    state of a name is six values, by updates that keep a small spread of large values; a query that starts again from its
    checkpoint goes on from them.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, squares, wide, wide_squares, precise = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, False)
        out = []
        for batch, norm, diameter in pd.concat(list(chunks)).sort_values("batch")[["batch", "norm", "diameter"]].itertuples(index=False):
            if precise:
                break
            n, away, off = n + 1, norm - mean, diameter - wide
            mean, wide = mean + away / n, wide + off / n
            squares, wide_squares = squares + away * (norm - mean), wide_squares + off * (diameter - wide)
            spread, wide_spread = (math.sqrt(x / (n - 1)) if n > 1 else math.nan for x in (squares, wide_squares))
            half = DEVIATIONS * spread / math.sqrt(n)
            precise = n >= least and half < eps
            out.append((key[0], batch, n, mean, spread, wide, wide_spread, half, precise))
        state.update((int(n), float(mean), float(squares), float(wide), float(wide_squares), bool(precise)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in AVERAGES.split(", ")])

    ship(stream.sparkSession)
    out = stream.groupBy("name").applyInPandasWithState(step, AVERAGES, STATE, "append", GroupStateTimeout.NoTimeout)
    nan = F.lit(math.nan)  # which comes out of pandas as null
    return out.select(*[F.coalesce(c, nan).alias(c) if c in ("spread", "diameter_spread", "half_width") else c for c in out.columns])


def until_precise(graph: Graph, draws: DataFrame, size: int, eps: float, path: str, together: int = 4, least: int = LEAST, name: str = "average") -> DataFrame:
    """The running averages (AVERAGES) of the draws (draw_id, v) in batches of `size`, up to the first that is precise, or all.

    `together` batches are traversed at a time and added to the stream under path; no draw after a precise batch's step is
    traversed. Called again with the same path, it goes on after the last batch that was written, with other draws of the same order.
    No draws, or none that reaches a vertex, give no rows.
    """
    spark = draws.sparkSession
    end = draws.agg(F.max("draw_id")).first()[0]
    batches = 0 if end is None else end // size + 1
    spark.createDataFrame([], BATCHES).write.mode("append").parquet(f"{path}/batches")
    written = spark.read.schema(BATCHES).parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    at = 0 if written is None else written + 1
    while True:
        arriving = spark.readStream.schema(BATCHES).parquet(f"{path}/batches")
        drained(averages(arriving, eps, least), f"{path}/averages", f"{path}/state")
        found = spark.read.schema(AVERAGES).parquet(f"{path}/averages")
        if at >= batches or not found.where("precise").isEmpty():
            return found
        own = draws.where(F.col("draw_id").between(at * size, min(at + together, batches) * size - 1))
        stats = batch_stats(graph, own, size).select(F.lit(name).alias("name"), "batch", "norm", F.col("diameter").cast("double").alias("diameter"))
        stats.write.mode("append").parquet(f"{path}/batches")
        at += together
