"""Streams: merging of several producers, and running averages of a stream of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def from_folder(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON lines that appear under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def merged(*streams: DataFrame) -> DataFrame:
    """One stream of the messages of all, in no order."""
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what the stream holds to Parquet under path and ends; a later call goes on where this one ended."""
    query: StreamingQuery = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """start, end, n per tumbling window; rows later than the watermark are left out."""
    own = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return own.select("w.start", "w.end", "n")


class RunningAverages:
    """A foreachBatch sink that keeps the running mean and deviation of (norm, diameter) rows in a table, one row per batch.

    A batch's row has number, mean and summed squares about the mean of each measure, so a batch costs its own rows only and
    large values with a small spread keep it. A repeated batch id is the same batch again.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, rows: DataFrame, batch: int) -> None:
        own = rows.agg(*[x.alias(f"{k}_{c}") for c in ("norm", "diameter") for k, x in (("n", F.count(c)), ("mean", F.avg(c)), ("squares", F.var_pop(c) * F.count(c)))])
        own.select(F.lit(batch).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(f"{self.path}/batch={batch}/")

    def averages(self, spark: SparkSession) -> DataFrame:
        """average, spread, diameter, diameter_spread over all batches so far; the spread of one value is NaN."""
        parts = spark.read.option("recursiveFileLookup", "true").parquet(self.path)
        names = (("norm", "average", "spread"), ("diameter", "diameter", "diameter_spread"))
        whole = parts.agg(*[F.try_divide(F.sum(F.col(f"n_{c}") * F.col(f"mean_{c}")), F.sum(f"n_{c}")).alias(mean) for c, mean, _ in names]).first()
        out = []
        for c, mean, spread in names:
            away = F.col(f"mean_{c}") - F.lit(whole[mean])
            squares = F.sum(F.col(f"squares_{c}") + F.col(f"n_{c}") * away * away)
            alone = F.when(F.sum(f"n_{c}") == 1, F.lit(float("nan")))
            out += [F.lit(whole[mean]).cast("double").alias(mean), alone.otherwise(F.sqrt(F.try_divide(squares, F.sum(f"n_{c}") - 1))).alias(spread)]
        return parts.agg(*out)
