"""Tables kept in buckets of the shared folder, so that joins on their keys leave them where they are."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailgraph.plans.durable import TABLES, files_of, shared_dir

#: Arcs of one vertex in one part; the arcs of a vertex with more are dealt over several parts.
PART_ARCS = 100_000
#: Rows up to which a table may be sent whole to meet others. Spark goes by compressed bytes, of which a large table of near ids has few.
BROADCAST_ROWS = 100_000


def buckets(spark: SparkSession) -> int:
    """As many buckets as shuffles have partitions, so that a shuffled side meets a bucketed one without moving it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner", large: bool = True) -> DataFrame:
    """rows joined with a table. If it is large, by sorting where both lie, so that nothing of it goes through the driver."""
    return rows.join(table.hint("merge") if large else table, on, how)


@dataclass
class Bucketed:
    """A table of the catalog, bucketed and sorted by keys, under a path of its own."""

    rows: DataFrame
    name: str
    path: str
    count: int

    @property
    def large(self) -> bool:
        return self.count > BROADCAST_ROWS

    def discard(self) -> None:
        """Removes the table and its files, once nothing reads them any more."""
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        files, where = files_of(spark, self.path)
        files.delete(where, True)


def bucketed(df: DataFrame, keys: list[str], name: str, path: str | None = None, dealt: bool = False) -> Bucketed:
    """Writes df in buckets of its keys and counts its rows on the way. dealt: df is partitioned by its keys already."""
    spark, seen = df.sparkSession, Observation()
    n, table = buckets(spark), f"trailgraph_{name}_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/{TABLES}/{table}"
    placed = df if dealt else df.repartition(n, *keys)
    placed.observe(seen, F.count(F.lit(1)).alias("n")).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(table)
    return Bucketed(spark.table(table), table, path, seen.get["n"])


@dataclass
class Index:
    """The arcs (tail, head, w) in buckets of tail. If there are hubs (tail, parts), the arcs have a part and lie in buckets of tail and part."""

    arcs: Bucketed
    hubs: Bucketed | None

    def ahead(self, rows: DataFrame) -> DataFrame:
        """rows (node and others) joined with the arcs from node, its tail. Only rows move, to where the arcs of their vertices lie."""
        if self.hubs is None:
            return met(rows.withColumnRenamed("node", "tail"), self.arcs.rows, "tail", large=self.arcs.large)
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        rows = rows.withColumnRenamed("node", "tail").join(self.hubs.rows, "tail", "left").withColumn("part", F.explode(parts))
        return met(rows.drop("parts"), self.arcs.rows, ["tail", "part"], large=self.arcs.large).drop("part")

    def discard(self) -> None:
        for table in (self.arcs, self.hubs):
            if table is not None:
                table.discard()


def indexed(edges: DataFrame, part_arcs: int = PART_ARCS) -> Index:
    """The index of edges (src, dst and, if they have lengths, w; 1 otherwise).

    The arcs of a vertex with more than part_arcs are dealt by their heads over as many parts as that takes, so no bucket
    holds all of a hub's arcs and no task meets them all.
    """
    w = F.col("w").cast("long") if "w" in edges.columns else F.lit(1).cast("long")
    arcs = edges.select(F.col("src").alias("tail"), F.col("dst").alias("head"), w.alias("w"))
    many = arcs.groupBy("tail").agg(F.count("*").alias("n")).where(F.col("n") > part_arcs)
    hubs = bucketed(many.select("tail", F.ceil(F.col("n") / part_arcs).cast("int").alias("parts")), ["tail"], "hubs")
    if not hubs.count:
        hubs.discard()
        return Index(bucketed(arcs, ["tail"], "arcs"), None)
    part = F.pmod(F.xxhash64("head"), F.coalesce("parts", F.lit(1))).cast("int")
    return Index(bucketed(arcs.join(hubs.rows, "tail", "left").select("tail", "head", "w", part.alias("part")), ["tail", "part"], "arcs"), hubs)
