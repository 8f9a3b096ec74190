"""Graphs as two tables, their loaders and generators."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.plans.durable import running, stored


@dataclass
class Graph:
    """vertices(id) and edges(src, dst), both without repeats; loops and isolated vertices are allowed."""

    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From columns src and dst, and id; without vertices, those of the edges. Rows with nulls are left out."""
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).na.drop().distinct()
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return cls(vertices.select(F.col("id").cast("long").alias("id")).na.drop().distinct(), edges)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, num_nodes: int | None = None, sep: str = ",") -> Graph:
        """Arcs of numeric ids, one a line, without header; ids 0 to num_nodes - 1 if given."""
        arcs = spark.read.schema("src BIGINT, dst BIGINT").option("sep", sep).csv(path)
        return cls.of(arcs, spark.range(num_nodes) if num_nodes is not None else None)

    @classmethod
    def from_table(cls, spark: SparkSession, edges_path: str, vertices_path: str | None = None) -> Graph:
        """From Parquet tables; the scan reads only the named columns."""
        return cls.of(spark.read.parquet(edges_path), spark.read.parquet(vertices_path) if vertices_path else None)

    @classmethod
    def from_labels(cls, arcs: DataFrame) -> tuple[Graph, DataFrame]:
        """From columns pos, a, b: arcs of labels in order of pos. Also returns the dictionary (id, label).

        Ids are dense, in order of first appearance.
        """
        ends = arcs.select("pos", F.posexplode(F.array("a", "b")).alias("side", "label"))
        first = ends.groupBy("label").agg(F.min(F.struct("pos", "side")).alias("first"))
        labels = stored(running(first, ["first"], {}, "id").select("id", "label"), "labels")
        one, two = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        return cls.of(arcs.join(one, "a").join(two, "b"), labels), labels

    @classmethod
    def from_label_file(cls, spark: SparkSession, path: str, sep: str = "\t") -> tuple[Graph, DataFrame]:
        """Arcs of labels from a text file, one a line, in the file's order."""
        lines = numbered_lines(spark, path)
        parts = F.split("value", sep, 2)
        return cls.from_labels(lines.where(F.size(parts) == 2).select("pos", parts[0].alias("a"), parts[1].alias("b")))

    def transpose(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def clustered(self) -> Graph:
        """The arcs dealt and sorted by src and written, for joins from there."""
        return Graph(self.vertices, stored(self.edges.repartition("src").sortWithinPartitions("src", "dst"), "arcs"))

    def size(self) -> DataFrame:
        one, none = F.lit(1).alias("v"), F.lit(0).alias("e")
        both = self.vertices.select(one, none).union(self.edges.select(none, one))
        return both.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n_vertices"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_arcs"))

    def successors(self) -> DataFrame:
        """src and its successors in order; a row for each vertex that has some."""
        return self.edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("successors"))

    def out_degree(self) -> DataFrame:
        degree = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def sinks(self) -> DataFrame:
        """Vertices without successors; of the transpose, those without predecessors."""
        return self.vertices.join(self.edges, F.col("id") == F.col("src"), "left_anti")

    def induced(self, members: DataFrame) -> Graph:
        """Arcs whose head is in members (id). Tails are not tested, as a traversal that filters successors does."""
        inside = self.edges.join(members.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        return Graph(self.vertices, inside)

    def check_transposed(self, other: Graph) -> None:
        """Raises if other can't be the transpose of this graph."""
        a, b = self.size().first(), other.size().first()
        if a != b:
            raise ValueError(f"not a graph and its transpose: {a} and {b}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, pos: the lines of a text file or folder with their numbers from 0, over the files in order of name.

    A part of a file is read in order by one task, so file, part and place within the task are the order of the lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return running(stored(lines, "lines"), ["file", "start", "place"], {}).select("value", "pos")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary with one label a line; the line number is the id. A folder's files are one dictionary, in order of name."""
    return numbered_lines(spark, path).select(F.col("pos").alias("id"), F.col("value").alias("label"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Writes a dictionary (id, label) as lines in order of id, over several files whose names are in that order."""
    labels.orderBy("id").select("label").write.text(path)


def decode(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Replaces the ids in a column by their labels."""
    names = labels.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    both = df.join(names, F.col(column) == F.col("__id"), "left")
    return both.select(*[F.col("__label").alias(c) if c == column else F.col(c) for c in df.columns])


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """key, value of the lines key=value of a file; lines that begin with # are comments. Of a repeated key, the last one holds."""
    lines = numbered_lines(spark, path).where("value LIKE '%=%' AND value NOT LIKE '#%'").select("pos", F.split("value", "=", 2).alias("p"))
    pairs = lines.select("pos", F.btrim(F.col("p")[0]).alias("key"), F.btrim(F.col("p")[1]).alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def write_properties(pairs: DataFrame, path: str, comment: str | None = None) -> None:
    """Writes key, value as lines key=value."""
    lines = pairs.select(F.concat("key", F.lit("="), "value").alias("value"))
    if comment:
        lines = pairs.sparkSession.range(1).select(F.lit(f"# {comment}").alias("value")).union(lines)
    lines.write.text(path)


#: Values of a line of a stored vector.
VECTOR_BLOCK = 65_536


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """Per-vertex measures stored as bracketed, comma-separated lines: node, value. The lines, often one alone, follow each other."""
    lines = numbered_lines(spark, path).select("pos", F.from_json("value", "array<double>").alias("values")).where("values IS NOT NULL")
    placed = running(lines.withColumn("size", F.size("values").cast("long")), ["pos"], {"upto": "size"}, "line")
    one = placed.select((F.col("upto") - F.col("size")).alias("before"), F.posexplode("values").alias("k", "value"))
    return one.select((F.col("before") + F.col("k")).alias("node"), "value")


def write_vector(values: DataFrame, path: str, block: int = VECTOR_BLOCK) -> None:
    """Writes node, value (nodes 0 to n - 1) as bracketed lines in order, `block` values a line; a null value is null."""
    text = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    lines = values.groupBy(F.floor(F.col("node") / block).alias("line")).agg(F.array_sort(F.collect_list(F.struct("node", text.alias("x")))).alias("own"))
    lines.orderBy("line").select(F.concat(F.lit("["), F.array_join(F.transform("own", lambda r: r["x"]), ", "), F.lit("]")).alias("value")).write.text(path)


def read_centrality(spark: SparkSession, path: str) -> DataFrame:
    """node, cc from CSV; nan and -nan are null."""
    raw = spark.read.schema("node BIGINT, cc STRING").csv(path)
    return raw.select("node", F.when(F.trim("cc").isin("nan", "-nan"), None).otherwise(F.expr("try_cast(cc AS DOUBLE)")).alias("cc"))


def star(spark: SparkSession, n: int) -> Graph:
    """Centre 0 with n spokes of two arcs each: 0 to i, and i to n + i."""
    i = F.col("id")
    arcs = spark.range(1, n + 1).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("src"), i.alias("dst")), F.struct(i.alias("src"), (i + n).alias("dst")))).alias("a"))
    return Graph(spark.range(2 * n + 1), arcs.select("a.*"))


def gnp(spark: SparkSession, n: int, p: float, seed: int = 42) -> Graph:
    """A random graph: each ordered pair is an arc with chance p, by arithmetic on its numbers, so every engine draws the same.

    Work is n * n; random graphs of that density have as many arcs but for the factor p.
    """
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).cast("long").alias("src"), (F.col("id") % n).alias("dst"))
    draw = (F.col("src") * 7919 + F.col("dst") * 104729 + (F.col("src") * F.col("dst")) % 10007 * 31337 + seed) % 1000003
    return Graph(spark.range(n), pairs.where((F.col("src") != F.col("dst")) & (draw < int(p * 1000003))))


def dual_barabasi_albert(spark: SparkSession, n: int, m1: int, m2: int = 3, p: float = 0.6, seed: int = 42) -> Graph:
    """Preferential attachment: each new vertex gets m1 neighbours with chance p, else m2. Arcs once per neighbour, as drawn.

    Each step depends on all before, so the arcs are drawn on the driver, which bounds n.
    """
    if n > 2_000_000:
        raise ValueError("preferential attachment is drawn on the driver; n must be at most 2,000,000")
    rng = random.Random(seed)
    start = max(m1, m2)
    arcs = [(0, i) for i in range(1, start + 1)]
    ends = [x for arc in arcs for x in arc]
    for v in range(start + 1, n):
        chosen: set[int] = set()
        while len(chosen) < (m1 if rng.random() < p else m2) and len(chosen) < v:
            chosen.add(rng.choice(ends))
        for u in sorted(chosen):
            arcs.append((u, v))
            ends += (u, v)
    return Graph(spark.range(n), spark.createDataFrame(arcs, "src BIGINT, dst BIGINT"))
