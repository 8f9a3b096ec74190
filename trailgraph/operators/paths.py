"""Simple paths between two vertices, enumerated or as a zero-suppressed decision diagram.

Mode `directed` follows arcs as they are. Mode `forward` numbers the vertices that the source reaches in breadth-first order,
keeps the arcs to a higher number, and reads those as undirected edges; on symmetric graphs both agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.operators.traverse import hop_distances
from trailgraph.plans.durable import running, stored
from trailgraph.sources.graphs import Graph


def bfs_numbering(graph: Graph, source: int, members: DataFrame | None = None) -> DataFrame:
    """id, num, level of the vertices that source reaches: 1 for the source, then by level, number of the first parent, and id."""
    graph = graph.induced(members) if members is not None else graph
    one = graph.spark.createDataFrame([(source,)], "src BIGINT")
    levels = hop_distances(graph, one, include_start=True).select(F.col("node").alias("id"), F.col("d").alias("level"))
    levels = stored(levels, "levels")
    deepest = levels.agg(F.max("level")).first()[0]
    known = stored(levels.where("level = 0").select("id", F.lit(1).cast("long").alias("num"), "level"), "numbers")
    out, count = known, 1
    for level in range(1, deepest + 1):
        parent = graph.edges.join(known.select(F.col("id").alias("src"), "num"), "src").groupBy("dst").agg(F.min("num").alias("parent"))
        own = levels.where(F.col("level") == level).join(parent, F.col("id") == F.col("dst")).select("id", "parent", "level")
        known = stored(running(own, ["parent", "id"], {}).select("id", (F.col("pos") + count + 1).alias("num"), "level"), "numbers")
        count += known.count()
        out = out.union(known)
    return out


def forward_arcs(graph: Graph, source: int, members: DataFrame | None = None) -> DataFrame:
    """arc, j, k, src, dst: the arcs to a higher number, numbered from 1 in order of j, the tail's number, and dst."""
    numbers = stored(bfs_numbering(graph, source, members), "numbers")
    graph = graph.induced(members) if members is not None else graph
    a, b = numbers.select(F.col("id").alias("src"), F.col("num").alias("j")), numbers.select(F.col("id").alias("dst"), F.col("num").alias("k"))
    arcs = graph.edges.join(a, "src").join(b, "dst").where("k > j")
    return running(arcs, ["j", "dst"], {}).select((F.col("pos") + 1).alias("arc"), "j", "k", "src", "dst")


def _check(graph: Graph, source: int, target: int) -> None:
    if source == target:
        raise ValueError("source and target must differ")


def _walks(edges: DataFrame, source: int, target: int, max_length: int | None) -> DataFrame:
    """All paths without repeated vertices along edges (src, dst); a round per length, so only live walks are kept."""
    live = edges.sparkSession.createDataFrame([([source],)], "path ARRAY<BIGINT>")
    found, length = [], 0
    edges = edges.distinct()
    while max_length is None or length < max_length:
        length += 1
        end = F.element_at("path", -1)
        live = live.join(edges, end == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        live = stored(live.select(F.concat("path", F.array("dst")).alias("path")), "walks")
        found.append(live.where(end == target))
        live = live.where(end != target)
        if live.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def simple_paths(graph: Graph, source: int, target: int, mode: str = "directed", max_length: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """path: every simple path from source to target. Raises if target is the source or can't be reached."""
    _check(graph, source, target)
    if mode == "directed":
        graph = graph.induced(members) if members is not None else graph
        # Only vertices that still reach the target can be on a path.
        one = graph.spark.createDataFrame([(target,)], "src BIGINT")
        useful = stored(hop_distances(graph.transpose(), one, include_start=True).select(F.col("node").alias("dst")), "useful")
        edges = graph.edges.join(useful, "dst", "left_semi")
        if useful.where(F.col("dst") == source).isEmpty():
            raise ValueError(f"no path from {source} to {target}")
    elif mode == "forward":
        arcs = stored(forward_arcs(graph, source, members), "arcs")
        if arcs.where(F.col("dst") == target).isEmpty():
            raise ValueError(f"no path from {source} to {target}")
        edges = arcs.select("src", "dst").union(arcs.select("dst", "src"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return _walks(edges, source, target, max_length)


#: Key of a state from which the path is complete, and marks of the two ends of the diagram.
DONE = [-1]
#: Arcs that one job of a count takes.
ARCS_AT_ONCE = 8


@dataclass
class Steps:
    """The arcs of a diagram in order, as numbers (j, k), and which vertices a state knows before each.

    The frontier before an arc is the source, the target and all vertices that an arc before touched, as long as an arc from
    there on touches them. A state holds their mates in that order and nothing else: itself if untouched, the other end of its
    fragment, or 0 inside one. Source and target begin as mates, so a path closes a ring.
    """

    arcs: list[tuple[int, int]]
    goal: int

    def __post_init__(self):
        self.last = {v: i for i, step in enumerate(self.arcs) for v in step}
        self.first = {v: i for i, step in reversed(list(enumerate(self.arcs))) for v in step} | {1: -1, self.goal: -1}

    def frontier(self, i: int) -> list[int]:
        return sorted(v for v, at in self.first.items() if at < i <= self.last[v])

    def start(self) -> list[int]:
        return [self.goal if v == 1 else 1 for v in self.frontier(0)]

    def children(self, i: int, mate: Column) -> tuple[Column, Column]:
        """The states after arc i without and with it; null is false, DONE true."""
        (j, k), before, after = self.arcs[i], self.frontier(i), self.frontier(i + 1)
        known = {v: F.get(mate, F.lit(p)) for p, v in enumerate(before)} | {v: F.lit(v) for v in self.arcs[i] if v not in before}
        mj, mk = known[j], known[k]

        def state(mates: dict[int, Column]) -> Column:
            """Null if a vertex that goes is a fragment's end, or none is left."""
            out = F.array(*[mates[v].cast("int") for v in after]) if after else F.lit(None).cast("array<int>")
            for v in set(mates) - set(after):
                out = F.when(mates[v].isin(0, v), out)
            return out

        joined = {v: F.when(mj == v, mk).when(mk == v, mj).otherwise(m) for v, m in known.items()}
        for v, m in ((j, mj), (k, mk)):
            joined[v] = F.when(m != v, F.lit(0)).otherwise(joined[v])
        alone = reduce(Column.__and__, [m.isin(0, v) for v, m in known.items() if v not in (j, k)], F.lit(True))
        done = F.array(*[F.lit(x) for x in DONE])
        hi = F.when((mj == 0) | (mk == 0), None).when((mj == k) & (mk == j), F.when(alone, done)).otherwise(state(joined))
        return state(known), hi


def _steps(arcs: DataFrame, target: int) -> Steps:
    """The arcs of a diagram, which its rounds follow one by one: meant for small components."""
    ends = arcs.where(F.col("dst") == target).select("k").first()
    if ends is None:
        raise ValueError(f"no path to {target}")
    return Steps([tuple(r) for r in arcs.orderBy("arc").select("j", "k").collect()], ends["k"])


def diagram(graph: Graph, source: int, target: int, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The reduced decision diagram (id, var, lo, hi) of the forward arcs' sets that are paths from source to target, and the arcs.

    Layers follow the arcs, equal states of a layer are one row, and a state is as wide as the frontier. Terminals are 0 (false)
    and 1 (true); a node's var is its arc's number. States can grow exponentially with the frontier's width: meant for small
    components; simple_paths needs no diagram, and count_all_paths no nodes.
    """
    _check(graph, source, target)
    arcs = stored(forward_arcs(graph, source, members), "arcs")
    steps = _steps(arcs, target)
    states = graph.spark.createDataFrame([(steps.start(),)], "mate ARRAY<INT>")
    name = lambda c: F.when(c.isNull(), "0").when(c == F.array(*[F.lit(x) for x in DONE]), "1").otherwise(F.concat(F.lit("m"), F.array_join(c.cast("array<string>"), ",")))
    layers = []
    for i in range(len(steps.arcs)):
        lo, hi = steps.children(i, F.col("mate"))
        layer = states.select(F.lit(i + 1).alias("var"), name(F.col("mate")).alias("key"), name(lo).alias("lo"), name(hi).alias("hi"))
        layers.append(stored(layer, "layer"))
        states = layers[-1].select(F.explode(F.array("lo", "hi")).alias("key")).where("key NOT IN ('0', '1')").distinct()
        states = states.select(F.split(F.substr("key", F.lit(2)), ",").cast("array<int>").alias("mate"))
    return _reduced(layers), arcs


def count_all_paths(graph: Graph, source: int, target: int, members: DataFrame | None = None) -> DataFrame:
    """paths: how many simple paths lead from source to target over forward arcs, of any length and without listing any.

    Ways into equal states are added up, arc by arc, several arcs a job, as whole numbers of 38 digits; more raise. Raises as
    diagram does. Work is by the number of states of a frontier, not by the number of paths.
    """
    _check(graph, source, target)
    steps = _steps(stored(forward_arcs(graph, source, members), "arcs"), target)
    states = graph.spark.createDataFrame([(steps.start(), 1)], "mate ARRAY<INT>, ways LONG").select("mate", F.col("ways").cast("decimal(38,0)").alias("ways"))
    done = F.array(*[F.lit(x) for x in DONE])
    for i in range(len(steps.arcs)):
        lo, hi = steps.children(i, F.col("mate"))
        after = F.when(F.col("mate") == done, F.array(done)).otherwise(F.array(lo, hi))
        states = states.select(F.explode(after).alias("mate"), "ways").where("mate IS NOT NULL")
        states = states.groupBy("mate").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        if (i + 1) % ARCS_AT_ONCE == 0:
            states = stored(states, "states")
    return states.where(F.col("mate") == done).agg(F.coalesce(F.sum("ways"), F.lit(0)).cast("decimal(38,0)").alias("paths"))


def _reduced(layers: list[DataFrame]) -> DataFrame:
    """Bottom-up: nodes whose hi is false give way to their lo, and equal nodes of a layer are one."""
    spark = layers[0].sparkSession
    known = spark.createDataFrame([("0", "0"), ("1", "1")], "key STRING, node STRING")
    nodes = []
    for layer in reversed(layers):
        lo, hi = known.select(F.col("key").alias("lo"), F.col("node").alias("l")), known.select(F.col("key").alias("hi"), F.col("node").alias("h"))
        both = layer.join(lo, "lo").join(hi, "hi")
        name = F.when(F.col("h") == "0", F.col("l")).otherwise(F.md5(F.concat_ws("|", F.col("var").cast("string"), "l", "h")))
        both = stored(both.select("key", "var", "l", "h", name.alias("node")), "reduced")
        nodes.append(both.where("h <> '0'").select("node", "var", "l", "h").distinct())
        ends = spark.createDataFrame([("0", "0"), ("1", "1")], "key STRING, node STRING")
        known = both.select("key", "node").union(ends)
    every = nodes[0]
    for more in nodes[1:]:
        every = every.union(more)
    # Each node is some state's, and states come from the root, so all nodes hang together.
    numbered = stored(running(every, ["var", "l", "h"], {}).withColumn("id", F.col("pos") + 2), "nodes")
    ids = numbered.select("node", "id").union(spark.createDataFrame([("0", 0), ("1", 1)], "node STRING, id BIGINT"))
    lo, hi = ids.select(F.col("node").alias("l"), F.col("id").alias("lo")), ids.select(F.col("node").alias("h"), F.col("id").alias("hi"))
    return numbered.join(lo, "l").join(hi, "h").select("id", "var", "lo", "hi")


def decode(nodes: DataFrame, arcs: DataFrame, source: int) -> DataFrame:
    """path: the paths of a diagram, each arc set walked from the source."""
    nodes = stored(nodes, "nodes")
    live = nodes.orderBy("var", "id").limit(1).select(F.col("id").alias("at"), F.array().cast("array<int>").alias("sets"))
    done = []
    while not live.isEmpty():
        own = live.join(nodes, F.col("at") == F.col("id"))
        step = own.select("lo", "sets").withColumnRenamed("lo", "at").union(own.select("hi", F.concat("sets", F.array("var"))))
        step = stored(step.where("at <> 0"), "walks")
        done.append(step.where("at = 1").select("sets"))
        live = step.where("at <> 1")
    if not done:
        return arcs.sparkSession.createDataFrame([], "path ARRAY<BIGINT>")
    sets = done[0]
    for more in done[1:]:
        sets = sets.union(more)
    sets = sets.withColumn("key", F.concat_ws(",", F.col("sets").cast("array<string>")))
    edges = sets.select("key", F.explode("sets").alias("arc")).join(arcs, "arc").groupBy("key").agg(F.collect_list(F.array("src", "dst")).alias("edges"))
    other = lambda e, x: F.when(e[0] == x, e[1]).otherwise(e[0])

    def walk(state: Column, _: Column) -> Column:
        end = F.element_at(state["path"], -1)
        at = F.filter(state["left"], lambda e: F.array_contains(e, end))[0]
        return F.struct(F.concat(state["path"], F.array(other(at, end))).alias("path"), F.array_except(state["left"], F.array(at)).alias("left"))

    start = F.struct(F.array(F.lit(source).cast("long")).alias("path"), F.col("edges").alias("left"))
    return edges.select(F.aggregate("edges", start, walk)["path"].alias("path"))


def count_paths(graph: Graph, source: int, target: int, mode: str = "directed", members: DataFrame | None = None) -> DataFrame:
    return simple_paths(graph, source, target, mode, members=members).agg(F.count("*").alias("paths"))


