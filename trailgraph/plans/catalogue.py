"""Every operator as a query on the driver's tables, with SQL for the same rows where SQL can express it.

Three sparse directed graphs are derived from the tables: customers in the order of urgent orders, users in the order of
error events, and parts within orders.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailgraph.functions.scalars import closeness_sample_size_column, sample_size_column
from trailgraph.operators import centrality, components, estimate, paths, sampling, sketches, traverse
from trailgraph.plans.durable import running, shared_dir, stored, stored_once
from trailgraph.plans.index import indexed
from trailgraph.sources import graphs, sinks
from trailgraph.sources.graphs import Graph
from trailgraph.streaming import channels, estimates

CUST = """SELECT DISTINCT src, dst FROM (
  SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS dst, o_orderpriority AS p FROM orders) t
WHERE dst IS NOT NULL AND src <> dst AND p = '1-URGENT'"""
USERS = """SELECT DISTINCT src, dst FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type AS p, value FROM events) t
WHERE dst IS NOT NULL AND src <> dst AND p = 'error' AND value < 20"""
PARTS = """SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst, l_quantity AS q FROM lineitem) t
WHERE dst IS NOT NULL AND src <> dst AND q >= 48"""

#: Arcs, table and column of vertices of each graph.
GRAPHS = {"cust": (CUST, "orders", "customer", "c_custkey"), "users": (USERS, "events", "events", "user_id"), "parts": (PARTS, "lineitem", "part", "p_partkey")}


def followed(rows: DataFrame, order: list[str]) -> DataFrame:
    """From rows (v, wanted and the columns of a total order) the arcs from each wanted row's v to the next row's: src, dst.

    The rows are numbered over many partitions, so the order needs no window without keys.
    """
    ranked = stored(running(rows.select("v", "wanted", *order), order, {}).select("pos", "v", "wanted"), "ranked")
    after = ranked.select((F.col("pos") - 1).alias("pos"), F.col("v").alias("dst"))
    return ranked.where("wanted").join(after, "pos").where("v <> dst").select(F.col("v").alias("src"), "dst").distinct()


def arcs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The arcs of a graph of GRAPHS, as its SQL has them."""
    t = spark.read.parquet(f"{sf_dir}/{GRAPHS[name][1]}.parquet")
    if name == "cust":
        return followed(t.select(F.col("o_custkey").alias("v"), F.expr("o_orderpriority = '1-URGENT'").alias("wanted"), "o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])
    if name == "users":
        return followed(t.select(F.col("user_id").alias("v"), F.expr("event_type = 'error' AND value < 20").alias("wanted"), "ts", "event_id"), ["ts", "event_id"])
    return spark.sql(PARTS.replace("FROM lineitem)", "FROM {t})"), t=t)


def load(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """A graph of GRAPHS, derived and written once a session."""
    _, table, of, column = GRAPHS[name]
    inputs = [f"{sf_dir}/{t}.parquet" for t in {table, of}]
    edges = stored_once(spark, (sf_dir, name, "arcs"), inputs, lambda: Graph.of(arcs(spark, sf_dir, name)).edges.hint("rebalance"))
    ids = lambda: Graph.of(edges, spark.read.parquet(f"{sf_dir}/{of}.parquet").select(F.col(column).alias("id"))).vertices.hint("rebalance")
    return Graph(stored_once(spark, (sf_dir, name, "vertices"), inputs, ids), edges)


def head(name: str) -> str:
    """The common table expressions e(src, dst), v(id) and r(src, dst, d), all hop distances of 1 or more."""
    sql, _, of, column = GRAPHS[name]
    return f"""WITH RECURSIVE e AS ({sql}), v AS (SELECT DISTINCT {column} AS id FROM {of}),
r(src, dst, d) USING KEY (src, dst) AS (
  SELECT src, dst, 1 FROM e
  UNION
  SELECT r.src, e.dst, min(r.d) + 1 FROM r JOIN e ON r.dst = e.src
  WHERE e.dst <> r.src AND NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.src = r.src AND k.dst = e.dst)
  GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM v)"""


def plain(name: str) -> str:
    sql, _, of, column = GRAPHS[name]
    return f"WITH e AS ({sql}), v AS (SELECT DISTINCT {column} AS id FROM {of}), n AS (SELECT count(*) AS n FROM v)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(plain("cust") + " SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_arcs")
def graph_size(spark, sf_dir):
    return load(spark, sf_dir, "cust").size()


@query(plain("cust") + " SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON v.id = e.src GROUP BY v.id")
def out_degree(spark, sf_dir):
    return load(spark, sf_dir, "cust").out_degree()


@query(plain("cust") + " SELECT src, list(dst ORDER BY dst)::VARCHAR AS successors FROM e GROUP BY src")
def successors(spark, sf_dir):
    out = load(spark, sf_dir, "cust").successors()
    return out.select("src", F.concat(F.lit("["), F.concat_ws(", ", F.col("successors").cast("array<string>")), F.lit("]")).alias("successors"))


@query(plain("parts") + " SELECT count(*) AS sinks FROM v WHERE id NOT IN (SELECT src FROM e)")
def sinks_count(spark, sf_dir):
    return load(spark, sf_dir, "parts").sinks().agg(F.count("*").alias("sinks"))


@query(plain("parts") + " SELECT count(*) AS sources FROM v WHERE id NOT IN (SELECT dst FROM e)")
def sources_only(spark, sf_dir):
    return load(spark, sf_dir, "parts").transpose().sinks().agg(F.count("*").alias("sources"))


@query(plain("parts") + " SELECT dst AS src, src AS dst FROM e")
def transpose_arcs(spark, sf_dir):
    return load(spark, sf_dir, "parts").transpose().edges


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, 'c' || o_custkey AS x, 'p' || o_orderpriority AS y FROM orders),
f AS (SELECT label, min(p) AS p FROM (SELECT x AS label, 2 * pos AS p FROM a UNION ALL SELECT y, 2 * pos + 1 FROM a) t GROUP BY label)
SELECT row_number() OVER (ORDER BY p) - 1 AS id, label FROM f""")
def dense_ids(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), "o_orderpriority").alias("b"))
    return Graph.from_labels(running(orders, ["o_orderdate", "o_orderkey"], {}).select("pos", "a", "b"))[1]


@query(head("users") + " SELECT src, dst AS node, CAST(d AS BIGINT) AS d FROM r")
def hop_distances(spark, sf_dir):
    return traverse.hop_distances(load(spark, sf_dir, "users"))


@query(head("users") + " SELECT src, dst AS node, CAST(d AS BIGINT) AS d FROM r")
def hop_distances_by_joins(spark, sf_dir):
    return traverse.hop_distances(load(spark, sf_dir, "users"), strategy="frontier")


@query(head("cust") + """ SELECT v.id AS src, CAST(coalesce(max(d), 0) AS BIGINT) AS ecc, CAST(coalesce(sum(d), 0) AS BIGINT) AS dist_sum, count(d) AS reach
FROM v LEFT JOIN r ON v.id = r.src GROUP BY v.id""")
def bfs_summary(spark, sf_dir):
    return traverse.bfs_summary(load(spark, sf_dir, "cust"))


@query(head("users") + """ SELECT v.id AS src, CAST(coalesce(max(d), 0) AS BIGINT) AS ecc, CAST(coalesce(sum(d), 0) AS BIGINT) AS dist_sum, count(d) AS reach
FROM v LEFT JOIN r ON v.id = r.src GROUP BY v.id""")
def bfs_summary_by_joins(spark, sf_dir):
    return traverse.bfs_summary(load(spark, sf_dir, "users"), strategy="frontier")


@query(head("users") + " SELECT dst AS node, CAST(d AS BIGINT) AS d, count(*) AS n FROM r GROUP BY 1, 2")
def node_levels_by_joins(spark, sf_dir):
    return traverse.node_levels(load(spark, sf_dir, "users"), strategy="frontier")


@query(plain("cust") + " SELECT a.src, CAST(count(DISTINCT b.dst) AS BIGINT) AS n FROM e a JOIN e b ON a.dst = b.src GROUP BY a.src")
def two_hops_on_index(spark, sf_dir):
    """How many vertices are two arcs away, by two joins on the stored index; the arcs stay in their buckets."""
    g = load(spark, sf_dir, "cust")
    index = indexed(g.edges)
    once = index.ahead(g.vertices.select(F.col("id").alias("node"), F.col("id").alias("src"))).select("src", F.col("head").alias("node")).distinct()
    return index.ahead(once).select("src", "head").groupBy("src").agg(F.count_distinct("head").alias("n"))


#: A customer's orders follow each other; the last of some leads back to the first, and dear urgent ones also to the next order of all.
ORDERED = """o AS (SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' AS urgent, o_totalprice >= 450000 AS dear, lead(o_orderkey) OVER own AS own, first_value(o_orderkey) OVER own AS first,
  lead(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS following, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WINDOW own AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
OWN_ORDERS = "SELECT id AS src, own AS dst FROM o WHERE own IS NOT NULL UNION SELECT id, following FROM o WHERE urgent AND dear AND following IS NOT NULL UNION SELECT id, first FROM o WHERE own IS NULL AND urgent AND id <> first"
#: All orders follow each other, and dear urgent ones also lead to their customer's next.
ALL_ORDERS = "SELECT id AS src, following AS dst FROM o WHERE following IS NOT NULL UNION SELECT id, own FROM o WHERE urgent AND dear AND own IS NOT NULL"


def order_graph(spark: SparkSession, sf_dir: str, arcs: str) -> Graph:
    """A deep graph of orders, by OWN_ORDERS or ALL_ORDERS. The order of all is found by range-sorting, not by a window without keys."""

    def made() -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
        placed = stored(running(t, ["o_orderdate", "o_orderkey"], {}, "place"), "placed")
        after = placed.select((F.col("place") - 1).alias("place"), F.col("o_orderkey").alias("following"))
        own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        o = placed.withColumn("own", F.lead("o_orderkey").over(own)).withColumn("first", F.first("o_orderkey").over(own)).join(after, "place", "left")
        o = o.select(F.col("o_orderkey").alias("id"), "own", "first", "following", F.expr("o_orderpriority = '1-URGENT' AS urgent"), F.expr("o_totalprice >= 450000 AS dear"))
        return spark.sql(arcs.replace(" FROM o ", " FROM {o} "), o=o).hint("rebalance")

    name = "own" if arcs is OWN_ORDERS else "all"
    edges = stored_once(spark, (sf_dir, name, "orders"), [f"{sf_dir}/orders.parquet"], lambda: Graph.of(made()).edges)
    return Graph.of(edges, spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id")))


@query(f"""WITH RECURSIVE {ORDERED}, e AS MATERIALIZED ({OWN_ORDERS}), r(src, dst, d) USING KEY (src, dst) AS (
  SELECT src, dst, 1 FROM e
  UNION
  SELECT r.src, e.dst, min(r.d) + 1 FROM r JOIN e ON r.dst = e.src
  WHERE e.dst <> r.src AND NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.src = r.src AND k.dst = e.dst) GROUP BY 1, 2)
SELECT id AS src, CAST(coalesce(max(d), 0) AS BIGINT) AS ecc, CAST(coalesce(sum(d), 0) AS BIGINT) AS dist_sum, count(d) AS reach FROM o LEFT JOIN r ON id = r.src GROUP BY id""")
def bfs_summary_by_chains(spark, sf_dir):
    """From every order, by contraction of chains and rings."""
    return traverse.bfs_summary(order_graph(spark, sf_dir, OWN_ORDERS), strategy="chains")


@query(f"""WITH RECURSIVE {ORDERED}, e AS MATERIALIZED ({ALL_ORDERS}), s AS (SELECT id AS s FROM o WHERE place = 1), r(node, d) USING KEY (node) AS (
  SELECT s, 0 FROM s
  UNION
  SELECT e.dst, min(r.d) + 1 FROM r JOIN e ON r.node = e.src WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.node = e.dst) GROUP BY 1)
SELECT s AS src, node, CAST(d AS BIGINT) AS d FROM r, s WHERE d > 0""")
def hop_distances_by_chains(spark, sf_dir):
    """From the first order over hundreds of levels, which are few rounds in the contracted graph."""
    g = order_graph(spark, sf_dir, ALL_ORDERS)
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.struct("o_orderdate", F.col("o_orderkey").alias("src")).alias("o"))
    return traverse.hop_distances(g, first.agg(F.min("o").alias("o")).select("o.src"), strategy="chains")


@query(head("users") + " SELECT dst AS src, src AS node, CAST(d AS BIGINT) AS d FROM r UNION ALL SELECT id, id, 0 FROM v")
def ancestors(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    return traverse.ancestors(g, traverse.all_sources(g))


@query(head("cust") + " SELECT src, dst AS node, CAST(d AS BIGINT) AS d FROM r WHERE d <= 3")
def bounded_hops(spark, sf_dir):
    return traverse.hop_distances(load(spark, sf_dir, "cust"), max_depth=3)


EXACT = " SELECT CAST(sum(d) AS BIGINT) AS total, count(*) AS pairs, CAST(max(d) AS BIGINT) AS diameter, CAST(sum(d) AS DOUBLE) / count(*) AS average FROM r"


@query(head("cust") + EXACT)
def exact_avg_distance(spark, sf_dir):
    return estimate.exact(load(spark, sf_dir, "cust"))


@query(head("parts") + EXACT)
def exact_avg_distance_parts(spark, sf_dir):
    return estimate.exact(load(spark, sf_dir, "parts"))


#: Draws as arithmetic: the vertices of the driver's graphs are 0 to n - 1.
PAIRS = f""", k AS (SELECT CAST(ceil(log2(n) / (2 * 0.1::DOUBLE * 0.1::DOUBLE)) AS BIGINT) AS k FROM n),
x AS (SELECT i, {sampling.draw_sql('i', sampling.FIRST, 42)} % n AS v, {sampling.draw_sql('i', sampling.SECOND, 43)} % n AS w FROM n, k, range(16384) t(i) WHERE i < 4 * k),
c AS (SELECT x.* FROM x JOIN r ON x.v = r.src AND x.w = r.dst WHERE v <> w ORDER BY i LIMIT (SELECT k FROM k)),
b AS (SELECT src, sum(d) AS s, count(*) AS c, max(d) AS m FROM r GROUP BY src)
SELECT CAST(max(m) AS BIGINT) AS diameter, CAST(sum(b.s) AS BIGINT) AS total, CAST(sum(b.c) AS BIGINT) AS pairs, count(*) AS nonempty, round(sum(CAST(b.s AS DOUBLE) / b.c) / (SELECT k FROM k), 9) AS average
FROM c JOIN b ON c.v = b.src"""


@query(head("users") + PAIRS)
def avg_distance_pairs(spark, sf_dir):
    out = estimate.average_distance(load(spark, sf_dir, "users"), "pairs", "mean_of_ratios", eps=0.1, seed=42)
    return out.withColumn("average", F.round("average", 9))


BATCHED = f""", x AS (SELECT i, {sampling.draw_sql('i', sampling.FIRST, 42)} % n AS v FROM n, range(400) t(i)),
b AS (SELECT src, sum(d) AS s, count(*) AS c, max(d) AS m FROM r GROUP BY src),
s AS (SELECT CAST(i // 40 AS BIGINT) AS batch, CAST(sum(s) AS BIGINT) AS total, CAST(sum(c) AS BIGINT) AS pairs, CAST(max(m) AS BIGINT) AS diameter FROM x JOIN b ON x.v = b.src GROUP BY 1)"""


@query(head("users") + BATCHED + " SELECT s.*, round(CAST(total AS DOUBLE) / pairs, 9) AS norm, round(CAST(total AS DOUBLE) / pairs / (n - 1), 12) AS scaled FROM s, n")
def avg_distance_uniform(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    out = estimate.batch_stats(g, sampling.uniform(g, 400), 40)
    return out.withColumn("norm", F.round("norm", 9)).withColumn("scaled", F.round("scaled", 12))


@query(head("users") + BATCHED + """ SELECT batch, round(avg(norm) OVER w, 8) AS average, round(coalesce(stddev_samp(norm) OVER w, 0), 8) AS spread,
  round(avg(diameter) OVER w, 8) AS diameter, round(coalesce(stddev_samp(diameter) OVER w, 0), 8) AS diameter_spread
FROM (SELECT batch, diameter, CAST(total AS DOUBLE) / pairs AS norm FROM s) t WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)""")
def batch_running_avg(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    out = estimate.running_averages(estimate.batch_stats(g, sampling.uniform(g, 400), 40))
    # NaN, the deviation of one batch, doesn't compare equal everywhere: shown as 0 here.
    return out.select("batch", *[F.round(F.nanvl(c, F.lit(0.0)), 8).alias(c) for c in ("average", "spread", "diameter", "diameter_spread")])


@query(head("users") + BATCHED + """, a AS (SELECT batch, row_number() OVER w AS n, avg(norm) OVER w AS average, stddev_samp(norm) OVER w AS spread, avg(diameter) OVER w AS diameter
  FROM (SELECT batch, diameter, CAST(total AS DOUBLE) / pairs AS norm FROM s) t WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, coalesce(1.96::DOUBLE * spread / sqrt(n), 0) AS half_width, n >= 3 AND 1.96::DOUBLE * spread / sqrt(n) < 0.05 AS precise FROM a)
SELECT batch, n, round(average, 8) AS average, round(coalesce(spread, 0), 8) AS spread, round(diameter, 8) AS diameter, round(half_width, 8) AS half_width, precise
FROM h WHERE batch <= coalesce((SELECT min(batch) FROM h WHERE precise), 1000)""")
def batch_stream_until_precise(spark, sf_dir):
    """Batches as a stream with state, traversed until the average is known to a twentieth of a hop."""
    g = load(spark, sf_dir, "users")
    out = estimates.until_precise(g, sampling.uniform(g, 400), 40, 0.05, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}")
    return out.select("batch", "n", *[F.round(F.nanvl(c, F.lit(0.0)), 8).alias(c) for c in ("average", "spread", "diameter", "half_width")], "precise")


WEIGHTS = f""", t AS (SELECT i, {sampling.draw_sql('i', sampling.SECOND, 42)} % n AS v FROM n, range(100) t(i)),
b AS (SELECT src AS node, dst AS v FROM r UNION ALL SELECT id, id FROM v),
w AS (SELECT v.id AS node, count(b.v) AS weight FROM v LEFT JOIN (SELECT b.* FROM t JOIN b ON t.v = b.v) b ON v.id = b.node GROUP BY v.id),
c AS (SELECT node, weight, CAST(sum(weight) OVER (ORDER BY node) AS BIGINT) AS cumulative FROM w)"""


@query(head("users") + WEIGHTS + " SELECT node, weight, cumulative FROM c")
def reach_weights(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    return sampling.reach_weights(g, sampling.uniform(g, 100, 42, sampling.SECOND))


@query(head("users") + WEIGHTS + f""", m AS (SELECT max(cumulative) AS m FROM c), d AS (SELECT i AS draw_id, {sampling.draw_sql('i', sampling.THIRD, 42)} % m + 1 AS x FROM m, range(500) t(i))
SELECT draw_id, node AS v FROM d JOIN c ON x > cumulative - weight AND x <= cumulative""")
def reach_weighted_draws(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    return sampling.reach_weighted(g, 500, sampling.uniform(g, 100, 42, sampling.SECOND))


@query(plain("cust") + """ SELECT eps, CAST(ceil(log2(n) / (2::DOUBLE * eps * eps)) AS BIGINT) AS k, CAST(ceil(6.907::DOUBLE / (2::DOUBLE * eps * eps)) AS BIGINT) AS k_closeness
FROM n, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(eps)""")
def sample_size(spark, sf_dir):
    n = load(spark, sf_dir, "cust").vertices.agg(F.count("*").alias("n"))
    eps = n.withColumn("eps", F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))))
    return eps.select("eps", sample_size_column(F.col("n"), F.col("eps")).alias("k"), closeness_sample_size_column(F.col("eps")).alias("k_closeness"))


@query(head("users") + " SELECT dst AS node, count(*) AS reach FROM r GROUP BY dst")
def node_reach(spark, sf_dir):
    return centrality.reach(centrality.sums(load(spark, sf_dir, "users"), "in"))


@query(head("users") + " SELECT dst AS node, CAST(sum(d) AS BIGINT) AS dist_sum FROM r GROUP BY dst")
def node_distance_sum(spark, sf_dir):
    return centrality.distance_sum(centrality.sums(load(spark, sf_dir, "users"), "in"))


CLOSE = ", c AS (SELECT src AS node, 1::DOUBLE / (CAST(sum(d) AS BIGINT) * (SELECT n FROM n)) AS c FROM r GROUP BY src)"


def _closeness(spark, sf_dir, name="cust"):
    g = load(spark, sf_dir, name)
    return centrality.closeness(centrality.sums(g), g.vertices.count())


@query(head("cust") + CLOSE + " SELECT * FROM c")
def closeness(spark, sf_dir):
    return _closeness(spark, sf_dir)


@query(head("users") + CLOSE + " SELECT CAST(floor(c * 1000000000::DOUBLE) AS BIGINT) AS bucket, count(*) AS cnt, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY node) AS members FROM c GROUP BY 1")
def closeness_buckets(spark, sf_dir):
    out = centrality.buckets(_closeness(spark, sf_dir, "users"))
    return out.withColumn("members", F.concat_ws(" ", F.col("members").cast("array<string>")))


HIST = " SELECT CAST(floor(c * {0}::DOUBLE) AS BIGINT) AS bucket, floor(c * {0}::DOUBLE) / {0}::DOUBLE AS lo, (floor(c * {0}::DOUBLE) + 1) / {0}::DOUBLE AS hi, count(*) AS cnt FROM c GROUP BY 1, 2, 3"


@query(head("cust") + CLOSE + HIST.format(1000000))
def closeness_hist(spark, sf_dir):
    return centrality.histogram(_closeness(spark, sf_dir))


HARMONIC = ", h AS (SELECT src, d, count(*) AS k FROM r GROUP BY 1, 2), c AS (SELECT src AS node, round(sum(k * (1::DOUBLE / (1 + d))) * (1::DOUBLE / (SELECT n FROM n)), 9) AS c FROM h GROUP BY src)"


def _harmonic(spark, sf_dir):
    g = load(spark, sf_dir, "cust")
    return centrality.harmonic(centrality.sums(g), g.vertices.count()).withColumn("c", F.round("c", 9))


@query(head("cust") + HARMONIC + " SELECT * FROM c")
def harmonic(spark, sf_dir):
    return _harmonic(spark, sf_dir)


@query(head("cust") + HARMONIC + HIST.format(1000))
def harmonic_hist(spark, sf_dir):
    return centrality.histogram(_harmonic(spark, sf_dir), 1000)


@query(head("cust") + CLOSE + " SELECT row_number() OVER (ORDER BY c DESC, node) - 1 AS rank, node, c FROM c")
def centrality_rank(spark, sf_dir):
    c = _closeness(spark, sf_dir)
    return running(c.withColumn("down", -F.col("c")), ["down", "node"], {}, "rank").select("rank", "node", "c")


@query(head("cust") + CLOSE + """, m AS (SELECT min(c) AS a, max(c) AS b FROM c)
SELECT CAST(least(floor((c - a) / (b - a) * 10), 9) AS BIGINT) AS bin, count(*) AS cnt FROM c, m GROUP BY 1""")
def equal_width_hist(spark, sf_dir):
    return centrality.equal_width(_closeness(spark, sf_dir))


@query(head("cust") + """ SELECT src AS node, count(*) AS reach, CAST(sum(d) AS BIGINT) AS dist_sum, CAST(count(*) * count(*) AS DOUBLE) / sum(d) AS lin,
  CAST(count(*) * count(*) - sum(d) AS BIGINT) AS nieminen FROM r GROUP BY src""")
def lin_nieminen(spark, sf_dir):
    return centrality.indices(centrality.sums(load(spark, sf_dir, "cust")))


#: Registers of each vertex by distance, from the pairs: the running maxima that rise, as the sketches have them.
SKETCHED = f""", a AS (SELECT src, dst, CAST(d AS BIGINT) AS d FROM r UNION ALL SELECT id, id, 0 FROM v),
h AS (SELECT id, md5(CAST(id AS VARCHAR)) AS h FROM v),
k AS (SELECT id, CAST('0x' || substr(h, 1, 4) AS BIGINT) % {1 << sketches.PRECISION} AS key, 49 - length(bin(CAST('0x' || substr(h, 5, 12) AS BIGINT))) AS rank FROM h),
m AS (SELECT src, d, key, max(rank) AS value FROM a JOIN k ON a.dst = k.id GROUP BY src, d, key),
u AS (SELECT *, max(value) OVER (PARTITION BY src, key ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM m),
g AS (SELECT src, d, sum(pow(2.0, -value) - CASE WHEN old IS NULL THEN 0 ELSE pow(2.0, -old) END) AS more, count(*) - count(old) AS used FROM u WHERE old IS NULL OR value > old GROUP BY src, d),
w AS (SELECT src, d, sum(more) OVER t AS powers, ({1 << sketches.PRECISION} - sum(used) OVER t)::DOUBLE / {1 << sketches.PRECISION} AS x FROM g WINDOW t AS (PARTITION BY src ORDER BY d)),
z AS (SELECT src, d, {(1 << 2 * sketches.PRECISION) / (2 * math.log(2))!r}::DOUBLE / (powers + {1 << sketches.PRECISION}::DOUBLE * (x + {' + '.join(f'pow(x, {1 << (k + 1)}) * {1 << k}' for k in range(sketches.PRECISION + 6))})) AS within FROM w),
f AS (SELECT src, d, within - lag(within) OVER (PARTITION BY src ORDER BY d) AS n FROM z),
t AS (SELECT src, sum(n) AS reach, sum(d * n) AS dist_sum, sum(n / (1 + d)) AS h FROM f WHERE d > 0 GROUP BY src)"""


@query(head("users") + SKETCHED + " SELECT v.id AS node, round(coalesce(reach, 0), 6) AS reach FROM v LEFT JOIN t ON v.id = t.src")
def approx_reach(spark, sf_dir):
    return centrality.approximate_reach(load(spark, sf_dir, "users")).withColumn("reach", F.round("reach", 6))


@query(head("cust") + SKETCHED + """ SELECT v.id AS node, round(coalesce(reach, 0), 5) AS reach, round(coalesce(dist_sum, 0), 4) AS dist_sum,
  round(CASE WHEN dist_sum > 0 THEN 1 / (dist_sum * (SELECT n FROM n)) END, 12) AS closeness, round(coalesce(h, 0) / (SELECT n FROM n), 9) AS harmonic,
  round(CASE WHEN dist_sum > 0 THEN reach * reach / dist_sum END, 5) AS lin FROM v LEFT JOIN t ON v.id = t.src""")
def approx_measures(spark, sf_dir):
    """Every vertex's measures by one propagation of sketches."""
    out = sketches.measures(load(spark, sf_dir, "cust"))
    digits = {"reach": 5, "dist_sum": 4, "closeness": 12, "harmonic": 9, "lin": 5}
    return out.select("node", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(head("users") + " SELECT v.id AS node, least(v.id, min(a.dst)) AS component FROM v LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) a ON v.id = a.src GROUP BY v.id")
def strong_components(spark, sf_dir):
    return components.strong_components(load(spark, sf_dir, "users"))


@query(head("users") + " SELECT dst AS node, count(*) AS reach FROM r GROUP BY dst")
def node_reach_by_components(spark, sf_dir):
    """Reach by the graph of strong components and their sizes."""
    return components.reach_by_components(load(spark, sf_dir, "users"))


NUMBERED = """WITH RECURSIVE e AS ({0}), s AS (SELECT {1} AS s),
num(id, num, level) USING KEY (id) AS (
  SELECT s, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM s
  UNION
  SELECT dst, (SELECT max(num) FROM recurring.num) + row_number() OVER (ORDER BY parent, dst), level FROM (
    SELECT e.dst, min(n.num) AS parent, min(n.level) + 1 AS level FROM num n JOIN e ON n.id = e.src
    WHERE NOT EXISTS (SELECT 1 FROM recurring.num k WHERE k.id = e.dst) GROUP BY e.dst) t),
f AS (SELECT row_number() OVER (ORDER BY a.num, e.dst) AS arc, a.num AS j, b.num AS k, e.src, e.dst
  FROM e JOIN num a ON e.src = a.id JOIN num b ON e.dst = b.id WHERE b.num > a.num)"""
FROM_ONE = NUMBERED.format(USERS, 1)


@query(FROM_ONE + " SELECT id, num, level FROM num")
def bfs_numbering(spark, sf_dir):
    return paths.bfs_numbering(load(spark, sf_dir, "users"), 1)


@query(FROM_ONE + " SELECT arc, j, k, src, dst FROM f")
def forward_arcs(spark, sf_dir):
    return paths.forward_arcs(load(spark, sf_dir, "users"), 1)


@query(plain("users") + " SELECT src, dst FROM e WHERE dst % 3 = 0")
def subgraph_filter(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    return g.induced(g.vertices.where("id % 3 = 0")).edges


#: Most arcs of the paths that are listed in the whole graph: their number grows exponentially with it.
PATH_ARCS = 6
#: The pair of the paths: the first vertex with an arc, and the first that it reaches in exactly three.
ENDS = """st AS (SELECT min(src) AS s FROM e),
l1 AS (SELECT DISTINCT dst AS id FROM e, st WHERE src = s), l2 AS (SELECT DISTINCT dst AS id FROM e JOIN l1 ON src = id),
l3 AS (SELECT DISTINCT dst AS id FROM e JOIN l2 ON src = id),
en AS (SELECT s, min(id) AS t FROM l3, st WHERE id <> s AND id NOT IN (SELECT id FROM l1) AND id NOT IN (SELECT id FROM l2) GROUP BY s)"""
WALKS = f"""p AS (SELECT [s] AS path, s AS tip FROM en UNION ALL
  SELECT list_append(path, u.dst), u.dst FROM p JOIN u ON p.tip = u.src, en WHERE p.tip <> en.t AND len(path) <= {PATH_ARCS} AND NOT list_contains(path, u.dst))"""
DIRECTED = f"WITH RECURSIVE e AS ({USERS}), {ENDS}, u AS (SELECT src, dst FROM e), {WALKS}"
FORWARD = f"{NUMBERED.format(USERS, '(SELECT min(src) FROM e)')}, {ENDS}, u AS (SELECT src, dst FROM f UNION SELECT dst, src FROM f), {WALKS}"


def _ends(g: Graph) -> tuple[int, int] | None:
    source = g.edges.agg(F.min("src")).first()[0]
    if source is None:
        return None
    one = g.spark.createDataFrame([(source,)], "src BIGINT")
    target = traverse.hop_distances(g, one, max_depth=3).where("d = 3").agg(F.min("node")).first()[0]
    return None if target is None else (source, target)


def _paths(spark, sf_dir, mode):
    g = load(spark, sf_dir, "users")
    ends = _ends(g)
    if ends is None:
        return spark.createDataFrame([], "path STRING")
    return paths.simple_paths(g, *ends, mode, max_length=PATH_ARCS).select(F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


@query(DIRECTED + " SELECT array_to_string(path, '-') AS path FROM p, en WHERE tip = t")
def simple_paths_directed(spark, sf_dir):
    return _paths(spark, sf_dir, "directed")


@query(FORWARD + " SELECT array_to_string(path, '-') AS path FROM p, en WHERE tip = t")
def simple_paths_forward(spark, sf_dir):
    return _paths(spark, sf_dir, "forward")


@query(DIRECTED + " SELECT count(*) AS paths FROM p, en WHERE tip = t")
def count_simple_paths(spark, sf_dir):
    return _paths(spark, sf_dir, "directed").agg(F.count("*").alias("paths"))


#: Nations before others of their region: all simple paths from the first nation to the last of its region, of any length.
NATIONS = "SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"
NATION_PATHS = f"""WITH RECURSIVE e AS ({NATIONS}), en AS (SELECT src AS s, max(dst) AS t FROM e WHERE src = (SELECT min(src) FROM e) GROUP BY src),
i AS (SELECT s AS id FROM en UNION SELECT dst FROM e, en WHERE src = s),
f AS (SELECT row_number() OVER (ORDER BY src, dst) AS arc, src, dst FROM e WHERE src IN (SELECT id FROM i)),
u AS (SELECT arc, src, dst FROM f UNION ALL SELECT arc, dst, src FROM f),
p AS (SELECT [s] AS path, CAST([] AS BIGINT[]) AS arcs, s AS tip FROM en UNION ALL
  SELECT list_append(path, u.dst), list_append(arcs, arc), u.dst FROM p JOIN u ON p.tip = u.src, en WHERE p.tip <> t AND NOT list_contains(path, u.dst)),
q AS (SELECT path, list_sort(arcs) AS arcs FROM p, en WHERE tip = t)"""


def _nations(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    g = Graph.of(spark.sql(NATIONS.replace("FROM nation a JOIN nation b", "FROM {t} a JOIN {t} b"), t=t))
    source = g.edges.agg(F.min("src")).first()[0]
    target = g.edges.where(F.col("src") == source).agg(F.max("dst")).first()[0]
    return (*paths.diagram(g, source, target), source)


@query(NATION_PATHS + """, x AS (SELECT f.arc AS var, list_filter(q.arcs, lambda y: y < f.arc) AS before, list_filter(q.arcs, lambda y: y >= f.arc) AS rest FROM q, f),
y AS (SELECT var, before, list(rest ORDER BY rest) AS family, bool_or(list_contains(rest, var)) AS used FROM x GROUP BY var, before)
SELECT CAST(var AS INTEGER) AS var, count(DISTINCT family) AS nodes FROM y WHERE used GROUP BY var""")
def zdd_level_sizes(spark, sf_dir):
    """The nodes of each variable, which are the same in any reduced diagram of the same sets."""
    return _nations(spark, sf_dir)[0].groupBy("var").agg(F.count("*").alias("nodes"))


@query()
def zdd_nodes(spark, sf_dir):
    return _nations(spark, sf_dir)[0]


@query()
def zdd_text(spark, sf_dir):
    return sinks.diagram_lines(_nations(spark, sf_dir)[0])


@query(NATION_PATHS + " SELECT array_to_string(path, '-') AS path FROM q")
def zdd_paths(spark, sf_dir):
    nodes, arcs, source = _nations(spark, sf_dir)
    return paths.decode(nodes, arcs, source).select(F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


#: Nations as a grid, a row per region: arcs to the next of the region, and to the one at the same place in the next region.
GRID = """n AS (SELECT n_nationkey AS id, n_regionkey AS row, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation),
e AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON (a.row = b.row AND b.place = a.place + 1) OR (a.place = b.place AND b.row = a.row + 1)),
en AS (SELECT (SELECT id FROM n ORDER BY row, place LIMIT 1) AS s, (SELECT id FROM n ORDER BY row DESC, place DESC LIMIT 1) AS t)"""


@query(f"""WITH RECURSIVE {GRID}, u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
p AS (SELECT [s] AS path, s AS tip FROM en UNION ALL SELECT list_append(path, u.dst), u.dst FROM p JOIN u ON p.tip = u.src, en WHERE p.tip <> t AND NOT list_contains(path, u.dst))
SELECT CAST(count(*) AS DECIMAL(38, 0)) AS paths FROM p, en WHERE tip = t""")
def count_grid_paths(spark, sf_dir):
    """All simple paths between the corners of the nations' grid, of any length, counted on states without listing one."""
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("row"))
    n = stored(t.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy("id"))), "grid")
    a, b = n.select(F.col("id").alias("src"), "row", "place"), n.select(F.col("id").alias("dst"), "row", "place")
    right = a.join(b.withColumn("place", F.col("place") - 1), ["row", "place"])
    down = a.join(b.withColumn("row", F.col("row") - 1), ["row", "place"])
    ends = n.agg(F.min_by("id", F.struct("row", "place")), F.max_by("id", F.struct("row", "place"))).first()
    return paths.count_all_paths(Graph.of(right.union(down)), *ends)


#: Draws of the samplers: in the transpose, v is kept if w reaches it.
CLOSE_DRAWS = f""", k AS (SELECT CAST(ceil(6.907::DOUBLE / (2 * 0.2::DOUBLE * 0.2::DOUBLE)) AS BIGINT) AS k),
x AS (SELECT i, {sampling.draw_sql('i', sampling.FIRST, 42)} % n AS v, {sampling.draw_sql('i', sampling.SECOND, 43)} % n AS w FROM n, k, range(16384) t(i) WHERE i < 4 * k),
c AS (SELECT x.* FROM x JOIN r ON x.w = r.src AND x.v = r.dst WHERE v <> w ORDER BY i LIMIT (SELECT k FROM k))"""


@query(head("users") + CLOSE_DRAWS + " SELECT r.src AS node, 1::DOUBLE / (CAST(sum(r.d) AS BIGINT) * (SELECT k FROM k)) AS c FROM c JOIN r ON r.dst = c.v GROUP BY r.src")
def closeness_sampled(spark, sf_dir):
    return centrality.sampled_closeness(load(spark, sf_dir, "users"), 0.2)


UNIFORM_DRAWS = f""", k AS (SELECT CAST(ceil(log2(n) / (2 * 0.1::DOUBLE * 0.1::DOUBLE)) AS BIGINT) AS k FROM n),
x AS (SELECT i, {sampling.draw_sql('i', sampling.FIRST, 42)} % n AS v FROM n, k, range(16384) t(i) WHERE i < k)"""


@query(head("users") + UNIFORM_DRAWS + " SELECT r.src AS node, round(sum(1::DOUBLE / (1 + r.d)) / (SELECT k FROM k), 9) AS c FROM x JOIN r ON r.dst = x.v GROUP BY r.src")
def harmonic_sampled(spark, sf_dir):
    return centrality.sampled_harmonic(load(spark, sf_dir, "users"), 0.1).withColumn("c", F.round("c", 9))


@query(head("users") + " SELECT src AS node, CAST((SELECT n FROM n) AS DOUBLE) / CAST(sum(d) AS BIGINT) AS c FROM r GROUP BY src")
def closeness_mean(spark, sf_dir):
    g = load(spark, sf_dir, "users")
    return centrality.closeness(centrality.sums(g), g.vertices.count(), "mean")


REACH_DRAWS = f""", k AS (SELECT CAST(ceil(log2(n) / (2 * 0.1::DOUBLE * 0.1::DOUBLE)) AS BIGINT) AS k FROM n),
t AS (SELECT i, {sampling.draw_sql('i', sampling.SECOND, 42)} % n AS v FROM n, k, range(16384) t(i) WHERE i < k),
b AS (SELECT src AS node, dst AS v FROM r UNION ALL SELECT id, id FROM v),
w AS (SELECT v.id AS node, count(b.v) AS weight FROM v LEFT JOIN (SELECT b.* FROM t JOIN b ON t.v = b.v) b ON v.id = b.node GROUP BY v.id),
c AS (SELECT node, weight, CAST(sum(weight) OVER (ORDER BY node) AS BIGINT) AS cumulative FROM w),
m AS (SELECT max(cumulative) AS m FROM c), d AS (SELECT i AS draw_id, {sampling.draw_sql('i', sampling.THIRD, 42)} % m + 1 AS x FROM m, k, range(16384) t(i) WHERE i < k),
z AS (SELECT draw_id, node AS v FROM d JOIN c ON x > cumulative - weight AND x <= cumulative),
s AS (SELECT src, sum(d) AS s, count(*) AS c, max(d) AS m FROM r GROUP BY src),
g AS (SELECT draw_id // 50 AS batch, CAST(sum(s.s) AS DOUBLE) / sum(s.c) AS norm, max(s.m) AS diameter FROM z JOIN s ON z.v = s.src GROUP BY 1)
SELECT round(avg(norm), 8) AS average, round(coalesce(stddev_samp(norm), 0), 8) AS spread, round(avg(diameter), 8) AS diameter,
  round(coalesce(stddev_samp(diameter), 0), 8) AS diameter_spread, count(*) AS batches FROM g"""


@query(head("users") + REACH_DRAWS)
def avg_distance_reach(spark, sf_dir):
    """The main estimator in its default mode."""
    out = estimate.average_distance(load(spark, sf_dir, "users"), "reach", "ratio_of_sums", eps=0.1, batch=50)
    return out.select(*[F.round(F.nanvl(c, F.lit(0.0)), 8).alias(c) for c in ("average", "spread", "diameter", "diameter_spread")], "batches")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


@query(plain("cust") + " SELECT src, dst FROM e")
def arcs_from_csv(spark, sf_dir):
    """Arcs written as numeric CSV and loaded from there."""
    path = _folder(spark)
    load(spark, sf_dir, "cust").edges.write.csv(path)
    return Graph.from_csv(spark, path).edges


@query(plain("cust") + " SELECT id FROM v UNION SELECT src FROM e UNION SELECT dst FROM e")
def vertices_from_table(spark, sf_dir):
    """Arcs and vertices as tables, clustered by source, loaded from there; a transpose of one table's graph fits the other's."""
    path, g = _folder(spark), load(spark, sf_dir, "cust")
    g.clustered().edges.write.parquet(f"{path}/e")
    g.vertices.write.parquet(f"{path}/v")
    found = Graph.from_table(spark, f"{path}/e", f"{path}/v")
    found.check_transposed(g.transpose())
    return found.vertices


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS id, n_name AS label FROM nation")
def label_dictionary(spark, sf_dir):
    """A dictionary of labels written one a line and read again; the line number is the id."""
    path, names = _folder(spark), spark.read.parquet(f"{sf_dir}/nation.parquet")
    labels = running(names.select("n_nationkey", F.col("n_name").alias("label")), ["n_nationkey"], {}, "id").select("id", "label")
    graphs.write_labels(labels, path)
    return graphs.read_labels(spark, path)


@query("SELECT 'c' || r_regionkey AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def labelled_arcs(spark, sf_dir):
    """Arcs of labels written as lines, loaded with dense ids and named again."""
    path, t = _folder(spark), spark.read.parquet(f"{sf_dir}/nation.parquet")
    t.orderBy("n_nationkey").select(F.concat(F.lit("c"), "n_regionkey", F.lit("\t"), "n_name")).write.text(path)
    g, labels = Graph.from_label_file(spark, path)
    return graphs.decode(graphs.decode(g.edges, labels, "src"), labels, "dst")


@query(plain("cust") + " SELECT 'arcs' AS key, CAST((SELECT count(*) FROM e) AS VARCHAR) AS value UNION ALL SELECT 'nodes', CAST((SELECT count(*) FROM v) AS VARCHAR)")
def properties(spark, sf_dir):
    """A graph's properties written as a file and read again."""
    path, size = _folder(spark), load(spark, sf_dir, "cust").size()
    pairs = size.select(F.expr("stack(2, 'nodes', CAST(n_vertices AS STRING), 'arcs', CAST(n_arcs AS STRING)) AS (key, value)"))
    graphs.write_properties(pairs, path, "made here")
    return graphs.read_properties(spark, path)


@query("SELECT c_custkey AS node, CAST(c_acctbal AS DOUBLE) AS value FROM customer")
def stored_vector(spark, sf_dir):
    """A measure per vertex written as bracketed lines, and read again."""
    path, t = _folder(spark), spark.read.parquet(f"{sf_dir}/customer.parquet")
    graphs.write_vector(t.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").cast("double").alias("value")), path, 1000)
    return graphs.read_vector(spark, path)


@query(head("users") + CLOSE + " SELECT node, c AS cc FROM c UNION ALL SELECT id, NULL FROM v WHERE id NOT IN (SELECT node FROM c)")
def stored_centrality(spark, sf_dir):
    """Closeness written as CSV, nan where a vertex has none, and read again."""
    path, g = _folder(spark), load(spark, sf_dir, "users")
    c = g.vertices.join(_closeness(spark, sf_dir, "users"), F.col("id") == F.col("node"), "left")
    c.select("id", F.coalesce(F.col("c").cast("string"), F.lit("nan"))).write.csv(path)
    return graphs.read_centrality(spark, path)


@query(head("users") + CLOSE + " SELECT printf('%d, %.6f', node, c) AS line FROM c")
def ranked_report(spark, sf_dir):
    """The lines of a ranking, written as text and read again."""
    path = _folder(spark)
    sinks.write_lines(sinks.ranked_lines(_closeness(spark, sf_dir, "users")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _many(spark, sf_dir, name) -> int:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


@query("SELECT CAST(0 AS BIGINT) AS src, i AS dst FROM range(1, (SELECT count(*) + 1 FROM customer)) t(i) UNION ALL SELECT i, i + (SELECT count(*) FROM customer) FROM range(1, (SELECT count(*) + 1 FROM customer)) t(i)")
def star_graph(spark, sf_dir):
    """A star with a spoke for each customer."""
    return graphs.star(spark, _many(spark, sf_dir, "customer")).edges


@query("""SELECT a AS src, b AS dst FROM range((SELECT count(*) FROM supplier)) s(a), range((SELECT count(*) FROM supplier)) t(b)
WHERE a <> b AND (a * 7919 + b * 104729 + (a * b) % 10007 * 31337 + 42) % 1000003 < CAST(0.01::DOUBLE * 1000003 AS BIGINT)""")
def gnp_graph(spark, sf_dir):
    """A random graph with a vertex for each supplier."""
    return graphs.gnp(spark, _many(spark, sf_dir, "supplier"), 0.01).edges


@query()
def barabasi_graph(spark, sf_dir):
    """Preferential attachment with a vertex for each customer."""
    return graphs.dual_barabasi_albert(spark, _many(spark, sf_dir, "customer"), 10).edges


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY event_type")
def merge_streams(spark, sf_dir):
    """Two streams of the events table, one per kind, merged and drained."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    stream = lambda kind: spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").where(F.col("event_type") == kind).select("event_id", "event_type")
    channels.drained(channels.merged(stream("error"), stream("click")), f"{base}/out", f"{base}/state")
    return spark.read.schema("event_id BIGINT, event_type STRING").parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


