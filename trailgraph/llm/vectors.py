"""Near-duplicate vectors by cosine, compared in tiles with dimensions in order of their principal components.

Vectors are rotated so that leading dimensions hold most of their length. A tile of pairs first adds the products of the
leading dimensions; what the others can add is at most the product of the suffix norms, so pairs that can't reach the
threshold stop there. The rotation keeps cosines, so the bound loses no link; pairs that pass are decided on the vectors
as they are given, in double precision.

Equal vectors are one class from the start. Classes are ranked by their first component and dealt in that order into blocks
of bounded size. Each pair of blocks that is near enough along that component to hold a link is one group: every class is
compared with every other that it could be linked with exactly once, no group grows with the data, and each group returns
counts and a spanning forest of its links, not the links. The work is quadratic in the number of classes by nature of an
exact comparison; the bounds leave about a quarter of the multiplications on data without structure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import running, ship, stored
from trailgraph.llm.components import connected, forest

#: Classes in a block, and in a tile of a block.
BLOCK = 4096
TILE = 1024
#: Leading dimensions that are added before each test of the bound.
STEP = 16
#: Pairs whose products are added at once.
PAIRS = 1 << 16


def padded(values: pd.Series, size: int) -> np.ndarray:
    """Rows in double precision, filled up with zeros."""
    out = np.zeros((len(values), size))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def units(x: np.ndarray) -> np.ndarray:
    """The rows with length 1. A power of two, which is exact, keeps squares of the smallest and largest numbers in range first."""
    largest = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = np.ldexp(x, -np.frexp(largest)[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(classes: DataFrame, size: int) -> np.ndarray:
    """Principal directions of the unit vectors, the largest first, from size * size sums over all rows."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = units(padded(batch["vector"], size))
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(size * size), "n": total.ravel()})

    sums = classes.select("vector").mapInPandas(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    m = np.zeros(size * size)
    for r in sums.collect():
        m[r["at"]] = r["n"]
    values, directions = np.linalg.eigh(m.reshape(size, size))
    return directions[:, np.argsort(-values)]


def distance_at(threshold: float) -> float:
    """How far unit vectors with that cosine lie apart, and so at most in each component, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


def tile_links(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold; x, y are unit vectors and u, v the same ones rotated."""
    size = u.shape[1]
    least = threshold - 1e-9
    suffix = lambda a, k: np.sqrt(np.maximum(0, np.square(a[:, k:]).sum(axis=1)))
    partial, k = u[:, :step] @ v[:, :step].T, step
    mask = partial + np.outer(suffix(u, k), suffix(v, k)) >= least
    while k < size and np.count_nonzero(mask) * 16 > mask.size:  # many pairs: the next products of the whole tile are cheaper
        partial += u[:, k : k + step] @ v[:, k : k + step].T
        k += step
        mask &= partial + np.outer(suffix(u, k), suffix(v, k)) >= least
    i, j = np.nonzero(mask)
    sums = partial[i, j]
    for k in range(k, size, step):
        more = [np.einsum("ij,ij->i", u[i[p : p + PAIRS], k : k + step], v[j[p : p + PAIRS], k : k + step]) for p in range(0, len(i), PAIRS)]
        sums = sums + np.concatenate([np.zeros(0), *more])
        keep = sums + suffix(u, k + step)[i] * suffix(v, k + step)[j] >= least
        i, j, sums = i[keep], j[keep], sums[keep]
    hit = [np.einsum("ij,ij->i", x[i[k : k + PAIRS]], y[j[k : k + PAIRS]]) >= threshold for k in range(0, len(i), PAIRS)]
    hit = np.concatenate([np.zeros(0, bool), *hit])
    return i[hit], j[hit]


def block_links(own: np.ndarray, other: np.ndarray | None, n: np.ndarray, directions: np.ndarray, threshold: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows own with other, or among own: for all rows, own's first, the number of linked vectors and the forest's root.

    n: vectors in each row's class.
    """
    x = own if other is None else np.concatenate([own, other])
    x = units(x)
    u = x @ directions
    first = len(own)
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    sides = [np.arange(first)] * 2 if other is None else [np.arange(first), np.arange(first, len(x))]
    # Rows in order of the first component: tiles too far apart along it hold no link.
    tiles = [[s[np.argsort(u[s, 0], kind="stable")][k : k + tile] for k in range(0, len(s), tile)] for s in sides]
    reach = distance_at(threshold)
    for a, rows in enumerate(tiles[0]):
        for b, columns in enumerate(tiles[1]):
            if other is None and b < a or u[columns[0], 0] - u[rows[-1], 0] > reach or u[rows[0], 0] - u[columns[-1], 0] > reach:
                continue
            i, j = tile_links(x[rows], x[columns], u[rows], u[columns], threshold)
            i, j = rows[i], columns[j]
            if other is None and a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                links += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
                root = forest(np.concatenate([np.arange(len(x)), i]), np.concatenate([root, j]), len(x))
    return links, root


def near(rows: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """Links rows (vec_id, embedding) whose cosine is at least threshold.

    Returns vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that links reach) and kept (whether
    it is the row's own). Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    their own component; the smallest and largest finite numbers are compared as any. Shorter vectors are compared as if filled up with zeros. Rows are nodes, each by its own
    vector, also where they share a vec_id: rows of one id that don't link may be in different components. A null vec_id is kept only where it links with no id. An empty table gives no
    rows; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("good", good), "vectors")
    classes = rows.where("good").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    count, size = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    directions = rotation(classes, size)
    reach = distance_at(threshold)

    def first_component(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id"]].assign(u=units(padded(batch["vector"], size)) @ directions[:, 0])

    placed = classes.select("id", "vector").mapInPandas(first_component, "id long, u double")
    placed = stored(running(placed, ["u", "id"], {}).select("id", "u", F.floor(F.col("pos") / block).cast("int").alias("own")), "places")
    ends = placed.groupBy("own").agg(F.min("u").alias("low"), F.max("u").alias("high")).orderBy("own").toPandas()  # a row per `block` classes
    # Blocks lie in order of the first component, so those that a block can hold links with are neighbours of it.
    ends["least"] = np.searchsorted(ends["high"], ends["low"] - reach)
    ends["most"] = np.searchsorted(ends["low"], ends["high"] + reach, "right") - 1
    near = spark.createDataFrame(ends[["own", "least", "most"]], "own int, least int, most int")
    own = F.col("own")
    pairs = F.transform(F.sequence("least", "most"), lambda t: F.struct(F.least(own, t).alias("x"), F.greatest(own, t).alias("y")))
    dealt = classes.join(placed.join(F.broadcast(near), "own"), "id").select("vector", "id", "n", "own", F.explode(pairs).alias("p")).select("vector", "id", "n", "own", "p.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("own", kind="stable")
        x, n, rep = padded(group["vector"], size), group["n"].to_numpy(), group["id"].to_numpy()
        same = group["x"].iloc[0] == group["y"].iloc[0]
        cut = int((group["own"] == group["x"]).sum())
        links, root = block_links(x if same else x[:cut], None if same else x[cut:], n, directions, threshold)
        # The members of one block that another links stay together, so each block's pairs suffice for components.
        some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pd.DataFrame({"id": rep[some], "links": links[some], "root": rep[root[some]]})

    found = dealt.groupBy("x", "y").applyInPandas(compare, "id long, links long, root long")
    found = stored(found, "links")
    # Components of classes, then of ids: the smallest id of a component's classes.
    component = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.join(degrees, "id", "left").join(component, F.col("id") == F.col("node"), "left")
    classes = stored(classes.select("vector", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("group")), "linked")
    least = classes.groupBy("group").agg(F.min("rep").alias("component"))
    both = rows.where("good").select("vec_id", "vector").join(classes.join(least, "group"), "vector").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = both.union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
