"""Near-duplicate documents by SimHash, with candidates pruned by the pigeonring principle.

A fingerprint is cut into segments that stand in a ring. If two fingerprints differ in at most t bits over m segments, then
from some segment on, every chain of j consecutive segments differs in at most j * t / m bits (Qin and Xiao, 2018). With
m > t the chain's first segment is equal in both, so candidates are fingerprints that share a segment; those for which no
chain keeps its budgets are dropped before the Hamming distance is taken.

Equal fingerprints are one class from the start. A bucket of fingerprints that share a segment is compared in blocks: one
with more than a tile of members is dealt over all pairs of its tiles, so no task gathers it. A task returns a spanning
forest of the links that it finds, not the links.

alike() takes fingerprints for candidates only: what they bring together is linked by the exact Jaccard similarity of sets of
shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import WHOLE, Carried, ship, stored
from trailgraph.llm.components import connected, forest

SEED = 42

#: Members of a bucket that one group compares; larger buckets are dealt over pairs of tiles.
TILE = 2048
#: Sets of shingles that one group compares; larger groups are dealt over pairs of tiles.
SETS_TILE = 256
#: Texts whose sets of shingles a task holds at once.
TEXTS_AT_ONCE = 512
#: Rows of the table of large buckets up to which it is broadcast.
BROADCAST_ROWS = 20_000
#: Hashes whose bits are counted at once.
HASHES_AT_ONCE = 255 * 64


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the text's shingles in order; A-Z are lowered, words end at ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64, max(1, len(words) - shingle + 1))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash from the first: itself for 0, else a bijective mix."""
    if k:
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprint(text: str | None, shingle: int, parts: int) -> list[int]:
    """`parts` fingerprints of 64 bits, unsigned; all zero without words."""
    return majority(shingle_hashes(text or "", shingle), parts)


def majority(h: np.ndarray, parts: int) -> list[int]:
    """The fingerprints of hashes: bits that more than half of them have."""
    out = []
    for k in range(parts):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), HASHES_AT_ONCE):
            some = mixed(h[at : at + HASHES_AT_ONCE], k).astype(">u8")
            bits = np.unpackbits(some.view(np.uint8)).reshape(-1, 64)
            for b in range(0, len(bits), 255):  # sums of up to 255 bits stay in bytes
                counts += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
        out.append(int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big"))
    return out


def fingerprinted(docs: DataFrame, shingle: int, parts: int) -> DataFrame:
    """doc_id and f0, f1, ... (signed 64 bits) of docs (doc_id, text), written once."""
    names = [f"f{k}" for k in range(parts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t if isinstance(t, str) else None, shingle, parts) for t in batch["text"]], np.uint64).reshape(-1, parts)
            yield pd.DataFrame({carried.keys[0]: batch[carried.keys[0]], **dict(zip(names, found.view(np.int64).T, strict=True))})

    carried = Carried(docs, ["doc_id"])
    schema = carried.schema() + ", " + ", ".join(f"{c} long" for c in names)
    return stored(docs.select(*carried.columns(), "text").mapInPandas(run, schema).select(*carried.back(), *names), "fingerprints")


def segments(parts: int, count: int) -> list[tuple[int, int, int]]:
    """(part, shift, width) of the segments of a ring of `count`, evenly over the parts."""
    each = count // parts
    out = []
    for part in range(parts):
        widths = [64 // each + (k < 64 % each) for k in range(each)]
        out += [(part, sum(widths[:k]), w) for k, w in enumerate(widths)]
    return out


def linked(a: np.ndarray, b: np.ndarray, ring: list[tuple[int, int, int]], distance: int, chain: int) -> np.ndarray:
    """Which rows of fingerprints a and b (uint64, a column per part) differ in at most `distance` bits."""
    diff = a ^ b
    bits = [np.bitwise_count((diff[:, part] >> np.uint64(shift)) & np.uint64((1 << width) - 1)) for part, shift, width in ring]
    m = len(ring)
    viable = np.zeros(len(a), bool)
    for start in range(m):
        total, good = np.zeros(len(a), np.uint16), np.ones(len(a), bool)
        for j in range(1, chain + 1):
            total = total + bits[(start + j - 1) % m]
            good &= total <= j * distance // m
        viable |= good
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(viable)
    out[at] = np.bitwise_count(diff[at]).sum(axis=1) <= distance
    return out


def compared(group: np.ndarray, prints: np.ndarray, ring: list, distance: int, chain: int) -> np.ndarray:
    """The root of each row: rows of the same group (sorted) that are linked share it."""
    n, root = len(group), np.arange(len(group))
    at = np.arange(n)
    for gap in range(1, n):
        at = at[at < n - gap]
        at = at[group[at] == group[at + gap]]
        if not len(at):
            break
        far = at[root[at] != root[at + gap]]  # links inside a tree add nothing
        for k in range(0, len(far), 1 << 18):
            some = far[k : k + (1 << 18)]
            hit = some[linked(prints[some], prints[some + gap], ring, distance, chain)]
            if len(hit):
                root = forest(np.concatenate([np.arange(n), hit]), np.concatenate([root, hit + gap]), n)
    return root


def dealt_out(dealt: DataFrame, names: list[str], tile: int) -> DataFrame:
    """Rows with a key, those of buckets over a tile repeated for all pairs of its tiles under a key for each pair."""
    sizes = stored(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    large = sizes.where(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    few = large.count()
    if few:
        others = [c for c in dealt.columns if c != "key"]
        dealt = dealt.join(F.broadcast(large) if few <= BROADCAST_ROWS else large, "key", "left")
        own = F.pmod(F.xxhash64(*names), F.col("tiles")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(own, t).alias("x"), F.greatest(own, t).alias("y")))
        pairs = F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(pairs)
        dealt = dealt.withColumn("p", F.explode(pairs)).select(*others, F.xxhash64("key", "p.x", "p.y").alias("key"))
    return dealt


def by_group(links: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """links over batches of rows sorted by key, such that no key's rows are parted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            group = batch["key"].to_numpy()
            cut = np.searchsorted(group, group[-1]) if len(group) else 0
            rest = batch.iloc[cut:]
            yield links(batch.iloc[:cut])
        if rest is not None:
            yield links(rest)

    return run


def similar(docs: DataFrame, shingle: int = 3, parts: int = 1, segment_count: int = 3, distance: int = 2, chain: int | None = None, tile: int = TILE) -> DataFrame:
    """Groups docs (doc_id, text): returns doc_id, f0, f1, ... and component_id, the smallest doc_id that links reach.

    Two documents are linked if their fingerprints of 64 * parts bits differ in at most `distance` bits. All such links count
    if segment_count > distance; else those that share a segment. Null and empty texts have the fingerprint zero and are
    linked with each other. Rows of one doc_id that have different fingerprints are grouped each by its own. A null doc_id gets
    its fingerprint's component, null if no id has it. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    found = fingerprinted(docs, shingle, parts)
    names, ring = [f"f{k}" for k in range(parts)], segments(parts, segment_count)
    chain = len(ring) if chain is None else chain
    classes = found.groupBy(*names).agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    value = lambda k: F.shiftrightunsigned(F.col(f"f{ring[k][0]}"), ring[k][1]).bitwiseAND(F.lit((1 << ring[k][2]) - 1))
    keys = F.array(*[(value(k) * len(ring) + k) for k in range(len(ring))])
    dealt = dealt_out(classes.select("id", *names, F.explode(keys).alias("key")), names, tile)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rep = rows["id"].to_numpy()
        root = compared(rows["key"].to_numpy(), rows[names].to_numpy().view(np.uint64), ring, distance, chain)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})

    shuffled = dealt.repartition("key").sortWithinPartitions("key")
    component = connected(shuffled.mapInPandas(by_group(links), "a long, b long"))
    # Components of fingerprints, then their smallest doc_id: one id may have several fingerprints, which it doesn't link.
    classes = classes.join(component, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id"))
    least = classes.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "group").select(*names, "component_id")
    return found.join(classes, names, "left").select("doc_id", *names, "component_id")


#: Tables of candidates of alike(): byte b of a fingerprint with byte b ^ step, each pair of bytes a table.
STEPS = (1, 2, 4)


def byte_pairs(parts: int) -> np.ndarray:
    """The pairs of places of bytes, low byte of the first part first, that key the tables."""
    return np.array([(b, b ^ step) for step in STEPS for b in range(8 * parts) if b < b ^ step])


def shingled(docs: DataFrame, shingle: int, parts: int = 0) -> DataFrame:
    """doc_id with h, its sorted set of shingles' hashes (without parts), or d0 and d1, a digest of that set, and f0, f1, ..."""
    names = ["d0", "d1", *(f"f{k}" for k in range(parts))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch.iloc[at : at + TEXTS_AT_ONCE]
                sets = [np.unique(shingle_hashes(t if isinstance(t, str) else "", shingle)) for t in part["text"]]
                part = part.drop(columns="text")
                if parts:
                    digests = [divmod(xxhash.xxh3_128_intdigest(h.tobytes(), SEED), 1 << 64) for h in sets]
                    found = np.array([(*d, *majority(h, parts)) for d, h in zip(digests, sets, strict=True)], np.uint64).reshape(-1, len(names))
                    yield part.assign(**dict(zip(names, found.view(np.int64).T, strict=True)))
                else:
                    yield part.assign(h=[h.view(np.int64) for h in sets])

    carried = Carried(docs, ["doc_id"])
    new = names if parts else ["h"]
    schema = carried.schema() + ", " + (", ".join(f"{c} long" for c in new) if parts else "h array<long>")
    return docs.select(*carried.columns(), "text").mapInPandas(run, schema).select(*carried.back(), *new)


def agreed(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (doc_id, h) have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("y")), "b")
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= jaccard * (len(x) + len(y) - shared))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return stored(both.mapInPandas(run, f"a {kind}, b {kind}"), "agreed")


def similar_sets(sets: list[np.ndarray], root: np.ndarray, jaccard: float) -> np.ndarray:
    """The root of each set (sorted, without repeats) once those of at least that Jaccard similarity share theirs.

    One set at a time is held against all after it, by marking its hashes among all; pairs that share a root already don't count.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(size)
    if len(some) < 2:
        return root
    codes = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True)[1]
    n = size[some]
    edges = np.concatenate([[0], np.cumsum(n)])
    marked = np.zeros(int(codes.max()) + 1, bool)
    for k in range(len(some) - 1):
        own = codes[edges[k] : edges[k + 1]]
        marked[own] = True
        shared = np.add.reduceat(marked[codes[edges[k + 1] :]], edges[k + 1 : -1] - edges[k + 1], dtype=np.int64)
        marked[own] = False
        hit = some[k + 1 :][(shared >= jaccard * (n[k] + n[k + 1 :] - shared)) & (root[some[k + 1 :]] != root[some[k]])]
        if len(hit):
            root = forest(np.concatenate([np.arange(len(root)), np.full(len(hit), some[k])]), np.concatenate([root, hit]), len(root))
    return root


def alike(docs: DataFrame, shingle: int = 5, jaccard: float = 0.8, parts: int = 8, distance: int = 120, chain: int = 3, tile: int = TILE, sets_tile: int = SETS_TILE) -> DataFrame:
    """Groups docs (doc_id, text) by exact Jaccard similarity of their sets of shingles: returns doc_id and component_id.

    Equal sets are one class. Classes that share a pair of bytes of one of the tables are compared by their fingerprints of
    64 * parts bits: those that keep a chain of `chain` bytes' budgets and differ in at most `distance` bits are candidates of
    each other, and tasks return spanning forests of them. Each class is first held against its candidate component's smallest
    by their sets. Of components that this leaves in parts, all members' sets are compared, in groups over pairs of tiles, and
    linked where the similarity is at least `jaccard`; again only forests leave the tasks, so no pairs of a group are emitted.
    component_id is the smallest doc_id that links reach; doc_ids and texts are treated as similar() does.
    """
    ship(docs.sparkSession)
    found = stored(shingled(docs, shingle, parts), "fingerprints")
    names, tables, ring = [f"f{k}" for k in range(parts)], byte_pairs(parts), segments(parts, 8 * parts)
    classes = stored(found.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in names]).where("rep IS NOT NULL"), "classes")

    byte = lambda b: F.shiftrightunsigned(F.col(f"f{b // 8}"), int(b % 8 * 8)).bitwiseAND(F.lit(255))
    keys = F.array(*[(byte(a) * 256 + byte(b)) * len(tables) + k for k, (a, b) in enumerate(tables.tolist())])
    dealt = dealt_out(classes.select("rep", *names, F.explode(keys).alias("key")), ["rep"], tile)
    kind = dict(classes.dtypes)["rep"]

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        rep = rows["rep"].to_numpy()
        root = compared(rows["key"].to_numpy(), rows[names].to_numpy().view(np.uint64), ring, distance, chain)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})

    shuffled = dealt.repartition("key").sortWithinPartitions("key", "rep")  # so that roots are the smallest
    near = stored(connected(shuffled.mapInPandas(by_group(candidates), f"a {kind}, b {kind}")), "candidates", even=True)
    ids = stored(near.select(F.col("node").alias("doc_id")).union(near.select("component")).distinct(), "ids", even=True)
    some = ids.count()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if some <= BROADCAST_KEYS else ids, "doc_id", "left_semi")
    if not found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        texts = texts.distinct()
    sets = stored(shingled(texts, shingle), "sets")

    first = agreed(near.select(F.col("component").alias("a"), F.col("node").alias("b")), sets, jaccard)
    # Components in parts: the group of each member, and the smallest of what it is linked with so far.
    open_ = near.join(first.select(F.col("b").alias("node")), "node", "left_anti").select("component").distinct()
    members = near.union(near.select("component", "component").distinct()).join(open_, "component", "left_semi")
    members = members.join(first.select(F.col("b").alias("node"), F.col("a").alias("so_far")), "node", "left")
    members = members.select(F.col("node").alias("doc_id"), F.xxhash64("component").alias("key"), F.coalesce("so_far", "node").alias("so_far"))
    rows = dealt_out(stored(members, "members", even=True), ["doc_id"], sets_tile).join(sets, "doc_id")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids, out = group["doc_id"].to_numpy(), [(group["doc_id"].iloc[:0].to_numpy(),) * 2]
        key, so_far, sets = group["key"].to_numpy(), group["so_far"].to_numpy(), group["h"].tolist()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            start = np.unique(so_far[a:b], return_index=True, return_inverse=True)
            before = start[1][start[2]]
            root = similar_sets(sets[a:b], before, jaccard)
            moved = np.flatnonzero(root != before)
            out.append((ids[a:b][moved], ids[a:b][root[moved]]))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})

    shuffled = rows.repartition("key").sortWithinPartitions("key")
    component = connected(first.union(shuffled.mapInPandas(by_group(links), f"a {kind}, b {kind}")))
    classes = classes.join(component, F.col("rep") == F.col("node"), "left").select("d0", "d1", F.coalesce("component", "rep").alias("component_id"))
    return found.join(classes, ["d0", "d1"], "left").select("doc_id", "component_id")


def keyed(docs: DataFrame) -> Column:
    """A key per document that sorts as doc_id does, as whole number or text; rows without an id get one by their text, after all ids."""
    whole = dict(docs.dtypes)["doc_id"] in WHOLE
    text = F.coalesce("text", F.lit(""))
    if whole:
        return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text), 3) + F.lit(NO_ID))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\U0010ffff"), F.sha2(F.encode(text, "utf-8"), 256)))


#: From here on keys are those of documents without an id.
NO_ID = 3 << 61
#: Documents to leave out up to which their keys are broadcast, at about 50 bytes each; beyond, the join is by shuffle.
BROADCAST_KEYS = 500_000


def one_of_each(docs: DataFrame, groups: Callable[..., DataFrame] = similar, **kw) -> DataFrame:
    """The documents with their own columns, but one of each group: that with the smallest doc_id.

    Rows without a doc_id take part by their texts: the group's other documents are preferred to them, and of those with the
    same text one stays. Of rows of one doc_id that stays, the one with the smallest text stays; null is as empty, and the smallest.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    both = docs.select(keyed(docs).alias("doc_id"), "text")
    found = stored(groups(both, **kw), "grouped")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct(), "gone", even=True)
    again = stored(found.groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("n")).where("n > 1").select("__key"), "again", even=True)
    few = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", keyed(docs).alias("__key"))
    rows = rows.join(few(gone), "__key", "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    some = few(again)
    one = rows.join(some, "__key", "left_semi").groupBy("__key").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return rows.join(some, "__key", "left_anti").select("row.*").union(one.select("row.*"))
