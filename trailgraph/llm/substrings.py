"""Repeated substrings over the whole corpus, by an enhanced suffix array in buckets.

A window of `length` bytes is found by its anchor: of the k-grams inside, that with the smallest hash. Equal windows have
equal anchors at equal places, so all windows that can be equal meet in their anchor's bucket, and a text's consecutive
windows with one anchor travel there once, as the bytes around it. Buckets of one anchor never travel.

In a bucket the texts from the anchor on are sorted: a suffix array. Its array of common prefixes is scanned with a stack,
which yields the tree of common-prefix intervals; an interval holds all texts that share a prefix of some length. In each,
the texts before the anchor are sorted backwards, which shows where the left extensions part. A text's windows are
repeated where the shared prefix and the longest shared left extension together reach the length.

Surroundings of an anchor that are equal, by two hashes of 64 bits, repeat each other whole: they count as one and only one
travels as bytes. Buckets that stay beyond a bound are not gathered but parted, by where in a window the anchor stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import Carried, press, ship, stored

LENGTH = 200
#: Bytes of an anchor. Longer ones meet fewer buckets by chance; shorter ones make fewer anchors.
GRAM = 64
#: Texts that a bucket may gather.
BUCKET = 512
#: Parts that the windows of a large bucket are dealt into at once.
PARTS = 8
#: Rows of the table of large buckets up to which it is broadcast, 8 bytes each.
BROADCAST_ROWS = 100_000
#: Bytes of a text whose windows are scanned at once.
SCAN = 1 << 20

_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, and powers of the base and of its inverse modulo 2 ** 64."""
    table = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes, by its content alone."""
    table, up, down = _powers(1 << max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last window start that has it; starts rise and lie up to the place."""
    data, width = np.frombuffer(text, np.uint8), length - gram + 1
    found = [[], [], [], []]
    for at in range(0, max(0, len(data) - length + 1), SCAN):
        h = gram_hashes(data[at : at + SCAN + length - 1], gram)
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - width + 1
        full = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        full[: len(h)] = order
        blocks = full.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        for out, x in zip(found, (h[place[low]], place[low] + at, low + at, np.append(low[1:], n) - 1 + at), strict=True):
            out.append(x)
    if not found[0]:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h, place, low, high = map(np.concatenate, found)
    first = np.concatenate([[True], place[1:] != place[:-1]])  # an anchor that goes on in the next scan is one
    last = np.append(first[1:], True)
    return h[first], place[first], low[first], high[last]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def prefix_intervals(texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(shared length, first, end) of the intervals of sorted texts that share a prefix, inner ones first."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(texts) + 1):
        shared = common(texts[i - 1], texts[i]) if i < len(texts) else 0
        first = i - 1
        while stack and stack[-1][0] > shared:
            length, first = stack.pop()
            yield length, first, i
        if shared and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


def repeat_groups(bucket: list[tuple[bytes, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """The maximal repeats of a bucket that are at least `length` long: (bytes before the anchor, bytes from it on, all members).

    bucket: (text before the anchor, backwards; text from it on). Each interval of the texts from the anchor on shares a prefix;
    inside, the same tree over the texts before the anchor holds the groups whose left extensions part, so none can grow to the
    left. One that could grow to the right, as all of it lies in an inner interval, is told there. Inner groups come first.
    """
    order = sorted(range(len(bucket)), key=lambda i: bucket[i][1])
    place = {i: k for k, i in enumerate(order)}
    after = [common(bucket[a][1], bucket[b][1]) for a, b in zip(order, order[1:], strict=False)]
    for right, first, end in prefix_intervals([bucket[i][1] for i in order]):
        members = sorted(order[first:end], key=lambda i: bucket[i][0])
        for left, a, b in prefix_intervals([bucket[i][0] for i in members]):
            if left + right < length:
                continue  # left extensions part too soon
            group = members[a:b]
            inside = sorted(place[i] for i in group)
            if min(after[inside[0] : inside[-1]]) == right:
                yield left, right, group
        if right >= length and len(members) > 1 and not common(bucket[members[0]][0], bucket[members[-1]][0]):
            yield 0, right, members  # nothing before the anchor is shared by all


def repeated_windows(bucket: list[tuple[bytes, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each (text before the anchor, backwards; text from it on): (most, least) bytes before the anchor of repeated windows.

    A member's windows of all its groups are joined where they touch, so that nested groups make no more rows than one.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in bucket]
    if len(bucket) == 2:
        left, right = common(bucket[0][0], bucket[1][0]), common(bucket[0][1], bucket[1][1])
        if left + right >= length:
            out[0].append((left, length - right))
            out[1].append((left, length - right))
        return out
    for left, right, group in repeat_groups(bucket, length):
        for i in group:
            if not out[i] or out[i][-1] != (left, length - right):
                out[i].append((left, length - right))
    return [[(end - 1, least) for least, end in merged([(least, most + 1) for most, least in windows])] if len(windows) > 1 else windows for windows in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that touch joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per anchor: h, same (a hash of the bytes around it), rk, its place and how far before it windows start, m.

    What is equal within a batch is combined: one row with m = 2 stands for all, and the others come with m = 0, as repeated
    already; they are dealt by rk, so anchors that a good part of all texts have make few rows in their bucket.
    """
    for batch in batches:
        for at in range(0, len(batch), 2000):
            rks, texts, found = [], batch["text"].iloc[at : at + 2000], []
            same: list[int] = []
            for rk, text in zip(batch["rk"].iloc[at : at + 2000], texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                h, place, low, high = anchors(data)
                found.append((h, place, place - low, place - high))
                rks.append((rk, len(h)))
                digest = xxhash.xxh3_64_intdigest
                same += [digest(data[a:b], seed=k) for a, b, k in zip(low.tolist(), (high + LENGTH).tolist(), (place - low).tolist(), strict=True)]
            h, place, most, least = (np.concatenate(x) for x in zip(*found, strict=True))
            h, same_ = h.view(np.int64), np.array(same, np.uint64).view(np.int64)
            rk = np.repeat(np.array([r for r, _ in rks], object), [n for _, n in rks])
            dealt = np.repeat(np.array([int.from_bytes(r[:8], "little", signed=True) for r, _ in rks], np.int64), [n for _, n in rks])
            order = np.lexsort((same_, h))
            again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (same_[order][1:] == same_[order][:-1])])[: len(h)]
            m = np.where(again, 0, 1)
            m[:-1][again[1:] & ~again[:-1]] = 2
            yield pd.DataFrame({"key": np.where(again, dealt[order], h[order]), "same": same_[order], "rk": rk[order], "place": place[order], "most": most[order].astype(np.int16), "least": least[order].astype(np.int16), "m": m.astype(np.int8)})


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by key and same: repeated windows of equal surroundings, and one row of each kind of surroundings in a bucket of several.

    Rows come out as (h, rk, place, most, least, m), with m = 0 for repeated windows. One row is held between batches, so a
    bucket may have any number.
    """
    names = ["h", "rk", "place", "most", "least", "m"]
    held: pd.DataFrame | None = None  # the first row of the last class
    told = after = False  # whether its windows are out already; whether a class of its bucket was before it

    def out(rows: pd.DataFrame, m) -> pd.DataFrame:
        return rows.assign(m=np.int8(0) if m is None else m).rename(columns={"key": "h"})[names]

    for batch in batches:
        done = batch["m"] == 0
        if done.any():
            yield out(batch[done], None)
            batch = batch[~done]
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        key, same, m = batch["key"].to_numpy(), batch["same"].to_numpy(), batch["m"].to_numpy().astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (same[1:] != same[:-1])]))
        total = np.add.reduceat(m, first)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        twice = total[number] >= 2
        if told:
            twice[0] = False
        yield out(batch[twice], None)
        ahead = np.concatenate([key[first][1:] == key[first][:-1], [False]])
        behind = np.concatenate([[after], ahead[:-1]])
        several = (ahead | behind)[:-1]  # the last class waits for the next batch
        chosen = batch.iloc[first[:-1][several]]
        yield out(chosen, np.minimum(total[:-1][several], 2).astype(np.int8))
        held = batch.iloc[first[-1:]].assign(m=np.int8(min(2, total[-1])))
        told, after = bool(total[-1] >= 2), bool(behind[-1])
    if held is not None and after:
        yield out(held, held["m"].to_numpy())


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, len(batch), 64):
            out = []
            for rk, z, found in zip(batch["rk"].iloc[at : at + 64], batch["z"].iloc[at : at + 64], batch["found"].iloc[at : at + 64], strict=True):
                text = press.decompress(z)
                for x in found:
                    place, most, least = x["place"], x["most"], x["least"]
                    out.append((x["h"], rk, place, most, least, x["m"], x["large"], text[place - most : place - least + LENGTH]))
            yield pd.DataFrame(out, columns=["h", "rk", "place", "most", "least", "m", "large", "context"], dtype=object)


def _bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated windows of buckets, from rows sorted by h, as first and last start."""
    rest: pd.DataFrame | None = None

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, int)
        rks, places, contexts, mosts = (rows[c].tolist() for c in ("rk", "place", "context", "most"))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                bucket = [(contexts[i][: mosts[i]][::-1], contexts[i][mosts[i] :]) for i in range(a, b)]
                for i, windows in zip(range(a, b), repeated_windows(bucket), strict=True):
                    out += [(rks[i], places[i] - most, places[i] - least) for most, least in windows]
        return pd.DataFrame(out, columns=["rk", "a", "b"], dtype=object)

    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        cut = np.searchsorted(batch["h"].to_numpy(), batch["h"].iloc[-1]) if len(batch) else 0
        rest = batch.iloc[cut:]
        yield found(batch.iloc[:cut])
    if rest is not None:
        yield found(rest)


def _parted(rows: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Parts large buckets (h, rk, place, most, least, m, context): windows found repeated (rk, a, b), and small buckets to compare.

    The windows of a bucket are parted by how far before the anchor they start. Those that start low to high bytes before it
    all hold `low` bytes before and LENGTH - high bytes from the anchor on, so these bytes make buckets of that range: small
    ones are compared as any bucket, large ones are parted again. In each, rows that agree on all windows of the range are
    repeated and go on as one. count: the rows, about.
    """
    low, high = F.col("low"), F.col("high")
    rows = rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(LENGTH - GRAM)).withColumn("key", F.col("h"))
    members, repeated, few = [], [], []
    while True:
        # All that the row's windows of the range cover.
        least, most = F.greatest("low", "least"), F.least("high", "most")
        covered = F.substring("context", F.col("most") - most + 1, most + LENGTH - least)
        rows = stored(rows.withColumn("same", F.xxhash64(least, most, covered)), "parts", count)
        one = F.min(F.struct("rk", "place", "most", "least", "m", "context")).alias("one")
        classes = stored(rows.groupBy("h", "key", "low", "high", "same").agg(F.sum("m").alias("n"), one), "classes", count)
        members.append(rows.where("m < 2").select("h", "key", "same", "rk", (F.col("place") - most).alias("a"), (F.col("place") - least).alias("b")))
        repeated.append(classes.where("n > 1").select("h", "key", "same"))

        ones = classes.where("low < high").select("h", "low", "high", "one.*", "n").withColumn("m", F.when(F.col("n") > 1, 2).otherwise(F.col("m")))
        step = F.ceil((high - low + 1) / PARTS).cast("int")
        parts = F.transform(F.sequence(low, high, step), lambda p: F.struct(p.alias("low"), F.least(p + step - 1, high).alias("high")))  # noqa: B023
        ones = ones.withColumn("part", F.explode(F.filter(parts, lambda p: (p["low"] <= F.col("most")) & (p["high"] >= F.col("least")))))
        ones = ones.select("h", "rk", "place", "most", "least", "m", "context", "part.low", "part.high")
        shared = F.substring("context", F.col("most") - low + 1, low + LENGTH - high)
        ones = stored(ones.withColumn("key", F.xxhash64("low", "high", shared)), "parts", PARTS * count)
        sizes = ones.groupBy("h", "key").agg(F.count("*").alias("n")).where("n > 1")
        ones = stored(ones.join(sizes, ["h", "key"]), "parts", PARTS * count)
        few.append(ones.where(F.col("n") <= BUCKET).select(F.xxhash64("h", "key").alias("h"), "rk", "place", "most", "context"))
        rows = ones.where(F.col("n") > BUCKET).drop("n")
        if rows.isEmpty():
            every = reduce(DataFrame.unionByName, members).join(reduce(DataFrame.unionByName, repeated), ["h", "key", "same"], "left_semi")
            return every.select("rk", "a", "b"), reduce(DataFrame.unionByName, few)


def repeats(texts: DataFrame) -> DataFrame:
    """The repeated windows of texts (rk, text not null): rk, a, b for windows that start at a to b.

    rk names a row; rows that share it must be copies, and then repeat each other.
    """
    places = texts.mapInPandas(_anchors, "key long, same long, rk binary, place long, most short, least short, m byte")
    places = places.repartition("key").sortWithinPartitions("key", "same")
    found = stored(places.mapInPandas(_classes, "h long, rk binary, place long, most short, least short, m byte"), "places", even=True)
    out = found.where("m = 0").select("rk", (F.col("place") - F.col("most")).alias("a"), (F.col("place") - F.col("least")).alias("b"))

    ones = found.where("m > 0")
    sizes = stored(ones.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select(F.col("h").alias("of"), "n"), "sizes", even=True)
    some, count = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if some:
        large = F.broadcast(sizes.select("of")) if some <= BROADCAST_ROWS else sizes.select("of")
        ones = ones.join(large, F.col("h") == F.col("of"), "left").withColumn("large", F.col("of").isNotNull())
    else:
        ones = ones.withColumn("large", F.lit(False))
    own = ones.groupBy("rk").agg(F.collect_set(F.struct("h", "place", "most", "least", "m", "large")).alias("found"))  # at most a text's anchors
    pressed = texts.mapInPandas(press, "rk binary, z binary")
    contexts = pressed.join(own, "rk").mapInPandas(_contexts, "h long, rk binary, place long, most int, least int, m int, large boolean, context binary")
    if some:
        contexts = stored(contexts, "contexts", even=True)
    small = contexts.where("NOT large").select("h", "rk", "place", "most", "context")
    if some:
        more, few = _parted(contexts.where("large").drop("large"), count)
        out, small = out.unionByName(more), small.unionByName(few)
    small = small.repartition("h").sortWithinPartitions("h")
    return out.unionByName(small.mapInPandas(_bucketed, "rk binary, a long, b long"))


def remove(docs: DataFrame, carry: list[str], with_text: bool = True) -> DataFrame:
    """Removes every byte of docs (text and the columns `carry`) that a window of 200 bytes found again elsewhere covers.

    Texts are UTF-8 bytes and judged as given. Returns `carry`, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and, if with_text, kept (the other bytes in order). Null and empty texts have no bytes; texts under 200 bytes lose none;
    repeated rows are copies of each other and lose all; an empty table gives no rows; a carried column of a new name gives way.
    """
    ship(docs.sparkSession)
    carried, new = Carried(docs, carry), ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    docs = docs.select(*carried.columns(), F.coalesce("text", F.lit("")).alias("text"))
    wide = lambda *seed: F.lpad(F.hex(F.xxhash64(*seed, *docs.columns)), 16, "0")
    docs = docs.withColumn("rk", F.unhex(F.concat(wide(), wide(F.lit(1)))))
    spans = repeats(docs.where(F.octet_length("text") >= LENGTH).select("rk", "text")).groupBy("rk").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    schema = ", ".join([carried.schema()] * bool(carry))
    pressed = docs.mapInPandas(press, schema + ", " * bool(carry) + "rk binary, z binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, found in zip(batch.pop("z"), batch.pop("spans"), strict=True):
                text = press.decompress(z)
                gone = merged([(x["a"], x["b"] + LENGTH) for x in found]) if found is not None else []
                edges = [0, *(e for span in gone for e in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
            yield pd.concat([batch, pd.DataFrame(rows, columns=new, index=batch.index, dtype=object)], axis=1)

    both = pressed.join(spans, "rk", "left").select(*carried.keys, "z", "spans")
    kinds = ["long", "long", "long", "string", "binary"]
    out = both.mapInPandas(run, ", ".join([schema] * bool(carry) + [f"{c} {kind}" for c, kind in zip(new, kinds, strict=False)]))
    return out.select(*carried.back(new), *new)
