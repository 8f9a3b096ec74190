"""Phrase collocations by hashed passes (PCY and DHP) with Apriori pruning.

A pass counts phrases of one length exactly, and at the same time counts those one word longer in buckets by their hash. The
next pass looks only at phrases whose bucket holds enough and whose two shorter parts are frequent; both tests are bitmaps of
a fixed size, broadcast to the tasks. From the second pass on, texts are trimmed to the stretches that can still hold a longer
phrase. A bitmap can let a rare phrase through, never stop a frequent one, and what gets through is counted exactly, so results
are exact at any number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.llm.common import ship, stored

#: Buckets by their bits: 2^24 make a bitmap of 2 MB and an array of 16 MB in a task. Buckets of a block travel as one row.
BITS = 24
BLOCK = 1 << 16

#: Tokens that a task takes together, and bytes of a text that it splits at once.
TOKENS_AT_ONCE = 2_000_000
BYTES_AT_ONCE = 1 << 20

#: Ends of a piece, by what they become, with capitals and the tab.
END = b"\n"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")

#: Odd multipliers of the hash of a phrase from those of its words.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: The score, exact in 38 digits for counts below 10^15.
SCORE = "cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"

#: A task's rows: phrases with their number, blocks of buckets with their counts, or texts trimmed for the next pass.
SCHEMA = "lang string, phrase string, n long, block int, counts binary, text string"
ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("counts", pa.binary()), ("text", pa.string())])


def rows_of(size: int, **columns: object) -> pa.RecordBatch:
    """A batch of `size` rows; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in ARROW], schema=ARROW)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with an END after each piece, in parts that end with a piece."""
    text, at = text.translate(PLAIN), 0
    while at < len(text):
        end = at + BYTES_AT_ONCE
        end = len(text) if end >= len(text) else text.find(END, end) + 1 or len(text)
        yield [w for w in text[at:end].replace(END, b" " + END + b" ").split(b" ") if w] + [END]
        at = end


class Numbers(dict):
    """Words by number in order of first appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({END: 0})
        self.words = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes of phrases, each continued by a word."""
    return hashes * STEP + last


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * SPREAD
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7)) & 1 == 1


def blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks that aren't empty, a row each."""
    for k in range(0, len(counts), BLOCK):
        if counts[k : k + BLOCK].any():
            yield rows_of(1, block=[k // BLOCK], counts=[counts[k : k + BLOCK].tobytes()])


def saturating(least: int) -> type:
    return np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32


def bitmap(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bits of the buckets whose counts, summed over tasks, are `least` or more. Collects 2^bits bits at most.

    A task adds up the rows of its blocks as they come and holds one array a block.
    """
    kind, width = saturating(least), min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                now = held.setdefault(k, np.zeros(width, kind))
                now += np.minimum(np.frombuffer(counts, kind), kind(least) - now)
        for k, counts in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "bits": [np.packbits(counts >= least, bitorder="little").tobytes()]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    summed = rows.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(run, "block int, bits binary")
    for r in summed.collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["block"] * width // 8 :][: len(own)] = own
    return out


def counted(docs: DataFrame, length: int, least: int, bits: int, parts: Broadcast | None, buckets: Broadcast | None, more: bool) -> DataFrame:
    """A pass over docs (lang, text): rows of phrases of `length` words with their number; with `more` also for the pass after.

    parts has the bits of the frequent phrases one word shorter, buckets those of this length; both are absent in the first pass.
    """
    kind = saturating(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = np.zeros(1 << bits if more else 0, kind)
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        many = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                numbers, arrays = held.setdefault(lang, (Numbers(), []))
                for part in tokens(text.as_py()):
                    arrays.append(np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)))
                    many += len(part)
                if many >= TOKENS_AT_ONCE:
                    for lang, (numbers, arrays) in held.items():
                        yield from phrases(lang, numbers.words, np.concatenate([np.zeros(1, np.int32), *arrays]), ahead)
                    held, many = {}, 0
        for lang, (numbers, arrays) in held.items():
            yield from phrases(lang, numbers.words, np.concatenate([np.zeros(1, np.int32), *arrays]), ahead)
        yield from blocks(ahead)

    def phrases(lang: str, words: list[bytes], at: np.ndarray, ahead: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The counted phrases of the numbered words `at`, with 0 between pieces; adds the next length's to ahead."""
        own = word_hashes(words, lang)
        starts = np.flatnonzero(at)
        hashes = own[at[starts]]
        for k in range(1, length):
            last = k == length - 1
            if last:
                starts, hashes = kept(starts, hashes, has(parts.value, bucket(hashes, bits)))
            starts, hashes = kept(starts, hashes, followed(starts, len(at)) if last else at[starts + k] > 0)
            hashes = longer(hashes, own[at[starts + k]])
        if length > 1:
            starts, hashes = kept(starts, hashes, has(buckets.value, bucket(hashes, bits)))
        rows, n = distinct(at, starts, length, len(words))
        for k in range(0, len(n), 100_000):
            joined = [b" ".join([words[w] for w in row]) for row in rows[k : k + 100_000].tolist()]
            yield rows_of(len(joined), lang=[lang] * len(joined), phrase=pa.array(joined, pa.binary()).cast(pa.string()), n=n[k : k + 100_000])
        if more:
            starts, hashes = kept(starts, hashes, followed(starts, len(at)))
            place, n = np.unique(bucket(longer(hashes, own[at[starts + length]]), bits), return_counts=True)
            ahead[place] += np.minimum(n, least - ahead[place]).astype(kind)
        if more and length > 1:
            # Starts here have the next place as a start too: a run of them is a stretch of phrases that overlap.
            runs = [r for r in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1) if len(r)]
            stretches = [b" ".join([words[w] for w in at[r[0] : r[-1] + 1 + length].tolist()]) for r in runs]
            for k in range(0, len(stretches), 1000):
                yield rows_of(1, lang=[lang], text=pa.array([END.join(stretches[k : k + 1000])], pa.binary()).cast(pa.string()))

    return docs.mapInArrow(run, SCHEMA)


def kept(starts: np.ndarray, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return starts[which], hashes[which]


def followed(starts: np.ndarray, size: int) -> np.ndarray:
    """Which starts have the next place as a start too."""
    alive = np.zeros(size + 1, bool)
    alive[starts] = True
    return alive[starts + 1]


def distinct(at: np.ndarray, starts: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different phrases of `length` numbers at the starts, a row each, and how often each occurs."""
    if words**length >= 1 << 63:
        return np.unique(at[starts[:, None] + np.arange(length)], axis=0, return_counts=True)
    codes = np.zeros(len(starts), np.int64)
    for k in range(length):
        codes = codes * words + at[starts + k]
    codes, n = np.unique(codes, return_counts=True)
    return codes[:, None] // words ** np.arange(length - 1, -1, -1, dtype=np.int64) % words, n


def marked(frequent: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bits of the buckets of frequent phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, saturating(least))
        for batch in batches:
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                own = word_hashes(phrase.encode("utf-8", "surrogatepass").split(b" "), lang)
                hashes = own[:1]
                for k in range(1, len(own)):
                    hashes = longer(hashes, own[k : k + 1])
                out[bucket(hashes, bits)] = least
        yield from blocks(out)

    return bitmap(frequent.select("lang", "phrase").mapInArrow(run, SCHEMA), least, bits)


def frequent_phrases(docs: DataFrame, most: int = 3, least: int = 10, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `most` words with f >= least occurrences, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    out, total, parts, buckets = [], None, None, None
    for length in range(1, most + 1):
        found = stored(counted(docs, length, least, bits, parts, buckets, length < most), "phrases")
        exact = found.where("phrase IS NOT NULL")
        if total is None:
            total = exact.groupBy("lang").agg(F.sum("n").alias("n"))
        exact = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        out.append(stored(exact.select("lang", "phrase", F.lit(length).alias("words"), "f"), "frequent", even=True))
        if length < most:
            for old in (parts, buckets):
                if old is not None:
                    old.unpersist()
            docs = found.where("text IS NOT NULL").select("lang", "text") if length > 1 else docs
            parts, buckets = (spark.sparkContext.broadcast(b) for b in (marked(out[-1], least, bits), bitmap(found, least, bits)))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every, stored(total, "totals", even=True)


def _cut(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, cover: int = 50, top: int = 2000, bits: int = BITS, salts: int = 64) -> DataFrame:
    """Each language's first `top` phrases of 2 to `most` words by score: lang, rank, phrase, a, l, r, n, score.

    docs has lang and text. a is the phrase's occurrences, l and r those of its parts at the cut of the lowest score
    1000000 a a / (l r), rounded down and exact in decimals (ties to the first cut), n the words of its language. A phrase with
    `cover` hundredths or more of its occurrences inside one longer frequent phrase is left out. A null lang is `und`, a null
    text has no words; repeated rows count each; an empty table gives no rows; other columns are not read. Very long texts are
    split in parts between pieces. Ties of score and a are ranked by phrase, in the order of UTF-8.
    """
    every, total = frequent_phrases(docs, most, least, bits)
    longest = every.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = longest.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _cut(F.col("w"), F.lit(1), F.col("k")).alias("first"), _cut(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    one, two = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))

    scored = cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).withColumn("score", F.expr(SCORE).cast("long"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inside = longest.where("words > 2").select("lang", "f", F.col("words").alias("long"), "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("long") - F.col("size") + 1)).alias("at"))
    inside = inside.select("lang", _cut(F.col("w"), F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("covered"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("covered").isNull() | (100 * F.col("covered") < cover * F.col("a")))
    rows = left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within salts, so that no language's phrases are sorted in one place: at most salts * top of them are.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
