"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts (words, their characters, symbols, repeated lines, words in repeated windows) and ratios of
them. Sketches per language and source give the quartiles of each ratio, and merged those per language: counts of buckets
whose width grows with the value, so a quartile is at most 0.2 % low, merging adds counts up and no run, partitioning or order
of merging changes a threshold. A group's
threshold is the mean of its own and its language's, weighted by its documents against a fixed number, so that small groups
lean on their language and no size is a switch. A ratio fails where it lies far above its group's upper quartile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.llm.common import BLANKS, stored, words_of

#: Fixed values of the rules: the symbols, and the length of windows.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Ratios with an adaptive upper threshold, and the least spread (between quartiles) that each counts as having.
RATIOS = {"symbol_ratio": 0.02, "repeat_ratio": 0.1, "dup_line_ratio": 0.15, "mean_word": 1.0}

#: Spreads above the upper quartile at which a ratio fails.
FENCE = 3.0

#: Documents that a language's threshold counts as, against those of a language and source.
PRIOR_DOCS = 20

#: Bits after the point, and leading bits, that a sketch's buckets keep of a value.
FRACTION, LEADING = 20, 10

#: Rows of the threshold table up to which it is broadcast; beyond, the join is by shuffle. A row has about 100 bytes.
BROADCAST_ROWS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in windows (of two words or more) found twice or more among the words."""
    none = F.lit(0).cast("long")

    def joined(step: int) -> Callable[[Column], Column]:
        return lambda g: F.transform(g, lambda x, i: F.xxhash64(x, F.get(g, i + step)))

    def whole(g: Column) -> Column:
        return F.when(F.size(g) >= window, F.slice(g, 1, F.size(g) - (window - 1))).otherwise(F.array().cast("array<bigint>"))

    def windows(words: Column) -> Column:
        """A hash per window, each of those of two shorter ones that cover it."""
        out, length = words, 1
        while length < window:
            step = min(length, window - length)
            out, length = let(out, joined(step)), length + step
        return let(out, whole)  # past the last whole window are hashes of fewer words

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))).cast("long"))
        return F.aggregate(steps, none, lambda a, x: a + x)

    def repeats(g: Column) -> Column:
        def places(s: Column) -> Column:
            twice = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(let(let(pairs, places), covered))

    return let(windows(words), repeats)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` as a struct named row, lang, source, the counts and the ratios of each document."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    symbols = sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(s))) for s in SYMBOLS), F.lit(0))
    docs = docs.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    docs = docs.select(
        "row", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    per = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(n)), F.lit(0.0))
    return docs.select(
        "row", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbol_ratio"), per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("lines.dup", "lines.n").alias("dup_line_ratio"), per("word_chars", "n_words").alias("mean_word"),
    )


def bucket(ratio: Column) -> Column:
    """The bucket of a ratio: its 2^20th part's whole number, with all but the ten leading bits zero (at most 0.2 % below it)."""
    part = F.floor(ratio * float(1 << FRACTION)).cast("long")
    return let(part, lambda x: x - x % F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(x)) - LEADING, F.lit(0))))


def limits(counts: DataFrame, by: list[str], fence: float) -> DataFrame:
    """From rows (by, ratio, bucket, n) to by, n (their number) and per ratio its upper threshold, named as the ratio.

    A quartile is the smallest bucket with at least that share of the rows in it and below. A group has at most a few
    thousand buckets, whatever its rows.
    """
    group = Window.partitionBy(*by, "ratio")
    up_to = F.sum("n").over(group.orderBy("bucket"))
    counts = counts.select(*by, "ratio", "bucket", "n", up_to.alias("up_to"), F.sum("n").over(group).alias("rows"))
    quarter = lambda k: F.min(F.when(4 * F.col("up_to") >= k * F.col("rows"), F.col("bucket"))) / float(1 << FRACTION)
    found = counts.groupBy(*by, "ratio").agg(F.max("rows").alias("n"), quarter(1).alias("low"), quarter(3).alias("high"))
    least = F.element_at(F.array(*[F.lit(spread) for spread in RATIOS.values()]), F.col("ratio") + 1)
    found = found.select(*by, "ratio", "n", (F.col("high") + F.lit(fence) * F.greatest(F.col("high") - F.col("low"), least)).alias("limit"))
    each = [F.max(F.when(F.col("ratio") == k, F.col("limit"))).alias(r) for k, r in enumerate(RATIOS)]
    return found.groupBy(*by).agg(F.max("n").alias("n"), *each)


def thresholds(found: DataFrame, fence: float = FENCE, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """The upper thresholds of each ratio per lang and source, from quantile sketches: the same however rows are dealt."""
    each = F.posexplode(F.array(*[bucket(F.col(r)) for r in RATIOS])).alias("ratio", "bucket")
    own = found.select("lang", "source", each).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))
    own = stored(own, "sketches", even=True)
    whole = own.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    a, b = limits(own, ["lang", "source"], fence).alias("a"), limits(whole, ["lang"], fence).alias("b")
    both = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")))
    mean = lambda r: (F.col("a.n") * F.col(f"a.{r}") + prior_docs * F.col(f"b.{r}")) / (F.col("a.n") + prior_docs)
    return both.select("a.lang", "a.source", *[mean(r).alias(r) for r in RATIOS])


def judge(docs: DataFrame, carry: list[str] | None = None, fence: float = FENCE, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """Judges docs (text, lang, source and the columns `carry`, all by default).

    Returns row (a struct of `carry`), the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then
    base_failed and kept. Null and empty texts have no words and fail. A null lang or source is a group of its own.
    Repeated rows are judged each, very long texts whole, and runs agree, whatever the partitions; an empty table gives no rows; column names in docs can't clash with those made here.
    """
    found = stored(measured(docs, carry or docs.columns), "measured")
    upper = stored(thresholds(found, fence, prior_docs), "thresholds", even=True)
    if upper.count() <= BROADCAST_ROWS:
        upper = F.broadcast(upper)
    a, b = found.alias("a"), upper.alias("b")
    both = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    above = [F.col(f"a.{r}") > F.col(f"b.{r}") for r in RATIOS]
    kept = ~failed & ~F.coalesce(above[0] | above[1] | above[2] | above[3], F.lit(False))
    return both.select("a.row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def filter_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents that judge keeps, with their own columns."""
    return judge(docs, **kw).where("kept").select("row.*")
