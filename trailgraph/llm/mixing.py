"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue with a weight, its documents in shuffled order, played at most `epochs` times. The virtual finish
time of a copy is the number of its source's words up to its end, over all epochs, divided by the weight. The copies of all
sources are range-sorted by virtual finish time, words are summed along that order over many partitions, and the order is
cut where the sum reaches the total budget: the copy there gives the words that are left. A source that runs out leaves its
share to the others. Long documents queue as packets of bounded size, each with its own finish time, so that every source's
words come within a packet of weight * time, time being where the cut lies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.llm.common import Carried, press, running, ship, stored, unpress, word_count

#: Hexadecimal digits of the shuffle key that make a bucket: 4096 buckets a source bound what one sort ranks.
BUCKET_DIGITS = 3

#: Words of a document that queue together.
PACKET = 256


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Targets of sources (source, source_size), one row each: weights repeat in order of source, null last.

    Sources share share * all sizes by weight; a target stops at epochs * its size and the excess is shared again.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * epochs).withColumn("full_at", F.col("most") / F.col("weight"))
    by_end = Window.orderBy("full_at", "rank")
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("most").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("weights_left", F.sum("weight").over(by_end.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()  # a row per source
    ranked = ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("weights_left"))
    # The first source, in order of running out, that lasts until its level: there the budget ends.
    ranked = ranked.withColumn("time", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"])
    capped = F.when(F.col("time").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("weight") * F.col("time"), F.col("most").cast("double")))
    return ranked.select("source", "source_size", "rank", "weight", "most", "budget", capped.alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: str) -> DataFrame:
    """docs (id, doc_id, source, size) with source_size, target and start (words of the source before the document in its queue),
    and a row per packet of each copy: epoch, finish (virtual finish time in units of 1 / lcm of the weights) and taken, the
    words that the budget still takes. Ties in finish go by source rank, epoch, shuffle key and ids, so reruns agree.
    """
    docs = docs.withColumn("key", shuffle_key(F.col("doc_id"), seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    wanted = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, epochs)
    order = Window.partitionBy("source").orderBy("bucket")  # at most 16 ** BUCKET_DIGITS rows
    begun = sums.select("source", "bucket", (F.sum("n").over(order) - F.col("n")).alias("begun"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    begun = begun.alias("a").join(wanted.alias("b"), same).select("a.source", "a.bucket", "a.begun", "b.source_size", "b.rank", "b.weight", "b.target")
    both = docs.alias("a").join(begun.alias("b"), same & (F.col("a.bucket") == F.col("b.bucket")))
    both = both.select("a.*", "b.begun", "b.source_size", "b.rank", "b.weight", "b.target")
    rows = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("start", F.col("begun") + F.coalesce(F.sum("size").over(rows), F.lit(0)))
    both = both.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    both = both.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("size") - 1), F.lit(PACKET).cast("long"))))
    both = both.withColumn("words", F.least(F.col("size") - F.col("first"), F.lit(PACKET)))
    end = F.col("start") + F.col("first") + F.col("words") + F.col("epoch") * F.col("source_size")
    both = both.withColumn("finish", (end * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("long")))
    both = both.select("id", "size", "source_size", "target", "start", "epoch", "rank", "key", "doc_id", "first", "words", "finish")
    ranked = running(both, ["finish", "rank", "epoch", "key", "doc_id", "size", "id"], {"upto": "words"})
    # The budget: what all targets come to, at most share * all sizes.
    budget = F.lit(int(wanted.agg(F.floor(F.least(F.max("budget"), F.sum("most")))).first()[0] or 0))
    left = budget - (F.col("upto") - F.col("words"))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")
    return ranked.select("id", "size", "source_size", "target", "start", "epoch", "finish", taken.alias("taken"))


def identified(docs: DataFrame, carry: list[str], kept: list[str]) -> tuple[DataFrame, Carried]:
    """docs written with an id per row, the columns `carry` under names that clash with none, and the columns `kept`."""
    carried = Carried(docs, carry)
    return stored(docs.select(*carried.columns(), *kept).withColumn("id", F.monotonically_increasing_id()), "mixed"), carried


def mix(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Plans the mix of docs (doc_id, source, size), size in words.

    Returns the columns `carry` and size, source_size, target, start (words of the source before the document in its queue)
    and taken (words the mix takes over all epochs; the copy at the budget's end is cut there). A carried column of one of
    these names gives way. Null sizes count as 0. A null source is a source of its own. Ties in the shuffle are broken by id
    and size, so reruns agree; repeated rows are documents of their own; an empty table gives no rows.
    """
    sized = docs.withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    rows, carried = identified(sized, [c for c in carry if c not in PLANNED], ["doc_id", "source", "size"])
    plan = queued(rows.select("id", "doc_id", "source", "size"), weights, share, epochs, seed)
    plan = plan.groupBy("id").agg(*[F.first(c).alias(c) for c in PLANNED[:-1]], F.sum("taken").alias("taken"))
    return rows.select("id", *carried.keys).join(plan, "id").select(*carried.back(), *PLANNED)


#: Columns of the plan of a mix.
PLANNED = ["size", "source_size", "target", "start", "taken"]


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed documents with their own columns, a row for each copy, in order of virtual finish time.

    Documents are not cut here: a copy is in if the budget takes at least half of its words; documents without words come
    once. Nulls, ties and repeated rows are treated as in mix(); an empty table gives no rows.
    """
    ship(docs.sparkSession)
    names = docs.columns
    carried = Carried(docs, [c for c in names if c != "text"])
    kinds = dict(docs.dtypes)
    sized = docs.select(*carried.columns(), F.col("doc_id").cast("string").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), "text")
    pressed = sized.mapInPandas(press, f"{carried.schema()}, doc_id string, source {kinds['source']}, size long, z binary")
    rows = stored(pressed.withColumn("id", F.monotonically_increasing_id()), "mixed")
    plan = queued(rows.select("id", "doc_id", "source", "size"), weights, share, epochs, seed)
    copies = plan.groupBy("id", "epoch").agg(F.first("size").alias("size"), F.max("finish").alias("finish"), F.sum("taken").alias("taken"))
    inside = F.when(F.col("size") == 0, F.col("epoch") == 0).otherwise(F.col("taken") * 2 >= F.col("size"))
    plan = copies.where(inside).select("id", "finish", "epoch")
    out = plan.join(rows.select("id", *carried.keys, "z"), "id").orderBy("finish", "id").select(*carried.keys, "z").mapInPandas(unpress, carried.schema() + ", text string")
    return out.select(*carried.back(), "text").select(*[F.col(f"`{c}`") for c in names])


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words, written once so that texts are read once."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
