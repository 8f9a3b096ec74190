"""Values that flow along arcs until none improves, as rounds of joins on stored buckets.

A state has one value per vertex and key (a source, a word of 64 sources' bits, a register of a sketch). In a round only the
values that improved in the last one are sent; what arrives is combined per vertex and key and held against the state. Neither
the arcs nor the state move: both lie in buckets that the rows sent are shuffled to. The state is kept as tables of growing
size, the small ones merged as they come, so a round writes what it improved and each row is written again a logarithm of times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.plans.durable import TABLES, shared_dir
from trailgraph.plans.index import Bucketed, Index, bucketed, met

#: Tables of the state that a round looks into at most.
TIERS = 6

KEYS = ["node", "key"]
#: Removes a query's files of shuffles as it ends, as a round reads none of an earlier one.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Rule:
    """How values combine: `combined` of those that arrive, `merged` of the state's tables (null where a table has none), what of a new one is `fresh` against an old one (null for nothing), and what is `sent` along a length."""

    combined: Callable[[str], Column]
    merged: Callable[[list[Column]], Column]
    fresh: Callable[[Column, Column], Column]
    sent: Callable[[Column, Column], Column] = lambda value, w: value


def _or(parts: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, [F.coalesce(p, F.lit(0).cast("long")) for p in parts])


def _lower(new: Column, old: Column) -> Column:
    return F.when(old.isNull() | (new < old), new)


#: The smallest sum of lengths; the smallest and the greatest value; the union of bits.
LEAST = Rule(F.min, lambda parts: F.least(*parts), _lower, lambda value, w: value + w)
SMALLEST = Rule(F.min, lambda parts: F.least(*parts), _lower)
GREATEST = Rule(F.max, lambda parts: F.greatest(*parts), lambda new, old: F.when(old.isNull() | (new > old), new))
BITS = Rule(F.bit_or, _or, lambda new, old: F.nullif(new.bitwiseAND(F.bitwise_not(_or([old]))), F.lit(0).cast("long")))


def names(width: int) -> list[str]:
    """The columns of the values of a row that has `width` of them."""
    return ["value"] if width == 1 else [f"value{k}" for k in range(width)]


def fixpoint(index: Index, first: DataFrame, rule: Rule, max_rounds: int | None = None, told: Callable[[int, int], None] | None = None, width: int = 1, base: str | None = None) -> DataFrame:
    """Runs rounds from first (node, key, value; one row per node and key) until nothing improves, or max_rounds.

    Returns node, key, value, old and d for every improvement: at round d (0 for first) the vertex came to value, from old (null
    if it had none). With BITS, value is the bits that are new and old those before. told(d, rows) is called after each round.
    With a width above 1 a row has as many values, by names(width), null where one doesn't improve, and no old ones. The rounds
    are written under base, a folder of the caller's if it is to remove them.
    """
    spark = first.sparkSession
    base = base or f"{shared_dir(spark)}/{TABLES}/rounds-{uuid.uuid4().hex}"
    values, before = names(width), spark.conf.get(CLEANUP)
    old = [F.lit(None).cast("long").alias("old")] if width == 1 else []
    spark.conf.set(CLEANUP, "true")
    try:
        now = bucketed(first.select("node", "key", *[F.col(v).cast("long").alias(v) for v in values], *old), KEYS, "round", f"{base}/d=0")
        tiers, d = [now], 0
        while now.count and (max_rounds is None or d < max_rounds):
            d += 1
            now = bucketed(_improved(index, now, tiers, rule, values), KEYS, "round", f"{base}/d={d}", dealt=True)
            if told is not None:
                told(d, now.count)
            tiers = _kept(tiers, now, rule, base, values)
    finally:
        spark.conf.set(CLEANUP, before)
    for table in tiers:
        if not table.path.startswith(base):
            table.discard()
    return spark.read.schema(", ".join(f"{c} long" for c in (*KEYS, *values, *(["old"] if old else []), "d"))).parquet(base)


def _improved(index: Index, now: Bucketed, tiers: list[Bucketed], rule: Rule, values: list[str]) -> DataFrame:
    """What the last round's values improve: node, key, the values and, of one only, old."""
    sent = index.ahead(now.rows.select(*KEYS, *values))
    found = sent.select(F.col("head").alias("node"), "key", *[rule.sent(F.col(v), F.col("w")).alias(v) for v in values])
    found = found.groupBy(*KEYS).agg(*[rule.combined(v).alias(f"new_{v}") for v in values])
    for k, table in enumerate(tiers):
        olds = table.rows.select(*KEYS, *[F.col(v).alias(f"{v}_{k}") for v in values])
        found = met(found, olds, KEYS, "left", table.large)
    merged = {v: [F.col(f"{v}_{k}") for k in range(len(tiers))] for v in values}
    olds = [(rule.merged(parts) if len(parts) > 1 else parts[0]).alias(f"old_{v}") for v, parts in merged.items()]
    found = found.select(*KEYS, *[f"new_{v}" for v in values], *olds)
    fresh = [rule.fresh(F.col(f"new_{v}"), F.col(f"old_{v}")).alias(v) for v in values]
    found = found.select(*KEYS, *fresh, *([F.col("old_value").alias("old")] if len(values) == 1 else []))
    return found.where(F.coalesce(*values).isNotNull())


def _kept(tiers: list[Bucketed], now: Bucketed, rule: Rule, base: str, values: list[str]) -> list[Bucketed]:
    """The state's tables with a new one. Beyond TIERS, the last ones are merged, with each before that is less than twice as large as they are."""
    tiers = [*tiers, now] if now.count else tiers
    if len(tiers) <= TIERS:
        return tiers
    at, total = len(tiers) - 1, tiers[-1].count
    while at and (tiers[at - 1].count < 2 * total or at == len(tiers) - 1):
        at, total = at - 1, total + tiers[at - 1].count
    # Read as plain files, not as a union of bucketed tables: rows of one key must meet, whatever table they are from.
    rows = now.rows.sparkSession.read.schema(", ".join(f"{c} long" for c in (*KEYS, *values))).option("recursiveFileLookup", "true").parquet(*[table.path for table in tiers[at:]])
    rows = rows.groupBy(*KEYS).agg(*[rule.combined(v).alias(v) for v in values])
    merged = bucketed(rows, KEYS, "state", dealt=True)
    for table in tiers[at:]:
        if not table.path.startswith(base):
            table.discard()
    return [*tiers[:at], merged]
