"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.plans.durable import running, shared_dir, ship, stored

__all__ = ["BLANKS", "Carried", "held_out", "press", "running", "shared_dir", "ship", "stored", "table", "unpress", "word_count", "words_of"]

#: The six bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


WHOLE = ("tinyint", "smallint", "int", "bigint")


class Carried:
    """Columns that go through a Python function untouched.

    They travel under names that clash with none, whole numbers as text, since pandas turns those with nulls into floats.
    """

    def __init__(self, df: DataFrame, names: list[str]):
        kinds = dict(df.dtypes)
        self.names, self.kinds = list(names), [kinds[c] for c in names]
        self.keys = [f"__c{k}" for k in range(len(names))]

    def columns(self) -> list[Column]:
        quoted = [F.col(f"`{c}`") for c in self.names]
        return [(c.cast("string") if kind in WHOLE else c).alias(key) for c, kind, key in zip(quoted, self.kinds, self.keys, strict=True)]

    def schema(self) -> str:
        return ", ".join(f"{key} {'string' if kind in WHOLE else kind}" for key, kind in zip(self.keys, self.kinds, strict=True))

    def back(self, new: list[str] = ()) -> list[Column]:
        """The columns under their own names; one that is named as a new column gives way to it."""
        every = zip(self.keys, self.names, self.kinds, strict=True)
        return [(F.col(k).cast(kind) if kind in WHOLE else F.col(k)).alias(c) for k, c, kind in every if c not in new]


def press(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the column text by z, its UTF-8 bytes in a compressed form, about half of what shuffles make of it; null stays."""
    import zstandard

    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        batch["z"] = [None if t is None else tool.compress(t.encode("utf-8", "surrogatepass")) for t in batch.pop("text")]
        yield batch


def unpress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the column z by text."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        batch["text"] = [None if z is None else tool.decompress(z).decode("utf-8", "surrogatepass") for z in batch.pop("z")]
        yield batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null or blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(words_of(text)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves the remainder part; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
