"""Fill-in-the-middle by run-length class encoding.

A text becomes its maximal runs of characters of one class, each with the number of units that end in the runs up to it. A
cut after so many units is found by binary search over those numbers, and its place inside the run by arithmetic, so no unit
is ever made. Output is `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import Carried, ship

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: The classes of characters by unit: a class that ends a unit with each of its characters, and one whose characters wait for such an end.
CLASSES = {"line": re.compile(r"(\n+)|[^\n]+"), "word": re.compile(r"([\x20\x09-\x0D]+)|[^\x20\x09-\x0D]+"), "char": re.compile(r"((?s:.)+)")}


class Runs:
    """The runs of a text: where each starts, and how many units end up to and within it. An open last run ends a unit."""

    def __init__(self, text: str, unit: str):
        found = [(m.start(), m.end() - m.start() if m.group(1) else 0) for m in CLASSES[unit].finditer(text)]
        self.open = bool(found) and not found[-1][1]
        if self.open:
            found[-1] = found[-1][0], 1
        self.length, self.starts = len(text), [at for at, _ in found]
        self.upto = list(accumulate(n for _, n in found))

    @property
    def units(self) -> int:
        return self.upto[-1] if self.upto else 0

    def place(self, cut: int) -> int:
        """The place in the text after `cut` units."""
        if not cut:
            return 0
        run = bisect_left(self.upto, cut)
        if run == len(self.starts) - 1 and self.open:
            return self.length
        return self.starts[run] + cut - (self.upto[run - 1] if run else 0)


def drawn(doc_id: object, seed: int) -> list[int]:
    """Four numbers below 2^32 from the id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: str, doc_id: object, unit: str, rate: int, spm_rate: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the output of one text."""
    runs, (h1, h2, h3, h4) = Runs(text, unit), drawn(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return runs.units, "plain", None, None, text
    one, two = sorted(runs.place(h % (runs.units + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h4 % 100 < spm_rate:
        return runs.units, "spm", one, two - one, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return runs.units, "psm", one, two - one, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def infill(docs: DataFrame, carry: list[str], unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix_chars, middle_chars and output to the columns `carry` of docs (doc_id, text and those).

    rate and spm_rate are of a hundred; cuts and forms follow from seed and doc_id alone, so equal ids are cut alike and reruns
    agree. A null text counts as empty; an empty text, one that holds a mark and one not drawn stay plain, with null characters.
    A null doc_id draws as an empty one. Repeated rows are transformed each, an empty table gives no rows, a carried column of a
    new name gives way. A text is taken whole, however long; beside it a task holds one number pair per run.
    """
    if unit not in CLASSES:
        raise ValueError(f"unknown unit {unit}")
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch.pop("__text"), batch.pop("__id")
            made = [transformed(t if isinstance(t, str) else "", i, unit, rate, spm_rate, seed) for t, i in zip(texts, ids, strict=True)]
            for k, name in enumerate(new):
                batch[name] = pd.Series([m[k] for m in made], index=batch.index, dtype=object if name in ("form", "output") else "Int64")
            yield batch

    carried, new = Carried(docs, carry), ["n", "form", "prefix_chars", "middle_chars", "output"]
    schema = ", ".join([carried.schema()] * bool(carry) + ["n long, form string, prefix_chars long, middle_chars long, output string"])
    out = docs.select(*carried.columns(), F.col("text").alias("__text"), F.col("doc_id").cast("string").alias("__id")).mapInPandas(run, schema)
    return out.select(*carried.back(new), *new)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. No mark can arise where parts meet, so the marks in an output are those put there."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    first = lambda mark: F.substring_index(F.substr(head, F.lit(4)), mark, 1)
    last = lambda mark: F.substring_index(head, mark, -1)
    whole = F.when(form == "psm", F.concat(first(SUFFIX), middle, last(SUFFIX)))
    return whole.when(form == "spm", F.concat(last(PREFIX), middle, first(PREFIX))).otherwise(output)
