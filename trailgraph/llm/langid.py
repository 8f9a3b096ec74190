"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its letters' vectors, permuted by their place, with an
elementwise product; a text bundles the vectors of its trigrams by their sum; a language's prototype bundles those of all
its texts. A text's language is the prototype of greatest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import Carried, ship

#: Letter slots (a power of two; slot 0 is the edge of a word) and dimensions of vectors.
SLOTS = 1024
DIMENSIONS = 1024
SEED = 7

#: Texts whose trigrams are bound together in one product.
TEXTS_AT_ONCE = 128


@cache
def letter_vectors(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of all slots as first, second and third letter of a trigram."""
    base = np.random.default_rng(seed).integers(0, 2, (SLOTS, dimensions)).astype(np.float32) * 2 - 1
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


@cache
def letters() -> np.ndarray:
    """Slot by code point; 0 for what is no letter."""
    points = np.arange(0x110000, dtype=np.int32)
    return np.where([chr(p).isalpha() for p in points], 1 + points % (SLOTS - 1), 0).astype(np.int32)


def trigrams(text: str) -> np.ndarray:
    """Codes of all letter trigrams of a text in lower case; what is no letter is one edge of a word."""
    slot = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")]
    keep = slot != 0
    if not keep.any():
        return np.empty(0, np.int32)
    keep[1:] |= slot[:-1] != 0
    keep[0] = True
    slot = slot[keep]
    if slot[1] == 0:
        slot = slot[1:]
    return (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]


def bound(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vectors of trigrams."""
    first, second, third = letter_vectors(dimensions, seed)
    out = first[codes // (SLOTS * SLOTS)]
    out *= second[codes // SLOTS % SLOTS]
    out *= third[codes % SLOTS]
    return out


def bundles(texts: list[str], dimensions: int, seed: int) -> np.ndarray:
    """A row per text: the sum of its trigrams' vectors."""
    each = [np.unique(trigrams(t), return_counts=True) for t in texts]
    codes, place = np.unique(np.concatenate([c for c, _ in each]), return_inverse=True)
    row = np.repeat(np.arange(len(each)), [len(c) for c, _ in each])
    out = np.zeros((len(each), dimensions), np.float32)
    for at in range(0, len(codes), 8192):  # so that memory stays bounded with scripts of many trigrams
        inside = (place >= at) & (place < at + 8192)
        counts = np.zeros((len(each), min(8192, len(codes) - at)), np.float32)
        counts[row[inside], place[inside] - at] = np.concatenate([n for _, n in each])[inside]
        out += counts @ bound(codes[at : at + 8192], dimensions, seed)
    return out


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The prototype of each language in labelled (text, lang), from all rows with both; languages without letters have none.

    A task gives one vector per language; what is collected is a number per language and dimension. All are whole numbers,
    so the order of adding does not matter.
    """

    ship(labelled.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                texts = own["text"].tolist()
                for at in range(0, len(texts), TEXTS_AT_ONCE):
                    codes, n = np.unique(np.concatenate([trigrams(t) for t in texts[at : at + TEXTS_AT_ONCE]]), return_counts=True)
                    for k in range(0, len(codes), 8192):
                        part = n[k : k + 8192].astype(np.float64) @ bound(codes[k : k + 8192], dimensions, seed)
                        found[lang] = found.get(lang, 0) + part
        if found:
            yield pd.DataFrame({"lang": list(found), "bundle": [v.tolist() for v in found.values()]}, dtype=object)

    parts = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").mapInPandas(run, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["pos"]] = r["n"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v)}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], carry: list[str], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Adds lang_pred and score (the cosine, at least 0) to the columns `carry` of docs (text and those).

    Null texts, texts without a letter, and all texts if nothing was learned are und with score 0. Ties go to the first
    language by name; repeated rows are predicted each; an empty table gives no rows; a carried column of a new name gives way.
    """
    ship(docs.sparkSession)
    names = list(learned)
    protos = np.array([learned[k] for k in names], np.float32).reshape(len(names), dimensions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            texts = batch.pop("__text")
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                own = [t if isinstance(t, str) else "" for t in texts.iloc[at : at + TEXTS_AT_ONCE]]
                if names:
                    vectors = bundles(own, dimensions, seed)
                    norms = np.linalg.norm(vectors, axis=1)
                    cosines = vectors @ protos.T / np.maximum(norms, 1e-9)[:, None]
                    best = cosines.argmax(axis=1)
                    seen = norms > 0
                    lang[at : at + len(own)][seen] = np.array(names, object)[best[seen]]
                    score[at : at + len(own)][seen] = np.clip(cosines.max(axis=1)[seen], 0, 1)
            batch["lang_pred"], batch["score"] = lang, score
            yield batch

    carried, new = Carried(docs, carry), ["lang_pred", "score"]
    schema = ", ".join([carried.schema()] * bool(carry) + ["lang_pred string, score double"])
    out = docs.select(*carried.columns(), F.col("text").alias("__text")).mapInPandas(run, schema)
    return out.select(*carried.back(new), *new)
