"""A quality classifier by Bradley-Terry ranking.

Labelled documents make preference pairs: one of label 1 is preferred to one of label 0. The chance of a preference is
the logistic function of the difference of two scores, each linear in a document's features, so the weights maximise a
logistic likelihood on feature differences. The threshold is the quantile of the training scores at the share of label 0.

Features are counts of form (symbols, capitals, repetition, length) and the shares of a text's byte trigrams that fall into
each of a number of hash bins, so that what is learned is not bound to a list of marks.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import Carried, ship, stored

#: Most labelled rows that the fit takes (chosen by a hash of the id) and preference pairs that it draws from them.
SAMPLE_ROWS = 40_000
PAIRS = 100_000
SEED = 11

FEATURES = [
    "symbols_per_word", "pipes_per_word", "shouts_per_word", "digits_per_word", "upper_words", "repeated_next", "distinct_words",
    "distinct_lines", "word_length", "log_words", "stops_per_word", "blank",
]


#: Hash bins of byte trigrams, whose weights are held smaller by a larger ridge: each says little.
BINS = 128
RIDGE, BIN_RIDGE = 1e-3, 0.3
#: Bytes of a text whose trigrams are counted at once.
BYTES_AT_ONCE = 1 << 20
NAMES = [*FEATURES, *(f"bin{k}" for k in range(BINS))]


def trigram_shares(text: str | None) -> np.ndarray:
    """The share of a text's byte trigrams, A-Z lowered, in each bin; all 0 without one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    counts = np.zeros(BINS, np.int64)
    for at in range(0, len(data) - 2, BYTES_AT_ONCE):
        some = data[at : at + BYTES_AT_ONCE + 2].astype(np.uint32)
        codes = ((some[:-2] << 16 | some[1:-1] << 8 | some[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BINS.bit_length() + 1)
        counts += np.bincount(codes, minlength=BINS)
    return counts / max(1, len(data) - 2)


def features(text: str | None) -> list[float]:
    """The features of a whole text; all shares lie in 0 to 1."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    per = lambda x: min(1.0, x / n)
    lines = [x for x in text.split("\n") if x]
    count = text.count
    return [
        per(count("#") + count("*") + count("$") + count("%") + count("&") + count("<") + count(">")), per(count("|")), per(count("!")),
        per(sum(map(count, "0123456789"))), per(sum(map(str.isupper, words))), per(sum(map(operator.eq, words, words[1:]))),
        len(set(words)) / n / max(0.05, min(1.0, 12 / math.sqrt(n))) if n > 144 else len(set(words)) / n,
        len(set(lines)) / len(lines), min(1.0, (len(text) - n) / n / 20), min(1.0, math.log1p(n) / 10),
        per(count(".") + count(",")), 0.0,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of each document (doc_id, text) in order of NAMES, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            rows = np.array([[*features(t), *trigram_shares(t)] for t in texts], np.float32).reshape(-1, len(NAMES))
            yield pd.DataFrame({carried.keys[0]: batch[carried.keys[0]], "x": list(rows)})

    carried = Carried(docs, ["doc_id"])
    schema = carried.schema() + ", x array<float>"
    return stored(docs.select(*carried.columns(), "text").mapInPandas(run, schema).select(*carried.back(), "x"), "features")


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and threshold from features x and labels y; without both labels all scores are level."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0 if len(good) else 1e-9
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0, dtype=np.float64) + 1e-6
    ridge = np.where(np.arange(x.shape[1]) < len(FEATURES), RIDGE, BIN_RIDGE)
    z, first, second = (x / scale).astype(np.float32), rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method; the ridge keeps separable data finite
        slope, bend = -ridge * w, np.diag(ridge)
        for at in range(0, pairs, 8192):
            d = z[first[at : at + 8192]].astype(np.float64) - z[second[at : at + 8192]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope = slope + d.T @ p / pairs
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    scores = np.sort(x @ w)
    k = len(bad)  # the quantile at the share of label 0, between the two scores there
    return w, float(scores[k - 1] + scores[min(k, len(scores) - 1)]) / 2


def train(found: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Fits on about sample_rows documents of labels (doc_id, quality), chosen by a hash of the id, joined with features.

    Each document counts once, however often it or its label is repeated; documents with labels that differ don't count.
    """
    labels = labels.select("doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    share = min(1.0, sample_rows / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id", "quality")
    rows = some.join(found, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("doc_id", "quality", "x")
    rows = rows.toArrow().sort_by("doc_id")  # so that reruns agree; as arrays, without an object per number
    x = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in rows.column("x").chunks)]).reshape(-1, len(NAMES))
    return fit(x, rows.column("quality").to_numpy())


def score(weights: np.ndarray, threshold: float) -> Column:
    """The chance that a document is preferred to one at the threshold."""
    products = F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x.cast("double") * w)
    total = F.aggregate(products, F.lit(-float(threshold)), lambda a, x: a + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -total))))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Scores docs (doc_id, text) after learning from labels (doc_id, quality), which may cover some of them.

    Returns doc_id, score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts are scored as blank. Repeated rows
    are scored each; null labels and labels of unknown documents don't count; with one label only, all get it; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    found = featured(docs)
    weights, threshold = train(found, labels, sample_rows)
    out = found.select("doc_id", score(weights, threshold).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
