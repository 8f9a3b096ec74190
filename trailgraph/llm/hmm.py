"""A hidden Markov language model: Baum-Welch over all training texts, scores by the scaled forward recursion.

Every token is of a class: the most common words are one each, all others share classes by their ending. States emit classes,
a class emits its words in proportion to their counts, so the counts of the whole corpus decide the score of every word:
P(w | state) = P(class | state) * (c + 0.5) / (n + 0.5 (v + 1)) with the class's n tokens and v words. What is known of the words
themselves stays a table; the model in memory has a fixed size. An end token closes each text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import ship, stored

#: Hidden states, and rounds of Baum-Welch. Rounds end before where the likelihood of a token gains less than GAIN (natural logarithms).
STATES, ROUNDS, GAIN = 8, 5, 2e-3

#: Most words that are a class of their own, classes of other words by ending, and bytes of an ending.
OWN_WORDS, ENDINGS, ENDING_BYTES = 16_384, 4096, 4

#: Most words whose counts travel to every task; the counts of others are joined.
HEAD_WORDS = 200_000

#: Tokens of a stretch in training and in scoring, where one after the first is run from each state, and tokens taken at once.
STRETCH, SCORED_STRETCH, TOKENS_AT_ONCE = 256, 1024, 1 << 17

#: Texts that are scored together.
TEXTS_AT_ONCE = 512

#: Different words that a task holds before it gives rows.
WORDS_HELD = 500_000

#: The end token: no word has a line feed.
END = b"\n"

#: How states differ at first: the deviation of the logarithms of their emissions, and the chance that a state stays.
SPREAD, STAY = 1.0, 0.95
SEED = 1


def words(text: bytes) -> list[bytes]:
    """The words of a text with A-Z in lower case, and the end token."""
    return [*text.lower().split(), END]


def ending(word: bytes) -> int:
    """The class of a word by its ending, from 0."""
    import xxhash

    return xxhash.xxh32_intdigest(word[-ENDING_BYTES:]) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n of all texts (text); the end token is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                held.update(words(text.as_py()))
                if len(held) > WORDS_HELD:
                    yield given(held)
                    held = Counter()
        if held:
            yield given(held)

    def given(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def level(n: Column) -> Column:
    """Eight levels an octave of a count."""
    return F.floor(F.log2(n) * 8).cast("int")


def most_common(counts: DataFrame, most: int) -> int:
    """The least level whose words, with those above, are at most `most`: collects a row per level."""
    many = counts.groupBy(level(F.col("n")).alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
    fits = [r["level"] for r, upto in zip(many, accumulate(r["k"] for r in many), strict=True) if upto <= most]
    return min(fits, default=1 << 30)


@dataclass
class Words:
    """What is known of words: `counts` (word, n) of all, and in arrays the common ones and the classes.

    head numbers the common words; head_n and head_class are by that number. Classes are the own words, in order of head, then
    the endings; class_n and class_v are the tokens and words of an ending, 1 and 0 for an own word's class.
    """

    counts: DataFrame
    total: int
    distinct: int
    head: dict[bytes, int]
    head_n: np.ndarray
    head_class: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray

    @property
    def own(self) -> int:
        return len(self.class_n) - ENDINGS

    def log_base(self) -> float:
        """The logarithm of what the base model divides by."""
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def class_share(self) -> np.ndarray:
        """How likely each class is by counts alone; none is impossible."""
        own = np.zeros(self.own)
        mine = self.head_class < self.own
        own[self.head_class[mine]] = self.head_n[mine]
        share = np.concatenate([own, self.class_n[self.own :] + 0.5])
        return share / share.sum()


def learn_words(texts: DataFrame) -> Words:
    """The counts of the texts (text, without nulls), written once, with the arrays that follow from them."""
    counts = stored(word_counts(texts), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least_own, least_head = most_common(counts, OWN_WORDS), most_common(counts, HEAD_WORDS)
    common = counts.where(level(F.col("n")) >= min(least_own, least_head)).withColumn("own", level(F.col("n")) >= least_own).toArrow()
    rows = sorted(zip(common["word"].to_pylist(), common["n"].to_pylist(), common["own"].to_pylist(), strict=True))
    own = sum(r[2] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            at = np.array([ending(w) for w in batch.column("word").to_pylist()], np.int64)
            np.add.at(n, at, batch.column("n").to_numpy())
            np.add.at(v, at, 1)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_pydict({"class": pa.array(some, pa.int32()), "n": n[some], "v": v[some]})

    rare = counts.where(level(F.col("n")) < least_own).select("word", "n").mapInArrow(run, "class int, n long, v long")
    rare = rare.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    class_n, class_v = np.ones(own + ENDINGS), np.zeros(own + ENDINGS)
    class_n[own:] = 0
    at = own + rare["class"].to_numpy()
    class_n[at], class_v[at] = rare["n"].to_numpy(), rare["v"].to_numpy()
    mine = iter(range(own))
    head_class = np.array([next(mine) if r[2] else own + ending(r[0]) for r in rows], np.int64)
    return Words(counts, total, distinct, {r[0]: k for k, r in enumerate(rows)}, np.array([r[1] for r in rows], np.int64), head_class, class_n, class_v)


@dataclass
class Chain:
    """start (states), move (from, to) and emit (class, state): rows of start and move and columns of emit add up to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def stretches(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other cut into stretches of at most `size` tokens: where each starts, how long it is, and whether it begins a text."""
    many = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return (np.cumsum(lengths) - lengths)[text] + place * size, np.minimum(size, lengths[text] - place * size), place == 0


def together(length: np.ndarray) -> Iterator[np.ndarray]:
    """The stretches in groups of similar length, each the longest first, whose longest fills TOKENS_AT_ONCE."""
    order, at = np.argsort(-length, kind="stable"), 0
    while at < len(order):
        size = max(1, TOKENS_AT_ONCE // int(length[order[at]]))
        yield order[at : at + size]
        at += min(size, len(order) - at)


def forward(chain: Chain, ids: np.ndarray, start: np.ndarray, length: np.ndarray, prior: np.ndarray, kind: type = np.float64, keep: bool = False) -> tuple:
    """The scaled forward recursion over stretches, the longest first, from priors (state, stretch) of their first state.

    Returns the last state vectors (state, stretch; they add up to 1) and the natural logarithms of the likelihoods; with keep
    also the vectors and scales of all places, the emissions, and the classes (place, stretch), 0 past a stretch's end.
    """
    longest, states = int(length[0]), len(chain.start)
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # stretches longer than each place
    place = np.arange(longest)[:, None]
    classes = np.where(place < length, ids[np.minimum(start + place, len(ids) - 1)], 0)
    emit, step = np.ascontiguousarray(chain.emit.T, kind)[:, classes], np.ascontiguousarray(chain.move.T, kind)
    kept, scales = np.zeros((longest if keep else 0, states, len(start)), kind), np.ones((longest, len(start)), kind)
    last = np.array(prior, kind)
    for t, many in enumerate(live):
        now = (last[:, :many] if t == 0 else step @ last[:, :many]) * emit[:, t, :many]
        scale = now.sum(axis=0)
        now /= scale
        last[:, :many], scales[t, :many] = now, scale
        if keep:
            kept[t, :, :many] = now
    logs = np.log(scales, dtype=np.float64).sum(axis=0)
    return (last, logs, kept, scales, emit, classes, live) if keep else (last, logs)


def expected(chain: Chain, ids: np.ndarray, start: np.ndarray, length: np.ndarray, begins: np.ndarray, rest: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Adds the expected counts of stretches to out; a stretch that doesn't begin a text starts from the states' shares, rest.

    Single precision serves: vectors are scaled at every place, and sums over stretches are double.
    """
    prior = np.where(begins, chain.start[:, None], rest[:, None])
    _, logs, kept, scales, emit, classes, live = forward(chain, ids, start, length, prior, np.float32, keep=True)
    out["log"] += logs.sum()
    back, step = np.ones((len(chain.start), len(start)), np.float32), chain.move.astype(np.float32)
    shares = np.zeros(emit.shape, np.float32)
    for t in range(len(live) - 1, -1, -1):
        many = live[t]
        share = kept[t, :, :many] * back[:, :many]
        share /= share.sum(axis=0)
        shares[:, t, :many] = share
        if t:
            ahead = back[:, :many] * emit[:, t, :many] / scales[t, :many]
            out["move"] += kept[t - 1, :, :many] @ ahead.T
            back[:, :many] = step @ ahead
    out["start"] += shares[:, 0, begins].sum(axis=1)
    flat = classes.ravel()
    for s, own in enumerate(shares):
        out["emit"][:, s] += np.bincount(flat, own.ravel(), len(chain.emit))


def encoded(texts: DataFrame, known: Words) -> DataFrame:
    """The classes of each text's tokens as bytes (ids), two a token."""
    shared = texts.sparkSession.sparkContext.broadcast((known.head, known.head_class, known.own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_class, own = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()):
                ids, _ = classes(words(text.as_py()), head, head_class, own)
                out.append(ids.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_pydict({"ids": pa.array(out, pa.binary())})

    return texts.mapInArrow(run, "ids binary")


def classes(found: list[bytes], head: dict[bytes, int], head_class: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token, and its number among the common words or -1."""
    at = np.fromiter((head.get(w, -1) for w in found), np.int64, len(found))
    ids = head_class[at] if len(head_class) else np.empty(len(at), np.int64)
    for k in np.flatnonzero(at < 0).tolist():
        ids[k] = own + ending(found[k])
    return ids, at


def fit(texts: DataFrame, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> tuple[Words, Chain]:
    """The model of all texts (text). Null texts count as empty; no texts give states that don't differ.

    The classes of the tokens are written once; a round is one pass over them, whose sums are a row per class and state. Training
    reads a text in stretches; only the first counts as its beginning. Equal up to rounding however the rows are dealt.
    """
    ship(texts.sparkSession)
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    known = learn_words(texts)
    share, rng = known.class_share(), np.random.default_rng(seed)
    emit = share[:, None] * np.exp(SPREAD * rng.normal(size=(len(share), states)))
    chain = Chain(np.full(states, 1 / states), np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states), emit / emit.sum(axis=0))
    if not known.total:
        return known, chain
    ids, rest, before = stored(encoded(texts, known), "classes"), chain.start, None
    for _ in range(rounds):
        found = one_round(ids, chain, rest)
        chain, rest = raised(found, share)
        now = found["log"][0] / known.total
        if before is not None and now - before < GAIN:
            break
        before = now
    return known, chain


def raised(found: dict[str, np.ndarray], share: np.ndarray) -> tuple[Chain, np.ndarray]:
    """The next chain from expected counts; a state's emissions count the classes' shares as one token, so none is impossible."""
    emit = found["emit"] + share[:, None]
    move, start = found["move"] + 0.1, found["start"] + 0.1
    rest = found["emit"].sum(axis=0) + 1e-3
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), rest / rest.sum()


def one_round(ids: DataFrame, chain: Chain, rest: np.ndarray) -> dict[str, np.ndarray]:
    """The expected counts of all texts: emit (class, state), move, start, and log, the likelihood."""
    states, many = len(chain.start), len(chain.emit)
    shared = ids.sparkSession.sparkContext.broadcast((chain, rest))
    columns = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, rest = shared.value
        out = {"emit": np.zeros((many, states)), "move": np.zeros((states, states)), "start": np.zeros(states), "log": np.zeros(1)}
        for batch in batches:
            if not len(batch):
                continue
            texts = [np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column("ids")]
            lengths = np.array([len(x) for x in texts], np.int64)
            every = np.concatenate(texts).astype(np.int64)
            start, length, begins = stretches(lengths, STRETCH)
            for some in together(length):
                expected(chain, every, start[some], length[some], begins[some], rest, out)
        out["move"] *= chain.move
        table = np.concatenate([out["emit"], out["move"], out["start"][None], np.full((1, states), out["log"])])
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int32())} | {c: table[rows, k] for k, c in enumerate(columns)})

    summed = ids.mapInArrow(run, ", ".join(["row int", *[f"{c} double" for c in columns]])).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    shared.unpersist()
    table = np.zeros((many + states + 2, states))
    table[summed["row"].to_numpy()] = np.stack([summed[c].to_numpy() for c in columns], axis=1)
    return {"emit": table[:many], "move": table[many:-2], "start": table[-2], "log": table[-1]}


def likelihoods(chain: Chain, texts: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each text's likelihood (classes), exact for any length.

    A stretch after the first is run from every state, which gives the matrix that it stands for; a text's are multiplied in order.
    """
    states = len(chain.start)
    lengths = np.array([len(x) for x in texts], np.int64)
    every = np.concatenate(texts)
    start, length, begins = stretches(lengths, SCORED_STRETCH)
    runs = np.where(begins, 1, states)
    which = np.repeat(np.arange(len(start)), runs)
    entry = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    prior = np.where(begins[which, None], chain.start, chain.move[entry])
    last, logs = np.empty((len(which), states)), np.empty(len(which))
    for some in together(length[which]):
        state, logs[some] = forward(chain, every, start[which[some]], length[which[some]], prior[some].T)
        last[some] = state.T
    out, at = np.zeros(len(texts)), 0
    for k, many in enumerate((-(-lengths // SCORED_STRETCH)).tolist()):
        state, log = last[at], logs[at]
        at += 1
        for _ in range(many - 1):
            own = logs[at : at + states]
            top = own.max()
            state = (state * np.exp(own - top)) @ last[at : at + states]
            scale = state.sum()
            state, log, at = state / scale, log + top + np.log(scale), at + states
        out[k] = log
    return out


def score(docs: DataFrame, known: Words, chain: Chain, carry: list[str]) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (logarithms to base 10) to the columns `carry` of docs (text and those).

    n_known are the tokens met in training. A null text is empty: the end token alone. Repeated rows are scored each, an empty
    table gives no rows, a carried column of a new name gives way. Texts are scored whole; beside a text a task holds a state
    vector per stretch and state. Counts of common words are at hand in each task, those of the others are joined: a word that
    training doesn't hold and that fills the scored texts is a hot key, which adaptive execution splits.
    """
    ship(docs.sparkSession)
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    divisor = np.log10(known.class_n + 0.5 * (known.class_v + 1))
    divisor[: known.own] = 0.0
    shared = docs.sparkSession.sparkContext.broadcast((known.head, known.head_n, known.head_class, known.own, divisor, known.log_base(), chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_n, head_class, own, divisor, base, chain = shared.value
        logs = np.log10(head_n + 0.5)
        for batch in batches:
            for k in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.slice(k, TEXTS_AT_ONCE)
                made, texts = [], []
                for text in some.column("__text").cast(pa.binary()):
                    found = words(text.as_py())
                    ids, at = classes(found, head, head_class, own)
                    texts.append(ids)
                    common, shared_class = at >= 0, ids >= own
                    met = logs[at[common]]
                    tail = Counter(found[j] for j in np.flatnonzero(~common).tolist())
                    made.append((len(found), int(common.sum()), float(met.sum() - base * len(found)), float(met[shared_class[common]].sum() - divisor[ids].sum()), list(tail.items())))
                chains = likelihoods(chain, texts) / np.log(10)
                n, n_known, base_score, inside, tails = zip(*made, strict=True)
                tails = pa.array([[{"word": w, "n": c} for w, c in t] for t in tails], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
                columns = {"n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base_score), "score": pa.array(np.array(inside) + chains), "tail": tails}
                kept = some.drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns.values()], names=[*kept.schema.names, *columns])

    carried = F.struct(*[F.col(f"`{c}`") for c in carry if c not in new])
    rows = docs.select(F.monotonically_increasing_id().alias("key"), carried.alias("row"), F.coalesce("text", F.lit("")).alias("__text"))
    schema = f"key long, row {rows.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, n: bigint>>"
    scored = stored(rows.mapInArrow(run, schema), "scored")
    tail = scored.select("key", F.explode("tail").alias("t")).select("key", "t.word", F.col("t.n").alias("k"))
    tail = tail.join(known.counts, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    tail = tail.groupBy("key").agg(F.sum(F.col("k") * log).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("met"))
    both = scored.drop("tail").join(tail, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select("row.*", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
