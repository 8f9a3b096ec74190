import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgraph.llm import hmm
from trailgraph.llm.common import held_out


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "\n"]


def base(trained, text):
    """n_tokens, n_known, train_tokens and base_score by plain counting."""
    c = Counter(w for t in trained for w in tokens(t))
    n, v, own = sum(c.values()), len(c), tokens(text)
    return len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)


def probability(known, chain, counts, text):
    """The model's likelihood of a text by the unscaled recursion, a word at a time, with counts taken anew."""
    logs, state = 0.0, None
    for w in tokens(text):
        word = w.encode()
        k = known.head.get(word, -1)
        c = int(known.head_class[k]) if k >= 0 else known.own + hmm.ending(word)
        emit = chain.emit[c] * (1.0 if c < known.own else (counts[w] + 0.5) / (known.class_n[c] + 0.5 * (known.class_v[c] + 1)))
        state = (chain.start if state is None else state @ chain.move) * emit
        total = state.sum()  # only so that long texts don't vanish
        logs, state = logs + math.log10(total), state / total
    return logs


def check(trained, scored, **kw):
    known, chain = hmm.fit(trained, **kw)
    texts = [r["text"] for r in trained.select("text").collect()]
    counts = Counter(w for t in texts for w in tokens(t))
    out = hmm.score(scored, known, chain, ["doc_id", "text"]).collect()
    assert len(out) == scored.count()
    for r in out:
        n, n_known, total, score = base(texts, r["text"]) if len(r["text"] or "") < 5000 else (len(tokens(r["text"])), r["n_known"], known.total, r["base_score"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, n_known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] == pytest.approx(probability(known, chain, counts, r["text"]), rel=1e-9)
    return known, chain, out


def small(docs, many=40):
    return docs.orderBy("doc_id").limit(many)


def test_scores_by_plain_recursion(docs, monkeypatch):
    """Stretches of few tokens, so that texts are multiplied together from many."""
    monkeypatch.setattr(hmm, "SCORED_STRETCH", 50)
    part = small(docs).select("doc_id", "text")
    check(part.where(~held_out(F.col("doc_id"), 5, 1)), part, rounds=2)


def test_few_common_words(docs, monkeypatch):
    """Most words are in shared classes, and most counts are joined."""
    monkeypatch.setattr(hmm, "OWN_WORDS", 30)
    monkeypatch.setattr(hmm, "HEAD_WORDS", 100)
    part = small(docs).select("doc_id", "text")
    known, _, _ = check(part.where(~held_out(F.col("doc_id"), 5, 1)), part, rounds=2)
    assert known.own <= 30 and known.own < len(known.head) <= 100 < known.distinct


def test_odd(spark, odd, none):
    known, chain, out = check(odd.where("doc_id IS NULL OR doc_id <> 7"), odd.select("doc_id", "text"), rounds=1, states=3)
    assert hmm.score(none, known, chain, ["doc_id"]).count() == 0
    every = hmm.score(odd, known, chain, odd.columns)
    assert every.columns == [*odd.drop("score").columns, "n_tokens", "n_known", "train_tokens", "base_score", "score"] and every.count() == odd.count()
    nothing, chain = hmm.fit(none, states=2)
    r = hmm.score(odd.where("doc_id = 9"), nothing, chain, ["doc_id"]).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0)


def test_expected_counts_by_all_paths():
    """Baum-Welch on short sequences against sums over every sequence of states."""
    from itertools import product

    rng = np.random.default_rng(4)
    chain = hmm.Chain(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    texts = [np.array(x) for x in ([0, 1, 2, 1], [2], [1, 1, 0])]
    want = {"emit": np.zeros((3, 2)), "move": np.zeros((2, 2)), "start": np.zeros(2), "log": 0.0}
    for x in texts:
        ways = {}
        for s in product(range(2), repeat=len(x)):
            ways[s] = chain.start[s[0]] * math.prod(chain.move[a, b] for a, b in zip(s, s[1:], strict=False)) * math.prod(chain.emit[c, k] for c, k in zip(x, s, strict=True))
        total = sum(ways.values())
        want["log"] += math.log(total)
        for s, p in ways.items():
            want["start"][s[0]] += p / total
            for c, k in zip(x, s, strict=True):
                want["emit"][c, k] += p / total
            for a, b in zip(s, s[1:], strict=False):
                want["move"][a, b] += p / total
    lengths = np.array([len(x) for x in texts])
    start, length, begins = hmm.stretches(lengths, 256)
    out = {"emit": np.zeros((3, 2)), "move": np.zeros((2, 2)), "start": np.zeros(2), "log": np.zeros(1)}
    for some in hmm.together(length):
        hmm.expected(chain, np.concatenate(texts), start[some], length[some], begins[some], chain.start, out)
    out["move"] *= chain.move
    for name in want:
        assert out[name] == pytest.approx(want[name], rel=1e-4)


def test_rounds_raise_the_likelihood_and_beat_single_words(docs, monkeypatch):
    seen = []
    plain = hmm.one_round
    monkeypatch.setattr(hmm, "one_round", lambda *a: seen.append(plain(*a)) or seen[-1])
    held = held_out(F.col("doc_id"), 5, 1)
    part = docs.select("doc_id", "text")
    known, chain = hmm.fit(part.where(~held), rounds=4)
    logs = [r["log"][0] for r in seen]
    assert logs == sorted(logs)
    r = hmm.score(part, known, chain, ["doc_id"]).where(held).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.02 * r[2]  # on 200 documents; more with more


def test_chances_add_up(docs):
    """All words and unknown ones of every class, from a state, have chance 1."""
    known, chain = hmm.fit(small(docs).select("text"), rounds=1)
    assert chain.emit.sum(axis=0) == pytest.approx(np.ones(hmm.STATES)) and chain.move.sum(axis=1) == pytest.approx(np.ones(hmm.STATES))
    mass = (known.class_n + 0.5 * known.class_v + 0.5) / (known.class_n + 0.5 * (known.class_v + 1))
    assert mass[known.own :] == pytest.approx(np.ones(hmm.ENDINGS))
