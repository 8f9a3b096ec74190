import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailgraph.llm import packing
from trailgraph.llm.queries import tokenizer_json


@pytest.fixture(scope="module")
def known():
    return packing.word_codes(tokenizer_json())


def test_words_encode_as_texts_do(known):
    rng = random.Random(3)
    letters = [*"aAbBéÉÑñßÄ .,.,!'0 9\n\t　İΣσжЖ中é한한ÅÅ<|>#&s't", "<|endoftext|>", "é ", "'s ", "ing. "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [None, ""]
    ids, edges = packing.encoded(pa.array(texts), known)
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == known.tokenizer.encode(t or "", add_special_tokens=False).ids


def brute_best_fit(lengths, capacity):
    """Best-fit decreasing, a window at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return Counter(left)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.choice([1, 2, capacity // 3]) for _ in range(rng.randint(1, 400))]
    counts = Counter(lengths)
    windows = {}
    for length, first, end, each, window, offset in packing.best_fit_plan(counts, capacity):
        for k in range(end - first):
            windows.setdefault(window + k // each, []).append((offset + k % each * length, length))
    assert Counter(n for w in windows.values() for _, n in w) == counts and sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    left = Counter(capacity - sum(n for _, n in w) for w in windows.values())
    assert left == brute_best_fit(lengths, capacity)


def check(df, known, window):
    out = packing.pack(df, tokenizer_json(), window=window).collect()
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(known.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    total = sum(len(x) for v in texts.values() for x in v)
    assert sum(r["length"] for r in out) == total == sum(len(r["ids"]) for r in out)
    windows = {}
    for r in out:
        assert any(len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]] == r["ids"] for x in texts[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return total / (window * len(windows))


def test_documents(docs, known):
    assert check(docs, known, 4096) > 0.9
    assert check(docs, known, 100) > 0.97


def test_odd(odd, none, known, monkeypatch):
    check(odd, known, 64)
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 2)
    check(odd, known, 64)
    assert packing.pack(none, tokenizer_json()).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.word_codes(tokenizer_json(public_tokenizers.path("byte_bpe_50k.json")))
