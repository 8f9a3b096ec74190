import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from trailgraph.llm import substrings


def brute(texts):
    """For (key, bytes): what remains, removed bytes and runs."""
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    out = []
    for key, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((key, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(df):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
    out = substrings.remove(df, ["doc_id"]).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out], key=repr)
    assert got == brute(texts)


@pytest.mark.parametrize("bucket", [512, 2])
def test_documents(docs, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    check(docs)


@pytest.mark.parametrize("bucket", [512, 2])
def test_planted(spark, monkeypatch, bucket):
    """Passages of any length around 200, many times, in one text twice, overlapping themselves, at ends, and with one byte changed."""
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (150, 190, 195, 199, 200, 201, 260, 900)]
    texts = [noise(rng.randint(0, 300)) + rng.choice(passages) + noise(rng.randint(0, 300)) for _ in range(60)]
    texts += [passages[7] + passages[7], "ab" * 300, "z" * 500, "z" * 199, noise(350)]
    texts += [t[:150] + "#" + t[151:] for t in texts[:20]] + [None, "", noise(199)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    check(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))


def test_odd(odd, none):
    check(odd)
    assert substrings.remove(none, ["doc_id"]).count() == 0


def test_anchors_own_every_window_once(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 101, 5000, dtype=np.uint8)) + b"q" * 700 + b"xyz" * 200
    whole = substrings.anchors(text)
    monkeypatch.setattr(substrings, "SCAN", 700)
    parts = substrings.anchors(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    _, place, low, high = whole
    assert low[0] == 0 and high[-1] == len(text) - 200 and (low[1:] == high[:-1] + 1).all() and (place >= high).all() and (place - low <= 136).all()
    assert len(substrings.anchors(b"a" * 199)[0]) == 0


def test_prefix_intervals():
    texts = sorted([b"abc", b"abd", b"ab", b"b", b"abcx"])
    assert set(substrings.prefix_intervals(texts)) == {(3, 1, 3), (2, 0, 4)}


def maximal(bucket, length):
    """All (left, right, members) whose members share that much on both sides of the anchor and not a byte more on either."""
    out = set()
    for left in {substrings.common(a[0], b[0]) for a, b in combinations(bucket, 2)}:
        for right in {substrings.common(a[1], b[1]) for a, b in combinations(bucket, 2)}:
            groups = defaultdict(list)
            for i, (before, after) in enumerate(bucket):
                if len(before) >= left and len(after) >= right:
                    groups[before[:left], after[:right]].append(i)
            for own in groups.values():
                shared = [min(substrings.common(bucket[a][k], bucket[b][k]) for a, b in combinations(own, 2)) for k in (0, 1)] if len(own) > 1 else []
                if left + right >= length and shared == [left, right]:
                    out.add((left, right, tuple(own)))
    return out


def test_groups_are_all_maximal_repeats():
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(0, n))).encode()
    for _ in range(400):
        bucket = [(some(6), b"x" + some(6)) for _ in range(rng.randint(2, 9))]
        for length in (1, 4, 7):
            got = [(left, right, tuple(sorted(own))) for left, right, own in substrings.repeat_groups(bucket, length)]
            assert len(got) == len(set(got)) and set(got) == maximal(bucket, length)
