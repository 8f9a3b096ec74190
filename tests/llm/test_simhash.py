import re

import numpy as np
import pytest
import xxhash

from corpus_pipeline import near_duplicates
from trailgraph.llm import simhash
from trailgraph.llm.components import connected, forest


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode("utf-8").lower())
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    counts = np.zeros(64, int)
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        counts += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(parts))


def brute(rows, distance=2):
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if (f ^ g).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(df, **kw):
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]
    prints = [(i, plain(t)) for i, t in texts]
    want = brute(prints)
    out = simhash.similar(df, **kw).collect()
    assert len(out) == df.count()
    for r in out:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["f0"] % (1 << 64) in {f for i, f in prints if i == r["doc_id"]}


def test_documents(docs):
    check(docs)
    check(docs, tile=2)


def test_odd(odd, none):
    check(odd)
    assert simhash.similar(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 7, 8, 9, None]


def test_pairs_at_every_distance(spark):
    """Fingerprints that differ in bits of any segments are linked up to the distance, also in buckets over a tile."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 64, (6, 2))]
    for parts, count in ((1, 3), (1, 4)):
        a = np.array(prints, np.uint64).reshape(-1, 1)
        i, j = np.triu_indices(len(a), 1)
        near = simhash.linked(a[i], a[j], simhash.segments(parts, count), 2, count)
        assert (near == (np.bitwise_count(a[i] ^ a[j])[:, 0] <= 2)).all()


def test_near_copies_of_the_pipeline(spark):
    """Groups of similarity 0.8 or more of five-word shingles are found; others stay apart."""
    rng = np.random.default_rng(2)
    rows = []
    for group in range(40):
        words = [f"g{group}w{x}" for x in rng.integers(0, 400, 300)]
        rows.append(" ".join(words))
        copy = list(words)
        for at in rng.choice(300, 4, replace=False):
            copy[at] = "other"
        rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id BIGINT, text STRING")
    out = simhash.similar(docs, shingle=5, parts=8, segment_count=32, distance=80, chain=4).collect()
    groups = {r["doc_id"]: r["component_id"] for r in out}
    assert sum(groups[2 * g + 1] == 2 * g for g in range(40)) >= 39
    assert all(groups[2 * g] == 2 * g for g in range(40))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    root = forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 600)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges + [(None, 3), (4, 4)], "a BIGINT, b BIGINT")).collect()}
    assert all(got.get(v, v) == root[v] for v in range(600)) and all(v != c for v, c in got.items())
    assert connected(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def overlapping(rng, name, size, jaccard):
    """Two texts of `size` different five-word shingles each, and their similarity, the least that is at least `jaccard`."""
    shared = int(np.ceil(2 * size * jaccard / (1 + jaccard)))
    words = [f"{name}w{k}x{rng.integers(1 << 30)}" for k in range(2 * size - shared + 4)]
    return " ".join(words[: size + 4]), " ".join(words[size - shared :]), shared / (2 * size - shared)


def shingle_sets(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_pairs_just_over_and_under_the_similarity(spark, odd):
    """Of pairs at 0.80 to 0.82 the pipeline's stage links nearly all; none under 0.8 is linked, also in buckets over a tile."""
    rng = np.random.default_rng(5)
    texts, over = [], []
    for k in range(200):
        a, b, found = overlapping(rng, f"p{k}", (60, 300)[k % 2], (0.8, 0.81, 0.75, 0.785)[k // 2 % 4])
        x, y = shingle_sets(a), shingle_sets(b)
        assert len(x & y) / len(x | y) == found
        texts += [a, b]
        over.append(found >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    kept = {r["doc_id"] for r in near_duplicates(spark, df, "").select("doc_id").collect()}
    together = [2 * k + 1 not in kept for k in range(200)]
    assert kept >= {2 * k for k in range(200)} and not any(t and not o for t, o in zip(together, over, strict=True))
    assert sum(together) >= 0.97 * sum(over) > 0
    out = simhash.alike(df.where("doc_id < 32"), tile=2).collect()
    assert sum(r["doc_id"] != r["component_id"] for r in out) == sum(together[:16])


def test_alike_is_of_sets_of_shingles(spark, odd, none):
    """One shingle that fills a text doesn't make it like another that it fills too; chains of links join groups."""
    fill = "a b c d e " * 40
    base = [f"w{k}" for k in range(104)]
    chain = [" ".join(base[4 * k :] + [f"n{x}" for x in range(4 * k)]) for k in range(6)]
    rows = [(0, fill + " ".join(f"u{k}" for k in range(60))), (1, fill + " ".join(f"v{k}" for k in range(60))), (2, None), (3, "")]
    rows += [(10 + k, t) for k, t in enumerate(chain)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.alike(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 2, **{10 + k: 10 for k in range(6)}}
    assert simhash.alike(none).count() == 0 and simhash.alike(odd).count() == odd.count()
    kept = simhash.one_of_each(odd, simhash.alike)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 7, 8, 9, None]


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_documents_without_id_are_kept_once(spark, kind, monkeypatch):
    """Alone they stay; with a group's document that has an id they go; of one text without any id one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [("5", a), (None, a), (None, a + " more"), (None, b), (None, b), (None, c), ("7", c[:-4] + "zz"), ("9", "x"), ("9", "y z"), ("9", "x"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id STRING, text STRING").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    for most in (simhash.BROADCAST_KEYS, 0):
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", most)
        kept = simhash.one_of_each(docs, simhash.alike)
        got = sorted(((str(r["doc_id"]), (r["text"] or "")[:3]) for r in kept.collect()))
        assert got == [("5", "a0 "), ("7", "c0 "), ("9", "x"), ("None", ""), ("None", "b0 ")]


def test_sets_are_compared_exactly():
    rng = np.random.default_rng(11)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 9))) for _ in range(rng.integers(1, 9))]
        before = np.arange(len(sets))
        if len(sets) > 2:
            before[2] = before[1]
        got = simhash.similar_sets(sets, before.copy(), 0.5)
        label = before.copy()
        for _ in sets:
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    if len(x) and len(y) and both >= 0.5 * (len(x) + len(y) - both) or before[i] == before[j]:
                        label[i] = label[j] = min(label[i], label[j])
        assert ((got[:, None] == got[None]) == (label[:, None] == label[None])).all()


@pytest.mark.parametrize("sets_tile", [256, 4])
def test_large_groups_of_near_copies_around_one(spark, sets_tile):
    """Copies that are like their original only, whatever its id, become one group, without pairs of copies; a chain too."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(300)]

    def copy(spoilt):
        own = words.copy()
        for at in rng.choice(60, spoilt, replace=False):
            own[5 * at] = f"n{rng.integers(1 << 40)}"
        return " ".join(own)

    rows = [(k, copy(6)) for k in range(60)] + [(60, " ".join(words))] + [(100 + k, f"other text number {k} of {rng.integers(1 << 40)} and on") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    sets = {i: shingle_sets(t) for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert sum(like(60, k) for k in range(60)) == 60 and not all(like(0, k) for k in range(60))
    out = {r["doc_id"]: r["component_id"] for r in simhash.alike(df, sets_tile=sets_tile).collect()}
    assert out == {**{k: 0 for k in range(61)}, **{100 + k: 100 + k for k in range(20)}}


def test_one_id_with_texts_that_differ(spark):
    """Rows of one id are grouped each by its own fingerprint, whether one of them equals another document's or is a bit off."""
    words = [f"word{i}" for i in range(400)]
    one, near = " ".join(words), " ".join([*words[:-1], "other"])
    far = " ".join(f"else{i}" for i in range(400))
    bits = {t: r["f0"] for t, r in zip((one, near), simhash.similar(spark.createDataFrame([(1, one), (2, near)], "doc_id LONG, text STRING")).orderBy("doc_id").collect(), strict=True)}
    assert 0 < bin((bits[one] ^ bits[near]) & (1 << 64) - 1).count("1") <= 2
    for linked in (one, near):
        df = spark.createDataFrame([(1, one), (5, linked), (5, far), (7, far)], "doc_id LONG, text STRING")
        got = sorted((r["doc_id"], r["f0"] == bits[linked] or r["f0"] == bits[one], r["component_id"]) for r in simhash.similar(df).collect())
        assert got == [(1, True, 1), (5, False, 5), (5, True, 1), (7, False, 5)]
