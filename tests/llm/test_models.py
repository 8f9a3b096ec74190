import numpy as np
import pytest

from trailgraph.llm import langid, ranking
from trailgraph.llm.common import held_out


def test_ranking_on_held_out_documents(spark, docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = ranking.classify(docs, labels.where(~held_out(labels.doc_id, 3, 1))).join(labels, "doc_id").where(held_out(labels.doc_id, 3, 1)).toPandas()
    assert len(out) > 80 and (out["predicted"] == out["quality"]).mean() > 0.95
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and out.score.between(0, 1).all()


def test_ranking_learns_pairs():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.1 * rng.normal(size=400) > 0.5).astype(int)
    w, t = ranking.fit(x, y)
    assert ((x @ w >= t) == y).mean() > 0.95 and w[0] > 0 > w[1]


def test_ranking_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (4, None), (99, 0)], "doc_id BIGINT, quality INT")
    out = ranking.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert ranking.classify(none, labels).count() == 0
    for quality in (0, 1):
        one = labels.where(f"quality = {quality} OR quality IS NULL")
        assert {r["predicted"] for r in ranking.classify(odd, one).collect()} == {quality}


def test_scores_match_plain_arithmetic(spark, docs):
    """The score of each document is the logistic function of its features' weighted sum over the threshold."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    weights, threshold = ranking.train(ranking.featured(docs), labels)
    got = {r["doc_id"]: r["score"] for r in ranking.classify(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = np.array([*ranking.features(r["text"]), *ranking.trigram_shares(r["text"])], np.float32).astype(float)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(np.clip(threshold - x @ weights, -700, 700))), abs=1e-9)


def test_trigrams_teach_what_no_count_shows():
    """Two kinds of texts that agree in all counts of form are told apart by their letters."""
    rng = np.random.default_rng(9)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    texts, y = [text("abcde" if k % 2 else "fghij") for k in range(200)], np.arange(200) % 2
    x = np.array([[*ranking.features(t), *ranking.trigram_shares(t)] for t in texts])
    w, t = ranking.fit(x[:120], y[:120])
    assert ((x[120:] @ w >= t) == y[120:]).mean() > 0.95
    assert ranking.trigram_shares(None).sum() == 0 and ranking.trigram_shares("abC" * 9).sum() == pytest.approx(1)


def test_repeated_labels_count_once(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    again = labels.union(labels).union(labels.limit(1).selectExpr("doc_id", *[f"1 - {c} AS {c}" if c == "quality" else c for c in labels.columns[1:]]))
    found = ranking.featured(docs)
    one = labels.join(labels.limit(1).select("doc_id"), "doc_id", "left_anti")
    assert ranking.train(found, again)[1] == ranking.train(found.union(found), one)[1]


def brute_language(text, learned):
    """The language of greatest cosine, each trigram of letters bound alone."""
    total = np.zeros(langid.DIMENSIONS)
    low, edge = f" {text.lower()} ", [0]
    for c in low:
        slot = 1 + ord(c) % (langid.SLOTS - 1) if c.isalpha() else 0
        if slot or edge[-1]:
            edge.append(slot)
    base = np.random.default_rng(langid.SEED).integers(0, 2, (langid.SLOTS, langid.DIMENSIONS)) * 2.0 - 1
    for a, b, c in zip(edge, edge[1:], edge[2:], strict=False):
        total += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    if not total.any():
        return "und", 0.0
    cosines = {k: total @ v / np.linalg.norm(total) for k, v in learned.items()}
    best = max(sorted(cosines), key=cosines.get)
    return best, max(0.0, cosines[best])


def test_languages_match_plain_binding(odd, docs):
    learned = langid.prototypes(docs)
    rows = docs.limit(25).union(odd.select(docs.columns[:4]).where("doc_id <> 7 OR doc_id IS NULL").selectExpr("*", "0L AS n_chars"))
    for r in langid.predict(rows, learned, ["doc_id", "text"]).collect():
        lang, score = brute_language(r["text"] or "", learned)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_languages_of_held_out_documents(docs, spark):
    learned = langid.prototypes(docs.where(~held_out(docs.doc_id, 4, 2)))
    out = langid.predict(docs.where(held_out(docs.doc_id, 4, 2)), learned, ["doc_id", "lang"]).toPandas()
    assert len(out) > 30 and (out["lang"] == out["lang_pred"]).mean() > 0.97 and out.score.between(0, 1).all()


def test_languages_odd(odd, none):
    learned = langid.prototypes(odd)
    assert set(learned) == {"en", "de", "fr"}
    out = langid.predict(odd, learned, odd.columns[:1] + odd.columns[2:])
    rows = out.select("doc_id", "lang_pred", "score").collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4)) and all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (1, 5, 8, 9))
    assert langid.prototypes(none) == {} and langid.predict(none, learned, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, {}, ["doc_id"]).collect()} == {"und"}


def test_vectors_are_bound_by_place():
    code = lambda s: langid.trigrams(s)
    assert sorted(code("ab")) == sorted(code("AB!")) and len(code("ab c")) == 4
    x = langid.bound(np.array([code("abc")[1], code("acb")[1]]), 1024, 7)
    assert abs(x[0] @ x[1]) < 200 and x[0] @ x[0] == 1024
    whole = langid.bundles(["abc abd"], 256, 7)[0]
    assert whole == pytest.approx(langid.bound(code("abc abd"), 256, 7).sum(axis=0))
