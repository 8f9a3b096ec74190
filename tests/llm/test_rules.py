import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailgraph.llm import rules

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    covered = {i for v in at.values() if len(v) > 1 for k in v for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def check(docs):
    text = docs.select("doc_id", "text")
    out = rules.judge(docs, ["doc_id", "text"]).select("row.*", *NAMES, "kept").collect()
    assert len(out) == text.count()
    for r in out:
        assert tuple(r[n] for n in NAMES) == brute(r["text"])
        assert not (r["base_failed"] and r["kept"])
    return out


def test_counts(docs):
    out = check(docs)
    assert sum(r["kept"] for r in out) > 0.6 * len(out)


def test_odd(odd, none):
    check(odd)
    assert rules.judge(none).count() == 0
    assert rules.filter_documents(odd).columns == odd.columns


def test_windows(spark):
    texts = ["a b c d e f g h " * 3, "x " * 40, "\n".join(["same line of words"] * 9), "a b c d e f g h i a b c d e f g h j " + "k " * 5]
    check(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id INT, text STRING, lang STRING, source STRING"))


def test_thresholds_adapt_and_keep_clean_documents(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = rules.judge(docs, ["doc_id"]).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id")
    clean = out.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = out.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.98 and junk < 0.2
    plain, marked = "word another thing " * 3, "word# another* thing$ " * 3
    rows = [(i, " ".join(f"{w}{i}{k}" for k, w in enumerate((marked if s == "m" or i == 0 else plain).split() * 3)), "en", s) for s in ("p", "m") for i in range(300)]
    got = {(r["doc_id"], r["source"]): r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id INT, text STRING, lang STRING, source STRING"), ["doc_id", "source"]).select("row.*", "kept").collect()}
    assert not got[(0, "p")] and got[(1, "p")] and got[(0, "m")]  # as usual as its source


def rounded(value):
    x = math.floor(value * 2**20)
    out = x >> max(x.bit_length() - 10, 0) << max(x.bit_length() - 10, 0)
    assert out <= x and x - out <= x / 500
    return out / 2**20


def test_thresholds_agree_however_rows_are_dealt(docs):
    found = rules.measured(docs, ["doc_id"])
    runs = [{tuple(r) for r in rules.thresholds(found.repartition(n, *key)).collect()} for n, key in ((1, []), (7, []), (13, ["n_words"]))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 10


def test_verdicts_and_thresholds_match_plain_quartiles(docs):
    """Quartiles are those of the values rounded down to ten leading bits; verdicts follow from thresholds alone."""
    found = rules.measured(docs, ["doc_id"]).toPandas()
    limits = {(r["lang"], r["source"]): r for r in rules.thresholds(rules.measured(docs, ["doc_id"])).collect()}

    def limit(rows, ratio, spread):
        quarter = lambda q: rounded(sorted(rows[ratio])[max(0, math.ceil(q * len(rows)) - 1)])
        return quarter(0.75) + rules.FENCE * max(quarter(0.75) - quarter(0.25), spread)

    for (lang, source), rows in found.groupby(["lang", "source"], dropna=False):
        for ratio, spread in rules.RATIOS.items():
            n, whole = len(rows), found[found["lang"] == lang]
            want = (n * limit(rows, ratio, spread) + rules.PRIOR_DOCS * limit(whole, ratio, spread)) / (n + rules.PRIOR_DOCS)
            assert limits[lang, source][ratio] == pytest.approx(want, rel=1e-9)
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, ["doc_id"]).select("row.doc_id", "kept").collect()}
    for r in found.itertuples():
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert kept[r.row["doc_id"]] == (not base and all(getattr(r, x) <= limits[r.lang, r.source][x] for x in rules.RATIOS))


def test_a_group_leans_on_its_language_by_its_size(spark):
    """A group of one takes nearly its language's threshold, and the more documents it has, the nearer is its own."""
    rows = [("en", "big", 0.0)] * 9000 + [("en", "few", 1.0)] * 1 + [("en", "more", 1.0)] * 100 + [("en", "most", 1.0)] * 1000
    found = spark.createDataFrame([(lang, s, x, x, x, x) for lang, s, x in rows], "lang STRING, source STRING, " + ", ".join(f"{r} DOUBLE" for r in rules.RATIOS))
    got = {r["source"]: r["symbol_ratio"] for r in rules.thresholds(found).collect()}
    assert got["big"] < got["few"] + 1e-9 < got["more"] < got["most"] and got["few"] < 0.12


def test_columns_with_dots(docs):
    from pyspark.sql import functions as F

    odd = docs.withColumn("a.b", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert rules.filter_documents(odd).columns == odd.columns


def test_no_python(docs):
    found = rules.measured(docs, ["doc_id"])
    for step in (found, rules.thresholds(found), rules.judge(docs, ["doc_id"]), rules.filter_documents(docs)):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
