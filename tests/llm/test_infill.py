import hashlib
import re

import pytest
from pyspark.sql import functions as F

from trailgraph.llm import infill

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+", "char": r"(?s:.)"}


def brute(doc_id, text, unit="line", rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def check(df, **kw):
    out = infill.infill(df, ["doc_id", "text"], **kw).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    assert len(out) == df.count()
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"], **kw)
        assert r["back"] == (r["text"] or "")
    return {r["form"] for r in out}


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "a\n\nb\n", "é\U0001f600\nb\r\nc", "x<P>y\nz", "<", "<\n>\n<S\nP>", "a\n<M>", " \t a b\x0b\n", "one\ntwo\nthree\n\n\nfour" * 5]


@pytest.mark.parametrize("unit", list(UNITS))
def test_texts(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 40)]
    assert check(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), unit=unit) == {"plain", "psm", "spm"}


def test_rates(spark):
    df = spark.createDataFrame([(i, "a\nb\nc") for i in range(200)], "doc_id INT, text STRING")
    assert check(df, rate=0) == {"plain"} and check(df, spm_rate=0) == {"psm"} and check(df, rate=60, spm_rate=100) == {"plain", "spm"}
    with pytest.raises(ValueError):
        infill.infill(df, [], unit="page")


def test_documents_and_odd(docs, odd, none):
    check(docs)
    check(odd)
    out = infill.infill(odd, odd.columns)
    assert out.columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == odd.count()
    assert infill.infill(none, ["doc_id"]).count() == 0
    assert infill.infill(odd.withColumn("n", F.lit(1)), ["doc_id", "n"]).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_a_very_long_text(spark):
    text = "\n".join("line %d " % i * (i % 9) for i in range(200_000))
    check(spark.createDataFrame([(1, text), (2, "x" * 3_000_000), (3, "\n" * 1_000_000)], "doc_id INT, text STRING"))


def test_runs_find_cuts_without_units():
    runs = infill.Runs("ab\n\n\nc\nd", "line")
    assert runs.upto == [0, 3, 3, 4, 5] and [runs.place(k) for k in range(6)] == [0, 3, 4, 5, 7, 8]
