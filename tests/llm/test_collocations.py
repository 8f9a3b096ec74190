import re
from collections import Counter, defaultdict

import pytest

from trailgraph.llm import collocations

SCHEMA = "lang STRING, text STRING"


def brute(rows, most=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        held = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= cover * a for b in held):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, i + 1, *r[3:]) for lang, own in out.items() for i, r in enumerate(sorted(own)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_documents(docs):
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    got = rows_of(collocations.collocations(docs, least=5))
    assert len(got) > 100 and any(r[2].count(" ") == 2 for r in got)
    assert got == brute(rows, least=5)


#: Pieces, overlaps, ties, phrases inside others, capitals, wide spaces that part no words, languages that share words, nulls.
ODD = [("en", "A a a a, a a. B\tc B c;b c"), ("en", "new york city\nnew york city\nNEW york"), ("de", "new york city new york"), (None, "x y z x y z x y z"), ("und", "x y"),
       ("en", None), ("en", ""), ("de", " \t\n.,;"), ("fr", "é à é à été été ÉTÉ"), ("fr", "p q r s p q r s p q r s"), ("en", "k\x00l m k\x00l m <P> [m] [m] [m]")]


@pytest.mark.parametrize("bits", [24, 10])
@pytest.mark.parametrize(("most", "least"), [(3, 2), (2, 1), (4, 2), (3, 300)])
def test_odd(spark, bits, most, least):
    """Few buckets let more through, and the counts are the same."""
    df = spark.createDataFrame(ODD * 3, SCHEMA).repartition(5)
    assert rows_of(collocations.collocations(df, most, least, bits=bits)) == brute(ODD * 3, most, least)


def test_first_ones_and_ties(spark):
    rows = [("en", "\n".join(f"a{i:02d} b{i:02d}" for i in range(60)))] * 10
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(collocations.collocations(df, top=7, salts=3)) == brute(rows, top=7)


def test_long_texts_and_small_parts(spark, monkeypatch):
    """A text of many parts, and a task that gives its rows many times."""
    text = " ".join(f"w{i % 7} v{i % 11}" + ("." if i % 13 == 0 else "") for i in range(3000))
    monkeypatch.setattr(collocations, "BYTES_AT_ONCE", 100)
    assert [w for part in collocations.tokens(text.encode()) for w in part if w != b"\n"] == re.sub(r"\.", " ", text).encode().split()
    rows = [("en", text), ("de", text[::-1])]
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, SCHEMA), most=3)) == brute(rows)


def test_odd_columns(odd, none):
    assert collocations.collocations(none).count() == 0
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    assert rows_of(collocations.collocations(odd, most=2)) == brute(rows, most=2)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the score's decimals."""
    from pyspark.sql import functions as F

    a, l, r = 3_000_000_000_017, 3_000_000_000_019, 3_000_000_000_023
    exact = "cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    assert collocations.SCORE == exact
    assert spark.createDataFrame([(a, l, r)], "a LONG, l LONG, r LONG").select(F.expr(exact)).first()[0] == 1000000 * a * a // (l * r)
