import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from trailgraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    def luhn(s):
        s = [int(c) for c in s][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(s)) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


parts = st.sampled_from(["a@b.c", ".", "@", "a", "+1", " (269) ", "555-3296", "4", "1.2.3.4", "255.0.0.1", "256", "-", " ", "4521999999999999", "4111 1111 1111 1111", "é", "%", "_", "00000000000000", "\n"])


@settings(max_examples=600, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_linear_on_long_runs():
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "+1(" * 50_000, "1." * 100_000):
        pii.base_spans(text)


def test_documents(docs):
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.sanitise(docs.select("doc_id", "text"), with_text=False).collect():
        spans = brute(rows[r["doc_id"]] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_odd(odd, none):
    out = {(r["doc_id"], r["source"]): r for r in pii.sanitise(odd).collect()}
    assert out[(2, "a")]["clean_text"] is None and out[(3, None)]["clean_text"] == "" and out[(2, "a")]["spans"] == ""
    assert pii.sanitise(odd).count() == odd.count() and pii.sanitise(none).count() == 0


def test_terms_that_reveal(spark):
    """A term that always stands by an address is marked wherever it stands; one that stands anywhere is not."""
    rows = [f"lorem ipsum dolor sit amet consetetur elitr sed diam nonumy filler words of no kind here kontakt x{i}@y.de the end" for i in range(40)]
    rows += ["the weather of words is fine here"] * 200 + ["kontakt without an address"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id INT, text STRING")
    terms = pii.disclosing(texts)
    assert "kontakt" in terms and terms["kontakt"] == 40 / 41 and "the" not in terms and "lorem" not in terms
    last = [r for r in pii.sanitise(texts).collect() if r["doc_id"] == 240][0]
    assert last["spans"] == "term:0:7" and last["clean_text"] == " without an address" and last["n_email"] == 0


def test_rare_terms_that_reveal_are_marked_in_a_large_corpus(spark):
    """The number of documents that a term needs doesn't grow with the corpus."""
    beside = " ".join("ab cd ef gh ij kl mn op".split())
    rows = [f"{beside} x{i}@y.de {beside.upper()[::-1]}" for i in range(5000)] + [f"{beside} {beside[::-1]}"] * 9000
    rows += [f"kontakt x{i}@y.de" for i in range(6)]
    terms = pii.disclosing(spark.createDataFrame([(t,) for t in rows], "text STRING"))
    assert terms == {"kontakt": 1.0}


def test_terms_joined_are_as_those_sent(spark, odd, monkeypatch):
    """Past the bound for sending them, terms are joined: the same rows, also for null, empty and repeated texts."""
    rows = [f"kontakt x{i}@y.de mail Adresse" for i in range(20)] * 2 + ["the weather is fine"] * 100 + ["Kontakt ohne adresse", None, "", " 1 "]
    texts = spark.createDataFrame([(i // 2, t) for i, t in enumerate(rows)], "doc_id INT, text STRING")
    sent = sorted(map(repr, pii.sanitise(texts).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 1)
    joined = sorted(map(repr, pii.sanitise(texts).collect()))
    assert sent == joined and any("term:0:7" in r for r in sent)
    assert pii.sanitise(odd).count() == odd.count()


def test_cleaned():
    text = "write to a.b@c.de or +1 (269) 555-3296 now"
    assert pii.cleaned(text, pii.base_spans(text), {}) == "write to [EMAIL] or [PHONE] now"


def brute_terms(texts):
    """The disclosing terms by plain counting: of each document's terms, those within 8 of a base span or an opaque value."""
    docs, near, entities, values = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for text in texts:
        text = text or ""
        base = brute(text)
        opaque = [(m.start(), 5, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{12,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        opaque = [x for x in opaque if not any(s < x[2] and x[0] < e for s, _, e in base)]
        for s, _, e in opaque:
            values["*"].add(text[s:e])
            if text[s : s + 4].isalpha():
                values[text[s : s + 4].lower() + "*"].add(text[s:e])
        docs.update({t.lower() for t in pii.TERM.findall(text)})
        spans, beside = sorted(base + opaque), defaultdict(list)
        edges = [(0, 0), *((s, e) for s, _, e in spans), (len(text), len(text))]
        for k in range(len(edges) - 1):
            terms = [m[0].lower() for m in pii.TERM.finditer(text, max(e for _, e in edges[: k + 1]), edges[k + 1][0])] if max(e for _, e in edges[: k + 1]) < edges[k + 1][0] else []
            for some, at in ((terms[:8], k), (terms[-8:], k + 1)):
                for t in some if 0 < at <= len(spans) else []:
                    beside[t].append(pii.number(text[edges[at][0] : edges[at][1]]))
        near.update(beside.keys())
        for t, found in beside.items():
            entities[t].add(min(found))
    prior, judged = sum(near.values()) / max(1, sum(docs.values())), sum(len(x) >= 5 for x in [*entities.values(), *values.values()])
    least = 4 + math.log2(max(1, judged))

    def told(k, n, chance):
        return k * math.log2(k / n / chance) + ((n - k) * math.log2((n - k) / n / (1 - chance)) if k < n else 0)

    out = {t: near[t] / n for t, n in docs.items() if len(entities[t]) >= 5 and near[t] / n >= 0.5 and near[t] / n / prior >= 2 and told(near[t], n, prior) >= least}
    every = len(values["*"])
    return out | {t: 1.0 for t, x in values.items() if t != "*" and len(x) >= 5 and len(x) / every * 16**4 >= 2 and told(len(x), every, 16.0**-4) >= least}


def test_terms_of_documents_match_plain_counting(spark):
    """On the tables' own documents the terms that name keys are found, by the same counts as brute force; base spans don't change."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    terms = pii.disclosing(docs)
    assert terms == brute_terms(texts.values()) and "token" in terms
    marked = 0
    for r in pii.sanitise(docs, with_text=False).collect():
        text = texts[r["doc_id"]] or ""
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        own = [(int(s), int(e)) for kind, s, e in spans if kind == "term"]
        want = [m.span() for m in pii.TERM.finditer(text) if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, _, e in brute(text))]
        assert own == want
        marked += len(own)
    assert marked >= 10


def test_values_are_protected_where_a_term_names_them_or_they_begin_alike(spark):
    rng = random.Random(3)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n)) + "1f"
    rows = [f'some words here then geheim = "{value(30)}" and more of them' for _ in range(20)] + [f"words QRST{value(14)} and others" for _ in range(12)]
    rows += ["some words here then and more of them and others"] * 300 + [f"a name {value(20)} alone"]
    out = pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id INT, text STRING")).orderBy("doc_id").collect()
    assert all(r["clean_text"] == 'some words here then  = "[SECRET]" and more of them' for r in out[:20])
    assert all(r["clean_text"] == "words [SECRET] and others" for r in out[20:32])
    assert all(r["clean_text"] == t for r, t in zip(out[32:], rows[32:], strict=True))


def test_copies_of_a_document_are_no_evidence(spark):
    rows = ["unusual words stand beside a@b.de here"] * 50 + ["the weather is fine"] * 50
    assert pii.disclosing(spark.createDataFrame([(t,) for t in rows], "text STRING")) == {}
