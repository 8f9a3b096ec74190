"""Personal data: patterns, and terms that reveal where protected data stands.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by pattern. These and opaque values (long runs
of mixed letters and digits, as keys and passwords are) are the protected entities. Over the whole corpus it is counted in
how many of the documents that hold a term it stands within a few terms of an entity. The information that the term gives
about entities is the logarithm of that share over the share of all terms. A term whose share, information, number of
different entities and weight of evidence all exceed their thresholds discloses: it is marked wherever it stands, and
generalised or, if it reveals more still, removed. An opaque value is protected, and replaced, where a disclosing term names it,
or where it begins with letters that far more different values begin with than chance would have it, as keys of one issuer do.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgraph.llm.common import Carried, ship, stored

#: Kinds in the order of the contract, then the method's own.
KINDS = ["email", "ip", "card", "phone", "term", "secret"]
TERM_KIND, SECRET_KIND = 4, 5

# Runs are matched possessively and begin at a run's first character: the same matches in linear time.
LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
EMAIL_AT = re.compile(LOCAL)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + LOCAL)
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{12,}+")
LETTER = re.compile(r"[A-Za-z]")

#: Terms on either side of protected data that count as near.
NEAR = 8
#: Different entities that a term needs to stand near to be judged, whatever the corpus's size. Copies of one document hold one.
LEAST_ENTITIES = 5
#: Bits by which the evidence for a term has to exceed what the best of as many terms would have by chance.
EVIDENCE = 4.0
#: Code points between a disclosing term's end and the opaque value that it names, at most.
NAMED = 8
#: Letters that an opaque value may begin with as others of its kind do, and the chance of such a beginning in random values of
#: the smallest alphabet to expect, hexadecimal digits.
PREFIX = 4
PREFIX_CHANCE = 16.0**-PREFIX
#: Stands for all opaque values among the terms; after letters, for values that begin with these.
ANY = "*"
#: Disclosing terms up to which they are sent to all tasks, at about 20 bytes each; beyond, they are joined to the documents.
BROADCAST_TERMS = 100_000
#: Bits and shares from which a term is generalised, and the share from which it is removed.
BITS = 1.0
GENERALISE = 0.5
REMOVE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    while m := (EMAIL_AT.match(text, at) if at else None) or EMAIL.search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of all base matches, in order."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def opaque_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, SECRET_KIND, end) of the runs of letters and digits mixed, outside base spans: values, not words or numbers."""
    if not DIGIT.search(text):
        return []
    runs = [m for m in OPAQUE.finditer(text) if DIGIT.search(m[0]) and LETTER.search(m[0])]
    return [(m.start(), SECRET_KIND, m.end()) for m in runs if not any(s < m.end() and m.start() < e for s, _, e in base)]


def prefix(value: str) -> str | None:
    """The term that stands for opaque values with the same beginning; None where it isn't of letters only."""
    return value[:PREFIX].lower() + ANY if value[:PREFIX].isalpha() else None


def number(text: str) -> int:
    """A digest of an entity's text, not negative."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def near_terms(text: str, spans: list[tuple[int, int, int]], near: int = NEAR) -> dict[str, int]:
    """The terms within `near` terms of a span and outside all spans, with the smallest digest of the spans' texts that each is near.

    Reads only what lies between spans.
    """
    found: dict[str, int] = {}
    digests = [number(text[s:e]) for s, _, e in spans]
    edges = [0, *(e for _, _, e in spans)], [*(s for s, _, _ in spans), len(text)]
    end = 0
    for k, (after, before) in enumerate(zip(*edges, strict=True)):
        end = max(end, after)
        if end < before:
            terms = [m[0].lower() for m in TERM.finditer(text, end, before)]
            for some, at in ((terms[:near], k - 1), (terms[-near:], k)):
                if 0 <= at < len(spans):
                    found.update((t, min(digests[at], found.get(t, digests[at]))) for t in some)
    return found


def disclosing_terms(
    texts: DataFrame, near: int = NEAR, least_entities: int = LEAST_ENTITIES, bits: float = BITS, generalise: float = GENERALISE, evidence: float = EVIDENCE
) -> DataFrame:
    """Terms of the corpus (column text) over the thresholds, with their share: term, share.

    One pass counts over all documents in how many of them each term stands near an entity, near which, and in how many at
    all. The counts stay tables; none of them comes to the driver but three totals.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beside: Counter[tuple[str, int]] = Counter()
        every: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    every.update({t.lower() for t in TERM.findall(text)})
                    base = base_spans(text)
                    values = opaque_spans(text, base)
                    if spans := sorted(base + values):
                        beside.update(near_terms(text, spans, near).items())
                    for start, _, end in values:
                        value = text[start:end]
                        beside.update((t, number(value)) for t in (ANY, prefix(value)) if t)
            if len(every) + len(beside) > 200_000:
                yield rows(beside, every)
                beside.clear()
                every.clear()
        yield rows(beside, every)

    def rows(beside: Counter[tuple[str, int]], every: Counter[str]) -> pd.DataFrame:
        terms, entities = [t for t, _ in beside] + list(every), [e for _, e in beside] + [-1] * len(every)
        return pd.DataFrame({"term": pd.Series(terms, dtype=object), "entity": entities, "n": [*beside.values()] + [0] * len(every), "docs": [0] * len(beside) + [*every.values()]})

    parts = texts.select("text").mapInPandas(counted, "term string, entity long, n long, docs long")
    parts = parts.groupBy("term", "entity").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.count_if(F.col("entity") >= 0).alias("entities"))
    found = stored(found.where("n > 0 OR docs > 0"), "near-terms", even=True)
    own = ~F.col("term").endswith(ANY)
    judged = F.col("entities") >= least_entities
    near_all, all_terms, judged_all, values = found.agg(F.sum(F.when(own, F.col("n"))), F.sum("docs"), F.count_if(judged), F.max(F.when(F.col("term") == ANY, F.col("entities")))).first()
    prior = (near_all or 0) / max(1, all_terms or 0)
    least = evidence + math.log2(max(1, judged_all or 0))

    def told(k: Column, n: Column, chance: float) -> Column:
        """What k of n tell against the chance, in bits."""
        return k * F.log2(k / n / F.lit(chance)) + F.when(k < n, (n - k) * F.log2((n - k) / n / F.lit(1 - chance))).otherwise(F.lit(0.0))

    share = (F.col("n") / F.col("docs")).alias("share")
    out = found.where(own & judged & (F.col("docs") > 0)).select("term", share, F.col("n").cast("double").alias("k"), F.col("docs").cast("double").alias("of"))
    out = out.where((F.col("share") >= generalise) & (F.log2(F.col("share") / F.lit(prior)) >= bits)) if 0 < prior < 1 else out.limit(0)
    out = out.where(told(F.col("k"), F.col("of"), prior) >= least).select("term", "share") if 0 < prior < 1 else out.select("term", "share")
    k, of = F.col("entities").cast("double"), F.lit(float(values or 1))
    begun = found.where(~own & (F.col("term") != ANY) & judged & (F.log2(k / of / F.lit(PREFIX_CHANCE)) >= bits))
    return out.union(begun.where(told(k, of, PREFIX_CHANCE) >= least).select("term", F.lit(1.0)))


def disclosing(texts: DataFrame, **thresholds) -> dict[str, float]:
    """The terms of disclosing_terms, at the driver."""
    ship(texts.sparkSession)
    return {r["term"]: r["share"] for r in disclosing_terms(texts, **thresholds).collect()}


def terms_by_text(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """For each text (column text) that holds some of the terms: of, its digest, and a map own of these with their share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch.pop("text"):
                begun = {prefix(text[s:e]) for s, _, e in opaque_spans(text, base_spans(text))} - {None}
                found.append(sorted({t.lower() for t in TERM.findall(text)} | begun))
            yield batch.assign(term=found).explode("term").dropna()

    each = texts.where("text IS NOT NULL").select(digest(F.col("text")).alias("of"), "text").mapInPandas(run, "of string, term string").distinct()
    return each.join(terms, "term").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("own"))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def all_spans(text: str, terms: dict[str, float], named: int = NAMED) -> list[tuple[int, int, int]]:
    """Base spans, and outside them those of disclosing terms and of opaque values that such a term names or that begin as one, in order."""
    base = base_spans(text)
    if not terms:
        return base
    values = opaque_spans(text, base)
    taken = sorted(base + values)
    own, k, end = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end, k = max(end, taken[k][2]), k + 1
        if m.start() >= end and m[0].lower() in terms:
            own.append((m.start(), TERM_KIND, m.end()))
    ends = [e for _, _, e in own]
    for value in values:
        at = bisect.bisect_right(ends, value[0]) - 1
        if at >= 0 and value[0] - ends[at] <= named or prefix(text[value[0] : value[2]]) in terms:
            own.append(value)
    return sorted(base + own)


def cleaned(text: str, spans: list[tuple[int, int, int]], terms: dict[str, float], remove: float = REMOVE) -> str:
    """The text with each stretch of spans generalised to its first kind's name, or removed."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            gone = kind == TERM_KIND and terms[text[start:end].lower()] >= remove
            out += [text[at:start], "" if gone else f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sanitise(docs: DataFrame, carry: list[str] | None = None, with_text: bool = True, **thresholds) -> DataFrame:
    """Finds and replaces personal data in docs (text and the columns `carry`, all but text by default).

    Returns `carry`, n_email, n_ip, n_card, n_phone, base_sha256, spans, and clean_text if with_text. Offsets count code
    points, ends are exclusive. A null text is as an empty one, but clean_text stays null. Repeated rows are treated each;
    an empty table gives no rows; a carried column with one of the new names gives way to it.
    """
    ship(docs.sparkSession)
    carried = Carried(docs, [c for c in docs.columns if c != "text"] if carry is None else carry)
    found = disclosing_terms(docs, **thresholds)
    whole = {r["term"]: r["share"] for r in found.limit(BROADCAST_TERMS + 1).collect()}
    few = len(whole) <= BROADCAST_TERMS
    whole = whole if few else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            held = [whole] * len(batch) if few else [dict(own) if own is not None else {} for own in batch.pop("__own")]
            for text, terms in zip(batch.pop("__text"), held, strict=True):
                spans = all_spans(text, terms) if text else []
                base = [x for x in spans if x[1] < 4]
                n = Counter(k for _, k, _ in base)
                row = (n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans))
                rows.append((*row, cleaned(text, spans, terms) if text else text) if with_text else row)
            yield pd.concat([batch, pd.DataFrame(rows, columns=new, index=batch.index, dtype=object)], axis=1)

    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] + ["clean_text"] * with_text
    kinds = ["long"] * 4 + ["string"] * 3
    schema = ", ".join([carried.schema()] * bool(carried.keys) + [f"{c} {kind}" for c, kind in zip(new, kinds, strict=False)])
    out = docs.select(*carried.columns(), F.col("text").alias("__text"))
    if not few:
        own = terms_by_text(docs, found).select(F.col("of").alias("__of"), F.col("own").alias("__own"))
        out = out.join(own, digest(F.col("__text")) == F.col("__of"), "left").drop("__of")
    out = out.mapInPandas(run, schema)
    return out.select(*carried.back(new), *new)
