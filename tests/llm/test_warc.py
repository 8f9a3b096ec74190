import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trailgraph.llm import warc
from trailgraph.llm.common import shared_dir
from trailgraph.llm.queries import QUERIES

FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
HTML = ["x" * 150, "x" * 150, "short", "short", None, "", FAKE, "<p>é</p>" * 30 + FAKE + "tail", warc.MAGIC, "a\r\n\r\nb", "y" * 99, "y" * 99, "y" * 100, "y" * 100]


def brute(rows):
    first = {}
    for i, html in rows:
        p = (html or "").encode()
        if len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, html in rows:
        p = (html or "").encode()
        of = first.get(p, i)
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "response" if of == i else "revisit", None if of == i else str(of)))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, "http://x/\r\ninjected: 1", h) for i, h in rows], "page_id BIGINT, url STRING, html STRING")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_round_trip(spark, odd):
    check(spark, list(enumerate(HTML)))
    check(spark, [(3, "z" * 200), (3, "z" * 200), (5, "z" * 200)])  # repeated rows of the smallest id are both responses
    check(spark, [])


def test_magic_in_payloads_is_rejected(spark, odd):
    path = f"{shared_dir(spark)}/warc-test"
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(HTML)], "page_id BIGINT, url STRING, html STRING")
    warc.write(pages.coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(warc._candidates(False), warc.CANDIDATES)
    assert found.where("begin IS NOT NULL").count() > len(HTML)  # the fakes look like records
    back = warc.read(spark, path).collect()
    assert len(back) == len(HTML) and {r["page_id"] for r in back} == {str(i) for i in range(len(HTML))}
    assert {bytes(r["payload"]).decode() for r in back} == {h or "" for h in HTML}


def test_long_urls(spark, odd):
    """A URL of any length hides neither its own record nor those after it."""
    path = f"{shared_dir(spark)}/warc-long"
    pages = spark.createDataFrame([(0, "u", "a"), (1, "u" * 70_000, "b"), (2, "u", "c")], "page_id BIGINT, url STRING, html STRING")
    warc.write(pages.coalesce(1), path)
    assert {r["page_id"] for r in warc.read(spark, path).collect()} == {"0", "1", "2"}


def test_chains_of_any_length(spark, odd):
    for n in (0, 1, 2, 7, 64):
        rows = [("f", k * 10, k * 10 + 10) for k in range(n)] + [("f", 5, 20), ("g", 3, 9)]
        got = {(r["path"], r["begin"]) for r in warc.reachable(spark.createDataFrame(rows, "path STRING, begin BIGINT, next BIGINT")).collect()}
        assert got == {("f", k * 10) for k in range(n)}


def test_pages(spark, sf_dir, odd):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    check(spark, rows)


def test_ids_come_back_as_they_were(spark, odd):
    """Null ids, and ids with line breaks, blanks or marks of headers."""
    long = "z" * 200
    rows = [(None, long), ("b", long), (None, "short"), ("a\r\n b: <c>", long), ("", "q" * 150), (None, "only" * 50), (None, "only" * 50), ("%2B+", "")]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id STRING, url STRING, html STRING")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=repr)
    first = "a\r\n b: <c>"
    want = [(None, 200, "revisit", first), ("b", 200, "revisit", first), (None, 5, "response", None), (first, 200, "response", None), ("", 150, "response", None)]
    assert got == sorted([*want, (None, 200, "response", None), (None, 200, "response", None), ("%2B+", 0, "response", None)], key=repr)


def test_query_with_null_ids(spark, odd, tmp_path):
    spark.createDataFrame([(None, "u", "x"), (3, "u", "y")], "page_id BIGINT, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"] for r in QUERIES["op5_warc"](spark, str(tmp_path)).collect()} == {None, 3}


def test_files_are_bounded_by_bytes(spark, odd):
    path = f"{shared_dir(spark)}/warc-bytes"
    rng = random.Random(1)
    pages = [(i, "u", "".join(rng.choice("ab") for _ in range(rng.choice([0, 10, 90, 300, 1000, 5000])))) for i in range(200)]
    warc.write(spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").coalesce(1), path, records_per_file=20, file_bytes=2000)
    back = warc.read(spark, path)
    assert back.count() == 200
    for r in back.groupBy("path").agg(F.sum("payload_bytes").alias("bytes"), F.count("*").alias("n")).collect():
        assert r["n"] <= 20 and (r["bytes"] <= 2000 or r["n"] == 1)


def test_a_broken_chain_is_told(spark, odd):
    path = f"{shared_dir(spark)}/warc-broken"
    warc.write(spark.createDataFrame([(i, "u", "abc") for i in range(5)], "page_id BIGINT, url STRING, html STRING").coalesce(1), path)
    lines = spark.read.option("lineSep", "\n\n\n").text(path).first()["value"]
    spark.createDataFrame([(lines.replace("<urn:page:3>\r\n", "<urn:page:3>\r\nContent-Length: 9\r\nX-"),)], "value STRING").coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path + "2")
    with pytest.raises(ValueError):
        warc.read(spark, path + "2").count()
