"""The registered queries: those with SQL against it, all for their columns, and the pipeline's stages."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from trailgraph.llm.common import stored
from trailgraph.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_pack": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_substrings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_vectors": ["vec_id", "n_links", "component_id", "kept"],
    "op9_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_hmm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op13_infill": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    table = {"op5_warc": "pages", "op8_vectors": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert len(rows) == n or name == "op4_pack" and len(rows) > n or name == "op11_collocations" and rows
    if name in ORACLE_SQL:
        assert cells(df.columns, rows) == by_sql(name, sf_dir, table)


def cells(names, rows):
    return sorted(repr(sorted(zip(names, c, strict=True))) for c in rows)


def by_sql(name, sf_dir, table):
    db = duckdb.connect()
    path = f"{os.path.join(sf_dir, table)}.parquet"
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path + '/*.parquet' * os.path.isdir(path)}')")
    cursor = db.execute(ORACLE_SQL[name])
    return cells([c[0] for c in cursor.description], cursor.fetchall())


def written(df, tmp_path, table):
    df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


def test_vectors_by_sql_with_links(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    near = [(v + 0.1 * k * rng.normal(size=8)).tolist() for v in x for k in range(5)]
    odd = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], near[3], near[3]]
    df = spark.createDataFrame(list(enumerate(near + odd)), "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    sf_dir = written(df, tmp_path, "embeddings")
    out = QUERIES["op8_vectors"](spark, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    assert sum(r[1] > 0 for r in rows) > 100 and sum(not r[3] for r in rows) > 50
    assert cells(out.columns, rows) == by_sql("op8_vectors", sf_dir, "embeddings")


def test_substrings_by_sql_on_odd_texts(spark, odd, tmp_path):
    """Several bytes a character, runs that touch, repeats inside one text, a window's length and a byte less."""
    block = "".join(chr(0x100 + i * 7 % 300) for i in range(130))
    texts = [block[:100], block[:99], "x" + block[:100], "ab" * 300, block * 2 + "q" + block, block[:100] + block[:100], "é" * 250, "-" + block[10:110] + "z" * 90]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    sf_dir = written(odd.select("doc_id", "text").where("doc_id IS NOT NULL").union(more), tmp_path, "documents")
    out = QUERIES["op6_substrings"](spark, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    assert sum(r[2] > 0 for r in rows) >= 6
    assert cells(out.columns, rows) == by_sql("op6_substrings", sf_dir, "documents")


def test_rules_by_sql_on_odd_texts(spark, odd, tmp_path):
    """Windows that overlap themselves, groups of one document, lines that are blank, tails above a threshold."""
    plain = [f"some words of {k} that differ from {k * 7} and others {k * 11} on\n line {k}, which goes on for a while about {k * 13} and so" + " again and again" * (k % 5) for k in range(60)]
    signs, long, lines = (" ".join(f"{x}{k}" for k in range(30)) for x in ("#*$%&|<>", "w" * 50, "end\n\n \nu"))
    texts = [*plain, "a b c d e f g h " * 5, "x " * 40, plain[0] + signs, long, lines.replace(" u", "\nu").replace(" end", "\nend")]
    more = spark.createDataFrame([(100 + i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    sf_dir = written(odd.select(more.columns).union(more), tmp_path, "documents")
    out = QUERIES["op10_rules"](spark, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    assert 3 <= sum(not r[6] and not r[7] for r in rows) < 30 < sum(r[7] for r in rows)
    assert cells(out.columns, rows) == by_sql("op10_rules", sf_dir, "documents")


def test_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(driver.queries())


def test_stages_on_documents(spark, docs, sf_dir):
    df, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stored(stage(spark, df, sf_dir), "stage")
        assert df.columns == docs.columns, name
        assert 0.5 * before < df.count() <= 2 * before
    assert stage and corpus_pipeline.run(spark, sf_dir).count() >= df.select("doc_id").distinct().count()


def test_stages_on_odd_documents(spark, odd, none, sf_dir):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, df, sf_dir), "stage")
            assert name == "packing" or out.columns == df.columns
            assert df is odd or out.count() == 0
