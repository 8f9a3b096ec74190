"""The queries opN_<name> on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.llm import collocations, hmm, infill, langid, mixing, packing, pii, ranking, rules, simhash, substrings, vectors, warc
from trailgraph.llm.common import held_out, table


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary as text; by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    out = ranking.classify(docs, labels)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.sanitise(docs, ["doc_id"], with_text=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.similar(docs, shingle=3, parts=1, segment_count=3, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_json(), window=4096, end_id=2, with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select(F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove(docs, ["doc_id"], with_text=False)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    return mixing.mix(sized, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = langid.prototypes(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = langid.predict(docs, learned, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = rules.judge(docs, ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known, chain = hmm.fit(docs.where(~held_out(F.col("doc_id"), 5, 1)))
    out = hmm.score(docs, known, chain, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.infill(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    digest = F.sha2(F.col("output"), 256).alias("output_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, F.sha2(infill.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_pack": op4_pack,
    "op5_warc": op5_warc,
    "op6_substrings": op6_substrings,
    "op7_mix": op7_mix,
    "op8_vectors": op8_vectors,
    "op9_langid": op9_langid,
    "op10_rules": op10_rules,
    "op11_collocations": op11_collocations,
    "op12_hmm": op12_hmm,
    "op13_infill": op13_infill,
}

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS most FROM r),
c AS (SELECT *, CAST(most AS DOUBLE) / weight AS full_at FROM w),
e AS (SELECT *, CAST(coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spent,
    CAST(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS weights_left,
    CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM c),
l AS (SELECT *, (everything * 1.5::DOUBLE - spent) / weights_left AS level FROM e),
t AS (SELECT level AS vt FROM l WHERE level <= full_at ORDER BY full_at, rank LIMIT 1),
g AS (SELECT source, source_size, rank, weight, least(weight * (SELECT vt FROM t), CAST(most AS DOUBLE)) AS target FROM l),
q AS (SELECT d.doc_id, d.k, d.size, g.source_size, g.target, g.rank, g.weight, row_number() OVER () AS id,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT q.*, epoch, first, least(size - first, 256) AS words FROM q, (VALUES (0), (1)) e(epoch), unnest(range(0, greatest(size, 1), 256)) u(first)),
f AS (SELECT *, (start + first + words + epoch * source_size) * (10 // weight) AS finish FROM p),
c2 AS (SELECT *, CAST(sum(words) OVER (ORDER BY finish, rank, epoch, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM f),
b AS (SELECT CAST(floor(sum(source_size) * 1.5::DOUBLE) AS BIGINT) AS budget FROM s)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(words, budget - (upto - words)))) AS BIGINT) AS taken
FROM c2, b GROUP BY id, doc_id, size, source_size, target
"""

# Windows of 200 bytes by their md5, as hexadecimal digits: two a byte, taken from pieces of a text so that no substring starts far in.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS MATERIALIZED (SELECT *, CAST(length(x) // 2 AS BIGINT) AS n_bytes FROM d),
c AS (SELECT rk, base, substr(x, 2 * base + 1, 2 * (1024 + 199)) AS piece, least(1024, n_bytes - 199 - base) AS many
  FROM n, unnest(range(0, n_bytes - 199, 1024)) u(base)),
w AS MATERIALIZED (SELECT rk, base + i AS pos, md5_number(substr(piece, 2 * i + 1, 400)) AS h FROM c, unnest(range(0, many)) u(i)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
p AS (SELECT rk, pos, lag(pos) OVER (PARTITION BY rk ORDER BY pos) AS before FROM w WHERE h IN (SELECT h FROM r)),
s AS (SELECT rk, pos, sum(CASE WHEN pos <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rk ORDER BY pos) AS run FROM p),
g AS MATERIALIZED (SELECT rk, min(pos) AS a, max(pos) + 200 AS b FROM s GROUP BY rk, run),
t AS (SELECT rk, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM g GROUP BY rk),
e AS (SELECT rk, coalesce(lag(b) OVER (PARTITION BY rk ORDER BY a), 0) AS since, a AS until FROM g
  UNION ALL SELECT rk, coalesce(last, 0), n_bytes FROM n LEFT JOIN t USING (rk)),
k AS (SELECT rk, string_agg(substr(x, 2 * since + 1, 2 * (until - since)), '' ORDER BY since) AS kept FROM e JOIN n USING (rk) GROUP BY rk)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256
FROM n JOIN k USING (rk) LEFT JOIN t USING (rk)
"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND list_count(e) = len(e)
  AND isfinite(list_min(e)) AND isfinite(list_max(e)) AND (list_min(e) <> 0 OR list_max(e) <> 0)),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT id AS root, id FROM v UNION SELECT root, b FROM r JOIN l ON r.id = l.a),
c AS (SELECT r.id, min(v.vec_id) AS component_id FROM r JOIN v ON r.root = v.id GROUP BY r.id)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (id) LEFT JOIN n USING (id)
"""

# Windows of eight words by their md5; sketches as rows of (group, ratio, bucket, number).
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
m AS MATERIALIZED (SELECT rk, doc_id, lang, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM d),
e AS (SELECT rk, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM m),
g AS (SELECT rk, i, lead(word, 7) OVER p AS last, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p,
    lead(word, 4) OVER p, lead(word, 5) OVER p, lead(word, 6) OVER p, lead(word, 7) OVER p) AS x FROM e WINDOW p AS (PARTITION BY rk ORDER BY i)),
t AS (SELECT rk, i FROM (SELECT rk, i, md5_number(x) AS h FROM g WHERE last IS NOT NULL) q QUALIFY count(*) OVER (PARTITION BY rk, h) > 1),
s AS (SELECT rk, CAST(sum(least(8, coalesce(next - i, 8))) AS BIGINT) AS n
  FROM (SELECT rk, i, lead(i) OVER (PARTITION BY rk ORDER BY i) AS next FROM t) q GROUP BY rk),
c AS (SELECT m.rk, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(s.n, 0) AS n_repeat_words
  FROM m LEFT JOIN s ON s.rk = m.rk),
v AS MATERIALIZED (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word FROM c),
x AS (SELECT rk, lang, source, unnest([0, 1, 2, 3]) AS k, unnest([symbol_ratio, repeat_ratio, dup_line_ratio, mean_word]) AS ratio FROM v),
y AS (SELECT lang, source, k, CAST(floor(ratio * 1048576) AS BIGINT) AS part FROM x),
z AS (SELECT lang, source, k, part - part % (1::BIGINT << greatest(length(bin(part)) - 10, 0)) AS bucket FROM y),
own AS MATERIALIZED (SELECT lang, source, k, bucket, count(*) AS n FROM z GROUP BY lang, source, k, bucket),
both_ AS (SELECT true AS own, lang, source, k, bucket, n FROM own UNION ALL SELECT false, lang, null, k, bucket, sum(n) FROM own GROUP BY lang, k, bucket),
u AS (SELECT *, sum(n) OVER (PARTITION BY own, lang, source, k ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY own, lang, source, k) AS total FROM both_),
q AS (SELECT own, lang, source, k, CAST(max(total) AS DOUBLE) AS n, min(CASE WHEN 4 * up_to >= total THEN bucket END) / 1048576::DOUBLE AS low,
    min(CASE WHEN 4 * up_to >= 3 * total THEN bucket END) / 1048576::DOUBLE AS high FROM u GROUP BY own, lang, source, k),
l AS (SELECT *, high + 3::DOUBLE * greatest(high - low, ([0.02, 0.1, 0.15, 1.0]::DOUBLE[])[k + 1]) AS upper FROM q),
b AS (SELECT a.lang, a.source, a.k, (a.n * a.upper + 20::DOUBLE * o.upper) / (a.n + 20) AS upper
  FROM l a JOIN l o ON a.own AND NOT o.own AND a.k = o.k AND a.lang IS NOT DISTINCT FROM o.lang),
o AS (SELECT DISTINCT rk FROM x JOIN b ON x.k = b.k AND x.lang IS NOT DISTINCT FROM b.lang AND x.source IS NOT DISTINCT FROM b.source WHERE x.ratio > b.upper),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.rk IS NULL AS kept
FROM f LEFT JOIN o ON o.rk = f.rk
"""

OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM w, (VALUES (1), (2), (3)) t(k), unnest(range(1, len(w) - k + 2)) u(i)),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING k = 1 OR count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM c WHERE k > 1),
s AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * x.a * x.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM x
  JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.k], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1 : x.size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(string_split(phrase, ' ')[j : j + 1], ' ') AS phrase FROM c, (VALUES (1), (2)) t(j) WHERE k = 3) q GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
      WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op6_substrings": OP6_SQL, "op7_mix": OP7_SQL, "op8_vectors": OP8_SQL, "op10_rules": OP10_SQL, "op11_collocations": OP11_SQL, "op13_infill": OP13_SQL}
