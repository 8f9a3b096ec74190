"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns documents with their columns;
the last returns packed pieces. run() writes each stage's documents to the shared folder and reads them again.

In every stage: an empty table gives no rows, columns of any further names go through untouched, and repeated rows are documents
each, but in near-duplicates, where they are copies. Null and empty texts have no words: quality rules reject them; given to the
later stages, they are one group of near-duplicates, hold no personal data, come once in the mix and pack as the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.llm import mixing, packing, pii, rules, simhash
from trailgraph.llm.common import ship, stored, table
from trailgraph.llm.queries import tokenizer_json


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed and adaptive rules keep. A null lang or source is a group of its own."""
    return rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: similarity 0.8 of five-word shingles.

    Sets of shingles with Jaccard similarity 0.8 have cosine 8 / 9, at which a SimHash bit differs with chance 0.151: 77 of 512
    bits (deviation 8). Candidates differ in at most 120 bits and share one of 96 pairs of bytes, which finds 0.995 of the pairs
    at 0.8 (simulated); what they bring together is linked by exact similarity. Documents without an id stay if no other of
    their group has one, once per text.
    """
    ship(spark)
    return simhash.one_of_each(docs, simhash.alike, shingle=5, jaccard=0.8, parts=8, distance=120)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and terms that reveal it generalised or removed."""
    ship(spark)
    names, others = docs.columns, [c for c in docs.columns if c != "text"]
    plain = docs.select(F.col("text"), *[F.col(f"`{c}`").alias(f"column{k}") for k, c in enumerate(others)])  # so no name clashes
    clean = pii.sanitise(plain)
    clean = clean.select(F.col("clean_text").alias("text"), *[F.col(f"column{k}").alias(c) for k, c in enumerate(others)])
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in names])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weights, a row for each time that the mix plays one, in the mix's order. A null source is a source."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_json(), window=4096, end_id=2, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed),
]

#: SQL can't express sketches, fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
