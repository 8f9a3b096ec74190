import pytest

#: Texts with all that operators must stand: null, empty, blank, ties, repeated rows, very long, odd characters.
LONG = " ".join(f"w{i % 977}x" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "en", "b"),
    (5, "alpha beta gamma delta", "en", "b"), (5, "alpha beta gamma delta", "en", "b"), (None, "a text without id", "de", None),
    (7, LONG, "de", "b"), (8, "İstanbul ΣΑΣ 한국   é́ \U0001f600", None, "c"), (9, "one", "fr", "a"),
]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    from trailgraph.llm.common import ship

    ship(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "key", "row", "size", "spans", "rank", "n_words", "kept", "rk", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    from trailgraph.llm.common import table

    return table(spark, sf_dir, "documents")
