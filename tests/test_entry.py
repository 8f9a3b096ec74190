"""Each query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from trailgraph.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 7) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        cursor = db.execute(ORACLE_SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert cells(cursor.fetchall(), names) == cells(rows, df.columns)


def test_entry(spark):
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
