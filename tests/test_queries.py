"""Every registered query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from rosterloom.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    want = db.execute(oracle.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    assert key(df.select(*(f"`{c}`" for c in columns)).collect()) == key(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
