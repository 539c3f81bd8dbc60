"""Every query against its SQL, as the driver does it."""

import duckdb
import pytest

import __spark_entry__
from quillstore import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    relation = oracle.sql(catalog.ORACLE[name])
    assert sorted(relation.columns) == names
    expected = sorted(repr(r) for r in oracle.sql(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE[name]})").fetchall())
    assert got == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
