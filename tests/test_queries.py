"""Every query that SQL can express, against DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = __spark_entry__.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = con.execute(ORACLE[name])
    names = sorted(d[0] for d in got.description)
    assert sorted(df.columns) == names
    at = [[d[0] for d in got.description].index(n) for n in names]
    expected = sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
