"""The queries against their SQL, on small tables."""

import duckdb
import pytest

import __spark_entry__
from lexiweave import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    order = sorted(got.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == order

    def tidy(rows, columns):
        return sorted(([round(v, 9) if isinstance(v, float) else v for v in (r[columns.index(c)] for c in order)] for r in rows), key=repr)

    assert tidy([tuple(r) for r in got.collect()], got.columns) == tidy(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    same(spark, name)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
